import random

from pyspark.sql import functions as F

from ridgeline.llm import url_filter

URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "https://a.NET/x", "http://example.net/en/", "http://m.example.net/en/1?q=/de/", "http://m.example.net/EN/1", "http://example.com/de/x#f", "http://xexample.com/de/", "ftp://org/fr/", "http://a.b.org/fr", "http://net?x", "a://b://net/", "http://example.net:80/en/", "http://.net/", "http://é.net/ü"]


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end], rest[end:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def rows(df):
    return sorted(((r.page_id, (r.host, r.path, r.rule, r.verdict)) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    labels = ["a", "b", "net", "org", "x-y"]
    rules = list({(".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(["/", "/en/", "/en/1", ""])): None for _ in range(25)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = URLS + [f"http://{'.'.join(rng.choices(labels, k=rng.randint(1, 5)))}{rng.choice(['', '/', '/en/', '/en/12', '/fr?x'])}" for _ in range(400)]
    df = spark.createDataFrame([(i if i % 50 else None, u, "x") for i, u in enumerate(urls)] * 2, "page_id long, url string, verdict string")
    for own in (rules, url_filter.RULES):
        want = sorted([(i if i % 50 else None, brute(u, own)) for i, u in enumerate(urls)] * 2, key=str)
        assert rows(url_filter.judged(df, own)) == want
        table = spark.createDataFrame(own, "rule_host string, rule_path string, rule_verdict string")
        assert rows(url_filter.judged(df, table)) == want


def test_ties_long_urls_and_clashing_columns(spark):
    rules = [("net", "/", "block"), ("net", "/", "allow"), ("a.net", "/", "block"), ("a.net", "/", "block"), ("org", "", "block"), ("org", "/", "allow"), (None, "/", "block"), ("com", None, "block"), ("com", "/", None)]
    urls = ["http://net/", "http://b.a.net/x", "http://org", "http://x.org/1", "http://" + "l." * 100_000 + "net/" + "p" * 100_000, "http://com/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("key", F.lit(1)).withColumn("range", F.lit(2))
    swept = rows(url_filter.judged(df, rules))
    assert [(r[1][2], r[1][3]) for r in swept] == [("net/", "allow"), ("a.net/", "block"), ("org", "block"), ("org/", "allow"), ("net/", "allow"), (None, "allow")]


def test_more_rules_than_a_broadcast_would_hold(spark):
    """150,000 rules, among them some that are open over many ranges, as a table of Spark's own."""
    n = 150_000
    many = spark.range(n).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("rule_host"), F.lit("/").alias("rule_path"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("rule_verdict"))
    wide = spark.createDataFrame([("net", "/x", "block"), ("org", "/", "block")], many.schema)
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://m.h"), F.col("id") * 10 - 7, F.lit(".net/x")).alias("url"))
    hot = spark.range(20_000).select((F.col("id") + 20_000).alias("page_id"), F.lit("http://a.org/").alias("url"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(pages.union(hot), many.union(wide)).collect()}
    want = {i: (f"h{k}.net/", "block" if k % 2 == 0 else "allow") if 0 <= (k := 10 * i - 7) < n else ("net/x", "block") for i in range(20_000)}
    assert got == want | {i: ("org/", "block") for i in range(20_000, 40_000)}


def test_no_rule(spark):
    df = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert rows(url_filter.judged(df, [])) == [(1, ("net", "/", None, "allow"))]


def test_empty_table(spark):
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
