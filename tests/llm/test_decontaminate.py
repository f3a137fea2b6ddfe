import random
import re

from pyspark.sql import functions as F

from ridgeline.llm import decontaminate

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in LETTERS.upper() else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = norm(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = {}
    for doc, text, _ in docs:
        w, hit, got = norm(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    got |= windows[tuple(w[i : i + k])] - {None}
        out[doc] = (len(w), len(hit), tuple(sorted(got)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["Alpha", "beta", "É", "é", "x1"]) + str(rng.randrange(40))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([13, 14, 30, 12, 3, 25, 25])]
    items += [(7, items[2][1]), (8, None), (9, "?!"), (None, items[0][1]), (2, items[2][1])]
    docs = []
    for i in range(80):
        w = [word() for _ in range(rng.randrange(200))]
        if i % 2:
            own = rng.choice(items[:7])[1].split()
            a = rng.randrange(0, max(1, len(own) - 13))
            w[i:i] = own[a : a + rng.choice([12, 13, 20, 40])]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 3 == 0 else " ".join(w), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, "...", "x"), (103, items[4][1], "x"), (104, (items[2][1] + " ") * 3, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: (r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in decontaminate.contamination(df, bench).collect()}
    assert out == brute(docs, items)
    kept = {r.doc_id for r in decontaminate.decontaminated(df, bench).collect()}
    assert kept == {d for d, v in out.items() if not v[3]}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c " + " ".join(map(str, range(20)))), (1, "a"), (None, "q")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(map(str, range(3, 17))))], "item_id long, text string")
    want = sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert sorted(map(str, decontaminate.contamination(docs, bench).collect())) == want and "n_hit=14" in want[0] + want[1]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.contamination(docs, bench).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in out] == [(2, 0, False)]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_rows_that_share_an_id_are_judged_each(spark):
    """Repeated and null ids, repeated rows, clashing columns, and a long text."""
    bench = spark.createDataFrame([(1, "a b c"), (2, " ".join(f"q{i}" for i in range(13)))], "item_id long, text string")
    long = "w " * 300_000 + " ".join(f"q{i}" for i in range(13))
    rows = [(5, "a b c"), (5, "z " * 200), (None, "a b c"), (None, "clean text"), (7, "a b c x"), (7, "a b c x"), (8, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("_bad", F.lit(2)).withColumn("_doc", F.lit(3))
    out = sorted(((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert out == sorted([(5, 3, 3, True), (5, 200, 0, False), (None, 3, 3, True), (None, 2, 0, False), (7, 4, 3, True), (7, 4, 3, True), (8, 300_013, 13, False)], key=str)
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, len(r.text)) for r in kept.collect()), key=str) == sorted([(5, 400), (None, 10), (8, len(long))], key=str)
