import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import near_dup
from ridgeline.llm.components import connected

SCHEMA = "doc_id long, text string, bands string"


def sets_of(rows):
    out = {}
    for doc, text, _ in rows:
        w = (text or "").encode().lower().split()
        out[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows, threshold=75):
    sets = sets_of(rows)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    rows, k = [], 0
    word = lambda: f"w{rng.randrange(2000)}"
    for base in range(25):
        text = [word() for _ in range(rng.choice([3, 5, 8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 6, 12])):
            own = list(text)
            for _ in range(rng.randrange(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            if base % 5 == 0:
                text = own  # chains: each is near the one before it only
            rows.append((k * 37 % 1009, rng.choice([" ", "\n"]).join(own).replace("w1", rng.choice(["w1", "W1"])), "x"))
            k += 1
    return rows + [(2000, None, "x"), (2001, "", "x"), (2002, " \n", "x"), (2003, "One two", "x"), (2004, "one TWO", "x"), (2005, "É a b c d e", "x"), (2006, "é a b c d e", "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == brute(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f", ""), (4, "a b c d e f", ""), (4, "a b c d e f", ""), (3, "a b c d e f", "")], SCHEMA)
    out = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert out == [(0, 0, True), (3, 3, True), (4, 3, False), (4, 3, False)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_close_to_the_similarity(spark):
    rng = random.Random(5)
    words = [f"v{rng.randrange(10**6)}" for _ in range(1000)]
    rows = [(1, " ".join(words), ""), (2, " ".join(words[:800] + [f"u{i}" for i in range(200)]), ""), (3, " ".join(f"t{i}" for i in range(1000)), "")]
    sigs = near_dup.signatures(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "planes")
    a, b = sigs.toDF("a", "pa"), sigs.toDF("b", "pb")
    got = {(r.a, r.b): r.e for r in a.join(b, F.col("a") < F.col("b")).withColumn("e", near_dup.estimate(F.col("pa"), F.col("pb"))).collect()}
    s = sets_of(rows)
    for (x, y), e in got.items():
        assert abs(e - len(s[x] & s[y]) / len(s[x] | s[y])) < 0.2


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(10, 60)]
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in chain + star] + [(7, 7), (None, 3)]
    out = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in [5, *range(10, 60)]}}


def without_hubs(monkeypatch):
    """Leave the pairs of mixed buckets to the bounds alone."""
    monkeypatch.setattr(near_dup, "centred", lambda inside, placed, threshold: inside.select(F.col("doc_id").alias("x"), F.col("doc_id").alias("y")).limit(0))


@pytest.mark.parametrize("hubs", [False, True])
def test_groups_around_the_threshold(spark, monkeypatch, hubs):
    """Edits from none to many of a few bases, so that buckets stay mixed and bounds have to decide."""
    if not hubs:
        without_hubs(monkeypatch)
    rng = random.Random(9)
    rows, k = [], 0
    for _ in range(3):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(45):
            own = list(base[: rng.choice([120, 120, 110, 95])])
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(40)}"
            rows.append((k * 101 % 997, " ".join(own), ""))
            k += 1
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == brute(rows)


@pytest.mark.parametrize("hubs", [False, True])
def test_groups_that_share_passages(spark, monkeypatch, hubs):
    """Texts of several common passages and own words: similar in part, linked in few pairs; a long text, repeated ids and clashing columns too."""
    if not hubs:
        without_hubs(monkeypatch)
    rng = random.Random(4)
    passages = [[f"p{j}_{rng.randrange(9000)}" for _ in range(60)] for j in range(5)]
    rows = []
    for k in range(150):
        own = [w for p in rng.sample(passages, rng.choice([2, 3, 4])) for w in p]
        own += [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([0, 10, 40, 90]))]
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(30)}"
        rows.append((k * 37 % 311, " ".join(own), "x"))
    long = [f"l{rng.randrange(10**6)}" for _ in range(200_000)]
    rows += [(400, " ".join(long), "x"), (401, " ".join(long[:190_000]), "x"), (402, " ".join(long[:140_000]), "x")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("band", F.lit(1)).withColumn("n", F.lit("n")).withColumn("_d", F.lit(0))
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(table).collect()}
    assert out == brute(rows)
