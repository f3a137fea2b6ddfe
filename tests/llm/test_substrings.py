import random

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import substrings

SCHEMA = "doc_id long, text string, marks string"


def brute(rows, span=20):
    """Plain dictionaries over every window."""
    first, docs = {}, {}
    for doc, text in sorted((r[:2] for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = docs[doc] = (text or "").split()
        for i in range(len(w) - span + 1):
            first.setdefault(tuple(w[i : i + span]), (doc, i))
    out = {}
    for doc, w in docs.items():
        gone = set()
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] != (doc, i):
                gone.update(range(i, i + span))
        out[doc] = (" ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta Beta é".split()) + str(rng.randrange(300))
    shared = [[word() for _ in range(rng.choice([19, 20, 21, 35, 60]))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at, s = rng.randrange(len(w) + 1), rng.choice(shared)
            a = rng.randrange(0, 5)
            w[at:at] = s[a : len(s) - rng.randrange(0, 3)]
        rows.append((i * 7 % 61 + 1, rng.choice([" ", "\n", "\t  "]).join(w), "x"))
    rows += [(70 + i, rows[i][1], "x") for i in range(5)]
    return rows + [(90, "a " * 100, "x"), (91, "b " * 19, "x"), (92, None, "x"), (93, "", "x"), (94, " \n ", "x"), (95, rows[0][1].upper(), "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    monkeypatch.setattr(substrings, "SLICE_CHARS", 2000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substrings.dedup_passages(df).collect()}
    assert out == brute(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, text, ""), (None, text, ""), (1, text, ""), (1, text, ""), (2, text, "")], SCHEMA)
    out = sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup_passages(df).collect())
    assert out == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 30)]
    assert substrings.dedup_passages(df.limit(0)).count() == 0


def test_a_hot_passage_a_long_text_and_clashing_columns(spark, monkeypatch):
    """A passage that every document holds, in small runs and slices; its later starts go to their documents' blocks."""
    monkeypatch.setattr(substrings, "SLICE_CHARS", 3000)
    monkeypatch.setattr(substrings, "RUN_BYTES", 500)
    passage = [f"p{i}" for i in range(25)]
    rows = [(i, " ".join([f"a{i}", *passage, f"b{i}"]), "x") for i in range(200)]
    rows.append((300, " ".join([f"w{i % 90_000}" for i in range(100_000)] + passage), "x"))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit(1)).withColumn("slice", F.lit("s")).repartition(3)
    out = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substrings.dedup_passages(df).collect()}
    assert out == brute(rows) and out[300][2] == 10_025 and out[0][2] == 0
