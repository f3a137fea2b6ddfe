import hashlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import line_dedup
from ridgeline.llm.line_dedup import SLOTS, CuckooFilter, LineIndex, built, dedup_lines, dedup_within, line_key
from ridgeline.llm.queries import OP4_SQL

LONG = "this boiler plate line is longer than forty code points"
ROWS = [
    *((i, f"own {i}\n {LONG.upper()}\t\n{LONG}", "x") for i in range(1, 6)),
    (6, None, "x"),
    (7, "", "x"),
    (8, "\n\n", "x"),
    (9, "é" * 39 + "\n" + LONG[:39], "x"),
    (None, LONG, "x"),
]
SCHEMA = "doc_id long, text string, n_lines string"


def result(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in df.collect()}


def test_frequent_lines_stay_in_the_largest_holder(spark):
    out = result(dedup_within(spark.createDataFrame(ROWS, SCHEMA)))
    for i in range(1, 5):
        assert out[i] == (f"own {i}", 3, 2)
    assert out[5] == (ROWS[4][1], 3, 0)
    assert out[6] == ("", 1, 0) and out[7] == ("", 1, 0) and out[8] == ("\n\n", 3, 0)
    assert out[9] == (ROWS[8][1], 2, 0) and out[None] == (LONG, 1, 0)


def test_four_holders_are_too_few_and_empty_table(spark):
    out = result(dedup_within(spark.createDataFrame(ROWS[1:], SCHEMA)))
    assert all(v[2] == 0 for v in out.values())
    assert dedup_within(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deletion_reverses_insertion(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    more = spark.createDataFrame([(20, LONG, "x"), (21, LONG + "!", "x")], SCHEMA)
    index = LineIndex(spark).insert(docs).insert(more)
    assert {r.n for r in index.counts().collect()} == {6, 1}
    assert result(dedup_lines(docs, index))[5][2] == 2
    index.delete(more)
    before = {(r.k1, r.k2, r.n, r["last"]) for r in LineIndex(spark).insert(docs).counts().collect()}
    assert {(r.k1, r.k2, r.n, r["last"]) for r in index.counts().collect()} == before
    assert result(dedup_lines(docs, index))[5][2] == 0


def test_filters_have_no_false_negatives_and_few_false_positives():
    k = np.frombuffer(b"".join(hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(40000)), "<i8").reshape(-1, 2)
    f = built(k[:20000, 0], k[:20000, 1])
    assert f.contains(k[:20000, 0], k[:20000, 1]).all()
    assert f.contains(k[20000:, 0], k[20000:, 1]).mean() < 0.002
    f.delete(k[:10000, 0], k[:10000, 1])
    assert f.contains(k[10000:20000, 0], k[10000:20000, 1]).all()
    assert f.contains(k[:10000, 0], k[:10000, 1]).mean() < 0.002
    again = CuckooFilter(table=np.frombuffer(f.table.tobytes(), np.uint16).reshape(-1, SLOTS))
    assert (again.table == f.table).all()


def bits(index):
    return {r.shard: bytes(r.bits) for r in index.filters.collect()}


def test_broadcast_and_dealt_filters_agree(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    lines = [f"line {k} is repeated in quite a few of all these documents" for k in range(30)]
    docs = spark.createDataFrame([(i, "\n".join(lines[k] for k in range(30) if (i * 7 + k) % 4 == 0), "x") for i in range(40)], SCHEMA)
    index = LineIndex(spark).insert(docs)
    assert index.shards == 10
    want = result(dedup_lines(docs, index))
    assert sum(v[2] for v in want.values()) > 100
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(line_dedup, "SALT_ROWS", 7)
    assert result(dedup_lines(docs, index)) == want
    assert line_key(("  " + LONG + " ").encode(), 40) == line_key(LONG.upper().encode(), 40)


def test_filters_follow_insertions_and_deletions(spark, monkeypatch):
    """Filters change by the keys that cross the threshold, and grow anew when full."""
    docs = spark.createDataFrame([(i, LONG, "x") for i in range(4)], SCHEMA)
    more = spark.createDataFrame([(9, LONG, "x")], SCHEMA)
    index = LineIndex(spark).insert(docs)
    assert not bits(index)
    index.insert(more)
    (one,) = bits(index).values()
    assert np.count_nonzero(np.frombuffer(one, np.uint16)) == 1
    index.delete(more)
    assert not any(np.frombuffer(x, np.uint16).any() for x in bits(index).values())
    assert result(dedup_lines(docs, index))[0][2] == 0
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    many = spark.createDataFrame([(i, "\n".join(f"{LONG} {k}" for k in range(9)), "x") for i in range(20, 26)], SCHEMA)
    index.insert(many)
    assert index.shards == 9 and sum(np.count_nonzero(np.frombuffer(x, np.uint16)) for x in bits(index).values()) == 9
    assert result(dedup_lines(many, index))[20] == ("", 9, 9)


def test_holders_are_distinct_documents(spark):
    """Four rows of one document and one of another are two holders; clashing columns pass; a long text is cut whole."""
    rows = [(1, LONG)] * 4 + [(2, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_doc", F.lit("d")).withColumn("_drop", F.lit(1)).withColumn("k1", F.lit(2))
    assert {r.n_dropped for r in dedup_within(docs).collect()} == {0}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join(f"({d}, '{t}')" for d, t in rows) + ") v(doc_id, text)")
    assert {r[2] for r in con.execute(OP4_SQL).fetchall()} == {0}
    long = "\n".join([LONG] * 200_000 + ["end"])
    out = dedup_within(docs.union(spark.createDataFrame([(d, t, "d", 1, 2) for d, t in [(3, LONG), (4, long), (5, LONG)]], docs.schema)))
    assert sorted(out.columns) == ["_doc", "_drop", "doc_id", "k1", "n_dropped", "n_lines", "text"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in out.collect()) == [(1, 1, 1)] * 4 + [(2, 1, 1), (3, 1, 1), (4, 200_001, 200_000), (5, 1, 0)]
