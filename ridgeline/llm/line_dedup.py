"""Line dedup over an index that takes insertions and document deletions.

A line's key is the line without white space at both ends and with A-Z lower-cased; a 128-bit digest stands for it. The
index holds three tables: postings (key, doc_id) with a sign, +1 for an inserted document and -1 for a deleted one; exact
reference counts by key; and cuckoo filters, one for each shard of the key space, of the keys that ``min_docs`` rows or
more hold. Each insertion or deletion adds its own counts to the table, and the keys whose count it takes across
``min_docs`` are inserted into their shard's filter or deleted from it, so a deletion undoes an insertion whole. Filters are
made anew, for more shards, only when they run full.

Only postings that pass their shard's filter are counted by distinct documents, which decides exactly. The filters are
broadcast while their measured bytes are under a bound; beyond, postings are dealt by shard and salt to their filter.

Defined cases: a null or empty text is one empty line; a null doc_id neither counts as a holder nor loses a line; a
doc_id that stands in several rows is one holder, and all its rows keep a line where it is the largest holder; a line that
occurs again in a document counts once for it and goes or stays in all its places; texts of any length are taken whole; an
empty table gives no row; other columns pass through, whatever their names, and columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.texts import SPACE, column, fresh, mixed, pieces, plus, raw
from ridgeline.sources.stage import new_path, stored

#: Slots of a bucket, and evictions after which a filter is built larger.
SLOTS, KICKS = 4, 500
#: A shard's keys, the summed bytes of filters up to which they are broadcast, and postings that meet a dealt filter at once.
SHARD_KEYS, BROADCAST_BYTES, SALT_ROWS = 50_000, 64 << 20, 1_000_000

POSTING = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("doc_id", T.LongType())])


def line_key(line: bytes, least: int) -> bytes | None:
    """The digest of a line's key; None if the key has fewer than ``least`` code points."""
    key = line.strip(SPACE)
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return blake2b(key.lower(), digest_size=16).digest()


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets, each found from the other by the fingerprint."""

    def __init__(self, keys: int = 0, table: np.ndarray | None = None):
        if table is None:
            n = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85)))))
            table = np.zeros((n, SLOTS), np.uint16)
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k1, k2 = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64)
        mark = (k2 >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = mixed(k1) & self.mask
        return mark, one, one ^ (mixed(mark.astype(np.uint64)) & self.mask)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if the table is too full; it must then be built anew with more buckets."""
        table, mask = self.table, int(self.mask)
        step = mixed(np.arange(1 << 16, dtype=np.uint64))
        for mark, one, two in zip(*(x.tolist() for x in self.places(k1, k2)), strict=True):
            at = one
            for kick in range(KICKS):
                row = table[at]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = mark
                    break
                if kick == 0 and (free := np.flatnonzero(table[two] == 0)).size:
                    table[two][free[0]] = mark
                    break
                slot = (mark + kick) % SLOTS
                mark, row[slot] = int(row[slot]), mark
                at = at ^ (int(step[mark]) & mask)
            else:
                return False
        return True

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(k1, k2)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Remove one copy of each key; only keys that were inserted may be deleted."""
        for mark, one, two in zip(*self.places(k1, k2), strict=True):
            for at in (int(one), int(two)):
                if len(found := np.flatnonzero(self.table[at] == mark)):
                    self.table[at][found[0]] = 0
                    break


def built(k1: np.ndarray, k2: np.ndarray, room: int = 1) -> CuckooFilter:
    """A filter of these keys, with room for ``room`` times as many."""
    size = max(1, room * len(k1))
    while not (f := CuckooFilter(size)).insert(k1, k2):
        size *= 2
    return f


def postings(docs: DataFrame, least: int) -> DataFrame:
    """One row for each document and distinct long line of it."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=4 << 20):
            found, owner = [], []
            for doc, text in zip(column(batch, "doc_id").to_pylist(), raw(batch, "text"), strict=True):
                if doc is not None and len(text) >= least:
                    own = {line_key(x, least) for x in text.split(b"\n") if len(x) >= least}
                    own.discard(None)
                    found += own
                    owner += [doc] * len(own)
            k = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(owner, pa.int64())], ["k1", "k2", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(keys, POSTING)


def shard_of(shards: int):
    return F.pmod("k1", F.lit(shards)).cast("int").alias("shard")


class LineIndex:
    """Tables under ``path``: a folder of postings for each insertion or deletion, and the last counts and filters."""

    def __init__(self, spark: SparkSession, path: str | None = None, least: int = 40, min_docs: int = 5):
        self.spark, self.least, self.min_docs = spark, least, min_docs
        self.path = path or new_path(spark, "line-index")
        self.parts: list[tuple[str, int]] = []
        self.references: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards, self.bytes = 0, 0

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        to = f"{self.path}/{name}{len(self.parts):06d}"
        df.write.parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def _add(self, docs: DataFrame, sign: int) -> LineIndex:
        to = f"{self.path}/part{len(self.parts):06d}"
        postings(docs, self.least).write.parquet(to)
        self.parts.append((to, sign))
        change = self.spark.read.schema(POSTING).parquet(to).groupBy("k1", "k2").agg(F.count("*").alias("change")).select("k1", "k2", F.lit(0).cast("long").alias("before"), (sign * F.col("change")).alias("change"))
        if self.references is not None:
            change = self.references.select("k1", "k2", F.col("n").alias("before"), F.lit(0).cast("long").alias("change")).union(change)
            change = change.groupBy("k1", "k2").agg(F.sum("before").alias("before"), F.sum("change").alias("change"))
        now = change.select("k1", "k2", "before", (F.col("before") + F.col("change")).alias("n"))
        self.references = self._table(now.where("n > 0 OR before > 0"), "counts")
        self._refilter()
        return self

    def _refilter(self) -> None:
        """Take the keys that crossed ``min_docs`` into the filters or out of them."""
        least = self.min_docs
        crossed = self.references.where((F.col("n") >= least) != (F.col("before") >= least)).select("k1", "k2", (F.col("n") >= least).alias("up"))
        keys = self.references.where(F.col("n") >= least).count()
        full = keys > 2 * SHARD_KEYS * self.shards
        if self.filters is not None and not full:
            new = self._table(updated(self.filters, crossed, self.shards), "filters")
            full = not new.where("bits IS NULL").isEmpty()
        if self.filters is None or full:
            self.shards = max(1, -(-keys // SHARD_KEYS))
            every = self.references.where(F.col("n") >= least).select("k1", "k2", F.lit(True).alias("up"))
            new = self._table(updated(None, every, self.shards), "new-filters")
        self.filters = new
        self.bytes = new.agg(F.sum(F.octet_length("bits"))).first()[0] or 0

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._add(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take inserted documents out again; the rows given must equal those inserted."""
        return self._add(docs, -1)

    def postings(self) -> DataFrame:
        """The postings that remain, one for each row that holds the key."""
        tables = [self.spark.read.schema(POSTING).parquet(p).withColumn("sign", F.lit(s)) for p, s in self.parts]
        if not tables:
            return self.spark.createDataFrame([], POSTING)
        every = tables[0]
        for t in tables[1:]:
            every = every.union(t)
        if all(s > 0 for _, s in self.parts):
            return every.drop("sign")
        left = every.groupBy("k1", "k2", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0")
        return left.select("k1", "k2", "doc_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")

    def counts(self) -> DataFrame:
        """key, number of distinct holders, largest holder."""
        return holders(self.postings())


def holders(posts: DataFrame) -> DataFrame:
    return posts.distinct().groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


def updated(filters: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """shard and bits of each filter after ``changes`` (k1, k2, up): keys inserted or deleted; null bits if it ran full."""

    def change(f: CuckooFilter | None, pdf: pd.DataFrame) -> CuckooFilter | None:
        up, down = pdf[pdf.up], pdf[~pdf.up]
        if f is None:
            return built(up.k1.to_numpy(), up.k2.to_numpy(), 3)
        f.delete(down.k1.to_numpy(), down.k2.to_numpy())
        return f if f.insert(up.k1.to_numpy(), up.k2.to_numpy()) else None

    def row(shard: int, f: CuckooFilter | None) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "bits": [f and f.table.tobytes()]})

    dealt = changes.select("k1", "k2", "up", shard_of(shards)).groupBy("shard")
    if filters is None:
        return dealt.applyInPandas(lambda pdf: row(int(pdf.shard.iloc[0]), change(None, pdf)), "shard int, bits binary")

    def both(old: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter(table=np.frombuffer(old.bits.iloc[0], np.uint16).reshape(-1, SLOTS).copy()) if len(old) else None
        return row(int((old if len(old) else pdf).shard.iloc[0]), change(f, pdf) if len(pdf) else f)

    return filters.groupBy("shard").cogroup(dealt).applyInPandas(both, "shard int, bits binary")


def likely(posts: DataFrame, index: LineIndex) -> DataFrame:
    """The postings that pass their shard's filter: all whose key is frequent, and few others."""
    shards, table = index.shards, index.filters
    if table is None or not index.bytes:
        return posts.where(F.lit(False))
    if index.bytes <= BROADCAST_BYTES:
        kept = posts.sparkSession.sparkContext.broadcast({r.shard: bytes(r.bits) for r in table.collect()})

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {s: CuckooFilter(table=np.frombuffer(b, np.uint16).reshape(-1, SLOTS)) for s, b in kept.value.items()}
            for batch in batches:
                k1, k2 = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
                at, ok = k1 % shards, np.zeros(len(k1), bool)
                for s, f in own.items():
                    if len(i := np.flatnonzero(at == s)):
                        ok[i] = f.contains(k1[i], k2[i])
                yield batch.filter(pa.array(ok))

        return posts.mapInArrow(test, POSTING)

    most = index.references.groupBy(shard_of(shards)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    salts = max(1, -(-most // SALT_ROWS))
    dealt = posts.select("k1", "k2", "doc_id", shard_of(shards), F.pmod(F.xxhash64("doc_id", "k2"), F.lit(salts)).alias("salt"))
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def passed(own: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        own = own[["k1", "k2", "doc_id"]]
        if not len(own) or not len(f):
            return own.iloc[:0]
        return own[CuckooFilter(table=np.frombuffer(f.bits.iloc[0], np.uint16).reshape(-1, SLOTS)).contains(own.k1.to_numpy(), own.k2.to_numpy())]

    return dealt.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(passed, POSTING)


def dedup_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """``docs`` with text cut by the lines that ``index.min_docs`` or more indexed documents hold, save in the largest holder."""
    least = index.least
    hits = stored(likely(index.postings(), index), "line-hits")
    # Written, so that a line of very many holders is a skewed join of two plain shuffles, which adaptive execution splits.
    frequent = stored(holders(hits).where(F.col("n") >= index.min_docs), "frequent-lines")
    docs = docs.drop("n_lines", "n_dropped")
    doc, drop = fresh(docs, "_doc"), fresh(docs, "_drop")
    drops = hits.join(frequent, ["k1", "k2"]).where(F.col("doc_id") < F.col("last")).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.struct("k1", "k2")).alias(drop))
    both = docs.join(drops, docs["doc_id"] == drops[doc], "left").drop(doc)
    schema = plus(docs.schema, ("text", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=4 << 20):
            out, lines, gone = [], [], []
            for text, never in zip(raw(batch, "text"), column(batch, drop).to_pylist(), strict=True):
                rows = text.split(b"\n") if never else None
                lines.append(text.count(b"\n") + 1)
                if never:
                    keys = {np.array([d["k1"], d["k2"]], "<i8").tobytes() for d in never}
                    rows = [x for x in rows if len(x) < least or line_key(x, least) not in keys]
                    text = b"\n".join(rows)
                gone.append(lines[-1] - len(rows) if never else 0)
                out.append(text)
            new = {"text": pa.array(out, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else column(batch, f.name) for f in schema.fields], [f.name for f in schema.fields])

    return both.mapInArrow(cut, schema)


def dedup_within(docs: DataFrame, least: int = 40, min_docs: int = 5) -> DataFrame:
    """Index all of ``docs`` and cut them by that index."""
    return dedup_lines(docs, LineIndex(docs.sparkSession, least=least, min_docs=min_docs).insert(docs))
