"""Phrase collocations from depth-truncated suffix subtrees, built by vertical partitions as ERA does.

1. Words are counted by language. Only those that occur ``least`` times or more can stand in a phrase that does; they get
   numbers, and the pieces of all texts become runs of numbers (a rarer word ends a run), written once.
2. Vertical partitioning: the root's children are the words. A prefix under which more suffixes stand than a group's
   budget is extended by a word, its extensions counted over the runs, and so on to four words. The other prefixes below
   one parent are put together in groups of about the budget.
3. Each run sends its suffixes, cut at five words, to the group of their prefix, equal ones as one with a count. A group
   sorts its suffixes, which is the order of the leaves of its subtree, and a node's count is the sum of its leaves. No
   node lies in two groups; counts of extended prefixes are known from step 2.
4. Nodes of the least count or more are joined with the counts of their parts, scored, and ranked in two steps.

What the driver holds: at most (suffixes / budget) extended prefixes a level, and the numbered words while they are small
(``BROADCAST_BYTES``); beyond, words meet their numbers in a join. Scores are exact (decimals of 38 digits).

Defined cases: a null language is ``und``, a null or empty text has no word; rows of repeated or null doc_ids each count;
texts of any length are taken whole; ties in score go by count, then by phrase; an empty table gives no row; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.texts import ascii_lower, mixed, pieces, raw, strings
from ridgeline.sources.stage import stored

#: Words of the longest phrase.
DEPTH = 5
#: Suffixes of a group: a five-hundredth of all, within these bounds.
GROUP_SUFFIXES = (1 << 16, 1 << 20)
#: Summed bytes of the numbered words up to which they are broadcast.
BROADCAST_BYTES = 8 << 20
#: What a task counts before it hands its counts on, and words of a stored run of texts.
DISTINCT, RUN_WORDS = 300_000, 1 << 20
#: Buckets that words are numbered in, and those in which ranks are cut before the last ranking.
BUCKETS, RANK_BUCKETS = 1024, 64

#: The contract's ends of pieces. A full stop never lies within a word, so it can stand for all of them.
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, with b"." between pieces."""
    return text.lower().translate(ENDS).replace(b".", b" . ").split()


def spoken(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, word, f of the words of ``least`` occurrences or more, and for each language the empty word with the count of all."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, own in total.items():
                own.pop(b".", None)
                own[b""] = sum(own.values())
                words = pa.array(list(own), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), words, pa.array(list(own.values()), pa.int64())], ["lang", "word", "f"])
            total.clear()

        for batch in pieces(batches, most=4 << 20):
            for lang, text in zip(strings(batch, "lang"), raw(batch, "text"), strict=True):
                total.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, total.values())) > DISTINCT:
                yield from rows()
        yield from rows()

    every = docs.mapInArrow(counted, "lang string, word string, f long")
    return every.groupBy("lang", "word").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("word") == ""))


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with a code from 1 on, counted by bucket of their hash."""
    dealt = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS)))
    own = stored(dealt.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))), "placed-words")
    before, total = {}, 0
    for r in own.groupBy("bucket").count().orderBy("bucket").collect():
        before[r.bucket], total = total, total + r["count"]
    if total >= 1 << 31:
        raise ValueError("more than 2^31 frequent words; raise the least count")
    start = words.sparkSession.createDataFrame(list(before.items()), "bucket long, start long")
    return own.join(F.broadcast(start), "bucket").select("lang", "word", "f", (F.col("start") + F.col("place")).cast("int").alias("code"))


def packed(codes: np.ndarray) -> np.ndarray:
    """``codes`` with one 0 between runs of two words and more; what stands alone goes."""
    with_next = np.zeros(len(codes), bool)
    with_next[:-1] = (codes[:-1] > 0) & (codes[1:] > 0)
    keep = with_next.copy()
    keep[1:] |= with_next[:-1]
    ends = np.zeros(len(codes), bool)
    ends[1:] = keep[:-1] & ~with_next[:-1]
    return np.where(keep, codes, 0)[keep | ends]


def runs(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The texts as runs of codes, 0 between them, in packed rows of int32."""
    size = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return joined_runs(docs, words)
    table: dict[str, dict[bytes, int]] = {}
    for r in words.select("lang", "word", "code").toLocalIterator():
        table.setdefault(r.lang, {})[r.word.encode()] = r.code
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in pieces(batches, most=4 << 20):
            for lang, text in zip(strings(batch, "lang"), raw(batch, "text"), strict=True):
                own = tokens(text)
                parts.append(packed(np.append(np.fromiter(map(shared.value.get(lang, {}).get, own, repeat(0)), np.int32, len(own)), np.int32(0))))
                n += len(parts[-1])
                if n > RUN_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["codes"])
                    parts, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["codes"])

    return docs.mapInArrow(coded, "codes binary")


def joined_runs(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The same through a join, where the words are too many to broadcast."""
    ends, blanks = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
    rows = stored(docs.withColumn("row", F.expr("uuid()")), "texts-with-keys")
    split = F.split(F.regexp_replace(ascii_lower(F.col("text")), ends, " . "), blanks, -1)
    each = rows.where("text IS NOT NULL").select("row", "lang", F.posexplode(split).alias("at", "word")).where("word <> ''")
    found = stored(each, "words-with-keys").join(words.select("lang", "word", "code"), ["lang", "word"], "left")
    lists = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("code", F.lit(0)).alias("code")))).alias("own")).select(F.transform("own", lambda x: x["code"]).alias("own"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [packed(np.append(np.asarray(x, np.int32), np.int32(0))).tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x in out if x], pa.binary())], ["codes"])

    return lists.mapInArrow(pack, "codes binary")


class Prefixes:
    """The extended prefixes by number, the root being 0, each with the groups of the suffixes that leave the extended ones there."""

    def __init__(self):
        self.words: list[tuple[int, ...]] = [()]
        self.keys, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.groups = np.zeros(1, np.int64), np.ones(1, np.int64)

    def add(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Extend ``parents`` by ``codes``; the new prefixes' numbers."""
        new = np.arange(len(self.words), len(self.words) + len(parents))
        self.words += [(*self.words[p], c) for p, c in zip(parents.tolist(), codes.tolist(), strict=True)]
        keys, ids = np.concatenate([self.keys, parents << 32 | codes]), np.concatenate([self.ids, new])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        return new

    def deal(self, under: np.ndarray, budget: int) -> None:
        """Groups for the suffixes that stay under each prefix."""
        self.groups = np.maximum(1, -(-under // budget))
        self.first = np.cumsum(self.groups) - self.groups

    def child(self, ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The extended prefix that (id, code) leads to, or -1."""
        if not len(self.keys):
            return np.full(len(ids), -1)
        keys = ids << 32 | codes
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], -1)

    def leave(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last extended prefix of each suffix (a row) and its depth."""
        ids, depth = np.zeros(len(suffixes), np.int64), np.zeros(len(suffixes), np.int64)
        on = np.arange(len(suffixes))
        for d in range(DEPTH - 1):
            to = self.child(ids[on], suffixes[on, d].astype(np.int64))
            on, to = on[to >= 0], to[to >= 0]
            if not len(on):
                break
            ids[on], depth[on] = to, d + 1
        return ids, depth


def suffixes_of(codes: bytes) -> np.ndarray:
    """All suffixes of two words and more, cut at DEPTH and filled with 0."""
    c = np.concatenate([np.frombuffer(codes, np.int32), np.zeros(DEPTH, np.int32)])
    at = np.flatnonzero((c[:-1] > 0) & (c[1:] > 0))
    out = np.empty((len(at), DEPTH), np.int32)
    for d in range(DEPTH):
        out[:, d] = c[at + d]
        if d > 1:
            out[out[:, d - 1] == 0, d] = 0
    return out


def hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for d in range(rows.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, d].astype(np.uint64))
    return h


def combined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with counts, by their first two words, equal ones as one (rows whose hashes collide just stay apart)."""
    order = np.lexsort((hashes(rows[:, 2:]), rows[:, 0].astype(np.int64) << 32 | rows[:, 1]))
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(1)]))
    return rows[first], np.diff(np.append(first, len(rows)))


def planes(values: np.ndarray) -> bytes:
    """Rows of int32 by column and byte: what is alike stands together, and a shuffle's compression takes it away."""
    return np.ascontiguousarray(values, "<i4").view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplaned(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4 * width, -1).T).view("<i4")


def partitioned(coded: DataFrame, words: DataFrame, suffixes: int, budget: int) -> tuple[Prefixes, list[tuple[int, int]]]:
    """The extended prefixes, and (number, count) of those of two words and more."""
    out, known = Prefixes(), []
    heavy = words.where((F.col("f") > budget) & (F.col("word") != "")).select("code", "f").collect()
    new = out.add(np.zeros(len(heavy), np.int64), np.array([r.code for r in heavy], np.int64))
    under = [suffixes - sum(r.f for r in heavy)]
    held = dict(zip(new.tolist(), (r.f for r in heavy), strict=True))
    for _ in range(2, DEPTH):
        if not len(new):
            break
        counts = stored(extensions(coded, out, new), "prefix-counts").where(F.col("k") > budget).collect()
        for r in counts:
            held[r.prefix] -= r.k
        under += [held[p] for p in new.tolist()]
        new = out.add(np.array([r.prefix for r in counts], np.int64), np.array([r.code for r in counts], np.int64))
        held = dict(zip(new.tolist(), (r.k for r in counts), strict=True))
        known += held.items()
    under += [held[p] for p in new.tolist()]
    out.deal(np.maximum(np.array(under, np.int64), 1), budget)
    return out, known


def extensions(coded: DataFrame, prefixes: Prefixes, last: np.ndarray) -> DataFrame:
    """prefix, code, k: how often each word follows the newest prefixes."""
    shared, low = coded.sparkSession.sparkContext.broadcast(prefixes), int(last.min())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes in batch.column(0).to_pylist():
                rows = suffixes_of(codes)
                ids, depth = shared.value.leave(rows)
                new = ids >= low
                ids, code = ids[new], rows[new, depth[new]].astype(np.int64)
                keys, k = np.unique((ids << 32 | code)[code > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(k)], ["prefix", "code", "k"])

    return coded.mapInArrow(count, "prefix long, code int, k long").groupBy("prefix", "code").agg(F.sum("k").alias("k"))


def dealt(coded: DataFrame, prefixes: Prefixes) -> DataFrame:
    """The suffixes by group: rows of DEPTH codes and their counts as byte planes, with the depth of their extended prefix."""
    shared = coded.sparkSession.sparkContext.broadcast(prefixes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes in batch.column(0).to_pylist():
                p = shared.value
                rows, count = combined(suffixes_of(codes))
                ids, depth = p.leave(rows)
                code = rows[np.arange(len(rows)), depth]
                # what ends with its extended prefix is counted there
                on = code > 0
                rows, count, ids, depth, code = (x[on] for x in (rows, count, ids, depth, code))
                group = p.first[ids] + (mixed(code.astype(np.uint64)) % p.groups[ids].astype(np.uint64)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                full, first = np.unique(group[order], return_index=True)
                cuts = [order[i:j] for i, j in zip(first, [*first[1:], len(order)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([planes(rows[c]) for c in cuts], pa.binary()), pa.array([planes(count[c]) for c in cuts], pa.binary()), pa.array([int(depth[c[0]]) for c in cuts], pa.int32())], ["grp", "rows", "counts", "depth"])

    return coded.mapInArrow(deal, "grp long, rows binary, counts binary, depth int")


def subtree(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """The nodes of a group's subtree, deeper than its extended prefix, that ``least`` leaves or more stand under."""
    rows = np.concatenate([unplaned(x, DEPTH) for x in pdf["rows"]])
    count = np.concatenate([unplaned(x, 1)[:, 0] for x in pdf["counts"]]).astype(np.int64)
    top = int(pdf["depth"].iloc[0])
    order = np.lexsort(rows.T[::-1])
    rows, count = rows[order], count[order]
    differs = np.zeros(len(rows), bool)
    differs[:1] = True
    phrases, totals = [], []
    for d in range(DEPTH):
        differs[1:] |= rows[1:, d] != rows[:-1, d]
        if d < max(top, 1):
            continue
        first = np.flatnonzero(differs)
        total = np.add.reduceat(count, first)
        node = (rows[first, d] > 0) & (total >= least)
        phrases += rows[first[node], : d + 1].tolist()
        totals += total[node].tolist()
    return pd.DataFrame({"codes": pd.Series(phrases, dtype=object), "f": pd.Series(totals, dtype="int64")})


def phrases(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """lang, words and f of all phrases of 1 to DEPTH words that occur ``least`` times or more; and lang and n of all words."""
    spark, docs = docs.sparkSession, spoken(docs)
    counts = stored(word_counts(docs, least), "word-counts")
    totals = counts.where("word = ''").select("lang", F.col("f").alias("n"))
    words = stored(numbered(counts.where("word <> ''")), "numbered-words")
    coded = stored(runs(docs, words), "coded-runs")
    suffixes = words.agg(F.sum("f")).first()[0] or 0
    budget = max(GROUP_SUFFIXES[0], min(GROUP_SUFFIXES[1], suffixes // 500))
    prefixes, known = partitioned(coded, words, suffixes, budget)
    nodes = dealt(coded, prefixes).groupBy("grp").applyInPandas(lambda pdf: subtree(pdf, least), "codes array<int>, f long")
    nodes = nodes.union(spark.createDataFrame([([int(c) for c in prefixes.words[p]], int(k)) for p, k in known if k >= least], "codes array<int>, f long"))
    return spelled(stored(nodes, "nodes"), words), totals


def spelled(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """Nodes (codes, f) with their language and words, after the single words."""
    each = nodes.select("codes", "f", F.posexplode("codes").alias("at", "code")).join(words.select("code", "lang", "word"), "code")
    own = each.groupBy("codes").agg(F.first("lang").alias("lang"), F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"), F.first("f").alias("f"))
    return stored(own.select("lang", "words", "f").union(words.select("lang", F.array("word"), "f")), "phrases")


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates: no longer one around them is as frequent, the lowest-scoring cut counts."""
    long = found.where(F.size("words") > 1)
    shorter = long.where(F.size("words") > 2).select("lang", "f", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"))
    # A phrase as frequent as one that is longer by several words is as frequent as all between them.
    own = long.join(shorter.distinct(), ["lang", "words", "f"], "left_anti").withColumnRenamed("f", "a")
    cuts = own.select("lang", "words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.withColumn("head", F.expr("slice(words, 1, k)")).withColumn("tail", F.expr("slice(words, k + 1, size(words) - k)"))
    part = lambda name, f: found.select("lang", F.col("words").alias(name), F.col("f").alias(f))
    both = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    up = (wide("a") * wide("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    both = both.withColumn("_up", up.cast("decimal(38,0)")).withColumn("_down", (wide("l") * wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("_up div _down"))
    best = both.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases."""
    every = stored(scored(*phrases(docs, least)), "scored-phrases")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = every.withColumn("_b", F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS)))
    some = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*order))).where(F.col("_r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
