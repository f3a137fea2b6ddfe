"""Spelling variants by pivotal grams: words that differ by one code point are near, and lead to their most frequent near word.

A word's bigrams are ordered by rarity (number of words that hold them, then the bigram). The first three, with all further
places of the third, are its gram prefix; two disjoint ones of least summed frequency, found by dynamic programming, are
its pivots. One edit leaves one of two disjoint grams whole, so of two near words one has a pivot in the other's prefix
(Deng, Li and Feng, 2014). Position limits: the edit lies on one side of that gram, so the gram stands at the same place
from the start, with equal text before it, or at the same place from the end, with equal text behind it. The index key is
that equal text, so a row is a word with a region [a, b) that holds the edit, everything around it being the key.

Rows are dealt by key. Where a key holds too many rows, the region is halved: with one edit in it, the first or the last
half is equal too and joins the key (``halves``), until the region has two code points, which bounds the group by the
alphabet. Keys of over ``HOT_ROWS`` rows are halved between tasks, smaller ones inside theirs, so no group grows with the
vocabulary. What shares a key is verified on the whole words; each near pair is kept once.

Defined cases: a null or empty text has no word; with a null doc_id no run loses a code point; repeated rows count each;
texts and runs of any length are taken whole; an empty table gives no row; ties go to the smallest word; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.texts import column, mixed, pieces, raw
from ridgeline.sources.stage import stored

#: Rows of one key up to which they stay together, rows that a task takes at once, and pairs verified at once.
HOT_ROWS, BUCKET_ROWS, PAIRS = 20_000, 150_000, 400_000
#: A key's pairs are enumerated up to this many a row; beyond, regions are halved first.
PAIRS_A_ROW = 6
#: Words up to this length are verified as rows of a matrix.
WIDTH = 48
#: What a task counts before it hands its counts on.
DISTINCT = 400_000

ROW = "key long, word string, a int, b int, pivot boolean, n long"
BASE, BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def runs_of(least: int) -> re.Pattern:
    """Maximal runs of letters; shorter ones can't become words, since deletion only shortens."""
    return re.compile("[a-zÀ-ÿ]{%d,}" % least)


def damaged(run: str, prefix: int | None, every: int) -> str:
    """The run as counted: where ``every`` divides the hash of doc_id and run, one code point is gone."""
    if prefix is None:
        return run
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least: int = 5, least_n: int = 3, every: int = 97) -> DataFrame:
    """word and n: the words of at least ``least`` code points that occur ``least_n`` times or more."""
    pattern = runs_of(least)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in pieces(batches, most=2 << 20):
            for doc, text in zip(column(batch, "doc_id").to_pylist(), raw(batch, "text"), strict=True):
                prefix = None if doc is None else zlib.crc32(b"%d:" % doc)
                for run, k in Counter(pattern.findall(text.lower().decode())).items():
                    word = damaged(run, prefix, every)
                    if len(word) >= least:
                        total[word] += k
            if len(total) > DISTINCT:
                yield batch_of()
        yield batch_of()

    every_word = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long")
    return every_word.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def latin(batch: pa.RecordBatch) -> list[bytes]:
    """Words as one byte a code point: none is above U+00FF."""
    return [w.encode("latin-1") for w in column(batch, "word").to_pylist()]


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many words hold each bigram (at most 65,536 numbers)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, w, _ in by_length(latin(batch)):
                grams = np.sort(grams_of(w), axis=1)
                first = np.ones(grams.shape, bool)
                first[:, 1:] = grams[:, 1:] != grams[:, :-1]
                total += np.bincount(grams[first], minlength=1 << 16)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], ["gram", "k"])

    out = np.zeros(1 << 16, np.int64)
    for r in words.select("word").mapInArrow(counted, "gram long, k long").groupBy("gram").agg(F.sum("k").alias("k")).collect():
        out[r.gram] = r.k
    return out


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Words of one length as rows of a matrix, with their places; long ones a few at a time."""
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for some in np.array_split(at, max(1, len(at) * int(n) // 2_000_000)):
            yield some, np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(-1, n), int(n)


def grams_of(w: np.ndarray) -> np.ndarray:
    return w[:, :-1].astype(np.int64) << 8 | w[:, 1:]


def chosen(w: np.ndarray, counts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word and place of a bigram: in the gram prefix, and pivot.

    The pivots are the disjoint pair of the prefix with the least summed count, by running minima over the places: the best
    pair that ends at i is i with the best one that starts at i - 2 or before.
    """
    grams = grams_of(w)
    order = rank[grams]
    prefix = order <= np.partition(order, 2, axis=1)[:, 2:3]
    never = np.int64(1) << 60
    cost = np.where(prefix, counts[grams], never)
    best = np.minimum.accumulate(cost, axis=1)
    pair = np.full(cost.shape, 2 * never)
    pair[:, 2:] = cost[:, 2:] + best[:, :-2]
    last = pair.argmin(axis=1)
    rows = np.arange(len(w))
    first = np.where(np.arange(cost.shape[1]) <= last[:, None] - 2, cost, 2 * never).argmin(axis=1)
    pivot = np.zeros(cost.shape, bool)
    pivot[rows, first] = pivot[rows, last] = True
    return prefix, pivot


def prefix_hashes(w: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... code points of each row."""
    out = np.zeros((len(w), w.shape[1] + 1), np.uint64)
    for i in range(w.shape[1]):
        out[:, i + 1] = (out[:, i] + w[:, i] + np.uint64(1)) * BASE
    return out


def keys_at(ahead: np.ndarray, behind: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of a word outside [a, b): its text before a and from b on."""
    n = ahead.shape[1] - 1
    return mixed(mixed(ahead[row, a]) ^ (behind[row, n - b] * BASE2 + (a.astype(np.uint64) << np.uint64(32)) + (n - b).astype(np.uint64)))


def region_keys(words: list[bytes], owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of rows (owner, a, b)."""
    out = np.zeros(len(owner), np.uint64)
    order = np.argsort(owner, kind="stable")
    start = np.searchsorted(owner[order], np.arange(len(words) + 1))
    for at, w, _ in by_length(words):
        count = start[at + 1] - start[at]
        rows = order[np.repeat(start[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        out[rows] = keys_at(prefix_hashes(w), prefix_hashes(w[:, ::-1]), np.repeat(np.arange(len(at)), count), a[rows], b[rows])
    return out


def halves(owner: np.ndarray, a: np.ndarray, b: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows with smaller regions such that any two near rows of one key still share one.

    The shorter region of a pair has m or m - 1 code points. With one edit, the first half of that many or the rest at
    the end is equal. Regions of two code points and fewer also stay as they are.
    """
    m, out = b - a, []
    for least in (m, np.maximum(m - 1, 0)):
        half = least // 2
        out += [(a + half, b), (a, b - (least - half))]
    new_a, new_b = (np.concatenate(x) for x in zip(*out, strict=True))
    rows = np.unique(np.stack([np.tile(owner, 4), new_a, new_b, np.tile(pivot, 4)]), axis=1)
    return rows[0], rows[1], rows[2], rows[3].astype(bool)


def index_rows(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """Two rows for each gram of each word's prefix: the edit lies behind it, or before it."""
    rank = np.empty(1 << 16, np.int64)
    rank[np.lexsort((np.arange(1 << 16), counts))] = np.arange(1 << 16)
    shared = words.sparkSession.sparkContext.broadcast((counts, rank))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = latin(batch), column(batch, "n").to_numpy()
            for at, w, size in by_length(own):
                prefix, pivot = chosen(w, *shared.value)
                row, place = np.nonzero(prefix)
                row, a, b = np.tile(row, 2), np.concatenate([place + 2, np.zeros_like(place)]), np.concatenate([np.full_like(place, size), place])
                key = keys_at(prefix_hashes(w), prefix_hashes(w[:, ::-1]), row, a, b)
                yield row_batch(key, [own[i] for i in at], row, a, b, np.tile(pivot[prefix], 2), n[at])

    return words.select("word", "n").mapInArrow(rows, ROW)


def row_batch(key: np.ndarray, words: list[bytes], owner: np.ndarray, a: np.ndarray, b: np.ndarray, pivot: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    text = pa.array([w.decode("latin-1") for w in words], pa.string()).take(pa.array(owner))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), text, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(pivot), pa.array(n[owner], pa.int64())], ["key", "word", "a", "b", "pivot", "n"])


def halved(rows: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = latin(batch)
            a, b, pivot, n = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("a", "b", "pivot", "n"))
            owner, a, b, pivot = halves(np.arange(len(own)), a.astype(np.int64), b.astype(np.int64), pivot)
            yield row_batch(region_keys(own, owner, a, b), own, owner, a, b, pivot, n)

    return rows.mapInArrow(cut, ROW)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` with the regions of hot keys halved until no key holds more than ``HOT_ROWS`` or its regions are of two code points."""
    rows = stored(rows, "gram-rows")
    done: list[DataFrame] = []
    while True:
        held = rows.groupBy("key").agg(F.count("*").alias("k"), F.max(F.col("b") - F.col("a")).alias("m"))
        hot = stored(held.where(f"k > {HOT_ROWS} AND m > 2").select("key"), "hot-keys")
        if hot.isEmpty():
            break
        done.append(rows.join(hot, "key", "left_anti"))
        rows = stored(halved(rows.join(hot, "key", "left_semi").select("key", "word", "a", "b", "pivot", "n")).distinct(), "halved-rows")
    for part in done:
        rows = rows.union(part.select(rows.columns))
    return rows


def one_edit(x: bytes, y: bytes) -> bool:
    """Do two different words differ by one inserted, deleted or replaced code point?"""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    p = next((i for i in range(len(x)) if x[i] != y[i]), len(x))
    return x[p + 1 :] == y[p + 1 :] if len(x) == len(y) else x[p:] == y[p + 1 :]


class Words:
    """The distinct words of a bucket, as rows of a matrix where they are short."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        self.width = min(WIDTH, int(self.size.max(initial=0))) + 1
        self.rows = np.frombuffer(b"".join([w[: self.width].ljust(self.width, b"\0") for w in words]), np.uint8).reshape(-1, self.width)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of different words are one edit apart."""
        swap = self.size[x] > self.size[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        more = self.size[y] - self.size[x]
        out = np.zeros(len(x), bool)
        short = self.size[y] < self.width
        same = np.flatnonzero(short & (more == 0))
        out[same] = (self.rows[x[same]] != self.rows[y[same]]).sum(1) == 1
        longer = np.flatnonzero(short & (more == 1))
        v, w = self.rows[x[longer]], self.rows[y[longer]]
        first = (v != w).argmax(1)
        out[longer] = ~((v[:, :-1] != w[:, 1:]) & (np.arange(self.width - 1) >= first[:, None])).any(1)
        for i in np.flatnonzero(~short & (more <= 1)):
            out[i] = one_edit(self.words[x[i]], self.words[y[i]])
        return out


def candidates(words: list[bytes], key: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray, pivot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a pivot's word with a word whose prefix has the same key, halving regions where a key would give many."""
    while len(key):
        order = np.lexsort((~pivot, key))
        key, owner, a, b, pivot = (x[order] for x in (key, owner, a, b, pivot))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rows = np.diff(np.append(first, len(key)))
        pivots, widest = np.add.reduceat(pivot.astype(np.int64), first), np.maximum.reduceat(b - a, first)
        many = (pivots * rows > PAIRS_A_ROW * rows + 64) & (widest > 2)
        few = np.flatnonzero(~many & (pivots > 0) & (rows > 1))
        # rows of pivots come first; each meets all rows of its key
        count = np.repeat(rows[few], pivots[few])
        one = np.repeat(first[few], pivots[few]) + np.arange(pivots[few].sum()) - np.repeat(np.cumsum(pivots[few]) - pivots[few], pivots[few])
        start = np.repeat(first[few], pivots[few])
        at, ends = 0, np.cumsum(count)
        while at < len(one):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = count[at:to]
            other = np.repeat(start[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield owner[np.repeat(one[at:to], n)], owner[other]
            at = to
        again = np.repeat(many, rows)
        owner, a, b, pivot = halves(owner[again], a[again], b[again], pivot[again])
        key = region_keys(words, owner, a, b)


PAIR = "x string, y string, nx long, ny long"


def bucket_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """The near pairs of a bucket's rows, the smaller word first."""
    owner, text = pd.factorize(pdf["word"])
    own = [w.encode("latin-1") for w in text]
    n = np.zeros(len(own), np.int64)
    n[owner] = pdf["n"].to_numpy()
    table, found = Words(own), []
    key, a, b, pivot = pdf["key"].to_numpy().view(np.uint64), *(pdf[c].to_numpy().astype(np.int64) for c in ("a", "b")), pdf["pivot"].to_numpy().astype(bool)
    for x, y in candidates(own, key, owner.astype(np.int64), a, b, pivot):
        differ = x != y
        x, y = x[differ], y[differ]
        close = table.near(x, y)
        x, y = x[close], y[close]
        found.append(np.unique(np.minimum(x, y) * len(own) + np.maximum(x, y)))
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    x, y = np.divmod(pairs, max(1, len(own)))
    text = np.asarray(text, object)
    # Latin-1 order, that of the strings and that of code points are the same.
    less = np.array([own[i] < own[j] for i, j in zip(x, y, strict=True)], bool)
    x, y = np.where(less, x, y), np.where(less, y, x)
    return pd.DataFrame({"x": text[x], "y": text[y], "nx": n[x], "ny": n[y]})


def near_pairs(words: DataFrame) -> DataFrame:
    """x, y, nx, ny: each two words (word, n) that differ by one code point, once."""
    rows = spread(index_rows(words, gram_counts(words)))
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(bucket_pairs, PAIR).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) to (word, root), following forms to the last by doubling steps; counts double at each, so none returns."""
    ends = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ends.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        both = stored(ends.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        ends = both.select("word", "root")
        if both.where("moved").isEmpty():
            return ends


def grouped(words: DataFrame, lead: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of ``words`` (word, n): its most frequent near word, if ``lead`` times as frequent."""
    pairs = stored(near_pairs(words), "near-words")
    both = pairs.select(F.col("x").alias("_w"), F.col("y").alias("near"), F.col("ny").alias("k")).union(pairs.select("y", "x", "nx"))
    best = both.groupBy("_w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("k"), "near")).alias("best"))
    own = words.join(best, F.col("word") == F.col("_w"), "left").withColumn("leads", -F.col("best.k") >= lead * F.col("n"))
    own = stored(own.select("word", F.when(F.col("leads"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("leads"), -F.col("best.k")).alias("form_n")), "forms")
    ends = roots(own.where("form IS NOT NULL")).select(F.col("word").alias("_w"), "root")
    return own.join(ends, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, least: int = 5, least_n: int = 3, every: int = 97, lead: int = 2) -> DataFrame:
    """The words of ``docs`` with their forms and roots."""
    return grouped(stored(vocabulary(docs, least, least_n, every), "vocabulary"), lead)
