"""Substring dedup: words covered by a passage of ``SPAN`` words that starts earlier in the corpus are removed.

``automata.strip_references`` is the way for a reference set of bounded size: broadcast suffix automata that documents
stream past. The corpus against itself has references as large as itself; streaming all documents past automata of all
shards costs documents x shards, so ``dedup_passages`` finds repeated windows by exact joins on window keys:

1. Every window of 20 words has a minimizer, the 8-gram of least hash in it (its leftmost one). Two equal windows have
   the same minimizer. Each task lists its distinct minimizers; reducers tell which ones occur more than once.
2. Windows over repeated minimizers, about a fifth of all, get a 128-bit key. Each task keeps the first start of each
   key and marks its other starts as covered at once, so no key reaches a reducer more than once from a task, however
   frequent it is. Reducers find the first start overall and mark all others.
3. Documents with marks are cut.

Rows between tasks are packed: one row for each run of input and slice of the key space that it has keys of, or slice and
block of documents. Slices and blocks hold about 8 M characters each, whatever the corpus. What a task itself finds to be
repeated goes straight to the blocks of its documents, so a passage that a tenth of the corpus holds makes no hot slice.

Defined cases: null, empty and blank texts have no words; documents of fewer than 20 words lose nothing; earlier means a
smaller doc_id, or an earlier start in the same document; rows that repeat a doc_id are one after another in no fixed
order, so equal ones keep one copy between them; a null doc_id is never compared and loses nothing; texts of any length are
taken whole; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.texts import column, mixed, pieces, raw, word_hashes

SPAN, GRAM = 20, 8
WINDOW = SPAN - GRAM + 1
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xD6E8FEB86659FD93
#: Text that a task takes at once, and characters of the corpus for each slice of the key space.
RUN_BYTES, SLICE_CHARS = 8 << 20, 8 << 20


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of all runs of k words, by prefix sums modulo 2^64 with an odd base and its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def runs(self, words: np.ndarray, k: int) -> np.ndarray:
        n = len(words)
        if n < k:
            return np.zeros(0, np.uint64)
        if len(self.up) < n:
            self.up, self.down = powers(self.base, 2 * n), powers(self.inverse, 2 * n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[:n], dtype=np.uint64)])
        return mixed((total[k:] - total[: n - k + 1]) * self.down[: n - k + 1])


ROLL, ROLL2 = Rolling(BASE), Rolling(BASE2)


def minimizers(grams: np.ndarray) -> np.ndarray:
    """For each window of WINDOW grams the place of its least one, the leftmost of equals."""
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for i in range(1, WINDOW):
        less = grams[i : i + n] < best
        best[less] = grams[i : i + n][less]
        at[less] = np.flatnonzero(less) + i
    return at


def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, word counts, and hashes of all words one after another."""
    counts, hashes = [], []
    for part in pieces([batch], most=1 << 20):
        words = [t.split() for t in raw(part, "text")]
        counts += [len(w) for w in words]
        hashes.append(word_hashes([x for w in words for x in w]))
    return column(batch, "doc_id").to_numpy(zero_copy_only=False), np.array(counts, np.int64), np.concatenate(hashes)


def whole(starts: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Places of all runs of k words that lie within one document."""
    n = np.maximum(counts - k + 1, 0)
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def slices(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.int64) % n


def packed_rows(at: np.ndarray, *values: np.ndarray) -> dict[int, list[bytes]]:
    """The values of each place (a slice or block) as bytes."""
    order = np.argsort(at, kind="stable")
    full, first = np.unique(at[order], return_index=True)
    cuts = [*first.tolist(), len(at)]
    values = [v[order] for v in values]
    return {int(s): [v[a:b].tobytes() for v in values] for s, a, b in zip(full, cuts[:-1], cuts[1:], strict=True)}


def slice_batch(n: int, keys: list[np.ndarray], marks: list[np.ndarray]) -> pa.RecordBatch:
    """Rows for the slices of ``keys`` (the first of them picks the slice), and from n on for the blocks of ``marks`` (ids, places)."""
    own, more = packed_rows(slices(keys[0], n), *keys), packed_rows(n + marks[0] % n, *marks)
    rows = [(s, *v, b"", b"") for s, v in own.items()] + [(s, *[b""] * len(keys), *v) for s, v in more.items()]
    columns = zip(*rows, strict=True) if rows else [()] * (len(keys) + 3)
    names = ["slice", *(f"v{k}" for k in range(len(keys) + 2))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(columns)], names)


def owners(starts: np.ndarray, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The document that each place lies in."""
    return np.repeat(np.arange(len(counts)), counts)[places]


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, the place of the first one with the same keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def anchors(docs: DataFrame, n: int) -> DataFrame:
    """Minimizers with document and place, each once for a run of input rows; those that a run has twice go along as marks."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=RUN_BYTES):
            ids, counts, h = read(batch)
            starts = np.cumsum(counts) - counts
            grams = ROLL.runs(h, GRAM)
            at = minimizers(grams)[whole(starts, counts, SPAN)]
            if not len(at):
                continue
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            key, owner = grams[at], owners(starts, counts, at)
            order = np.argsort(key, kind="stable")
            key, doc, place = key[order], ids[owner[order]], (at - starts[owner])[order].astype(np.int32)
            first = firsts(key) == np.arange(len(key))
            twice = ~first
            twice[:-1] |= ~first[1:]
            yield slice_batch(n, [key[first], doc[first], place[first]], [doc[twice], place[twice]])

    return docs.mapInArrow(collect, "slice int, " + ", ".join(f"v{k} binary" for k in range(5)))


def joined(pdf: pd.DataFrame, *kinds: str) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(pdf[f"v{k}"]), kind) for k, kind in enumerate(kinds)]


def by_block(ids: np.ndarray, places: np.ndarray, n: int) -> pd.DataFrame:
    """A row for each block of documents with ids and places, packed."""
    return pd.DataFrame([(s, *v) for s, v in packed_rows(ids % n, ids, places).items()], columns=["block", "ids", "places"])


def block_of(n: int) -> Column:
    """The block of a document: ``n`` is prime, so regular gaps between ids don't matter."""
    return F.coalesce(F.pmod("doc_id", F.lit(n)), F.pmod(F.xxhash64("text"), F.lit(n))).cast("int")


def prime(least: int) -> int:
    while any(least % k == 0 for k in range(2, int(least**0.5) + 1)):
        least += 1
    return least


class Marks:
    """Places by document, from the rows of a block."""

    def __init__(self, table: pa.Table):
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), "<i8")
        places = np.frombuffer(b"".join(table["places"].to_pylist()), "<i4")
        order = np.argsort(ids, kind="stable")
        self.ids, self.places = ids[order], places[order]

    def of(self, doc: int | None) -> np.ndarray:
        if doc is None:
            return self.places[:0]
        return self.places[np.searchsorted(self.ids, doc, "left") : np.searchsorted(self.ids, doc, "right")]


def repeated_anchors(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    key, doc, place, more_doc, more_place = joined(pdf, "<u8", "<i8", "<i4", "<i8", "<i4")
    order = np.argsort(key, kind="stable")
    later = firsts(key[order]) != np.arange(len(key))
    later[:-1] |= later[1:]
    return by_block(np.concatenate([doc[order[later]], more_doc]), np.concatenate([place[order[later]], more_place]), n)


WINDOWS = ["slice", *(f"v{k}" for k in range(6))]


def windows(docs: pa.Table, marks: pa.Table, n: int) -> pa.Table:
    """Of a block: keys of windows over marked minimizers with their first start, each once for a run of rows; its other starts go along."""
    found, out = Marks(marks), []
    for batch in pieces(docs.drop_columns("block").combine_chunks().to_batches(), most=RUN_BYTES) if len(found.ids) else ():
        batch = batch.filter(pc.is_valid(column(batch, "doc_id")))
        if not batch.num_rows:
            continue
        ids, counts, h = read(batch)
        starts = np.cumsum(counts) - counts
        at = whole(starts, counts, SPAN)
        if not len(at):
            continue
        hit = np.zeros(len(h) + 1, bool)
        for doc, s, k in zip(ids.tolist(), starts, counts, strict=True):
            own = found.of(doc)
            hit[own[own < k] + s] = True
        at = at[hit[minimizers(ROLL.runs(h, GRAM))[at]]]
        key, key2, owner = ROLL.runs(h, SPAN)[at], ROLL2.runs(h, SPAN)[at], owners(starts, counts, at)
        doc, start = ids[owner], (at - starts[owner]).astype(np.int32)
        order = np.lexsort((start, doc, key2, key))
        key, key2, doc, start = key[order], key2[order], doc[order], start[order]
        to = firsts(key, key2)
        first = to == np.arange(len(to))
        later = (doc != doc[to]) | (start != start[to])
        out.append(slice_batch(n, [key[first], key2[first], doc[first], start[first]], [doc[later], start[later]]))
    return pa.Table.from_batches(out, pa.schema([("slice", pa.int32()), *((c, pa.binary()) for c in WINDOWS[1:])]))


def later_starts(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    key, key2, doc, start, more_doc, more_start = joined(pdf, "<u8", "<u8", "<i8", "<i4", "<i8", "<i4")
    order = np.lexsort((start, doc, key2, key))
    key, key2, doc, start = key[order], key2[order], doc[order], start[order]
    to = firsts(key, key2)
    later = (doc != doc[to]) | (start != start[to])
    return by_block(np.concatenate([doc[later], more_doc]), np.concatenate([start[later], more_start]), n)


def cut_words(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """Documents of a block without the words under marks (starts of windows), joined by one space."""
    found, ids, out, total, gone = Marks(marks), [], [], [], []
    for batch in pieces(docs.to_batches()):
        for doc, text in zip(column(batch, "doc_id").to_pylist(), raw(batch, "text"), strict=True):
            words = text.split()
            total.append(len(words))
            at = found.of(doc) if len(words) >= SPAN else ()
            if len(at):
                edge = np.zeros(len(words) + 1, np.int32)
                at = np.unique(at[at <= len(words) - SPAN])
                edge[at] += 1
                edge[at + SPAN] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            ids.append(doc)
            gone.append(total[-1] - len(words))
            out.append(b" ".join(words))
    text = pa.chunked_array([pa.array(out, pa.binary())]).cast(pa.string())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": text, "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())})


def dedup_passages(docs: DataFrame) -> DataFrame:
    """doc_id, text (the words kept), n_words, n_removed for each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = prime(max(1, -(-size // SLICE_CHARS)))
    blocks, places = docs.withColumn("block", block_of(n)), "block int, ids binary, places binary"
    marks = anchors(docs.where("doc_id IS NOT NULL"), n).groupBy("slice").applyInPandas(lambda pdf: repeated_anchors(pdf, n), places)
    keyed = blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda d, m: windows(d, m, n), "slice int, " + ", ".join(f"{c} binary" for c in WINDOWS[1:]))
    covered = keyed.groupBy("slice").applyInPandas(lambda pdf: later_starts(pdf, n), places)
    return blocks.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(cut_words, "doc_id long, text string, n_words long, n_removed long")
