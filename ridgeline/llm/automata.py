"""Passages of a reference set removed from documents by broadcast suffix automata.

References are dealt to shards; each shard becomes a suffix automaton over word hashes, built in a task of its own. The
automata are broadcast and documents stream past them: after each word the automaton tells the longest suffix read that
the shard holds (the matching statistics), and every maximal span of ``SPAN`` words or more goes.

Automata take memory in proportion to the references and time in proportion to documents x shards, so this way is for
references of at most ``MOST_WORDS`` words; beyond, ``stripped_by_windows`` joins the keys of all windows instead. The
corpus against itself is ``substrings.dedup_passages``.

Defined cases: null, empty and blank texts have no words; no span reaches from one reference into the next; rows that
repeat a doc_id and null doc_ids are cut each by its own text; no references leave all texts whole (their words joined
by one space); an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.substrings import ROLL, ROLL2, SPAN
from ridgeline.llm.texts import column, pieces, raw, word_hashes

SHARD_WORDS, MOST_WORDS = 50_000, 1_000_000
OUT = "doc_id long, text string, n_words long, n_removed long"


class Automaton:
    """States have a suffix link and the length of their longest string; ``step`` maps state and letter to a state."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, letter: int) -> None:
        step, link, length = self.step, self.link, self.length
        new, at = len(step), self.last
        step.append({})
        length.append(length[at] + 1)
        link.append(0)
        while at >= 0 and letter not in step[at]:
            step[at][letter] = new
            at = link[at]
        if at >= 0:
            to = step[at][letter]
            if length[to] == length[at] + 1:
                link[new] = to
            else:  # a shorter string gets a state of its own
                copy = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(letter) == to:
                    step[at][letter] = copy
                    at = link[at]
                link[to] = link[new] = copy
        self.last = new

    def feed(self, letters: list[int]) -> None:
        """One reference: it starts from the empty string again, so no string of the automaton joins two references.

        Where the step is there already the state is taken over or split, as in a generalised automaton."""
        self.last = 0
        for letter in letters:
            to = self.step[self.last].get(letter)
            if to is None:
                self.add(letter)
            elif self.length[to] == self.length[self.last] + 1:
                self.last = to
            else:
                copy, at = len(self.step), self.last
                self.step.append(dict(self.step[to]))
                self.length.append(self.length[at] + 1)
                self.link.append(self.link[to])
                while at >= 0 and self.step[at].get(letter) == to:
                    self.step[at][letter] = copy
                    at = self.link[at]
                self.link[to] = copy
                self.last = copy

    def spans(self, letters: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal runs of letters, at least ``least`` long, that a reference holds."""
        step, link, length = self.step, self.link, self.length
        out: list[tuple[int, int]] = []
        state = size = 0
        for i, letter in enumerate(letters):
            to = step[state].get(letter)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step[state].get(letter)
            if to is None:
                size = 0
                continue
            state = to
            size += 1
            if size >= least:
                start = i - size + 1
                if out and out[-1][0] == start:
                    out[-1] = (start, i + 1)
                else:
                    out.append((start, i + 1))
        return out

    def packed(self) -> list[np.ndarray]:
        """States, letters and targets of all steps, links, lengths."""
        flat = [(s, a, t) for s, d in enumerate(self.step) for a, t in d.items()]
        return [np.array([r[0] for r in flat], np.int32), np.array([r[1] for r in flat], np.uint64), np.array([r[2] for r in flat], np.int32), np.array(self.link, np.int32), np.array(self.length, np.int32)]

    @classmethod
    def unpacked(cls, parts: list[np.ndarray]) -> Automaton:
        out = cls()
        out.link, out.length = parts[3].tolist(), parts[4].tolist()
        out.step = [{} for _ in out.link]
        for s, a, t in zip(*(p.tolist() for p in parts[:3]), strict=True):
            out.step[s][a] = t
        return out


KINDS = ("<i4", "<u8", "<i4", "<i4", "<i4")


def shards(references: DataFrame, n: int) -> DataFrame:
    """One packed automaton for each of ``n`` shards of the references."""

    def build(f: pd.DataFrame) -> pd.DataFrame:
        a = Automaton()
        for text in f.text:
            a.feed(word_hashes(text.encode().split()).tolist())
        return pd.DataFrame({"shard": [int(f.shard.iloc[0])], **{f"p{k}": [p.tobytes()] for k, p in enumerate(a.packed())}})

    rows = references.where("text IS NOT NULL").select("text", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int").alias("shard"))
    return rows.groupBy("shard").applyInPandas(build, "shard int, " + ", ".join(f"p{k} binary" for k in range(5)))


def without(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def strip_references(docs: DataFrame, references: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, text without the words of maximal spans that ``references`` (text) hold, n_words, n_removed."""
    size = references.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if size > MOST_WORDS:
        return stripped_by_windows(docs, references, span)
    packed = [[np.frombuffer(r[f"p{k}"], kind) for k, kind in enumerate(KINDS)] for r in shards(references, max(1, -(-size // SHARD_WORDS))).collect()] if size else []
    kept = docs.sparkSession.sparkContext.broadcast(packed)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Automaton.unpacked(p) for p in kept.value]
        for batch in pieces(batches):
            out, total = [], []
            for text in raw(batch, "text"):
                words = text.split()
                letters = word_hashes(words).tolist() if len(words) >= span else []
                total.append(len(words))
                out.append(without(words, [s for a in own for s in a.spans(letters, span)]))
            yield cut_batch(batch, out, total)

    return docs.select("doc_id", "text").mapInArrow(strip, OUT)


def cut_batch(batch: pa.RecordBatch, kept: list[list[bytes]], total: list[int]) -> pa.RecordBatch:
    text = pa.array([b" ".join(w) for w in kept], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([column(batch, "doc_id"), text, pa.array(total, pa.int64()), pa.array([n - len(w) for n, w in zip(total, kept, strict=True)], pa.int64())], ["doc_id", "text", "n_words", "n_removed"])


def window_keys(texts: DataFrame, span: int) -> DataFrame:
    """start, k1, k2 of every window, with the row's other columns."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            row, start, k1, k2 = [], [], [], []
            for i, text in enumerate(raw(batch, "text")):
                h = word_hashes(text.split())
                a, b = ROLL.runs(h, span), ROLL2.runs(h, span)
                row.append(np.full(len(a), i))
                start.append(np.arange(len(a)))
                k1.append(a)
                k2.append(b)
            at = np.concatenate(row)
            yield pa.RecordBatch.from_arrays([column(batch, "tag").take(pa.array(at)), pa.array(np.concatenate(start).astype(np.int32)), pa.array(np.concatenate(k1).view(np.int64)), pa.array(np.concatenate(k2).view(np.int64))], ["tag", "start", "k1", "k2"])

    return texts.select("tag", "text").mapInArrow(keys, "tag long, start int, k1 long, k2 long")


def stripped_by_windows(docs: DataFrame, references: DataFrame, span: int = SPAN) -> DataFrame:
    """The same for references of any size: equal texts are cut once, and their windows joined with the references'."""
    texts = docs.select("text").where("text IS NOT NULL").distinct().withColumn("tag", F.xxhash64("text"))
    known = window_keys(references.select("text", F.lit(0).cast("long").alias("tag")), span).select("k1", "k2").distinct()
    starts = window_keys(texts, span).join(known, ["k1", "k2"]).groupBy(F.col("tag").alias("_tag")).agg(F.sort_array(F.collect_set("start")).alias("starts"))
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    both = own.join(starts, own.tag == F.col("_tag"), "left").select("doc_id", "text", "starts")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = [t.split() for t in raw(batch, "text")]
            out = [without(w, [(s, s + span) for s in at or () if s + span <= len(w)]) for w, at in zip(words, column(batch, "starts").to_pylist(), strict=True)]
            yield cut_batch(batch, out, [len(w) for w in words])

    return both.mapInArrow(strip, OUT)
