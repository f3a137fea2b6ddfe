"""Best-fit packing of tokenised documents by minimum bin slack.

Only the number of pieces of each length matters for packing, and a length is at most the capacity: the histogram has
2,048 rows whatever the corpus. ``plan`` fills one bin at a time: it must hold the longest piece left, and a bitset of
reachable sums over the lengths left finds the fullest combination with it. The combination is then used as often as the
counts allow, so the number of distinct fillings is bound by the number of lengths, not by that of pieces. Pieces get a
rank among those of their length from counts by salt, and the rank picks bin and offset.

Defined cases: a null or empty text has the end id alone; a longer document is cut so that its first piece takes the
rest and all others are full; repeated rows and doc_ids are packed each for itself; ties go by doc_id, piece and ids;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.texts import cache, column, pieces, strings
from ridgeline.sources.stage import stored

CAPACITY, END = 2048, 0

#: The tokenizer's own pre-tokenisation: what one match holds is encoded apart from the rest.
CHUNK = regex.compile(public_tokenizers.PATTERN)


class Encoder:
    """Ids as little-endian 32-bit bytes. Chunks are encoded by ``tokenizers``; what was seen before is looked up.

    A part is what follows a space, with it. Where no two spaces meet, the pattern never joins two parts, so a text is
    encoded part by part and each distinct part of a batch once. The two tables stop growing at ``most`` entries; what
    isn't in them is encoded again.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(regex.escape(x) for x in added)) if added else None
        self.most, self.chunks, self.parts = most, {}, {}

    def _run(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new chunks. Those of a space and letters are encoded many at a time: the tokenizer tells them apart."""
        plain = [c for c in chunks if c[0] == " " and c[1:].isalpha()]
        other = [c for c in chunks if not (c[0] == " " and c[1:].isalpha())]
        out = {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True)}
        rows = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for row, e in zip(rows, self.tokenizer.encode_batch(["".join(r) for r in rows], add_special_tokens=False), strict=True):
            ids, place = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
            cuts = (4 * np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))).tolist()
            out.update(zip(row, (ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
        return out

    def _apart(self, texts: list[str]) -> list[bytes]:
        """Texts by their chunks."""
        cut = [[t] if t[1:].isalpha() and t[0] == " " else CHUNK.findall(t) for t in texts]
        known = self.chunks
        new = {c for p in cut for c in p if c not in known}
        got = self._run(list(new)) if new else {}
        if len(known) < self.most:
            known.update(got)
            got = {}
        return [known[p[0]] if len(p) == 1 and p[0] in known else b"".join([known[c] if c in known else got[c] for c in p]) for p in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts that spell an added token are encoded whole by the tokenizer, which gives it its own id."""
        whole = [i for i, t in enumerate(texts) if self.added and self.added.search(t)]
        if not whole:
            return self._spelled(texts)
        skip = set(whole)
        out = self._spelled(["" if i in skip else t for i, t in enumerate(texts)])
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _spelled(self, texts: list[str]) -> list[bytes]:
        heads, tails = [], []
        for t in texts:
            at = -1 if "  " in t else t.find(" ")
            heads.append(t if at < 0 else t[:at])
            tails.append(None if at < 0 else t[at + 1 :])
        split = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        coded = pc.dictionary_encode(split.flatten())
        words = [" " + x for x in coded.dictionary.to_pylist()]
        own = [self.parts.get(x) for x in words]
        new = [i for i, x in enumerate(own) if x is None]
        for i, x in zip(new, self._apart([words[i] for i in new]), strict=True):
            own[i] = x
        if len(self.parts) < self.most:
            self.parts.update((words[i], own[i]) for i in new)
        flat, size = np.frombuffer(b"".join(own), "<u4"), np.array([len(x) // 4 for x in own], np.int64)
        index = coded.indices.to_numpy(zero_copy_only=False)
        long = size[index] if len(own) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(long)])
        first = (np.cumsum(size) - size)[index] if len(own) else long
        ids = flat[np.repeat(first - ends[:-1], long) + np.arange(ends[-1])].tobytes()
        # A null list takes no place in the flattened parts.
        cuts = 4 * ends[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))])]
        return [h + ids[a:b] for h, a, b in zip(self._apart(heads), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    return cache(f"encoder {path}", lambda: Encoder(path))


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(public_tokenizers.path(vocabulary))
        end = np.array([END], "<u4").tobytes()
        for batch in pieces(batches, most=8 << 20):
            rows = []
            for doc, ids in zip(column(batch, "doc_id").to_pylist(), code.encode(strings(batch, "text")), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                ends = range(first, n + 1, capacity)
                for k, to in enumerate(ends):
                    start = to - capacity if k else 0
                    rows.append((doc, k, start, to - start, zlib.crc32(ids[4 * start : 4 * to])))
            doc, k, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: np.ndarray, first: int, room: int) -> list[int]:
    """Lengths left that fill ``room`` best next to ``first``: subset sums as the bits of an integer."""
    steps: list[tuple[int, int]] = []  # a length and the sums reachable before it was allowed once more
    sums, goal = 1, 1 << room
    keep = (goal << 1) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left = int(counts[length]) - (length == first)
        for _ in range(min(left, room // length)):
            more = (sums | (sums << length)) & keep
            if more == sums:
                break
            steps.append((length, sums))
            sums = more
            if sums & goal:
                break
        if sums & goal:
            break
    total, used = sums.bit_length() - 1, []
    for length, before in reversed(steps):
        if not (before >> total) & 1:
            used.append(length)
            total -= length
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Fillings of bins, each a list of lengths with the number of bins that it makes."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    while len(left := np.flatnonzero(counts)):
        first = int(left[-1])
        filling = [first, *fullest(counts, first, capacity - first)]
        each = Counter(filling)
        times = min(int(counts[x]) // n for x, n in each.items())
        for x, n in each.items():
            counts[x] -= n * times
        out.append((sorted(filling, reverse=True), times))
    return out


def places(fillings: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of each run of ranks, its first bin, pieces of this length in a bin, offset of the first."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: Counter = Counter()
    base = 0
    for filling, times in fillings:
        offset = 0
        for length, n in Counter(filling).items():
            runs.setdefault(length, []).append((rank[length], base, n, offset))
            rank[length] += n * times
            offset += n * length
        base += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def ranked(cut: DataFrame, salts: int) -> DataFrame:
    """A rank from 0 among the pieces of the same length. Only counts by salt are summed over a whole length."""
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("_rank", F.row_number().over(order) - 1).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_salt", "_base")


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    cut = stored(token_pieces(docs, vocabulary, capacity), "token-pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    salts = max(1, min(100_000, total // 20_000))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = where.value
        for batch in batches:
            length, rank = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            bins, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                i = np.flatnonzero(length == x)
                firsts, base, n, at = runs[x]
                k = np.searchsorted(firsts, rank[i], "right") - 1
                inside = rank[i] - firsts[k]
                bins[i] = base[k] + inside // n[k]
                offset[i] = at[k] + inside % n[k] * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(bins), pa.array(offset)], [*names, "sequence_id", "offset"])

    out = ranked(cut, salts).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_rank").cast("long"))
    return out.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
