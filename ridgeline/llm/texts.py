"""Small helpers shared by the text operators: Arrow batches as Python values, word hashes, id tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the contract's ``[\x20\x09-\x0D]`` holds; also what ``bytes.split()`` splits at.
SPACE = b" \t\n\x0b\x0c\r"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col):
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(col, UPPER, UPPER.lower())


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null gives b''."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text at the most (one row at least)."""
    for batch in batches:
        at, n = 0, batch.num_rows
        sizes = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


class WordHashes(dict):
    """64-bit hashes of byte words, kept for the most common ones of a worker's life."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: What a worker keeps between tasks; only of the operator that it ran last.
CACHES: dict[str, object] = {}


def cache(name: str, make):
    """The worker's cache of this name, made anew if another operator's was kept."""
    if name not in CACHES:
        forget()
        CACHES[name] = make()
    return CACHES[name]


def forget() -> None:
    """Free what the last operator kept; a function, so that a task calls its worker's own. What was freed goes back to the machine."""
    CACHES.clear()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(cache("word hashes", WordHashes).__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the 64-bit murmur constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def plus(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` with fields added or replaced by name."""
    new = dict(fields)
    kept = [f for f in schema.fields if f.name not in new]
    return T.StructType(kept + [T.StructField(n, t, True) for n, t in fields])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text")
