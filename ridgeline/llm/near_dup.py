"""Near-duplicate documents by b-bit MinHash.

A document is the set of its five-word shingles. 128 minima give 32 band keys of four minima each; of each minimum the
two low bits are kept, packed as bit planes in four longs. Documents that share a band key become candidates, the planes
estimate their similarity (matches by bit counts, corrected for the quarter that agrees by chance), and pairs whose
estimate is far below the threshold go. What stays is confirmed on full sets.

No bucket is expanded into all its pairs. Equal sets are one class, with its smallest doc_id as representative. Each
bucket first pairs its members with two hubs only; components of the confirmed links follow. A bucket whose members then
lie in several components is mixed. There, documents go of which more than a quarter of the shingles are theirs alone
(no similarity can reach the threshold). The others are placed against the centre of their group, the shingles that most
of it hold, and the nearest to the centre serve as further hubs. Of the pairs that still lie in different components, those
are tested that exact bounds leave possible (``possible_pairs``): they share a rare shingle outside the centre, early enough
in the order of rarity, or lie both close to the centre. So every pair that shares a band and isn't already connected is
tested or ruled out, and hot shingles, which the centre takes in, are never joined with themselves.

Two documents of similarity 0.75 share no band with probability (1 - 0.75^4)^32 = 5e-6. The bit estimate of such a pair falls
under ``SLACK`` with probability 3e-6. Shingles are 64-bit hashes.

Defined cases: null, empty or blank texts have no shingle and are linked with nothing; fewer than five words are one
shingle; rows that repeat a doc_id are judged each by its own text and share the id's links; a null doc_id takes part in
no link and keeps its row, with a null component (``deduplicated`` judges each row by a key of doc_id and text, null ids
too); texts of any length are taken whole; an empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.components import connected
from ridgeline.llm.texts import column, mixed, pieces, raw, word_hashes
from ridgeline.sources.stage import stored

WIDTH, BANDS, ROWS = 5, 32, 4
MINIMA = BANDS * ROWS
#: Estimates below the threshold by more than this are dropped; a standard deviation at similarity 0.75 is 0.046.
SLACK = 0.22
#: Overlaps with a centre are matched by levels a hundredth apart.
LEVEL = math.log(1.01)

_rng = np.random.default_rng(20240101)
FACTORS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)

LONG = T.LongType()
SIGNATURE = T.StructType([T.StructField("doc_id", LONG), T.StructField("n", LONG), T.StructField("d1", LONG), T.StructField("d2", LONG), T.StructField("planes", T.ArrayType(LONG)), T.StructField("bands", T.ArrayType(LONG))])


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, one after another, and how many each text has; repeated ones still stand twice."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = word_hashes([x for w in words for x in w])
    if len(h) < WIDTH:
        h = np.concatenate([h, np.zeros(WIDTH, np.uint64)])
    step = np.uint64(0x9E3779B97F4A7C15)
    run = h[: len(h) - WIDTH + 1].copy()
    for i in range(1, WIDTH):
        run *= step
        run += h[i : len(h) - WIDTH + 1 + i]
    mixed_run = mixed(run)
    ends = np.cumsum(n)
    starts = ends - n
    count = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    offsets = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
    out = mixed_run[np.minimum(offsets, len(mixed_run) - 1)]
    for i in np.flatnonzero((n > 0) & (n < WIDTH)):
        out[count[:i].sum()] = np.uint64(int.from_bytes(blake2b(b" ".join(words[i]), digest_size=8).digest(), "little"))
    return out, count


def minima(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """MINIMA x documents; all documents have a shingle."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(count) - count
    out, v = np.empty((MINIMA, len(count)), np.uint32), np.empty_like(x)
    for k in range(MINIMA):
        np.multiply(x, FACTORS[k], out=v)
        v += SHIFTS[k]
        np.minimum.reduceat(v, starts, out=out[k])
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """The low bits of the minima as planes: documents x 4 longs, first the lowest bits, then the next."""
    low = mins ^ (mins >> np.uint32(15))
    low *= np.uint32(0x2C1B3C6D)
    low ^= low >> np.uint32(12)
    bits = np.concatenate([(low >> np.uint32(b)) & np.uint32(1) for b in (0, 1)]).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1)).view("<i8")


def band_keys(mins: np.ndarray) -> np.ndarray:
    m = mins.reshape(BANDS, ROWS, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], m.shape[::2]).copy()
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + m[:, i])
    return key.T.view(np.int64)


def lists(values: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(np.ascontiguousarray(values).reshape(-1)))


def distinct_sets(h: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    return [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])] if len(count) else []


def signatures(docs: DataFrame) -> DataFrame:
    """For each document: size and digest of its set, packed bits and band keys (null and empty without a shingle)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=2 << 20):
            h, count = shingles(raw(batch, "text"))
            sets = distinct_sets(h, count)
            full = np.flatnonzero(count)
            digests = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
            planes, bands = np.zeros((len(count), 4), np.int64), np.zeros((len(count), BANDS), np.int64)
            if len(full):
                m = minima(h, count[full])
                planes[full], bands[full] = packed(m), band_keys(m)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), lists(planes), lists(bands)], SIGNATURE.names)

    return docs.select("doc_id", "text").mapInArrow(sign, SIGNATURE)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, the set as sorted longs and a hash of it."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=2 << 20):
            own = distinct_sets(*shingles(raw(batch, "text")))
            ends = np.cumsum([0, *(len(s) for s in own)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, shingles array<long>").withColumn("v", F.xxhash64("shingles"))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: the share of equal 2-bit values, less what chance gives."""
    same = sum((F.bit_count(F.bitwise_not(a[i].bitwiseXOR(b[i])).bitwiseAND(F.bitwise_not(a[i + 2].bitwiseXOR(b[i + 2])))) for i in range(2)), F.lit(0))
    return (same / MINIMA - 0.25) / 0.75


def likely(pairs: DataFrame, sigs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) that sizes and packed bits leave possible."""
    a, b = (sigs.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("planes").alias(f"p{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    fits = 100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    return both.where(fits & (estimate(F.col("pa"), F.col("pb")) >= threshold / 100 - SLACK)).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= threshold * union."""
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("inter", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("inter") >= threshold * (F.size("sa") + F.size("sb") - F.col("inter"))).select("a", "b")


def mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """band, doc_id, component and the largest component there, for buckets whose members lie in several components."""
    placed = members.select("band", "doc_id").join(labels, F.col("doc_id") == F.col("node"), "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("m"))
    several = parts.groupBy("band").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.count("*").alias("k")).where("k > 1").drop("k")
    return stored(placed.join(several, "band"), "mixed-buckets")


def linkable(inside: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """doc_id of those that may have a link here: shingles that no other document of the buckets has bound similarity."""
    each = sets.join(inside.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    alone = each.groupBy("s").agg(F.count("*").alias("k"), F.first(F.struct("doc_id", "n")).alias("o")).where("k = 1").groupBy("o").agg(F.count("*").alias("u"))
    out = alone.where(100 * (F.col("o.n") - F.col("u")) < threshold * F.col("o.n")).select(F.col("o.doc_id").alias("doc_id"))
    return inside.select("doc_id").distinct().join(out, "doc_id", "left_anti")


def placed_in_groups(inside: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Each set of the mixed buckets of one largest component, against the centre of that group.

    The centre is what more than half of the group's documents hold. ``n`` is the size of the set, ``i`` its overlap with the
    centre, ``need`` how many shingles outside it a partner must share at the least, ``rare`` the shingles outside that must
    hold the first of these: by how few documents have them, all but the last ``need - 1`` (prefix filter), each with the number
    of those after it. Sets that no partner can reach are left out. Counted by (group, shingle), so no task sees a whole group.
    """
    docs = stored(inside.select("largest", "doc_id").distinct(), "group-members")
    tokens = stored(docs.join(sets, "doc_id").select("largest", "doc_id", "v", F.explode("shingles").alias("s")), "group-shingles")
    # Both written, so that adaptive execution can split the join of a large group.
    sizes = stored(docs.groupBy("largest").agg(F.count("*").alias("docs")), "group-sizes")
    held = stored(tokens.groupBy("largest", "s").agg(F.count_distinct("doc_id").alias("k")), "group-counts").join(sizes, "largest").select("largest", "s", "k", (2 * F.col("k") > F.col("docs")).alias("central"))
    out = tokens.join(held, ["largest", "s"]).groupBy("largest", "doc_id", "v")
    out = out.agg(
        F.count("*").alias("n"),
        F.count_if("central").alias("i"),
        F.count_if(~F.col("central") & (F.col("k") == 1)).alias("alone"),
        F.sort_array(F.collect_list(F.when(~F.col("central") & (F.col("k") > 1), F.struct("k", "s")))).alias("rest"),
    )
    need = F.ceil((threshold * F.col("n") - 100 * F.col("i")) / 100)
    out = out.withColumn("need", need).where("need <= n - i")
    most = F.greatest(F.lit(0), F.col("n") - F.col("i") - F.greatest("need", F.lit(1)) + 1 - F.col("alone")).cast("int")
    rare = F.transform(F.slice("rest", F.lit(1), most), lambda x, at: F.struct(x["s"].alias("s"), (F.col("n") - F.col("i") - F.col("alone") - at - 1).alias("after")))
    return stored(out.select("largest", "doc_id", "n", "i", "need", rare.alias("rare")), "placed")


def centred(inside: DataFrame, placed: DataFrame, threshold: int) -> DataFrame:
    """Pairs of each document of a mixed bucket with two hubs: those nearest to the centre in the largest component and outside it.

    Two sets whose distances from the centre leave them similar whatever they share are both similar to the nearest one.
    """
    near = placed.groupBy("largest", "doc_id").agg(F.max((100 + threshold) * F.col("i") - threshold * F.col("n")).alias("near"))
    ranked = inside.join(near, ["largest", "doc_id"]).withColumn("r", F.struct("near", F.xxhash64("doc_id")))
    outside = F.col("component") != F.col("largest")
    best = ranked.groupBy("band").agg(*(F.max_by(F.when(w, F.struct(F.col("doc_id").alias("y"), F.col("component").alias("cy"))), F.when(w, F.col("r"))).alias(n) for n, w in (("h1", ~outside), ("h2", outside))))
    hubs = best.select("band", F.explode(F.array("h1", "h2")).alias("h")).select("band", "h.*")
    return ranked.select("band", F.col("doc_id").alias("x"), F.col("component").alias("cx")).join(hubs, "band").where("cx <> cy")


def possible_pairs(placed: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """Pairs (x, y) within groups, of different components, that may be as similar as the threshold; exact.

    The overlap of two sets is at most the smaller of their overlaps with the centre plus the shingles that both have outside
    it. Where the first part isn't enough by itself, the pair must share a rare shingle outside. Where it is (few: both lie
    close to the centre, and yet their components found no link), their overlaps with the centre are of like size.
    """
    t = threshold
    own, main = (labels.select(F.col("node").alias(f"_n{x}"), F.col("component").alias(f"_c{x}")) for x in "om")
    now = placed.join(own, F.col("doc_id") == F.col("_no"), "left").join(main, F.col("largest") == F.col("_nm"), "left")
    now = now.withColumn("c", F.coalesce("_co", "doc_id")).withColumn("minor", F.col("c") != F.coalesce("_cm", "largest")).drop("_no", "_co", "_nm", "_cm")
    now = stored(now, "labelled")

    def side(df: DataFrame, name: str, on: str, *more: str) -> DataFrame:
        return df.select("largest", on, F.col("doc_id").alias(name), *(F.col(k).alias(f"{k[0]}{name}") for k in ("c", "n", "i", "minor", *more)))

    apart = (F.col("cx") != F.col("cy")) & (~F.col("my") | (F.col("x") < F.col("y")))
    fits = 100 * F.least("nx", "ny") >= t * F.greatest("nx", "ny")
    rare = now.withColumn("r", F.explode("rare")).withColumn("s", F.col("r.s")).withColumn("after", F.col("r.after"))
    possible = (100 + t) * (1 + F.least("ax", "ay") + F.least("ix", "iy")) >= t * (F.col("nx") + F.col("ny"))
    shared = side(rare.where("minor"), "x", "s", "after").join(side(rare, "y", "s", "after"), ["largest", "s"]).where(apart & fits & possible).select("x", "y")
    level = lambda i: F.floor(F.log(i.cast("double")) / LEVEL)
    near = now.where("need <= 0")
    reach = F.sequence(level(F.greatest(F.lit(1), t * F.col("n") / 100)) - 1, level(F.greatest(F.col("i"), (100 + t) * F.col("i") / t - F.col("n"))) + 1)
    x = side(near.where("minor").withColumn("level", F.explode(reach)), "x", "level")
    enough = (100 + t) * F.least("ix", "iy") >= t * (F.col("nx") + F.col("ny"))
    close = x.join(side(near.withColumn("level", level(F.col("i"))), "y", "level"), ["largest", "level"]).where(apart & enough).select("x", "y")
    return shared.union(close)


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    sigs = stored(signatures(docs), "signatures")
    known = sigs.where("n > 0 AND doc_id IS NOT NULL")
    # The smallest doc_id of each set, with its signature, comes from partial aggregates: a set that very many hold is no hot key.
    signature = F.min_by(F.struct("n", "planes", "bands"), "doc_id").alias("own")
    classes = stored(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), signature), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "own.*")
    banded = reps.select("doc_id", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.min_by("doc_id", F.xxhash64("doc_id", "band")).alias("other"), F.max("doc_id").alias("_last")).where(F.col("hub") < F.col("_last")).drop("_last")
    members = stored(banded.join(hubs, "band"), "bucket-members")

    def ordered(x: Column, y: Column) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    first = members.select("doc_id", F.explode(F.array("hub", "other")).alias("hub")).where(F.col("doc_id") != F.col("hub")).select(*ordered(F.col("doc_id"), F.col("hub"))).distinct()
    names = stored(members.select("doc_id").distinct(), "candidates")
    sets = stored(shingle_sets(docs.select("doc_id", "text").join(names, "doc_id", "left_semi")).dropDuplicates(["doc_id", "v"]), "shingle-sets")
    few = reps.select("doc_id", "n", "planes").join(names, "doc_id", "left_semi")
    links = stored(confirmed(likely(first, few, threshold), sets, threshold).distinct(), "links")
    labels = connected(links)
    first = stored(first, "tested")
    inside = mixed_buckets(members, labels)
    if not inside.isEmpty():
        members = members.join(stored(linkable(inside, sets, threshold), "linkable"), "doc_id", "left_semi")
        inside = mixed_buckets(members, labels)
    if not inside.isEmpty():
        placed = placed_in_groups(inside, sets, threshold)
        for found in (centred(inside, placed, threshold), None):
            found = possible_pairs(placed, labels, threshold) if found is None else found
            pairs = stored(found.select(*ordered(F.col("x"), F.col("y"))).distinct().join(first, ["a", "b"], "left_anti"), "tested")
            more = stored(confirmed(likely(pairs, few, threshold), sets, threshold).distinct(), "links")
            first = first.union(pairs)
            if not more.isEmpty():
                links = links.union(more)
                labels = connected(links)

    # Written, so that the join by set is one of two plain sides, which adaptive execution splits.
    ids = stored(classes.join(labels, classes.rep == labels.node, "left").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.coalesce("component", "rep").alias("component")), "class-components")
    own = known.join(ids, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left").select("doc_id", "n", "component")
    rest = sigs.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = own.union(rest).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one of the smallest doc_id (null last).

    Rows are judged by a 64-bit key of doc_id and text, so those that share an id don't share links, and null ids take part.
    Rows that repeat both are one group. Texts without a shingle stay.
    """
    key = F.xxhash64("doc_id", "text")
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"), threshold).where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("key")).agg(F.max("component_id").alias("component"), F.count("*").alias("copies"))
    ids = docs.select(key.alias("key"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    judged = stored(found.join(ids, "key").select("key", "component", "copies", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("place")), "judged")
    firsts = judged.groupBy("component").agg(F.min("place").alias("first")).select("component", F.col("first.key").alias("kept"))
    gone = judged.join(firsts, "component").where("key <> kept").select(F.col("key").alias("_gone"))
    out = docs.join(gone, key == F.col("_gone"), "left_anti")
    repeated = stored(judged.join(firsts, "component").where("key = kept AND copies > 1").select(F.col("key").alias("_repeated")), "repeated")
    if repeated.isEmpty():
        return out
    once = out.join(repeated, key == F.col("_repeated"), "left_semi").groupBy(key.alias("_key")).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return out.join(repeated, key == F.col("_repeated"), "left_anti").union(once)
