"""Benchmark decontamination with DataFrame functions alone.

Benchmark items become windows of 13 consecutive normalised words (an item of fewer words is one window). The distinct
windows are the hash set: a join side that is broadcast while its measured bytes are under a bound, and shuffled beyond.
Training documents first probe with aligned blocks of words, which dismisses most of them at a seventh of the work; the
windows of the others probe the set, whose hash matches are verified by comparing the words themselves. Hits, one row for
each document and the texts of likely documents' join are what is shuffled.

Defined cases: null, empty and word-less texts have no words and no hits; word-less items match nothing; items that
repeat count by their distinct item_id, a null item_id not at all; each row is judged by its own text, whatever rows share
its doc_id or have none: rows are told apart by doc_id and a hash of the text, and rows that repeat both come out as often;
texts of any length are taken whole; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.texts import ascii_lower
from ridgeline.sources.stage import stored

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Summed bytes of distinct windows up to which they are broadcast.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Runs of ``WORD`` characters, by splitting at all others: several times faster than extracting the runs."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def windows(own: Column, k: int) -> Column:
    """All runs of ``k`` words with their place from 1."""
    runs = F.transform(F.sequence(F.lit(1), F.size(own) - k + 1), lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), F.array_join(F.slice(own, i, F.lit(k)), " ").alias("key")))
    return F.when(F.size(own) >= k, runs)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, k (its words) and the items that hold it."""
    own = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(window)))
    each = own.select("item_id", "k", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i"))
    keyed = each.select("item_id", "k", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("key"))
    return keyed.groupBy("key", "k").agg(F.collect_set("item_id").alias("items"))


def block_size(k: int) -> int:
    """The longest aligned block that every run of ``k`` words holds whole."""
    return (k + 1) // 2


def blocks(own: Column, k: int) -> Column:
    """The aligned blocks of a document: one in ``block_size(k)`` of its runs."""
    b = block_size(k)
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / b).cast("int") - 1), lambda j: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(own, j * b + 1, F.lit(b)), " ").alias("key")))
    return F.when(F.size(own) >= k, runs)


def window_blocks(known: DataFrame, lengths: list[int]) -> DataFrame:
    """All runs of ``block_size(k)`` words of the benchmark's windows."""
    w = F.split("key", " ")
    b = F.expr("CASE k " + " ".join(f"WHEN {k} THEN {block_size(k)}" for k in lengths) + " END") if lengths else F.lit(1)
    each = known.select("k", w.alias("w"), b.alias("b")).select("k", "w", "b", F.explode(F.expr("sequence(1, k - b + 1)")).alias("i"))
    return each.select("k", F.expr("array_join(slice(w, i, b), ' ')").alias("key")).distinct()


def limited(df: DataFrame, size: int) -> DataFrame:
    """A join side that is broadcast while it is small."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, h (a hash of the text), n_words and the hit windows with their items, for every row.

    First each document probes with aligned blocks, one in seven of its runs of seven words: any window of 13 words holds
    one of them whole. Only documents with a block of the benchmark's then probe with all their windows.
    """
    known = stored(item_windows(benchmark, window), "benchmark-windows")
    lengths = [r.k for r in known.select("k").distinct().orderBy("k").collect()]
    size = known.agg(F.sum(F.octet_length("key") + 16 * F.size("items"))).first()[0] or 0
    none = F.lit(None).cast("string")
    start = F.array(F.struct(F.lit(0).alias("k"), none.alias("key")))
    own = F.concat(start, *(F.coalesce(blocks(F.col("w"), k), F.filter(start, lambda _: F.lit(False))) for k in lengths))
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    same = lambda t: F.col("doc_id").eqNullSafe(t["_doc"]) & (F.col("h") == t["_h"])
    parts = docs.select("doc_id", "h", words(F.col("text")).alias("w")).select("doc_id", "h", F.size("w").cast("long").alias("n_words"), F.explode(own).alias("p")).select("doc_id", "h", "n_words", "p.*")
    seen = limited(window_blocks(known, lengths).withColumn("hit", F.lit(True)), 8 * size)
    marked = parts.join(seen, ["k", "key"], "left").where(F.col("hit") | (F.col("k") == 0))
    counted = stored(marked.groupBy("doc_id", "h").agg(F.max("n_words").alias("n_words"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("likely"), F.count_if(F.col("k") == 0).alias("rows")), "word-counts")

    likely = counted.where("likely").select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"))
    likely = limited(likely, 16 * likely.count())
    some = docs.join(likely, same(likely), "left_semi")
    runs = [F.coalesce(windows(F.col("w"), k), F.array().cast("array<struct<pos:int,k:int,key:string>>")) for k in lengths]
    probes = some.select("doc_id", "h", words(F.col("text")).alias("w")).select("doc_id", "h", F.explode(F.concat(*runs) if runs else F.array().cast("array<struct<pos:int,k:int,key:string>>")).alias("p")).select("doc_id", "h", "p.*")
    found = probes.join(limited(known.select("key", "items"), size), "key")
    span = F.struct("pos", (F.col("pos") + F.col("k") - 1).alias("end"))
    spans = found.groupBy(F.col("doc_id").alias("_doc"), F.col("h").alias("_h")).agg(F.sort_array(F.collect_set(span)).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    out = counted.join(spans, same(spans), "left").withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select("doc_id", "h", "n_words", F.coalesce("spans", F.array().cast("array<struct<pos:int,end:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def covered(spans: Column) -> Column:
    """Words under sorted spans, each once."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["last"], x["pos"] - 1))).alias("n"), F.greatest(a["last"], x["end"]).alias("last"))
    return F.aggregate(spans, zero, step, lambda a: a["n"]).cast("long")


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    out = hits(docs, benchmark, window).withColumn("n_hit", covered(F.col("spans")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, spans of hit words, items, and contaminated: one word in ``share`` or more is hit."""
    return judged(docs, benchmark, window, share).drop("h")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated rows, each judged by its own text whatever rows share its doc_id."""
    bad = judged(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("h").alias("_bad_text")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_bad_text"]), "left_anti")
