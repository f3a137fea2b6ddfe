"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's documents.

1. language: documents whose language can't be told go (no letter, or a score under ``LEAST_LEAD`` shares of 1 / languages).
2. lines: lines that five or more documents hold stay in the largest doc_id that holds them.
3. near_duplicates: one document of each group of near duplicates stays, the one of the smallest doc_id.
4. decontamination: documents of which a twentieth or more of the words stand in benchmark windows go.
5. packing: what is left is tokenised and packed into sequences of 2,048 tokens.

Stages 3 and 4 judge each row by its own text, also where rows share a doc_id or have none. Stages 1 to 4 return the columns of
``documents``, whatever these are called; n_chars follows the text. Null and empty texts have no letter, so stage 1 drops them; texts
of any length are taken whole; with an empty table, or no labelled row, nothing is told and nothing is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, langid, line_dedup, near_dup, packing
from ridgeline.sources.stage import stored

#: How many times the share that says nothing (1 / number of languages) the best language must have.
LEAST_LEAD = 1.2


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and one column of all others, so that no name can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))).alias("row"))


def whole(out: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of ``documents`` again, those in ``new`` as given."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), **new}
    return out.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(langid.training(docs))
    least = LEAST_LEAD / max(2, len(model.languages))
    told = langid.predicted(apart(docs), model)
    return whole(told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return whole(line_dedup.dedup_within(apart(docs)), docs.columns, n_chars=F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return whole(near_dup.deduplicated(apart(docs)), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return whole(decontaminate.decontaminated(apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: SQL can't express language ID, near-duplicate components or tokenisation; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
