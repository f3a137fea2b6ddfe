"""Connected components of a link table as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.sources.stage import stored


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a, b), of comparable ids, to (node, component), component being the smallest id reachable.

    Rounds of large-star and small-star (Kiveris et al., 2014), each over the remaining edges; every round's edges, and the
    least neighbours that they are joined with, are written to the shared folder, so that both sides of a join are plain and
    adaptive execution can split a node of very many edges. Nulls and loops are ignored, repeated links count once, no link
    gives no row.
    """
    edges = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "edges")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least-neighbours")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large, "large-star")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least-neighbours")
        small = large.join(low, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = stored(small, "edges")
        # Done when each edge leads to a root: no node is both a lower and an upper end, and no node has two edges.
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
