"""URL filter rules as a sort-merge range join.

A host is turned round (``net.example.m.``), so a rule for a host and its subdomains is an interval of keys that share a
prefix, and intervals are nested or disjoint. Rules and pages are dealt together to ranges of their keys; rules that are open
where a range begins are those whose key starts the range's least key, found by an equality join of its prefixes, so a range
gets no more of them than its least host has labels (and a host rules). A sweep over a sorted range keeps the stack of rules
whose interval is open. The rule of the longest host whose path starts the page's path wins, among those of one host the
longest path. This holds for rules of any number; a task keeps those of the hosts on its stack only.

Defined cases: of rules that repeat a host and path the verdict that sorts first wins; a rule with a null in it fits
nothing; a null URL or one without ``://`` has an empty host and path; where no rule fits, rule is null and the verdict is the
default; repeated rows and null page_ids are judged like any others; ports and user names stay in the host; URLs of any length
are taken whole; an empty table gives no row; only page_id and url are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.texts import ascii_lower, column
from ridgeline.sources.stage import stored

#: The contract's rules as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    after = F.coalesce(after, F.lit(""))
    return ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def labels(host: str = "host") -> Column:
    return F.split(host, r"\.", -1)


def key(turned: Column) -> Column:
    return F.concat(F.array_join(turned, "."), F.lit("."))


def parts(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path"))


def dealt(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages and rules with ``range``; each range has the rules inside it and those open at its least key, and is sorted."""
    own = rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND rule_verdict IS NOT NULL").select(F.lit(None).cast("long").alias("page_id"), F.col("rule_host").alias("host"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"), F.lit(0).alias("kind"))
    both = parts(pages).select("*", F.lit(None).cast("string").alias("verdict"), F.lit(1).alias("kind")).unionByName(own)
    keyed = both.withColumn("key", key(F.reverse(labels())))
    ranges = stored(keyed.repartitionByRange("key", "kind", "path", "page_id").withColumn("range", F.spark_partition_id()), "url-ranges")
    deepest = own.agg(F.coalesce(F.max(F.size(labels())), F.lit(0)).alias("deepest"))
    least = ranges.groupBy("range").agg(F.min("key").alias("least")).join(F.broadcast(deepest)).withColumn("of", F.split(F.expr("left(least, length(least) - 1)"), r"\.", -1))
    steps = least.where("deepest > 0").select("range", "of", F.explode(F.sequence(F.lit(1), F.least("deepest", F.size("of")))).alias("i"))
    begun = steps.select(F.col("range").alias("into"), key(F.expr("slice(of, 1, i)")).alias("key"))
    opened = ranges.where("kind = 0").join(begun, "key").where(F.col("range") < F.col("into")).withColumn("range", F.col("into")).select(*ranges.columns)
    most = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.unionByName(opened).repartitionById(most, F.col("range")).sortWithinPartitions("range", "key", "kind")


class Open:
    """The rules of one host whose interval is open: verdicts by path, and the paths' lengths, the longest first."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.verdicts: dict[str, str] = {}
        self.lengths: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        self.verdicts[path] = min(verdict, self.verdicts.get(path, verdict))
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def fitting(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if n <= len(path) and path[:n] in self.verdicts), None)


def judged(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each page; rules are tuples or rows of rule_host, rule_path, rule_verdict."""
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Open] = []
        inside = None
        for batch in batches:
            rule, verdict = [], []
            for at, own, kind, host, path, said in zip(*(column(batch, c).to_pylist() for c in ("range", "key", "kind", "host", "path", "verdict")), strict=True):
                if at != inside:
                    inside, stack = at, []
                while stack and not own.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != own:
                        stack.append(Open(own, host))
                    stack[-1].add(path, said)
                    continue
                best = next(((o, p) for o in reversed(stack) if (p := o.fitting(path)) is not None), None)
                rule.append(best and best[0].host + best[1])
                verdict.append(best[0].verdicts[best[1]] if best else default)
            kept = batch.filter(pc.equal(column(batch, "kind"), 1))
            yield pa.RecordBatch.from_arrays([*(column(kept, c) for c in ("page_id", "host", "path")), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return dealt(pages, rules).mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
