"""Designs of experiments. All randomness is a hash of (seed, row, dimension), so partitioning never changes a value."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions.normal import normal_quantile
from ridgeline.functions.scalars import clamp, job_key
from ridgeline.operators.curves import magnitude
from ridgeline.operators.ranges import ranked
from ridgeline.sources.stage import stored

#: Joe and Kuo (2008), the first dimensions: degree, coefficient, initial odd numbers.
JOE_KUO = [(1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3]), (4, 4, [1, 3, 5, 13]), (5, 2, [1, 1, 5, 5, 17])]
PRIMES = [2, 3, 5, 7, 11, 13, 17, 19]
#: Bits of a Sobol coordinate, and so the points before they would repeat: what a double holds exactly.
BITS = 52


def uniform(seed: int, *of: Column) -> Column:
    """A number strictly between 0 and 1."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 12).cast("double") + 0.5) / float(1 << 52)


def gaussian(seed: int, *of: Column) -> Column:
    return normal_quantile(uniform(seed, *of))


def rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row")


def random_design(spark: SparkSession, n: int, names: list[str], seed: int = 42) -> DataFrame:
    return rows(spark, n).select("row", *(uniform(seed, F.col("row"), F.lit(k)).alias(c) for k, c in enumerate(names)))


def permuted(row: Column, n: int, seed: int, rounds: int = 4) -> Column:
    """A permutation of 0..n-1 without a sort: a Feistel network on the next power of two, walked until it is inside.

    Each step leaves the range with a probability under a half, so 64 steps fail for a row with 5e-20.
    """
    bits = max(1, (n - 1).bit_length())
    low = bits - bits // 2
    masks = (1 << (bits // 2)) - 1, (1 << low) - 1

    def once(x: Column) -> Column:
        left, right = F.shiftright(x, low), x.bitwiseAND(F.lit(masks[1]))
        for k in range(rounds):
            if k % 2:
                right = right.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(k), left).bitwiseAND(F.lit(masks[1])))
            else:
                left = left.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(k), right).bitwiseAND(F.lit(masks[0])))
        return F.shiftleft(left, low).bitwiseOR(right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(row), lambda a, _: F.when(a < n, a).otherwise(once(a)))


def latin_hypercube(spark: SparkSession, n: int, names: list[str], seed: int = 42) -> DataFrame:
    """One point in each of n strata of every dimension, with a jitter inside."""
    return rows(spark, n).select("row", *(((permuted(F.col("row"), n, seed + 1000 * (k + 1)) + uniform(seed, F.col("row"), F.lit(k))) / n).alias(c) for k, c in enumerate(names)))


def radical_inverse(row: Column, base: int) -> Column:
    digits = F.sequence(F.lit(1), F.lit(int(63 / (base - 1).bit_length()) if base > 2 else 60))
    start = F.struct(row.alias("left"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("out"))
    step = lambda a, _: F.struct(F.floor(a["left"] / base).alias("left"), (a["scale"] / base).alias("scale"), (a["out"] + (a["left"] % base) * (a["scale"] / base)).alias("out"))
    return F.aggregate(digits, start, step, lambda a: a["out"])


def halton(spark: SparkSession, n: int, names: list[str], skip: int = 1) -> DataFrame:
    if len(names) > len(PRIMES):
        raise ValueError(f"at most {len(PRIMES)} dimensions")
    return rows(spark, n).select("row", *(radical_inverse(F.col("row") + skip, PRIMES[k]).alias(c) for k, c in enumerate(names)))


def directions(dimension: int) -> list[int]:
    """Sobol direction numbers of a dimension (0 is van der Corput's)."""
    if dimension == 0:
        return [1 << (BITS - 1 - i) for i in range(BITS)]
    degree, coefficient, first = JOE_KUO[dimension - 1]
    m = list(first)
    for i in range(degree, BITS):
        value = m[i - degree] ^ (m[i - degree] << degree)
        for k in range(1, degree):
            if (coefficient >> (degree - 1 - k)) & 1:
                value ^= m[i - k] << k
        m.append(value)
    return [m[i] << (BITS - 1 - i) for i in range(BITS)]


def sobol_point(row: Column, dimension: int, bits: int = BITS) -> Column:
    """Point ``row`` (under 2^``bits``) by its Gray code: the exclusive or of the directions of its bits."""
    gray = row.bitwiseXOR(F.shiftright(row, 1))
    out = F.lit(0).cast("long")
    for i, v in enumerate(directions(dimension)[:bits]):
        out = out.bitwiseXOR(F.shiftright(gray, i).bitwiseAND(F.lit(1)) * F.lit(v))
    return out / float(1 << BITS)


def sobol(spark: SparkSession, n: int, names: list[str], first: int = 0) -> DataFrame:
    """The largest power of two of points that is at most n; ``first`` picks the dimensions to begin with."""
    n = 1 << (n.bit_length() - 1)
    if n > 1 << BITS or first + len(names) > len(JOE_KUO) + 1:
        raise ValueError(f"at most 2^{BITS} points in {len(JOE_KUO) + 1} dimensions")
    return rows(spark, n).select("row", *(sobol_point(F.col("row"), first + k, n.bit_length()).alias(c) for k, c in enumerate(names)))


def grid(spark: SparkSession, per_axis: int, names: list[str]) -> DataFrame:
    """A regular grid of cell middles, by arithmetic on the row number (no cross join)."""
    return rows(spark, per_axis ** len(names)).select("row", *(((F.floor(F.col("row") / per_axis**k) % per_axis + 0.5) / per_axis).alias(c) for k, c in enumerate(names)))


def to_normal(u: Column, mean: float, std: float) -> Column:
    return mean + std * normal_quantile(u)


def to_lognormal(u: Column, mu: float, sigma: float) -> Column:
    return F.exp(mu + sigma * normal_quantile(u))


def to_range(u: Column, low: float, high: float) -> Column:
    return low + (high - low) * u


def clipped_normal(seed: int, mean: float, std: float, low: float, high: float, *of: Column) -> Column:
    return clamp(mean + std * gaussian(seed, *of), low, high)


def share_of(share: float, n: str) -> Column:
    """floor(share x n), the share being the decimal number it is written as: 0.7 of 90,000 is 63,000, and not one less."""
    return F.floor(F.expr(f"CAST('{Decimal(repr(share)):f}' AS DECIMAL(18, 17))") * F.col(n).cast("decimal(19, 0)"))


def split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """``split`` by a seeded shuffle with exact sizes: every part but the last has floor(share x n) rows."""
    ranked = hash_ranked(df, key, seed)
    out, bound = F.when(F.lit(False), F.lit("")), F.lit(0)
    names = list(shares)
    for name in names[:-1]:
        bound = bound + share_of(shares[name], "total")
        out = out.when(F.col("rank") <= bound, F.lit(name))
    return ranked.withColumn("split", out.otherwise(F.lit(names[-1]))).drop("rank", "total")


def sample(df: DataFrame, key: str, n: int, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """``n`` rows without replacement, those of the least hashes, or of the least ``draw``."""
    return df.orderBy(F.xxhash64(F.lit(seed), key) if draw is None else draw, key).limit(n)


def replicated(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(times))))


def partners(keys: DataFrame, key: str, seed: int = 42, n: int | None = None) -> DataFrame:
    """(key, partner): a random other key for each of ``keys``, which number consecutive places 0..n-1 in ``place``."""
    n = n if n is not None else keys.count()
    shift = 1 + F.pmod(F.xxhash64(F.lit(seed), key), F.lit(max(1, n - 1)))
    mine = keys.select(key, ((F.col("place") + shift) % n).alias("_to"))
    return mine.join(keys.select(F.col("place").alias("_to"), F.col(key).alias("partner")), "_to").select(key, "partner")


def numbered(keys: DataFrame, key: str) -> DataFrame:
    """``place`` of each key from 0 in ascending order; keys of any type that can be ordered."""
    return ranked(keys.select(key), [key]).select(key, (F.col("rank") - 1).alias("place"))


def augmentation(gridded: DataFrame, parameters: DataFrame, key: str, rounds: int, params: list[str], derived: dict[str, Column] | None = None, seed: int = 42, noise: float = 0.02, jitter: float = 0.02, shares: tuple[float, float] = (0.0, 1.0), least: float = 1e-6, low: float | None = None, high: float | None = None, draw: Callable[..., Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Augmentation rounds over keys of any type, re-keyed.

    In each round every curve is mixed with another one's, ``shares`` of the way, and gets noise scaled by its peak; its
    parameters are mixed alike, jittered and kept at ``least`` or more, and columns in ``derived`` are computed from the new ones.
    Round 0 is the original. Returns curves (key, round, number, job_aug, i, y), clamped to ``low`` and ``high``, and parameters
    (key, round, number, job_aug, ...); numbers go on from round to round in the order of keys. ``draw`` gives a uniform column
    from a name and columns; by default a hash. ``gridded`` is (key, i, y), or (key, y) with y an array on one grid: then curves are
    one row each, before and after, and have no i.
    """
    draw = draw or (lambda name, *of: uniform(seed, F.lit(name), *of))
    places = stored(numbered(parameters.select(key).distinct(), key), "places")
    n = places.count()
    turns = places.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    shift = F.least(1 + F.floor(draw("partner", F.col("place"), F.col("round")) * (n - 1)), F.lit(max(1, n - 1)))
    alpha = shares[0] + (shares[1] - shares[0]) * draw("alpha", F.col("place"), F.col("round"))
    turns = turns.select(key, "place", "round", alpha.alias("alpha"), F.pmod(F.col("place") + shift, F.lit(max(1, n))).alias("_to"))
    pairs = stored(turns.join(places.select(F.col("place").alias("_to"), F.col(key).alias("partner")), "_to").drop("_to"), "partners")

    def told(df: DataFrame, *columns: Column | str) -> DataFrame:
        number = F.col("round") * n + F.col("place")
        return df.select(key, "round", number.alias("number"), job_key(number).alias("job_aug"), *columns)

    normal = lambda name, *of: normal_quantile(draw(name, F.col("place"), F.col("round"), *of)) if noise or jitter else F.lit(0.0)
    at = ["i"] if "i" in gridded.columns else []
    other = gridded.select(F.col(key).alias("partner"), *at, F.col("y").alias("_o"))
    mixed = gridded.select(key, *at, "y").join(pairs, key).join(other, ["partner", *at])
    if noise:
        mixed = mixed.join(gridded.groupBy(key).agg(F.max(F.abs("y")).alias("_peak")), key) if at else mixed.withColumn("_peak", magnitude(F.col("y")))

    def point(mine: Column, theirs: Column, i: Column) -> Column:
        y = mine + F.col("alpha") * (theirs - mine) + (noise * F.col("_peak") * normal("y", i) if noise else F.lit(0.0))
        return y if low is None and high is None else clamp(y, low if low is not None else float("-inf"), high if high is not None else float("inf"))

    y = point(F.col("y"), F.col("_o"), F.col("i")) if at else F.transform("y", lambda v, i: point(v, F.get("_o", i), i))
    own = gridded.select(key, *at, "y").join(places, key).withColumn("round", F.lit(0))
    curves = told(own, *at, "y").unionByName(told(mixed, *at, y.alias("y")))

    theirs = parameters.select(F.col(key).alias("partner"), *(F.col(p).alias(f"_{p}") for p in params))
    both = parameters.select(key, *params).join(pairs, key).join(theirs, "partner")
    value = lambda p: F.col(p) + F.col("alpha") * (F.col(f"_{p}") - F.col(p))
    new = told(both, *(F.greatest(value(p) * (1 + jitter * normal(p)) if jitter else value(p), F.lit(least)).alias(p) for p in params))
    every = told(parameters.select(key, *params).join(places, key).withColumn("round", F.lit(0)), *params).unionByName(new)
    return curves, every.withColumns(derived) if derived else every


def augmented(gridded: DataFrame, parameters: DataFrame, key: str, rounds: int, params: list[str], seed: int = 42, noise: float = 0.02, jitter: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """``augmentation`` under the original keys: curves (key, round, i, y) and parameters (key, round, ...)."""
    curves, every = augmentation(gridded, parameters, key, rounds, params, None, seed, noise, jitter)
    return curves.drop("number", "job_aug"), every.drop("number", "job_aug")


def hash_ranked(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``rank`` from 1 in the order of a seeded hash, and ``total``; ranks come from ranges of the hash, as many as there are tasks."""
    return ranked(df.withColumn("_h", F.xxhash64(F.lit(seed), key)), ["_h", key]).withColumnRenamed("rank_all", "total").drop("_h")


def bound(design: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``design`` with the key of each of its rows: row k is that of the k-th key in ascending order."""
    places = numbered(keys, key)
    return design.join(places, design["row"] == places["place"]).drop("place")


def nested_subsets(df: DataFrame, key: str, fractions: list[float], seed: int = 42) -> DataFrame:
    """Rows with ``fraction``: the smaller subset is in every larger one, sizes are floor(fraction x n)."""
    sizes = F.array(*(F.struct(F.lit(f).alias("fraction"), share_of(f, "total").alias("size")) for f in sorted(fractions)))
    each = hash_ranked(df, key, seed).withColumn("_s", F.explode(sizes))
    return each.where("rank <= _s.size").withColumn("fraction", F.col("_s.fraction")).drop("rank", "total", "_s")


def bootstrapped(rows: DataFrame, factors: DataFrame, place: Column, n: int) -> DataFrame:
    """Each row with a row of ``factors`` (numbered 0..n-1 in ``place``) drawn by ``place`` modulo n."""
    return rows.withColumn("_to", F.pmod(place, F.lit(n))).join(factors.withColumnRenamed("place", "_to"), "_to").drop("_to")


def scaled_replicates(rows: DataFrame, scale: str, key: str, jitter: float = 0.02, low: float = 0.0, high: float = 10.0, seed: int = 42) -> DataFrame:
    """A drawn scale times 1 + jitter x a hashed normal, clamped."""
    return rows.withColumn(scale, clamp(F.col(scale) * (1 + jitter * gaussian(seed, F.col(key), F.lit("scale"))), low, high))
