"""Ranks, percentile ranks, trimmed means, modes and histograms over groups.

Ranks come from counts per distinct value: one aggregation, a running sum over the values of each group, and a join
back. Repeated values, however many rows hold them, take one row there. The running sum is cut into ranges of values:
each range is summed on its own and learns the total of the ranges before it from one row per group and range, so a
group with many distinct values is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def _range_of(counts: DataFrame, value: str) -> Column:
    """Number of the range of values that a row lies in; values that are no numbers are one range."""
    kind = dict(counts.dtypes)[value]
    if kind not in _NUMBERS and not kind.startswith("decimal"):
        return F.lit(0)
    x, n = F.col(value).cast("double"), int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = counts.select(F.percentile_approx(x, [k / n for k in range(1, n)], 10_000).alias("c")).first().c if n > 1 else None
    edges = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    return F.aggregate(edges, F.lit(0), lambda acc, c: acc + F.when(c < x, 1).otherwise(0))


def _values(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, _n, _below, _total) of every distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranged = counts.withColumn("_range", _range_of(counts, value))
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = [*by, "_range"]
    edges = sums.select(
        *(F.col(c).alias(f"_{k}") for k, c in enumerate(names)), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.sum("_sum").over(group).alias("_total")
    )
    inside = Window.partitionBy(*names).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_inside", F.sum("_n").over(inside) - F.col("_n"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(names)))
    return summed.join(edges, same).select(*by, value, "_n", (F.col("_before") + F.col("_inside")).alias("_below"), "_total")


def rank(df: DataFrame, value: str, by: list[str], ascending: bool = False) -> DataFrame:
    """``df`` with rank_eq (ties share the top rank) and rank_avg (ties share the mean rank)."""
    v = _values(df, value, by)
    top = F.col("_below") + 1 if ascending else F.col("_total") - F.col("_below") - F.col("_n") + 1
    places = v.select(*by, value, top.alias("rank_eq"), (top + (F.col("_n") - 1) / 2).alias("rank_avg"))
    return df.join(places, [*by, value], "left")


def percent_rank(df: DataFrame, value: str, by: list[str], exclusive: bool = False, significance: int | None = None) -> DataFrame:
    """PERCENTRANK.INC: rows below / (n - 1); .EXC: (rows below + 1) / (n + 1); cut to ``significance`` digits if given."""
    v = _values(df, value, by)
    share = (F.col("_below") + 1) / (F.col("_total") + 1) if exclusive else F.try_divide(F.col("_below"), F.col("_total") - 1)
    if significance is not None:
        share = F.floor(share * 10.0**significance) / 10.0**significance
    return df.join(v.select(*by, value, share.alias("percent_rank")), [*by, value], "left")


def percent_rank_of(df: DataFrame, value: str, x: float, by: list[str], significance: int = 3) -> DataFrame:
    """The inclusive percent rank of one number, between neighbours in proportion, truncated; null outside the range."""
    v = F.col(value).cast("double")
    stats = df.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.count_if(v < x).alias("below"),
        F.max(F.when(v <= x, v)).alias("low"),
        F.min(F.when(v >= x, v)).alias("high"),
        F.count_if(v <= x).alias("upto"),
    )
    between = F.col("upto") - 1 + F.try_divide(F.lit(x) - F.col("low"), F.col("high") - F.col("low"))
    place = F.when(F.col("low") == x, F.col("below").cast("double")).otherwise(between)
    scale = 10.0**significance
    out = F.floor(F.try_divide(place, F.col("n") - 1) * scale) / scale
    return stats.select(*by, F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), out).alias("percent_rank"))


def nth(df: DataFrame, value: str, k: int, by: list[str], largest: bool = True) -> DataFrame:
    """LARGE and SMALL per group: the k-th of the ordered values, from counts of distinct values."""
    v = _values(df, value, by)
    below = F.col("_total") - F.col("_below") - F.col("_n") if largest else F.col("_below")
    return v.where((below < k) & (below + F.col("_n") >= k)).select(*by, F.col(value).alias("value"))


def percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact inclusive percentiles of all rows, in one row: a column for each name; null without values."""
    v = _values(df.select(F.col(value).cast("double").alias("_x")), "_x", [])
    found = []
    for k, share in enumerate(shares.values()):
        place = F.col("_total").cast("double") - 1
        for name, rank_ in (("low", F.floor(place * share)), ("high", F.ceil(place * share))):
            found.append(F.max(F.when((F.col("_below") <= rank_) & (rank_ < F.col("_below") + F.col("_n")), F.col("_x"))).alias(f"_{name}{k}"))
    ends = v.agg(F.max("_total").alias("_total"), *found)
    place = lambda share: (F.col("_total").cast("double") - 1) * share
    between = lambda k, p: F.when(F.floor(p) == F.ceil(p), F.col(f"_low{k}")).otherwise((F.ceil(p) - p) * F.col(f"_low{k}") + (p - F.floor(p)) * F.col(f"_high{k}"))
    return ends.select(*(between(k, place(share)).alias(name) for k, (name, share) in enumerate(shares.items())))


def trim_mean(df: DataFrame, value: str, share: float, by: list[str]) -> DataFrame:
    """Mean without the outer ``share``, the same number of rows at both ends; repeated values are cut within."""
    v = _values(df, value, by)
    cut = F.floor(F.col("_total") * share / 2)
    kept = F.greatest(F.lit(0), F.least(F.col("_below") + F.col("_n"), F.col("_total") - cut) - F.greatest(F.col("_below"), cut))
    return v.groupBy(*by).agg((F.sum(F.col(value) * kept) / F.sum(kept)).alias("trim_mean"))


def modes(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """MODE.MULT: all values with the highest count, if that is over one."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.max("n").alias("n"))
    return counts.join(best, [*by, "n"]).where("n > 1").select(*by, F.col(value).alias("mode"), "n")


def mean_deviation(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """AVEDEV: two aggregations, the means joined back."""
    means = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    paired = df.join(means, by) if by else df.join(F.broadcast(means))  # without groups the means are one row
    return paired.groupBy(*by).agg(F.avg(F.abs(F.col(value) - F.col("_mean"))).alias("avedev"))


def frequency(df: DataFrame, value: str, bins: list[float], by: list[str] | None = None) -> DataFrame:
    """Counts of values at or below each bin and above the one before, and above the last; empty bins count 0."""
    edges = sorted(bins)
    place = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        place = F.when(F.col(value) <= edges[k], k).otherwise(place)
    counts = df.where(F.col(value).isNotNull()).groupBy(*(by or []), place.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    if by:
        grid = counts.select(*by).distinct().join(F.broadcast(grid))
    return grid.join(counts, [*(by or []), "bin"], "left").select(*(by or []), "bin", F.coalesce("n", F.lit(0)).alias("n"))
