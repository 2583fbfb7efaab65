"""Runs: draws, trials, statistics of runs and of distributions.

A uniform number is a hash of seed, input and trial, so a run gives the same trials on any number of executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import special as S
from tabulon.functions.registry import col, function, num
from tabulon.functions.vector import vector
from tabulon.operators.ranking import percentiles
from tabulon.simulation.quantiles import ALT_NAMES, QUANTILES, Columns, array_quantile, solve_percentiles


def uniform(seed: int, name: str, trial: Column | None = None) -> Column:
    """In (0, 1): 53 bits of a hash."""
    trial = F.col("trial") if trial is None else trial
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), trial), F.lit(2**53)) + 0.5) / float(2**53)


def draw(distribution: str, *parameters, u: Column, shift: float = 0.0, bounds: tuple | None = None, share: tuple | None = None) -> Column:
    """A draw; ``bounds`` cuts by value (PsiTruncate), ``share`` by probability (PsiTruncateP), ``shift`` comes last."""
    name = distribution.upper()
    if name.endswith("ALT"):
        parameters, name = tuple(solve_percentiles(name, *parameters)), name.removesuffix("ALT")
    if bounds:
        share = tuple(b if b is None else cumulative(name, parameters, b) for b in bounds)
    if share:
        low, high = share[0] or 0.0, 1.0 if share[1] is None else share[1]
        u = low + u * (high - low)
    out = QUANTILES[name](Columns, u, *parameters)
    return out + shift if shift else out


def cumulative(name: str, parameters: tuple, x: float) -> float:
    """P(X <= x), by bisection of the quantile function."""
    q, low, high = array_quantile(name, *parameters), 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float(q(np.array([mid]))[0]) <= x else (low, mid)
    return (low + high) / 2


Input = tuple  # (distribution, parameters...) or a dict of draw's arguments


def simulate(
    spark: SparkSession,
    trials: int,
    inputs: dict[str, Input],
    outputs: dict[str, Callable[[], Column] | Column],
    seed: int = 42,
    partitions: int | None = None,
    overrides: dict[str, float | Input] | None = None,
) -> DataFrame:
    """A row per trial with all inputs and outputs; outputs may use inputs and the outputs before them.

    ``overrides`` puts a number or another distribution in the place of inputs; the others draw what they drew before.
    """
    if unknown := set(overrides or {}) - set(inputs):
        raise KeyError(f"no input named {sorted(unknown)}")
    inputs = inputs | {k: v if isinstance(v, tuple) else ("PSIUNIFORM", float(v), float(v)) for k, v in (overrides or {}).items()}
    df = spark.range(0, trials, 1, partitions).withColumnRenamed("id", "trial")
    df = df.select("trial", *(draw(d, *p, u=uniform(seed, name)).alias(name) for name, (d, *p) in inputs.items()))
    for name, make in outputs.items():
        df = df.withColumn(name, make() if callable(make) else make)
    return df


def correlated(spark: SparkSession, trials: int, means: list[float], covariance: list[list[float]], seed: int = 42, log: bool = False) -> DataFrame:
    """PsiMVNormal and PsiMVLogNormal: columns x1, x2, ... from independent normals and a Cholesky factor."""
    root = np.linalg.cholesky(np.asarray(covariance, float))
    z = [draw("PSINORMAL", 0.0, 1.0, u=uniform(seed, f"z{k}")).alias(f"z{k}") for k in range(len(means))]
    df = spark.range(trials).withColumnRenamed("id", "trial").select("trial", *z)
    out = []
    for i, mean in enumerate(means):
        x = F.lit(float(mean))
        for k in range(i + 1):
            x = x + float(root[i, k]) * F.col(f"z{k}")
        out.append((F.exp(x) if log else x).alias(f"x{i + 1}"))
    return df.select("trial", *out)


def resampled(trials: DataFrame, data: DataFrame, order: str, seed: int = 42) -> DataFrame:
    """PsiMVResample and PsiMVShuffle: a whole row of ``data`` for each trial, drawn with replacement."""
    from tabulon.operators.lookup import zip_with_position

    placed = zip_with_position(data, order)
    n = data.count()
    picked = trials.withColumn("position", (F.floor(uniform(seed, "row") * n) + 1).cast("bigint"))
    return picked.join(placed, "position").drop("position")


def convergence(df: DataFrame, output: str) -> DataFrame:
    """Mean and the half width of its 95 % interval."""
    return df.agg(F.avg(output).alias("mean"), (1.96 * F.stddev_samp(output) / F.sqrt(F.count(output))).alias("half_width"))


# -- statistics of a run, as aggregates ------------------------------------------------------------------------------


def _s(name: str):
    return function(name, family="run statistics", kind="aggregate")


_mean = lambda c, f: F.avg(f(num(c)))
_s("PSIMEAN")(lambda c: F.avg(num(c)))
_s("PSISTDDEV")(lambda c: F.stddev_samp(num(c)))
_s("PSIVARIANCE")(lambda c: F.var_samp(num(c)))
_s("PSICOUNT")(lambda c: F.count(num(c)))
_s("PSIRANGE")(lambda c: F.max(num(c)) - F.min(num(c)))
_s("PSIPERCENTILE")(lambda c, p: F.percentile(num(c), p))
_s("PSIPTOX")(lambda c, p: F.percentile(num(c), p))
_s("PSIQTOX")(lambda c, q: F.percentile(num(c), 1 - q))
_s("PSIBVAR")(lambda c, p: -F.percentile(num(c), 1 - p))
_s("PSITARGET")(lambda c, x: _mean(c, lambda v: (v <= x).cast("double")))
_s("PSIXTOP")(lambda c, x: _mean(c, lambda v: (v <= x).cast("double")))
_s("PSIXTOQ")(lambda c, x: _mean(c, lambda v: (v > x).cast("double")))
_s("PSIFREQUENCY")(lambda c, a, b: _mean(c, lambda v: v.between(a, b).cast("double")))
_s("PSICOEFFVAR")(lambda c: F.stddev_samp(num(c)) / F.avg(num(c)))
_s("PSISTDERR")(lambda c: F.stddev_samp(num(c)) / F.sqrt(F.count(num(c))))
_s("PSIEXPGAIN")(lambda c, t: _mean(c, lambda v: F.greatest(v - t, F.lit(0.0))))
_s("PSIEXPLOSS")(lambda c, t: _mean(c, lambda v: F.greatest(t - v, F.lit(0.0))))
_s("PSIEXPGAINRATIO")(lambda c, t: _mean(c, lambda v: F.greatest(v - t, F.lit(0.0))) / _mean(c, lambda v: F.greatest(t - v, F.lit(0.0))))
_s("PSIEXPLOSSRATIO")(lambda c, t: _mean(c, lambda v: F.greatest(t - v, F.lit(0.0))) / _mean(c, lambda v: F.greatest(v - t, F.lit(0.0))))
_s("PSIEXPVALMARGIN")(lambda c, t: F.avg(num(c)) - t)
_s("PSISEMIVAR2")(lambda c, t: _mean(c, lambda v: F.pow(F.greatest(t - v, F.lit(0.0)), 2)))
_s("PSISEMIDEV2")(lambda c, t: F.sqrt(_mean(c, lambda v: F.pow(F.greatest(t - v, F.lit(0.0)), 2))))
_s("PSICORRELATION")(lambda a, b: F.corr(num(a), num(b)))
_s("PSISKEWNESS")(lambda c: F.skewness(num(c)) * F.sqrt(F.count(num(c)) * (F.count(num(c)) - 1.0)) / (F.count(num(c)) - 2))
_s("PSIKURTOSIS")(lambda c: (F.count(num(c)) - 1.0) / ((F.count(num(c)) - 2.0) * (F.count(num(c)) - 3)) * ((F.count(num(c)) + 1) * F.kurtosis(num(c)) + 6) + 3)


def two_pass(df: DataFrame, output: str, p: float = 0.05) -> DataFrame:
    """Statistics that need the mean or a percentile first: absdev, semivar, semidev and cvar, in one row.

    The first pass is one row, which is sent to all tasks of the second; its percentile is exact and made in ranges.
    """
    first = df.agg(F.avg(output).alias("_mean")).join(F.broadcast(percentiles(df, output, {"_cut": p})))
    x = num(output)
    short = F.greatest(F.col("_mean") - x, F.lit(0.0))
    return df.join(F.broadcast(first)).agg(
        F.avg(F.abs(x - F.col("_mean"))).alias("absdev"),
        F.avg(short * short).alias("semivar"),
        F.sqrt(F.avg(short * short)).alias("semidev"),
        (-F.avg(F.when(x <= F.col("_cut"), x))).alias("cvar"),
    )


def data(df: DataFrame, output: str, trial: int | None = None) -> DataFrame:
    """PsiData and PsiSimData: the value of one trial, or of all."""
    out = df.select("trial", output)
    return out if trial is None else out.where(F.col("trial") == trial)


# -- statistics of a distribution -----------------------------------------------------------------------------------


def theoretical(spark: SparkSession, distribution: str, *parameters, points: int = 100_000) -> DataFrame:
    """Moments by the midpoint rule over the quantile function, and quantiles at fixed probabilities, in one row."""
    name = distribution.upper()
    q = lambda p: F.max(F.when(F.col("_p") == p, F.col("x")))
    grid = spark.range(points).select((F.lit(0.0) + (F.col("id") + 0.5) / points).alias("_p"), F.lit(True).alias("_grid"))
    marks = spark.createDataFrame([(1e-9, False), (0.5, False), (1 - 1e-9, False)], "_p double, _grid boolean")
    both = grid.unionByName(marks).withColumn("x", QUANTILES[name](Columns, F.col("_p"), *parameters))
    x = F.when(F.col("_grid"), F.col("x"))
    return both.agg(
        F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("stddev"), F.skewness(x).alias("skewness"), (F.kurtosis(x) + 3).alias("kurtosis"),
        q(1e-9).alias("min"), q(0.5).alias("median"), q(1 - 1e-9).alias("max"),
    ).withColumn("range", F.col("max") - F.col("min"))


def theoretical_at(distribution: str, *parameters, p: float | None = None, x: float | None = None) -> float:
    """PsiTheoPercentile / PtoX at p, PsiTheoXtoP / Target at x; upper tails are these at 1 - p, or one minus these."""
    if p is not None:
        return float(array_quantile(distribution, *parameters)(np.array([p]))[0])
    return cumulative(distribution.upper(), parameters, x)


def theoretical_mode(distribution: str, *parameters, cells: int = 2000) -> float:
    """Middle of the quantile step that is the shortest for its share."""
    q = array_quantile(distribution, *parameters)(np.linspace(0.0005, 0.9995, cells))
    k = int(np.argmin(np.diff(q)))
    return float((q[k] + q[k + 1]) / 2)


# -- six sigma ------------------------------------------------------------------------------------------------------


def six_sigma(c, lsl: float, usl: float, target: float | None = None, shift: float = 1.5) -> dict[str, Column]:
    """Capability statistics of an output against its limits, as aggregates by name."""
    c = num(col(c))
    mean, sd = F.avg(c), F.stddev_samp(c)
    middle = (lsl + usl) / 2
    target = middle if target is None else target
    upper, lower = (usl - mean) / sd, (mean - lsl) / sd
    defects = F.avg(((c < lsl) | (c > usl)).cast("double"))
    tail = lambda z: vector(S.norm_cdf, -z)
    nearer_upper = upper < lower
    to_upper = lambda: tail(upper - shift) + tail(lower + shift)
    to_lower = lambda: tail(upper + shift) + tail(lower - shift)
    either = F.when(nearer_upper, to_upper()).otherwise(to_lower())
    return {
        "PSISIGMACP": (usl - lsl) / (6 * sd), "PSISIGMACPK": F.least(upper, lower) / 3, "PSISIGMACPKLOWER": lower / 3, "PSISIGMACPKUPPER": upper / 3,
        "PSISIGMACPM": (usl - lsl) / (6 * F.sqrt(sd * sd + (mean - target) * (mean - target))), "PSISIGMAK": (mean - middle) / ((usl - lsl) / 2),
        "PSISIGMALOWERBOUND": F.lit(float(lsl)), "PSISIGMAUPPERBOUND": F.lit(float(usl)), "PSISIGMAZLOWER": lower, "PSISIGMAZUPPER": upper,
        "PSISIGMAZMIN": F.least(upper, lower), "PSISIGMASIGMALEVEL": F.least(upper, lower), "PSISIGMAYIELD": 1 - defects, "PSISIGMADEFECTPPM": defects * 1e6,
        "PSISIGMAPROBDEFECTSHIFT": either, "PSISIGMAPROBDEFECTSHIFTLOWER": to_lower(), "PSISIGMAPROBDEFECTSHIFTUPPER": to_upper(),
        "PSISIGMADEFECTSHIFTPPM": either * 1e6, "PSISIGMADEFECTSHIFTPPMLOWER": to_lower() * 1e6, "PSISIGMADEFECTSHIFTPPMUPPER": to_upper() * 1e6,
    }


ALTS = ALT_NAMES
