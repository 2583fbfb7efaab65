"""Statistical tests and regression lines over groups: aggregated moments first, then one call on few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import special as S
from tabulon.functions.vector import vector


def _moments(x: Column, name: str) -> list[Column]:
    return [F.count(x).cast("double").alias(f"{name}_n"), F.avg(x).alias(f"{name}_mean"), F.var_samp(x).alias(f"{name}_var")]


def t_test(df: DataFrame, x: str, y: str, tails: int, kind: int, by: list[str]) -> DataFrame:
    """Types 1 (paired), 2 (equal variances), 3 (unequal variances)."""
    if kind == 1:
        d = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(x) - F.col(y))
        m = df.groupBy(*by).agg(*_moments(d, "d"))
        t, free = F.abs(F.col("d_mean")) / F.sqrt(F.col("d_var") / F.col("d_n")), F.col("d_n") - 1
    else:
        m = df.groupBy(*by).agg(*_moments(F.col(x), "x"), *_moments(F.col(y), "y"))
        nx, ny, vx, vy = (F.col(c) for c in ("x_n", "y_n", "x_var", "y_var"))
        if kind == 2:
            free = nx + ny - 2
            pooled = ((nx - 1) * vx + (ny - 1) * vy) / free
            scale = F.sqrt(pooled * (1 / nx + 1 / ny))
        else:
            a, b = vx / nx, vy / ny
            scale, free = F.sqrt(a + b), (a + b) * (a + b) / (a * a / (nx - 1) + b * b / (ny - 1))
        t = F.abs(F.col("x_mean") - F.col("y_mean")) / scale
    return m.select(*by, (vector(lambda t, k: S.t_cdf(-t, k), t, free) * tails).alias("p"))


def f_test(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Two-tailed p of the ratio of two variances."""
    m = df.groupBy(*by).agg(*_moments(F.col(x), "x"), *_moments(F.col(y), "y"))
    cdf = vector(S.f_cdf, F.col("x_var") / F.col("y_var"), F.col("x_n") - 1, F.col("y_n") - 1)
    return m.select(*by, cdf.alias("_c")).select(*by, F.least(F.lit(1.0), 2 * F.least("_c", 1 - F.col("_c"))).alias("p"))


def z_test(df: DataFrame, x: str, mean: float, by: list[str], sigma: float | None = None) -> DataFrame:
    m = df.groupBy(*by).agg(*_moments(F.col(x), "x"))
    scale = F.lit(sigma) if sigma is not None else F.sqrt("x_var")
    return m.select(*by, vector(lambda z: S.norm_cdf(-z), (F.col("x_mean") - mean) * F.sqrt("x_n") / scale).alias("p"))


def chisq_test(df: DataFrame, actual: str, expected: str, by: list[str]) -> DataFrame:
    """Right tail with one degree of freedom less than there are cells."""
    part = F.pow(F.col(actual) - F.col(expected), 2) / F.col(expected)
    m = df.groupBy(*by).agg(F.sum(part).alias("_x"), (F.count("*") - 1).cast("double").alias("_k"))
    return m.select(*by, vector(lambda x, k: S.gammaincc(k / 2, x / 2), "_x", "_k").alias("p"))


def trend(df: DataFrame, y: str, x: str, by: list[str], growth: bool = False, new: DataFrame | None = None) -> DataFrame:
    """TREND, or GROWTH on logarithms: fitted values at the rows of ``new`` (or of ``df``)."""
    target = F.ln(F.col(y)) if growth else F.col(y)
    line = df.groupBy(*by).agg(F.regr_slope(target, F.col(x)).alias("_b"), F.regr_intercept(target, F.col(x)).alias("_a"))
    rows = new if new is not None else df
    joined = rows.join(line, by) if by else rows.join(F.broadcast(line))
    fitted = F.col("_a") + F.col("_b") * F.col(x)
    return joined.withColumn("fitted", F.exp(fitted) if growth else fitted).drop("_a", "_b")


def correlation_of_ranks(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Spearman's rho: Pearson's r of average ranks."""
    from tabulon.operators.ranking import rank

    a = rank(df, x, by, ascending=True).withColumnRenamed("rank_avg", "_rx").drop("rank_eq")
    b = rank(a, y, by, ascending=True)
    return b.groupBy(*by).agg(F.corr("_rx", "rank_avg").alias("rho"))
