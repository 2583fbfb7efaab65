"""Forecasts of series, one per group: moving average, exponential smoothing, a line, and additive ETS.

A group's series comes together by ``applyInPandas``: it is the unit that a recursive fit needs, and it should be an
aggregated one (days, months), not raw events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import special as S


def moving_average(df: DataFrame, value: str, order: str, by: list[str], window: int) -> DataFrame:
    """Mean of the last ``window`` values of each series: its forecast at every horizon."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= window).groupBy(*by).agg(F.avg(value).alias("forecast"))


def _series(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value].cast("double")).alias("_xs"))


def exponential(df: DataFrame, value: str, order: str, by: list[str], alpha: float) -> DataFrame:
    """Simple smoothing from the first value on; the same forecast at every horizon."""
    level = F.reduce(F.slice("_xs", 2, F.size("_xs")), F.element_at("_xs", 1), lambda s, x: s * (1 - alpha) + x * alpha)
    return _series(df, value, order, by).select(*by, level.alias("forecast"))


def double_exponential(df: DataFrame, value: str, order: str, by: list[str], alpha: float, beta: float, horizon: int = 1) -> DataFrame:
    """Holt's level and trend, started from the first value and step."""
    start = F.struct(F.element_at("_xs", 1).alias("level"), (F.try_element_at("_xs", F.lit(2)) - F.element_at("_xs", 1)).alias("trend"))

    def step(s: Column, x: Column) -> Column:
        level = alpha * x + (1 - alpha) * (s["level"] + s["trend"])
        return F.struct(level.alias("level"), (beta * (level - s["level"]) + (1 - beta) * s["trend"]).alias("trend"))

    last = F.reduce(F.slice("_xs", 2, F.size("_xs")), start, step)
    return _series(df, value, order, by).select(*by, (last["level"] + horizon * last["trend"]).alias("forecast"))


def line(df: DataFrame, value: str, order: str, by: list[str], horizon: int = 1) -> DataFrame:
    """A least-squares line over the places 1, 2, ... of each series."""
    placed = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("double"))
    y, x = F.col(value).cast("double"), F.col("_k")
    return placed.groupBy(*by).agg((F.regr_intercept(y, x) + F.regr_slope(y, x) * (F.count("*") + horizon)).alias("forecast"))


# -- additive ETS --------------------------------------------------------------------------------------------------


def season_length(xs: np.ndarray) -> int:
    """The lag of the highest autocorrelation of the detrended series, or 1."""
    n = len(xs)
    if n < 4:
        return 1
    t = np.arange(n)
    rest = xs - np.polyval(np.polyfit(t, xs, 1), t)
    power = float(rest @ rest)
    if power <= 1e-12:
        return 1
    scores = [(float(rest[:-k] @ rest[k:]) / power, -k) for k in range(2, n // 2 + 1)]
    best = max(scores, default=(0.0, -1))
    return -best[1] if best[0] > 0.3 else 1


def _smooth(xs: np.ndarray, m: int, a: float, b: float, g: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Level, trend, seasons at the end, and one-step errors."""
    if m > 1:
        level = xs[:m].mean()
        trend = (xs[m : 2 * m].mean() - level) / m if len(xs) >= 2 * m else 0.0
        season = xs[:m] - level
    else:
        level, trend, season = xs[0], xs[1] - xs[0] if len(xs) > 1 else 0.0, np.zeros(1)
    season, errors = season.astype(float).copy(), np.empty(len(xs))
    for t, x in enumerate(xs):
        s = season[t % m]
        errors[t] = x - (level + trend + s)
        new = a * (x - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        season[t % m] = g * (x - new) + (1 - g) * s if m > 1 else 0.0
        level = new
    return level, trend, season, errors


def fit_ets(xs: np.ndarray, season: int = 1) -> dict:
    """Smoothing factors by a shrinking grid search on the squared errors; ``season`` 1 detects it, 0 means none."""
    m = season_length(xs) if season == 1 else max(season, 1)
    best, centre, width = None, np.array([0.5, 0.1, 0.1]), 0.5
    for _ in range(6):
        axes = [np.unique(np.clip(c + width * np.array([-1, -0.5, 0, 0.5, 1]), 0.001, 0.999)) for c in centre]
        for a in axes[0]:
            for b in axes[1]:
                for g in axes[2] if m > 1 else [0.0]:
                    e = _smooth(xs, m, a, b, g)[3]
                    loss = float(e @ e)
                    if best is None or loss < best[0]:
                        best = (loss, a, b, g)
        centre, width = np.array(best[1:]), width / 2
    level, trend, seasons, errors = _smooth(xs, m, *best[1:])
    n = len(xs)
    naive = np.abs(np.diff(xs)).mean() if n > 1 else np.nan
    fitted = xs - errors
    scale = np.abs(xs) + np.abs(fitted)
    return {
        "alpha": best[1], "beta": best[2], "gamma": best[3], "season": m, "level": level, "trend": trend, "seasons": seasons, "n": n,
        "mase": np.abs(errors).mean() / naive if naive else np.nan, "smape": (2 * np.abs(errors) / np.where(scale == 0, 1, scale)).mean(),
        "mae": np.abs(errors).mean(), "rmse": float(np.sqrt((errors**2).mean())),
    }


def ets_at(fit: dict, horizon: int, confidence: float = 0.95) -> tuple[float, float]:
    """Forecast and half width of its interval, ``horizon`` steps after the last point."""
    a, b, g, m = fit["alpha"], fit["beta"], fit["gamma"], fit["season"]
    mean = fit["level"] + horizon * fit["trend"] + (fit["seasons"][(fit["n"] + horizon - 1) % m] if m > 1 else 0.0)
    weights = [a * (1 + j * b) + (g * (1 - a) if m > 1 and j % m == 0 else 0.0) for j in range(1, horizon)]
    spread = fit["rmse"] * float(np.sqrt(1 + np.sum(np.square(weights))))
    return float(mean), float(S.norm_inv(np.array([(1 + confidence) / 2]))[0] * spread)


def ets(df: DataFrame, value: str, order: str, by: list[str], horizon: int = 1, season: int = 1, confidence: float = 0.95) -> DataFrame:
    """One row per series: forecast, half width, season and the fit statistics."""
    names = ["forecast", "half_width", "season", "alpha", "beta", "gamma", "mase", "smape", "mae", "rmse"]
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), *(f"{n} {'int' if n == 'season' else 'double'}" for n in names)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        fit = fit_ets(group.sort_values(order)[value].to_numpy(float), season)
        mean, half = ets_at(fit, horizon, confidence)
        return pd.DataFrame([[*(group[b].iloc[0] for b in by), mean, half, *(fit[n] for n in names[2:])]], columns=[*by, *names])

    return df.select(*by, order, F.col(value).cast("double")).groupBy(*by).applyInPandas(run, schema)
