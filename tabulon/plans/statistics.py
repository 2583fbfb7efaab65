"""Queries of distributions, regressions, tests and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import distributions  # noqa: F401  it fills the catalogue
from tabulon.functions.registry import value
from tabulon.operators import forecast, inference
from tabulon.plans.registry import query, r, rs, scalars
from tabulon.sources.tables import table


def _x():
    return F.col("l_discount") * 10 + 0.1


def _d(name, *args):
    return lambda: r(value(name, _x(), *args), 6)


_X = "(l_discount * 10 + 0.1)"
scalars(
    "distributions_closed",
    "lineitem",
    ["l_orderkey", "l_linenumber"],
    {
        "phi": (_d("PHI"), rs(f"exp(-{_X} * {_X} / 2) / sqrt(2 * pi())", 6)),
        "norm_pdf": (_d("NORM.DIST", 0.5, 0.3, False), rs(f"exp(-power(({_X} - 0.5) / 0.3, 2) / 2) / (0.3 * sqrt(2 * pi()))", 6)),
        "lognorm_pdf": (_d("LOGNORM.DIST", 0.1, 0.7, False), rs(f"exp(-power((ln({_X}) - 0.1) / 0.7, 2) / 2) / ({_X} * 0.7 * sqrt(2 * pi()))", 6)),
        "expon_cdf": (_d("EXPON.DIST", 1.5, True), rs(f"1 - exp(-1.5 * {_X})", 6)),
        "expon_pdf": (_d("EXPONDIST", 1.5, False), rs(f"1.5 * exp(-1.5 * {_X})", 6)),
        "weibull_cdf": (_d("WEIBULL.DIST", 2.0, 1.5, True), rs(f"1 - exp(-power({_X} / 1.5, 2))", 6)),
        "weibull_pdf": (_d("WEIBULL", 2.0, 1.5, False), rs(f"2 / 2.25 * {_X} * exp(-power({_X} / 1.5, 2))", 6)),
        "standardize": (_d("STANDARDIZE", 0.5, 0.2), rs(f"({_X} - 0.5) / 0.2", 6)),
        "fisher": (lambda: r(value("FISHER", F.col("l_discount") * 5), 6), rs("CASE WHEN l_discount * 5 < 1 THEN atanh(l_discount * 5) END", 6)),
        "fisherinv": (_d("FISHERINV"), rs(f"tanh({_X})", 6)),
        # Two degrees of freedom, one shape parameter of 1 and the like have closed forms to hold the general code against.
        "gamma_cdf": (_d("GAMMA.DIST", 1.0, 2.0, True), rs(f"1 - exp(-{_X} / 2)", 6)),
        "gamma2_cdf": (_d("GAMMADIST", 2.0, 1.0, True), rs(f"1 - exp(-{_X}) * (1 + {_X})", 6)),
        "chisq2_rt": (_d("CHISQ.DIST.RT", 2), rs(f"exp(-{_X} / 2)", 6)),
        "chisq4_cdf": (_d("CHISQ.DIST", 4, True), rs(f"1 - exp(-{_X} / 2) * (1 + {_X} / 2)", 6)),
        "t1_cdf": (_d("T.DIST", 1, True), rs(f"0.5 + atan({_X}) / pi()", 6)),
        "t2_cdf": (_d("T.DIST", 2, True), rs(f"0.5 + {_X} / (2 * sqrt(2 + {_X} * {_X}))", 6)),
        "f_2_2": (_d("F.DIST", 2, 2, True), rs(f"{_X} / (1 + {_X})", 6)),
        "beta_2_1": (lambda: r(value("BETA.DIST", _x() / 2, 2.0, 1.0, True), 6), rs(f"power({_X} / 2, 2)", 6)),
        "poisson_cdf": (lambda: r(value("POISSON.DIST", 2, _x(), True), 6), rs(f"exp(-{_X}) * (1 + {_X} + {_X} * {_X} / 2)", 6)),
        "poisson_pmf": (lambda: r(value("POISSON", 3, _x(), False), 6), rs(f"exp(-{_X}) * power({_X}, 3) / 6", 6)),
        "binom_pmf": (lambda: r(value("BINOM.DIST", 1, 3, _x() / 2, False), 6), rs(f"3 * ({_X} / 2) * power(1 - {_X} / 2, 2)", 6)),
        "binom_cdf": (lambda: r(value("BINOMDIST", 1, 3, _x() / 2, True), 6), rs(f"power(1 - {_X} / 2, 3) + 3 * ({_X} / 2) * power(1 - {_X} / 2, 2)", 6)),
        "negbinom": (lambda: r(value("NEGBINOM.DIST", 2, 2, _x() / 2, False), 6), rs(f"3 * power({_X} / 2, 2) * power(1 - {_X} / 2, 2)", 6)),
        "gammaln_5": (lambda: r(value("GAMMALN", F.lit(5.0)), 6), rs("ln(24.0)", 6)),
        "gamma_fn": (lambda: r(value("GAMMA", F.col("l_linenumber")), 4), "factorial(l_linenumber - 1)::DOUBLE"),
        "norm_median": (lambda: r(value("NORM.INV", 0.5, _x(), 2.0), 6), rs(_X, 6)),
        "chiinv2": (lambda: r(value("CHIINV", _x() / 2, 2), 5), rs(f"-2 * ln({_X} / 2)", 5)),
        "finv_2_2": (lambda: r(value("F.INV", _x() / 2, 2, 2), 5), rs(f"({_X} / 2) / (1 - {_X} / 2)", 5)),
        "tinv_1": (lambda: r(value("T.INV", _x() / 2, 1), 5), rs(f"tan(pi() * ({_X} / 2 - 0.5))", 5)),
        "betainv_1_2": (lambda: r(value("BETAINV", _x() / 2, 2.0, 1.0), 6), rs(f"sqrt({_X} / 2)", 6)),
        "gammainv_1": (lambda: r(value("GAMMA.INV", _x() / 2, 1.0, 3.0), 5), rs(f"-3 * ln(1 - {_X} / 2)", 5)),
    },
)


@query("distributions_inverse")
def distributions_inverse(spark, folder):
    """Quantiles and the probabilities at them, which give the first column back."""
    p = (F.col("s_suppkey") % 97 + 1) / 100.0
    df = table(spark, folder, "supplier").select("s_suppkey", p.alias("p"))
    pairs = {
        "norm_s": ("NORM.S.INV", (), "NORM.S.DIST", (True,)), "lognorm": ("LOGNORM.INV", (1.0, 0.5), "LOGNORM.DIST", (1.0, 0.5, True)), "t": ("T.INV", (7,), "T.DIST", (7, True)),
        "f": ("F.INV", (4, 9), "F.DIST", (4, 9, True)), "chisq": ("CHISQ.INV", (5,), "CHISQ.DIST", (5, True)), "gamma": ("GAMMA.INV", (2.5, 1.5), "GAMMA.DIST", (2.5, 1.5, True)),
        "beta": ("BETA.INV", (2.0, 3.5), "BETA.DIST", (2.0, 3.5, True)),
    }
    for name, (inverse, args, forward, more) in pairs.items():
        df = df.withColumn(f"{name}_x", value(inverse, F.col("p"), *args)).withColumn(f"{name}_p", value(forward, F.col(f"{name}_x"), *more))
    return df.withColumn("binom_k", value("BINOM.INV", 20, 0.3, F.col("p"))).withColumn("hypgeom", value("HYPGEOM.DIST", 1, 4, 8, 20, False)).withColumn("ci", value("CONFIDENCE.T", 0.05, 1.0, 50))


_PAIRS = {
    "slope": ("SLOPE", "regr_slope(y, x)"), "intercept": ("INTERCEPT", "regr_intercept(y, x)"), "rsq": ("RSQ", "regr_r2(y, x)"), "correl": ("CORREL", "corr(y, x)"),
    "pearson": ("PEARSON", "corr(y, x)"), "covar_p": ("COVARIANCE.P", "covar_pop(y, x)"), "covar_s": ("COVARIANCE.S", "covar_samp(y, x)"), "covar": ("COVAR", "covar_pop(y, x)"),
    "steyx": ("STEYX", "sqrt((regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2))"),
}


@query("regression", "SELECT l_returnflag, " + ", ".join(f"{rs(s, 3)} AS {a}" for a, (_, s) in _PAIRS.items()) + f", {rs('regr_intercept(y, x) + 60 * regr_slope(y, x)', 2)} AS forecast FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS x FROM lineitem) GROUP BY 1")
def regression(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.groupBy("l_returnflag").agg(
        *(r(value(n, "l_extendedprice", "l_quantity"), 3).alias(a) for a, (n, _) in _PAIRS.items()), r(value("FORECAST", 60, "l_extendedprice", "l_quantity"), 2).alias("forecast")
    )


@query("trend_lines", f"WITH l AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1) SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity, {rs('a + b * l_quantity', 2)} AS fitted FROM lineitem JOIN l USING (l_returnflag)")
def trend_lines(spark, folder):
    out = inference.trend(table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity", r(F.col("fitted"), 2).alias("fitted"))


@query("growth_lines")
def growth_lines(spark, folder):
    out = inference.trend(table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"], growth=True)
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "fitted")


@query("hypothesis_tests")
def hypothesis_tests(spark, folder):
    df = table(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_quantity") * 0.5 + F.col("l_linenumber") * 3.0 + 1).alias("y"))
    by = ["l_returnflag"]
    out = inference.t_test(df, "x", "y", 2, 1, by).withColumnRenamed("p", "paired")
    for name, other in {
        "equal": inference.t_test(df, "x", "y", 2, 2, by), "unequal": inference.t_test(df, "x", "y", 2, 3, by), "variance": inference.f_test(df, "x", "y", by),
        "z": inference.z_test(df, "x", 25.5, by), "chisq": inference.chisq_test(df, "x", "y", by),
    }.items():
        out = out.join(other.withColumnRenamed("p", name), "l_returnflag")
    return out


_MONTHLY = "(SELECT l_returnflag, date_trunc('month', l_shipdate)::DATE AS m, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


def _monthly(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.groupBy("l_returnflag", F.trunc("l_shipdate", "month").alias("m")).agg(F.sum("l_quantity").alias("q"))


@query("forecast_moving_average", f"SELECT l_returnflag, {rs('avg(q)')} AS forecast FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY m DESC) AS k FROM {_MONTHLY}) WHERE k <= 6 GROUP BY 1")
def forecast_moving_average(spark, folder):
    return forecast.moving_average(_monthly(spark, folder), "q", "m", ["l_returnflag"], 6).select("l_returnflag", r(F.col("forecast")).alias("forecast"))


@query("forecast_line", f"SELECT l_returnflag, {rs('regr_intercept(q, k) + regr_slope(q, k) * (count(*) + 3)', 3)} AS forecast FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY m) AS k FROM {_MONTHLY}) GROUP BY 1")
def forecast_line(spark, folder):
    return forecast.line(_monthly(spark, folder), "q", "m", ["l_returnflag"], 3).select("l_returnflag", r(F.col("forecast"), 3).alias("forecast"))


@query("forecast_exponential", f"SELECT l_returnflag, {rs('list_reduce(list(q ORDER BY m), lambda s, x: s * 0.7 + x * 0.3)', 3)} AS forecast FROM {_MONTHLY} GROUP BY 1")
def forecast_exponential(spark, folder):
    return forecast.exponential(_monthly(spark, folder), "q", "m", ["l_returnflag"], 0.3).select("l_returnflag", r(F.col("forecast"), 3).alias("forecast"))


_HOLT = f"""WITH RECURSIVE s AS (SELECT l_returnflag, q::DOUBLE AS q, row_number() OVER w AS k, lead(q) OVER w - q AS step FROM {_MONTHLY} WINDOW w AS (PARTITION BY l_returnflag ORDER BY m)),
    h AS (
        SELECT l_returnflag, k, q AS level, step::DOUBLE AS trend FROM s WHERE k = 1
        UNION ALL
        SELECT s.l_returnflag, s.k, 0.4::DOUBLE * s.q + 0.6::DOUBLE * (h.level + h.trend),
            0.2::DOUBLE * (0.4::DOUBLE * s.q + 0.6::DOUBLE * (h.level + h.trend) - h.level) + 0.8::DOUBLE * h.trend
        FROM h JOIN s ON s.l_returnflag = h.l_returnflag AND s.k = h.k + 1)
    SELECT l_returnflag, {rs('max_by(level, k) + 2 * max_by(trend, k)', 3)} AS forecast FROM h GROUP BY 1"""


@query("forecast_holt", _HOLT)
def forecast_holt(spark, folder):
    return forecast.double_exponential(_monthly(spark, folder), "q", "m", ["l_returnflag"], 0.4, 0.2, 2).select("l_returnflag", r(F.col("forecast"), 3).alias("forecast"))


@query("forecast_ets")
def forecast_ets(spark, folder):
    return forecast.ets(_monthly(spark, folder), "q", "m", ["l_returnflag"], horizon=3)


@query("spearman")
def spearman(spark, folder):
    return inference.correlation_of_ranks(table(spark, folder, "part"), "p_size", "p_retailprice", ["p_brand"])
