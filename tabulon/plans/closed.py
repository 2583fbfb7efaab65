"""Queries whose SQL states closed forms: functions and distributions that SQL has no name for.

Normal tails, Bessel functions and the like are midpoint sums in SQL; distributions without a closed quantile are held
to give their probabilities back through a cumulative function of the catalogue.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabulon.functions import datetime, distributions, engineering, finance, logic, matrix, text  # noqa: F401  they fill the catalogue
from tabulon.functions.registry import cell, error, value
from tabulon.plans.registry import query, r, rs, scalars
from tabulon.sources.tables import spread, table


def _lit_list(xs) -> str:
    return "[" + ", ".join(map(str, xs)) + "]"


def _sum(term: str, low: str, high: str, points: int = 2000) -> str:
    """SQL of an integral over ``t`` by the midpoint rule."""
    step = f"(({high}) - ({low})) / {points}"
    inner = term.replace("@t", f"(({low}) + (k + 0.5) * {step})")
    return f"(list_sum(list_transform(range(0, {points}), lambda k: {inner})) * {step})"


def _gauss(z: str) -> str:
    """SQL of the normal distribution between 0 and z."""
    return f"({_sum('exp(-@t * @t / 2)', '0', z)} / sqrt(2 * pi()))"


# -- information, higher order, bases, text, dates -------------------------------------------------------------------

_ROOT = lambda: cell("SQRT", F.col("p_size") - 20)
_SMALL = lambda: cell("IFS", F.col("p_size") < 10, F.lit("a"))
_GRID = lambda: F.array(F.array(F.col("p_size"), F.lit(2)), F.array(F.lit(3), F.lit(4)))
_TOTAL = lambda xs: F.reduce(xs, F.lit(0), lambda a, x: a + x)
scalars(
    "information_functions",
    "part",
    ["p_partkey"],
    {
        "isref_": (lambda: value("ISREF", F.col("p_name")), "true"),
        "iserror_": (lambda: value("ISERROR", _ROOT()), "p_size < 20"),
        "iserr_num": (lambda: value("ISERR", _ROOT()), "p_size < 20"),
        "iserr_na": (lambda: value("ISERR", _SMALL()), "false"),
        "na_": (lambda: value("NA"), "NULL::DOUBLE"),
        "na_error": (lambda: error("NA"), "'#N/A'"),
        "ifna_": (lambda: value("IFNA", _SMALL(), "none"), "CASE WHEN p_size < 10 THEN 'a' ELSE 'none' END"),
        "true_": (lambda: value("TRUE"), "true"),
        "false_": (lambda: value("FALSE"), "false"),
        "islogical_": (lambda: value("ISLOGICAL", F.col("p_size") > 10), "true"),
        "isformula_": (lambda: value("ISFORMULA", F.concat(F.when(F.col("p_size") > 25, "=").otherwise(""), F.col("p_name"))), "p_size > 25"),
        "isomitted_": (lambda: value("ISOMITTED"), "true"),
        "byrow_": (lambda: value("BYROW", _GRID(), _TOTAL), "[p_size + 2, 7]"),
        "bycol_": (lambda: value("BYCOL", _GRID(), _TOTAL), "[p_size + 3, 6]"),
        "makearray_": (lambda: F.flatten(value("MAKEARRAY", 2, 2, lambda i, j: i * 10 + j + F.col("p_size"))), "[p_size + 11, p_size + 12, p_size + 21, p_size + 22]"),
    },
)

_N = lambda: F.col("n_nationkey")
_BIN, _HEX = "bin(n_nationkey)", "upper(to_hex(n_nationkey))"
_OCT = "CASE WHEN n_nationkey >= 8 THEN (n_nationkey // 8)::VARCHAR ELSE '' END || (n_nationkey % 8)::VARCHAR"
scalars(
    "base_conversions",
    "nation",
    ["n_nationkey"],
    {
        "bin2dec": (lambda: value("BIN2DEC", value("DEC2BIN", _N())), "n_nationkey::DOUBLE"),
        "oct2dec": (lambda: value("OCT2DEC", value("DEC2OCT", _N())), "n_nationkey::DOUBLE"),
        "decimal_": (lambda: value("DECIMAL", value("BASE", _N(), 7), 7), "n_nationkey::DOUBLE"),
        "bin2hex": (lambda: value("BIN2HEX", value("DEC2BIN", _N())), _HEX),
        "bin2oct": (lambda: value("BIN2OCT", value("DEC2BIN", _N())), _OCT),
        "hex2bin": (lambda: value("HEX2BIN", value("DEC2HEX", _N())), _BIN),
        "hex2oct": (lambda: value("HEX2OCT", value("DEC2HEX", _N())), _OCT),
        "oct2bin": (lambda: value("OCT2BIN", value("DEC2OCT", _N())), _BIN),
        "oct2hex": (lambda: value("OCT2HEX", value("DEC2OCT", _N())), _HEX),
        "factdouble_": (lambda: value("FACTDOUBLE", F.col("n_regionkey") + 1), "[1.0, 2.0, 3.0, 8.0, 15.0][n_regionkey + 1]::DOUBLE"),
        "munit_": (lambda: F.flatten(value("MUNIT", 2)), "[1.0, 0.0, 0.0, 1.0]::DOUBLE[]"),
        "sequence_": (lambda: F.flatten(value("SEQUENCE", 2, 2, _N(), 2)), "[n_nationkey, n_nationkey + 2, n_nationkey + 4, n_nationkey + 6]::DOUBLE[]"),
        "roman_": (lambda: value("ROMAN", _N() * 161 + 3), "['', 'M', 'MM', 'MMM'][(n_nationkey * 161 + 3) // 1000 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(n_nationkey * 161 + 3) // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(n_nationkey * 161 + 3) // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][(n_nationkey * 161 + 3) % 10 + 1]"),
        "arabic_": (lambda: value("ARABIC", value("ROMAN", _N() * 161 + 3)), "(n_nationkey * 161 + 3)::DOUBLE"),
    },
)

scalars(
    "text_variants",
    "customer",
    ["c_custkey"],
    {
        "concatenate_": (lambda: value("CONCATENATE", F.col("c_name"), "-", F.col("c_mktsegment")), "c_name || '-' || c_mktsegment"),
        "unicode_": (lambda: value("UNICODE", F.col("c_name")), "unicode(c_name)"),
        "t_": (lambda: value("T", F.col("c_name")), "c_name"),
        "dollar_": (lambda: value("DOLLAR", F.col("c_custkey") * 1000), "'$' || format('{:,}', c_custkey * 1000) || '.00'"),
        "valuetotext_": (lambda: value("VALUETOTEXT", F.col("c_name"), 1), "'\"' || c_name || '\"'"),
        "arraytotext_": (lambda: value("ARRAYTOTEXT", F.array("c_name", "c_mktsegment")), "c_name || ', ' || c_mktsegment"),
        "lenb_": (lambda: value("LENB", F.col("c_name")), "length(c_name)"),
        "leftb_": (lambda: value("LEFTB", F.col("c_name"), 4), "left(c_name, 4)"),
        "rightb_": (lambda: value("RIGHTB", F.col("c_name"), 3), "right(c_name, 3)"),
        "midb_": (lambda: value("MIDB", F.col("c_name"), 3, 5), "substring(c_name, 3, 5)"),
        "findb_": (lambda: value("FINDB", "U", F.col("c_mktsegment")), "nullif(strpos(c_mktsegment, 'U'), 0)"),
        "searchb_": (lambda: value("SEARCHB", "u", F.col("c_mktsegment")), "nullif(strpos(lower(c_mktsegment), 'u'), 0)"),
        "replaceb_": (lambda: value("REPLACEB", F.col("c_name"), 2, 3, "__"), "left(c_name, 1) || '__' || substring(c_name, 5)"),
        "jis_back": (lambda: value("ASC", value("JIS", F.col("c_name"))), "c_name"),
        "jis_length": (lambda: F.octet_length(value("JIS", F.lit("abc"))), "9"),
        "phonetic_": (lambda: value("PHONETIC", F.col("c_name")), "''"),
        "baht": (lambda: value("BAHTTEXT", F.col("c_nationkey") % 3 + 1), "['หนึ่ง', 'สอง', 'สาม'][c_nationkey % 3 + 1] || 'บาทถ้วน'"),
    },
)

scalars(
    "date_variants",
    "orders",
    ["o_orderkey"],
    {
        "networkdays_intl": (
            lambda: value("NETWORKDAYS.INTL", F.col("o_orderdate"), F.date_add(F.col("o_orderdate").cast("date"), 40), 11),
            "len(list_filter(range(0, 41), lambda k: isodow(o_orderdate::DATE + k::INT) <> 7))::INT",
        ),
        "networkdays_mask": (
            lambda: value("NETWORKDAYS.INTL", F.col("o_orderdate"), F.date_add(F.col("o_orderdate").cast("date"), 25), "0101000"),
            "len(list_filter(range(0, 26), lambda k: isodow(o_orderdate::DATE + k::INT) NOT IN (2, 4)))::INT",
        ),
        "now_is_today": (lambda: F.date_diff(value("NOW").cast("date"), value("TODAY").cast("date")), "0"),
    },
)

# -- aggregates ------------------------------------------------------------------------------------------------------

_AT = lambda p: f"(x[floor({p} * (n + 1))::INT] + ({p} * (n + 1) - floor({p} * (n + 1))) * (x[floor({p} * (n + 1))::INT + 1] - x[floor({p} * (n + 1))::INT]))"


@query(
    "aggregate_variants",
    "WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sd, list_sort(list(l_quantity)) AS x, count(*) AS n,"
    " mode(l_quantity % 2) AS mode_, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,"
    " exp(regr_slope(ln(l_extendedprice), l_quantity)) AS g, exp(regr_intercept(ln(l_extendedprice), l_quantity)) AS h FROM lineitem GROUP BY 1)"
    f" SELECT l_returnflag, {rs('(SELECT avg(power((v - mean) / sd, 3)) FROM (SELECT unnest(x) AS v))')} AS skew_p, {_AT(0.25)} AS quartile_exc, {_AT(0.3)} AS percentile_exc,"
    f" mode_ AS mode_sngl, mode_ AS mode_old, {rs('b')} AS slope, {rs('a', 2)} AS level, {rs('g', 6)} AS growth, {rs('h', 2)} AS base FROM m",
)
def aggregate_variants(spark, folder):
    df = table(spark, folder, "lineitem")
    out = df.groupBy("l_returnflag").agg(
        r(value("SKEW.P", "l_quantity")).alias("skew_p"), value("QUARTILE.EXC", "l_quantity", 1).alias("quartile_exc"), value("PERCENTILE.EXC", "l_quantity", 0.3).alias("percentile_exc"),
        value("MODE.SNGL", F.col("l_quantity") % 2).alias("mode_sngl"), value("MODE", F.col("l_quantity") % 2).alias("mode_old"),
        value("LINEST", "l_extendedprice", "l_quantity").alias("line"), value("LOGEST", "l_extendedprice", "l_quantity").alias("curve"),
    )
    return out.select(
        "l_returnflag", "skew_p", "quartile_exc", "percentile_exc", "mode_sngl", "mode_old", r(F.col("line")[0]).alias("slope"), r(F.col("line")[1], 2).alias("level"),
        r(F.col("curve")[0], 6).alias("growth"), r(F.col("curve")[1], 2).alias("base"),
    )


# -- statistics of a run, over the prices as trials ------------------------------------------------------------------

_Q = "l_extendedprice"
_RUN = {
    "PSIMEAN": ((), "avg(x)"), "PSISTDDEV": ((), "stddev_samp(x)"), "PSIVARIANCE": ((), "var_samp(x) / 1e6"), "PSICOUNT": ((), "count(x)"), "PSIRANGE": ((), "max(x) - min(x)"),
    "PSIPERCENTILE": ((0.9,), "quantile_cont(x, 0.9)"), "PSIPTOX": ((0.9,), "quantile_cont(x, 0.9)"), "PSIQTOX": ((0.1,), "quantile_cont(x, 0.9)"), "PSIBVAR": ((0.95,), "-quantile_cont(x, 0.05)"),
    "PSITARGET": ((30000.0,), "avg((x <= 30000)::INT)"), "PSIXTOP": ((30000.0,), "avg((x <= 30000)::INT)"), "PSIXTOQ": ((30000.0,), "avg((x > 30000)::INT)"),
    "PSIFREQUENCY": ((20000.0, 40000.0), "avg((x BETWEEN 20000 AND 40000)::INT)"), "PSICOEFFVAR": ((), "stddev_samp(x) / avg(x)"), "PSISTDERR": ((), "stddev_samp(x) / sqrt(count(x))"),
    "PSIEXPGAIN": ((30000.0,), "avg(greatest(x - 30000, 0))"), "PSIEXPLOSS": ((30000.0,), "avg(greatest(30000 - x, 0))"), "PSIEXPGAINRATIO": ((30000.0,), "avg(greatest(x - 30000, 0)) / avg(greatest(30000 - x, 0))"),
    "PSIEXPLOSSRATIO": ((30000.0,), "avg(greatest(30000 - x, 0)) / avg(greatest(x - 30000, 0))"), "PSIEXPVALMARGIN": ((30000.0,), "avg(x) - 30000"),
    "PSISEMIVAR2": ((30000.0,), "avg(power(greatest(30000 - x, 0), 2)) / 1e6"), "PSISEMIDEV2": ((30000.0,), "sqrt(avg(power(greatest(30000 - x, 0), 2)))"),
    "PSISKEWNESS": ((), "skewness(x)"), "PSIKURTOSIS": ((), "kurtosis(x) + 3"), "PSIABSDEV": ((), "avg(abs(x - mean))"), "PSISEMIVAR": ((), "avg(power(greatest(mean - x, 0), 2)) / 1e6"),
    "PSISEMIDEV": ((), "sqrt(avg(power(greatest(mean - x, 0), 2)))"), "PSICVAR": ((), "-avg(x) FILTER (x <= cut)"),
}
_TWO_PASS = ("PSIABSDEV", "PSISEMIVAR", "PSISEMIDEV", "PSICVAR")
#: Percentiles of all trials are made in ranges rather than by an aggregate, whose buffer one task would hold.
_SHARES = {"PSIPERCENTILE": 0.9, "PSIPTOX": 0.9, "PSIQTOX": 1 - 0.1, "PSIBVAR": 1 - 0.95}
_SCALED = ("PSIVARIANCE", "PSISEMIVAR2", "PSISEMIVAR")


@query(
    "run_statistics",
    "SELECT " + ", ".join(f"{rs(s, 3)} AS {n.lower()}" for n, (_, s) in _RUN.items()) + f", {rs('corr(x, q)')} AS psicorrelation FROM (SELECT l_extendedprice AS x, l_quantity AS q FROM lineitem),"
    " (SELECT avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.05) AS cut FROM lineitem)",
)
def run_statistics(spark, folder):
    from tabulon.operators import ranking
    from tabulon.simulation import run

    df = table(spark, folder, "lineitem")
    one = df.agg(*(value(n, _Q, *args).alias(n.lower()) for n, (args, _) in _RUN.items() if n not in _TWO_PASS and n not in _SHARES), r(value("PSICORRELATION", _Q, "l_quantity")).alias("psicorrelation"))
    two = run.two_pass(df, _Q).select(*(F.col(n[3:].lower()).alias(n.lower()) for n in _TWO_PASS))
    places = ranking.percentiles(df, _Q, {n.lower(): p for n, p in _SHARES.items()}).withColumn("psibvar", -F.col("psibvar"))
    both = one.join(F.broadcast(two)).join(F.broadcast(places))
    return both.select(*(r(F.col(n.lower()) / (1e6 if n in _SCALED else 1.0), 3).alias(n.lower()) for n in _RUN), "psicorrelation")


@query("run_data", "SELECT o_orderkey AS trial, o_totalprice AS x, (o_orderkey = 7) AS one FROM orders")
def run_data(spark, folder):
    """PsiSimData gives all trials, PsiData one of them."""
    from tabulon.simulation import run

    df = table(spark, folder, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_totalprice").alias("x"))
    one = run.data(df, "x", 7).select("trial", F.lit(True).alias("found"))
    return run.data(df, "x").join(one, "trial", "left").select("trial", "x", F.coalesce("found", F.lit(False)).alias("one"))


@query(
    "spearman_ranks",
    f"SELECT p_brand, {rs('corr(a, b)')} AS rho FROM (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a,"
    " rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part) GROUP BY 1",
)
def spearman_ranks(spark, folder):
    from tabulon.operators import inference

    out = inference.correlation_of_ranks(table(spark, folder, "part"), "p_size", "p_retailprice", ["p_brand"])
    return out.select("p_brand", r(F.col("rho")).alias("rho"))


@query("growth_curves", f"WITH l AS (SELECT l_returnflag, regr_slope(ln(l_extendedprice), l_quantity) AS b, regr_intercept(ln(l_extendedprice), l_quantity) AS a FROM lineitem GROUP BY 1) SELECT l_returnflag, l_orderkey, l_linenumber, {rs('exp(a + b * l_quantity)', 2)} AS fitted FROM lineitem JOIN l USING (l_returnflag)")
def growth_curves(spark, folder):
    from tabulon.operators import inference

    out = inference.trend(table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"], growth=True)
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", r(F.col("fitted"), 2).alias("fitted"))


# -- distributions ---------------------------------------------------------------------------------------------------

_S = "(s_suppkey % 50 / 10.0 + 0.1)"
_P = "((s_suppkey % 97 + 0.5) / 97)"
_X = lambda: F.col("s_suppkey") % 50 / 10.0 + 0.1
_U = lambda: (F.col("s_suppkey") % 97 + 0.5) / 97


def _call(name, *args, digits=6):
    return lambda: r(value(name, *(a() if callable(a) else a for a in args)), digits)


_TAN_HALF = f"tan(pi() / 2 * (1 - {_P}))"
scalars(
    "distribution_tails",
    "supplier",
    ["s_suppkey"],
    {
        "t_rt": (_call("T.DIST.RT", _X, 1), rs(f"0.5 - atan({_S}) / pi()", 6)),
        "t_2t": (_call("T.DIST.2T", _X, 1), rs(f"1 - 2 * atan({_S}) / pi()", 6)),
        "tdist_2": (_call("TDIST", _X, 1, 2), rs(f"1 - 2 * atan({_S}) / pi()", 6)),
        "t_inv_2t": (_call("T.INV.2T", _U, 1, digits=4), rs(_TAN_HALF, 4)),
        "tinv": (_call("TINV", _U, 1, digits=4), rs(_TAN_HALF, 4)),
        "f_rt": (_call("F.DIST.RT", _X, 2, 2), rs(f"1 / (1 + {_S})", 6)),
        "fdist": (_call("FDIST", _X, 2, 2), rs(f"1 / (1 + {_S})", 6)),
        "f_inv_rt": (_call("F.INV.RT", _U, 2, 2, digits=4), rs(f"(1 - {_P}) / {_P}", 4)),
        "finv": (_call("FINV", _U, 2, 2, digits=4), rs(f"(1 - {_P}) / {_P}", 4)),
        "betadist": (_call("BETADIST", _U, 2.0, 1.0), rs(f"power({_P}, 2)", 6)),
        "gauss": (_call("GAUSS", _X), rs(_gauss(_S), 6)),
        "norm_s_dist": (_call("NORM.S.DIST", _X, True), rs(f"0.5 + {_gauss(_S)}", 6)),
        "normsdist": (_call("NORMSDIST", _X), rs(f"0.5 + {_gauss(_S)}", 6)),
        "norm_s_inv": (lambda: r(value("NORM.S.DIST", value("NORM.S.INV", _U()), True), 6), rs(_P, 6)),
        "normsinv": (lambda: r(value("NORM.S.DIST", value("NORMSINV", _U()), True), 6), rs(_P, 6)),
        "lognormdist": (_call("LOGNORMDIST", _X, 0.3, 0.7), rs(f"0.5 + {_gauss(f'(ln({_S}) - 0.3) / 0.7')}", 6)),
        "lognorm_inv": (lambda: r(value("LOGNORM.DIST", value("LOGNORM.INV", _U(), 1.0, 0.5), 1.0, 0.5, True), 6), rs(_P, 6)),
        "loginv": (lambda: r(value("LOGNORM.DIST", value("LOGINV", _U(), 1.0, 0.5), 1.0, 0.5, True), 6), rs(_P, 6)),
        "chisq_inv": (_call("CHISQ.INV", _U, 2), rs(f"-2 * ln(1 - {_P})", 6)),
        "binom_range": (_call("BINOM.DIST.RANGE", 3, _U, 1, 2), rs(f"3 * {_P} * power(1 - {_P}, 2) + 3 * power({_P}, 2) * (1 - {_P})", 6)),
        "binom_inv": (lambda: value("BINOM.INV", 1, 0.3, _U()), f"CASE WHEN {_P} <= 0.7 THEN 0.0 ELSE 1.0 END::DOUBLE"),
        "critbinom": (lambda: value("CRITBINOM", 1, 0.3, _U()), f"CASE WHEN {_P} <= 0.7 THEN 0.0 ELSE 1.0 END::DOUBLE"),
        "negbinomdist": (_call("NEGBINOMDIST", 2, 2, _U), rs(f"3 * power({_P}, 2) * power(1 - {_P}, 2)", 6)),
        "hypgeom": (_call("HYPGEOM.DIST", 1, 4, 8, 20, False), rs("8 * 220 / 4845.0", 6)),
        "hypgeomdist": (_call("HYPGEOMDIST", 1, 4, 8, 20), rs("8 * 220 / 4845.0", 6)),
        "confidence_norm": (_call("CONFIDENCE.NORM", 0.05, _X, 50), rs(f"1.959963984540054 * {_S} / sqrt(50)", 6)),
        "confidence": (_call("CONFIDENCE", 0.05, _X, 50), rs(f"1.959963984540054 * {_S} / sqrt(50)", 6)),
        "confidence_t": (_call("CONFIDENCE.T", 0.05, _X, 2, digits=4), rs(f"tan(pi() / 2 * 0.95) * {_S} / sqrt(2)", 4)),
        "erf_": (_call("ERF", _X), rs(f"2 / sqrt(pi()) * {_sum('exp(-@t * @t)', '0', _S)}", 6)),
        "erf_precise": (_call("ERF.PRECISE", _X), rs(f"2 / sqrt(pi()) * {_sum('exp(-@t * @t)', '0', _S)}", 6)),
        "erfc_": (_call("ERFC", _X), rs(f"1 - 2 / sqrt(pi()) * {_sum('exp(-@t * @t)', '0', _S)}", 6)),
        "erfc_precise": (_call("ERFC.PRECISE", _X), rs(f"1 - 2 / sqrt(pi()) * {_sum('exp(-@t * @t)', '0', _S)}", 6)),
        "bessel_j": (_call("BESSELJ", _X, 1), rs(f"{_sum(f'cos(@t - {_S} * sin(@t))', '0', 'pi()', 500)} / pi()", 6)),
        "bessel_i": (_call("BESSELI", _X, 1, digits=4), rs(f"{_sum(f'exp({_S} * cos(@t)) * cos(@t)', '0', 'pi()', 500)} / pi()", 4)),
        "bessel_k": (_call("BESSELK", _X, 1, digits=4), rs(_sum(f"exp(-{_S} * cosh(@t)) * cosh(@t)", "0", "9"), 4)),
        "bessel_y": (_call("BESSELY", _X, 1, digits=4), rs(f"{_sum(f'sin({_S} * sin(@t) - @t)', '0', 'pi()', 4000)} / pi() - {_sum(f'(exp(@t) - exp(-@t)) * exp(-{_S} * sinh(@t))', '0', '9', 20000)} / pi()", 4)),
    },
)

#: Quantiles with a closed form: parameters, and the form in ``u``.
_CLOSED = {
    "PSIUNIFORM": ((1.0, 3.0), "1 + 2 * u"), "PSITRIANGULAR": ((0.0, 1.0, 3.0), "CASE WHEN u < 1 / 3.0 THEN sqrt(3 * u) ELSE 3 - sqrt((1 - u) * 6) END"),
    "PSIDBLTRIANG": ((0.0, 1.0, 3.0, 0.4), "CASE WHEN u < 0.4 THEN sqrt(u / 0.4) ELSE 3 - 2 * sqrt((1 - u) / 0.6) END"), "PSIBERNOULLI": ((0.3,), "CASE WHEN u >= 0.7 THEN 1 ELSE 0 END"),
    "PSIINTUNIFORM": ((1, 6), "floor(1 + 6 * u)"), "PSIEXPONENTIAL": ((2.0,), "-2 * ln(1 - u)"), "PSIGEOMETRIC": ((0.3,), "floor(ln(1 - u) / ln(0.7))"),
    "PSIWEIBULL": ((2.0, 3.0), "3 * sqrt(-ln(1 - u))"), "PSIRAYLEIGH": ((2.0,), "2 * sqrt(-2 * ln(1 - u))"), "PSICAUCHY": ((0.0, 1.0), "tan(pi() * (u - 0.5))"),
    "PSILOGISTIC": ((1.0, 2.0), "1 + 2 * ln(u / (1 - u))"), "PSILOGLOGISTIC": ((0.0, 1.0, 3.0), "power(u / (1 - u), 1 / 3.0)"), "PSILAPLACE": ((0.0, 1.0), "CASE WHEN u < 0.5 THEN ln(2 * u) ELSE -ln(2 * (1 - u)) END"),
    "PSIMAXEXTREME": ((0.0, 1.0), "-ln(-ln(u))"), "PSIMINEXTREME": ((0.0, 1.0), "ln(-ln(1 - u))"), "PSIFRECHET": ((0.0, 1.0, 3.0), "power(-ln(u), -1 / 3.0)"), "PSIPARETO": ((1.0, 3.0), "power(1 - u, -1 / 3.0)"),
    "PSIPARETO2": ((1.0, 3.0), "power(1 - u, -1 / 3.0) - 1"), "PSIRECIPROCAL": ((1.0, 10.0), "power(10, u)"), "PSIHYPSECANT": ((0.0, 1.0), "2 / pi() * ln(tan(pi() / 2 * u))"),
    "PSIBURR12": ((0.0, 1.0, 2.0, 3.0), "sqrt(power(1 - u, -1 / 3.0) - 1)"), "PSIDAGUM": ((0.0, 1.0, 3.0, 2.0), "power(power(u, -0.5) - 1, -1 / 3.0)"), "PSIKUMARASWAMY": ((2.0, 3.0, 0.0, 1.0), "sqrt(1 - power(1 - u, 1 / 3.0))"),
    "PSIDISCRETE": (([1, 2, 5], [0.2, 0.3, 0.5]), "CASE WHEN u <= 0.2 THEN 1 WHEN u <= 0.5 THEN 2 ELSE 5 END"), "PSICUMULD": ((0.0, 4.0, [1, 2], [0.3, 0.7]), "CASE WHEN u <= 0.3 THEN 1 WHEN u <= 0.7 THEN 2 ELSE 4 END"),
    "PSIDISUNIFORM": (([1, 4, 9],), "[1, 4, 9][floor(u * 3)::INT + 1]"), "PSIRESAMPLE": (([1, 4, 9],), "[1, 4, 9][floor(u * 3)::INT + 1]"), "PSISHUFFLE": (([1, 4, 9],), "[1, 4, 9][floor(u * 3)::INT + 1]"),
    "PSICUMUL": ((0.0, 4.0, [1, 2], [0.3, 0.7]), "CASE WHEN u <= 0.3 THEN u / 0.3 WHEN u <= 0.7 THEN 1 + (u - 0.3) / 0.4 ELSE 2 + (u - 0.7) / 0.15 END"),
    "PSIHISTOGRAM": ((0.0, 3.0, [1, 2, 1]), "CASE WHEN u <= 0.25 THEN 4 * u WHEN u <= 0.75 THEN 1 + 2 * (u - 0.25) ELSE 2 + 4 * (u - 0.75) END"),
    "PSIGENERAL": ((0.0, 3.0, [1, 2], [1, 1]), "CASE WHEN u <= 0.25 THEN sqrt(4 * u) WHEN u <= 0.75 THEN 1 + 2 * (u - 0.25) ELSE 3 - sqrt(4 * (1 - u)) END"),
    "PSIMETALOG2": (([1.0, 2.0, 0.1],), "1 + 2 * ln(u / (1 - u)) + 0.1 * (u - 0.5) * ln(u / (1 - u))"), "PSIMETALOG": ((0.0, 10.0, [0.1, 0.5]), "10 * exp(0.1 + 0.5 * ln(u / (1 - u))) / (1 + exp(0.1 + 0.5 * ln(u / (1 - u))))"),
    "PSIPOISSON": ((1.5,), "len(list_filter(range(0, 40), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-1.5) * power(1.5, j) / gamma(j + 1))) < u))"),
    "PSIBINOMIAL": ((4, 0.3), "len(list_filter(range(0, 4), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: [1, 4, 6, 4, 1][j + 1] * power(0.3, j) * power(0.7, 4 - j))) < u))"),
    "PSINEGBINOMIAL": ((1, 0.4), "CASE WHEN u <= 0.4 THEN 0 ELSE ceil(ln(1 - u) / ln(0.6)) - 1 END"),
    "PSIHYPERGEO": ((2, 4, 10), "CASE WHEN u <= 15 / 45.0 THEN 0 WHEN u <= 39 / 45.0 THEN 1 ELSE 2 END"),
    "PSILOGARITHMIC": ((0.5,), "1 + len(list_filter(range(1, 60), lambda k: list_sum(list_transform(range(1, k + 1), lambda j: power(0.5, j) / (j * ln(2)))) < u))"),
}

#: Quantiles without one: parameters, and a probability of the catalogue that gives u back.
_NORMAL = lambda x: value("NORM.S.DIST", x, True)
_LN = F.ln
_BACK = {
    "PSINORMAL": ((5.0, 2.0), lambda x: value("NORM.DIST", x, 5.0, 2.0, True)), "PSIERF": ((1.0,), lambda x: _NORMAL(x * math.sqrt(2))), "PSILOGNORM2": ((0.2, 0.5), lambda x: value("LOGNORM.DIST", x, 0.2, 0.5, True)),
    "PSILOGNORMAL": ((10.0, 2.0), lambda x: value("LOGNORM.DIST", x, math.log(10) - math.log(1.04) / 2, math.sqrt(math.log(1.04)), True)),
    "PSIJOHNSONSB": ((0.5, 1.5, 0.0, 1.0), lambda x: _NORMAL(0.5 + 1.5 * _LN(x / (1 - x)))), "PSIJOHNSONSU": ((0.5, 1.5, 0.0, 1.0), lambda x: _NORMAL(0.5 + 1.5 * F.asinh(x))),
    "PSILEVY": ((0.0, 1.0), lambda x: 2 * (1 - _NORMAL(1 / F.sqrt(x)))), "PSIFATIGUELIFE": ((0.0, 1.0, 0.5), lambda x: _NORMAL((F.sqrt(x) - 1 / F.sqrt(x)) / 0.5)),
    "PSIGAMMA": ((2.0, 3.0), lambda x: value("GAMMA.DIST", x, 2.0, 3.0, True)), "PSIERLANG": ((2, 3.0), lambda x: 1 - F.exp(-x / 3) * (1 + x / 3)), "PSICHISQUARE": ((4,), lambda x: 1 - F.exp(-x / 2) * (1 + x / 2)),
    "PSIPEARSON5": ((2.0, 2.0), lambda x: F.exp(-2 / x) * (1 + 2 / x)), "PSIBETA": ((2.0, 1.0), lambda x: x * x), "PSIBETAGEN": ((2.0, 1.0, 0.0, 10.0), lambda x: x * x / 100),
    "PSIPEARSON6": ((2.0, 1.0, 3.0), lambda x: F.pow(x / (x + 3), 2)), "PSISTUDENT": ((2,), lambda x: 0.5 + x / (2 * F.sqrt(2 + x * x))), "PSIFDIST": ((2, 2), lambda x: x / (1 + x)),
    "PSIPERT": ((0.0, 1.0, 4.0), lambda x: value("BETA.DIST", x / 4, 2.0, 4.0, True)), "PSIBETASUBJ": ((0.0, 0.3, 0.4, 1.0), lambda x: value("BETA.DIST", x, 1.6, 2.4, True)),
    "PSIINVNORMAL": ((1.0, 2.0), lambda x: _NORMAL(F.sqrt(2 / x) * (x - 1)) + math.exp(4) * _NORMAL(-F.sqrt(2 / x) * (x + 1))), "PSIMYERSON": ((1.0, 2.0, 3.0), lambda x: _NORMAL((x - 2) * 1.2815515655446004)),
    "PSINORMALSKEW": ((0.0, 3.0, 6.0), lambda x: value("NORM.DIST", x, 3.0, 1.0, True)), "PSIMOMENTFIT": ((5.0, 2.0, 0.0, 3.0), lambda x: value("NORM.DIST", x, 5.0, 2.0, True)),
    "PSITRIANGGEN": ((1.0, 2.0, 3.0, 0.125, 0.875), lambda x: F.when(x < 2, F.pow(x, 2) / 8).otherwise(1 - F.pow(4 - x, 2) / 8)),
    "PSIAR1": ((0.0, 1.0, 0.5, 2.0), lambda x: _NORMAL(x - 1)), "PSIAR2": ((0.0, 1.0, 0.5, 0.2, 2.0, 1.0), lambda x: _NORMAL(x - 0.9)), "PSIMA1": ((0.0, 1.0, 0.5, 0.3), lambda x: _NORMAL(x - 0.15)),
    "PSIMA2": ((0.0, 1.0, 0.5, 0.2, 0.3, 0.1), lambda x: _NORMAL(x - 0.11)), "PSIARMA11": ((0.0, 1.0, 0.5, 0.3, 2.0, 0.1), lambda x: _NORMAL(x - 1.03)),
    "PSIARCH1": ((0.0, 1.0, 0.5, 2.0), lambda x: _NORMAL(x / math.sqrt(3))), "PSIGARCH11": ((0.0, 1.0, 0.3, 0.5, 2.0, 1.0), lambda x: _NORMAL(x / math.sqrt(2.7))),
    "PSIEGARCH11": ((0.0, 1.0, 0.0, 0.0, 0.3, 0.5, 2.0, 1.0), lambda x: _NORMAL(x)), "PSIAPARCH11": ((0.0, 1.0, 2.0, 0.1, 0.3, 0.5, 2.0, 1.0), lambda x: _NORMAL(x / math.sqrt(1 + 0.3 * 1.8**2 + 0.5))),
    "PSIMETALOG2FIT": ((2, [1.0, 3.0], [0.25, 0.75]), lambda x: 1 / (1 + F.exp(-(x - 2) * math.log(3)))), "PSIMETALOGFIT": ((2, [1.0, 3.0], [0.25, 0.75]), lambda x: 1 / (1 + F.exp(-(x - 2) * math.log(3)))),
    "PSIMETALOGSPT": ((0.0, 8.0, [2.0, 4.0, 6.0], 0.25), lambda x: x / (8 - x) / (1 + x / (8 - x))),
}
_PU = "((p_partkey % 199 + 0.5) / 199)"


def _quantile(name, parameters):
    from tabulon.simulation.quantiles import QUANTILES, Columns

    return QUANTILES[name](Columns, F.col("u"), *parameters).cast("double")


@query("distribution_quantiles", "SELECT p_partkey, " + ", ".join(f"{rs(s, 5)} AS {n.lower()}" for n, (_, s) in _CLOSED.items()) + f" FROM (SELECT p_partkey, {_PU} AS u FROM part)")
def distribution_quantiles(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", ((F.col("p_partkey") % 199 + 0.5) / 199).alias("u"))
    return df.select("p_partkey", *(r(_quantile(n, p), 5).alias(n.lower()) for n, (p, _) in _CLOSED.items()))


@query("distribution_round_trips", "SELECT p_partkey, " + ", ".join(f"{rs('u', 6)} AS {n.lower()}" for n in _BACK) + f" FROM (SELECT p_partkey, {_PU} AS u FROM part)")
def distribution_round_trips(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", ((F.col("p_partkey") % 199 + 0.5) / 199).alias("u"))
    drawn = df.select("p_partkey", *(_quantile(n, p).alias(n.lower()) for n, (p, _) in _BACK.items()))
    return drawn.select("p_partkey", *(r(back(F.col(n.lower())), 6).alias(n.lower()) for n, (_, back) in _BACK.items()))


_ALT = {
    "UNIFORM": (1.0, 3.0), "NORMAL": (5.0, 2.0), "LOGNORMAL": (10.0, 2.0), "TRIANGULAR": (1.0, 2.0, 4.0), "EXPONENTIAL": (2.0,), "WEIBULL": (2.0, 3.0), "GAMMA": (2.0, 3.0), "CAUCHY": (1.0, 2.0), "LAPLACE": (1.0, 2.0),
    "LEVY": (1.0, 2.0), "LOGISTIC": (1.0, 2.0), "LOGLOGISTIC": (0.0, 2.0, 3.0), "PARETO": (1.0, 3.0), "PARETO2": (1.0, 3.0), "PEARSON5": (3.0, 2.0), "RAYLEIGH": (2.0,), "MAXEXTREME": (1.0, 2.0), "MINEXTREME": (1.0, 2.0),
    "FRECHET": (0.0, 2.0, 3.0), "HYPSECANT": (1.0, 2.0), "INVNORMAL": (1.0, 2.0), "CHISQUARE": (4.0,), "STUDENT": (5.0,), "ERF": (1.0,), "PERT": (0.0, 1.0, 4.0), "FATIGUELIFE": (0.0, 1.0, 0.5), "PEARSON6": (2.0, 4.0, 3.0),
    "BETAGEN": (2.0, 3.0, 0.0, 10.0),
}


@query("percentile_forms", "SELECT 'PSI' || unnest([" + ", ".join(f"'{n}ALT'" for n in _ALT) + "]) AS distribution, true AS meets_its_points")
def percentile_forms(spark, folder):
    """Every family given by percentiles of a known member: the form found goes through all of the points."""
    from tabulon.simulation.quantiles import array_quantile
    from tabulon.simulation.run import draw

    out = None
    for name, parameters in _ALT.items():
        ps = [(k + 1) / (len(parameters) + 1) for k in range(len(parameters))]
        points = [(p, float(x)) for p, x in zip(ps, array_quantile(f"PSI{name}", *parameters)(ps), strict=True)]
        df = spark.createDataFrame(points, "u double, x double")
        near = F.abs(draw(f"PSI{name}ALT", points, u=F.col("u")) - F.col("x")) < 1e-4 * (1 + F.abs("x"))
        row = df.agg(F.lit(f"PSI{name}ALT").alias("distribution"), F.bool_and(near).alias("meets_its_points"))
        out = row if out is None else out.unionByName(row)
    return out


_THEORY = {
    # mean, variance, skewness, kurtosis, least, median, greatest
    "PSIUNIFORM": ((1.0, 3.0), "2, 1 / 3.0, 0, 1.8, 1, 2, 3"),
    "PSITRIANGULAR": ((0.0, 1.0, 3.0), "4 / 3.0, 7 / 18.0, sqrt(2) * 20 / (5 * power(7, 1.5)), 2.4, 0, 3 - sqrt(3), 3"),
    "PSIBETA": ((2.0, 2.0), "0.5, 0.05, 0, 2.142857, 0, 0.5, 1"),
}


@query(
    "theoretical_moments",
    " UNION ALL ".join(
        f"SELECT '{n}' AS distribution, " + ", ".join(f"{rs(c, 3)} AS {a}" for a, c in zip(("mean", "variance", "skewness", "kurtosis", "least", "median", "greatest"), s.split(", "), strict=True))
        if n != "PSITRIANGULAR"
        else f"SELECT '{n}' AS distribution, {rs('4 / 3.0', 3)} AS mean, {rs('7 / 18.0', 3)} AS variance, {rs('sqrt(2) * (0 + 3 - 2) * (0 - 3 - 1 + 1 + 0) * -0 + sqrt(2) * (0 + 3 - 2.0) * (2 * 0 - 3 - 1) * (0 - 2 * 3 + 1) / (5 * power(7, 1.5))', 3)} AS skewness, {rs('2.4', 3)} AS kurtosis, {rs('0', 3)} AS least, {rs('3 - sqrt(3)', 3)} AS median, {rs('3', 3)} AS greatest"
        for n, (_, s) in _THEORY.items()
    ),
)
def theoretical_moments(spark, folder):
    from tabulon.simulation import run

    out = None
    for name, (parameters, _) in _THEORY.items():
        row = run.theoretical(spark, name, *parameters).select(
            F.lit(name).alias("distribution"), *(r(F.col(c), 3).alias(a) for c, a in (("mean", "mean"), ("variance", "variance"), ("skewness", "skewness"), ("kurtosis", "kurtosis"), ("min", "least"), ("median", "median"), ("max", "greatest")))
        )
        out = row if out is None else out.unionByName(row)
    return out


# -- complex numbers and matrices ------------------------------------------------------------------------------------

_RE, _IM = "(s_suppkey % 7 + 1.0)", "(s_suppkey % 5 - 2.0)"
_ZC = lambda: value("COMPLEX", F.col("s_suppkey") % 7 + 1, F.col("s_suppkey") % 5 - 2)


def _both(name: str, real: str, imaginary: str, *more):
    """A function of z, and SQL of its two parts."""
    return {name: (more, real, imaginary)}


def _over(a: str, b: str, c: str, d: str) -> tuple[str, str]:
    """SQL of (a + bi) / (c + di)."""
    size = f"(({c}) * ({c}) + ({d}) * ({d}))"
    return f"(({a}) * ({c}) + ({b}) * ({d})) / {size}", f"(({b}) * ({c}) - ({a}) * ({d})) / {size}"


_ABS, _ARG = "sqrt(@a * @a + @b * @b)", "atan2(@b, @a)"
_SIN, _COS = ("sin(@a) * cosh(@b)", "cos(@a) * sinh(@b)"), ("cos(@a) * cosh(@b)", "-sin(@a) * sinh(@b)")
_SINH, _COSH = ("sinh(@a) * cos(@b)", "cosh(@a) * sin(@b)"), ("cosh(@a) * cos(@b)", "sinh(@a) * sin(@b)")
_W = ("1.0", "-2.0")
_COMPLEX = {
    **_both("IMCONJUGATE", "@a", "-@b"), **_both("IMSUM", "@a + 1", "@b - 2", "1-2i"), **_both("IMSUB", "@a - 1", "@b + 2", "1-2i"),
    **_both("IMPRODUCT", "@a + 2 * @b", "@b - 2 * @a", "1-2i"), **_both("IMDIV", *_over("@a", "@b", *_W), "1-2i"), **_both("IMPOWER", "@a * @a * @a - 3 * @a * @b * @b", "3 * @a * @a * @b - @b * @b * @b", 3),
    **_both("IMEXP", "exp(@a) * cos(@b)", "exp(@a) * sin(@b)"), **_both("IMLN", f"ln({_ABS})", _ARG), **_both("IMLOG10", f"ln({_ABS}) / ln(10.0)", f"{_ARG} / ln(10.0)"), **_both("IMLOG2", f"ln({_ABS}) / ln(2.0)", f"{_ARG} / ln(2.0)"),
    **_both("IMSQRT", f"sqrt({_ABS}) * cos({_ARG} / 2)", f"sqrt({_ABS}) * sin({_ARG} / 2)"), **_both("IMSIN", *_SIN), **_both("IMCOS", *_COS), **_both("IMTAN", *_over(*_SIN, *_COS)), **_both("IMSINH", *_SINH), **_both("IMCOSH", *_COSH),
    **_both("IMCSC", *_over("1", "0", *_SIN)), **_both("IMSEC", *_over("1", "0", *_COS)), **_both("IMCOT", *_over(*_COS, *_SIN)), **_both("IMCSCH", *_over("1", "0", *_SINH)), **_both("IMSECH", *_over("1", "0", *_COSH)),
}
_PARTS = lambda s: s.replace("@a", _RE).replace("@b", _IM)


@query(
    "complex_closed",
    f"SELECT s_suppkey, {_RE} AS imreal_, {_IM} AS imaginary_, {rs(_PARTS(_ABS), 6)} AS imabs_, {rs(_PARTS(_ARG), 6)} AS imargument_, "
    + ", ".join(f"{rs(_PARTS(a), 5)} AS {n.lower()}_re, {rs(_PARTS(b), 5)} AS {n.lower()}_im" for n, (_, a, b) in _COMPLEX.items()) + " FROM supplier",
)
def complex_closed(spark, folder):
    df = spread(table(spark, folder, "supplier").select("s_suppkey")).select("s_suppkey", _ZC().alias("z"))
    found = df.select("s_suppkey", "z", *(value(n, F.col("z"), *more).alias(n) for n, (more, _, _) in _COMPLEX.items()))
    z = F.col("z")
    return found.select(
        "s_suppkey", value("IMREAL", z).alias("imreal_"), value("IMAGINARY", z).alias("imaginary_"), r(value("IMABS", z), 6).alias("imabs_"), r(value("IMARGUMENT", z), 6).alias("imargument_"),
        *(r(value(part, F.col(n)), 5).alias(f"{n.lower()}_{end}") for n in _COMPLEX for part, end in (("IMREAL", "re"), ("IMAGINARY", "im"))),
    )


_MX = lambda: F.array(F.array(_N() + 1.0, F.lit(2.0)), F.array(F.lit(3.0), _N() + 4.0))
_DET = "((n_nationkey + 1.0) * (n_nationkey + 4.0) - 6)"
scalars(
    "matrices_closed",
    "nation",
    ["n_nationkey"],
    {
        "mdeterm": (lambda: r(value("MDETERM", _MX()), 6), rs(_DET, 6)),
        **{
            f"inverse_{i}{j}": ((lambda i=i, j=j: r(value("MINVERSE", _MX())[i][j], 6)), rs(f"{s} / {_DET}", 6))
            for (i, j), s in {(0, 0): "(n_nationkey + 4.0)", (0, 1): "-2.0", (1, 0): "-3.0", (1, 1): "(n_nationkey + 1.0)"}.items()
        },
        "mmult": (lambda: F.flatten(value("MMULT", _MX(), _MX())), "[power(n_nationkey + 1, 2) + 6, 2 * (2 * n_nationkey + 5), 3 * (2 * n_nationkey + 5), power(n_nationkey + 4, 2) + 6]::DOUBLE[]"),
        "transpose": (lambda: F.flatten(value("TRANSPOSE", _MX())), "[n_nationkey + 1, 3, 2, n_nationkey + 4]::DOUBLE[]"),
    },
)

# -- returns and bonds -----------------------------------------------------------------------------------------------

_FLOW = lambda: F.array(F.lit(-100.0), F.col("c_nationkey") + 101.0)
_DAYS = lambda: F.array(F.lit("2024-01-01").cast("date"), F.lit("2025-12-31").cast("date"))
scalars(
    "returns_closed",
    "customer",
    ["c_custkey"],
    {
        "irr_": (lambda: r(value("IRR", _FLOW()), 6), rs("(c_nationkey + 1) / 100.0", 6)),
        "xirr_": (lambda: r(value("XIRR", _FLOW(), _DAYS()), 5), rs("power((c_nationkey + 101) / 100.0, 0.5) - 1", 5)),
        "rate_": (lambda: r(value("RATE", 1, 0.0, -100.0, F.col("c_nationkey") + 101.0), 6), rs("(c_nationkey + 1) / 100.0", 6)),
        "xnpv_": (lambda: r(value("XNPV", 0.1, _FLOW(), _DAYS()), 6), rs("-100 + (c_nationkey + 101) / power(1.1, 730 / 365.0)", 6)),
    },
    slow=True,
)

_A, _B = lambda: F.col("o_orderdate"), lambda: F.lit("2030-06-15").cast("date")
_EARLY, _FIRST = lambda: F.add_months(F.col("o_orderdate"), -3), lambda: F.add_months(F.col("o_orderdate"), 4)
_SETTLED, _HALF = "o_orderdate::DATE", "(SELECT list_transform(range(0, 120), lambda k: (DATE '1990-06-15' + to_months((6 * k)::INT))::DATE))"
_NEXT = f"list_min(list_filter(h, lambda d: d > {_SETTLED}))"
_LAST = f"list_max(list_filter(h, lambda d: d <= {_SETTLED}))"


@query(
    "coupon_dates",
    f"SELECT o_orderkey, len(list_filter(h, lambda d: d > {_SETTLED} AND d <= DATE '2030-06-15'))::INT AS coupnum, {_LAST} AS couppcd, {_NEXT} AS coupncd,"
    f" ((year({_SETTLED}) - year({_LAST})) * 360 + (month({_SETTLED}) - month({_LAST})) * 30 + day({_SETTLED}) - 15)::INT AS coupdaybs, 180 AS coupdays FROM (SELECT *, {_HALF} AS h FROM orders)",
)
def coupon_dates(spark, folder):
    df = table(spark, folder, "orders")
    call = lambda n: value(n, _A(), _B(), 2)
    return df.select(
        "o_orderkey", call("COUPNUM").cast("int").alias("coupnum"), call("COUPPCD").cast("date").alias("couppcd"), call("COUPNCD").cast("date").alias("coupncd"),
        call("COUPDAYBS").cast("int").alias("coupdaybs"), call("COUPDAYS").cast("int").alias("coupdays"),
    )


_Y = lambda: 0.02 + F.col("o_custkey") % 7 / 100
_RATE = lambda: 0.03 + F.col("o_custkey") % 5 / 100
_END = lambda: F.add_months(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 60 + 7).cast("int"))
_YSQL = rs("0.02 + o_custkey % 7 / 100.0", 5)
scalars(
    "yields_round_trip",
    "orders",
    ["o_orderkey"],
    {
        "price_yield": (lambda: r(value("YIELD", _A(), _END(), _RATE(), value("PRICE", _A(), _END(), _RATE(), _Y(), 100.0, 2), 100.0, 2), 5), _YSQL),
        "pricemat_yieldmat": (lambda: r(value("YIELDMAT", _A(), _END(), _EARLY(), _RATE(), value("PRICEMAT", _A(), _END(), _EARLY(), _RATE(), _Y())), 5), _YSQL),
        "oddl": (lambda: r(value("ODDLYIELD", _A(), _END(), _EARLY(), _RATE(), value("ODDLPRICE", _A(), _END(), _EARLY(), _RATE(), _Y(), 100.0, 2), 100.0, 2), 5), _YSQL),
        "accrint_": (lambda: r(value("ACCRINT", F.lit("2024-01-01").cast("date"), F.lit("2024-07-01").cast("date"), F.lit("2024-10-01").cast("date"), _RATE(), 1000.0, 2), 5), rs("1000 * 0.75 * (0.03 + o_custkey % 5 / 100.0)", 5)),
    },
)
