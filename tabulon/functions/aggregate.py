"""Aggregates as columns for ``agg``: plain, conditional, coercing, statistical, and the database family.

Numbers are what casts to a double; text and blanks are left out, except by the coercing family, where text counts 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.registry import alias, col, function, num, value
from tabulon.operators.criteria import all_of

FAMILY = "aggregate"


def _f(name: str, family: str = FAMILY):
    return function(name, family=family, kind="aggregate")


def coerced(x) -> Column:
    """Numbers as they are, truth values as 1 and 0, other text as 0, blanks left out."""
    text = col(x).cast("string")
    return F.when(text.isNull(), None).otherwise(F.coalesce(text.try_cast("double"), text.try_cast("boolean").cast("double"), F.lit(0.0)))


_zero = lambda c: F.coalesce(c, F.lit(0.0))

_BASIC = {
    "SUM": lambda x: _zero(F.sum(x)), "SUMSQ": lambda x: _zero(F.sum(x * x)), "AVERAGE": F.avg, "STDEV": F.stddev_samp, "STDEVP": F.stddev_pop,
    "VAR": F.var_samp, "VARP": F.var_pop, "MEDIAN": F.median, "MIN": lambda x: _zero(F.min(x)), "MAX": lambda x: _zero(F.max(x)),
    "COUNT": F.count, "PRODUCT": lambda x: _zero(F.product(x)), "DEVSQ": lambda x: F.var_pop(x) * F.count(x),
    "GEOMEAN": lambda x: F.exp(F.avg(F.ln(x))), "HARMEAN": lambda x: F.count(x) / F.sum(F.try_divide(F.lit(1.0), x)),
    "SKEW.P": F.skewness,
}
for _name, _fn in _BASIC.items():
    _f(_name)(lambda x, fn=_fn: fn(num(x)))
_f("COUNTA")(lambda x: F.count(col(x)))
_f("COUNTBLANK")(lambda x: F.count_if(col(x).isNull() | (col(x).cast("string") == "")))
for _name, _fn in {"AVERAGEA": F.avg, "MAXA": F.max, "MINA": F.min, "STDEVA": F.stddev_samp, "STDEVPA": F.stddev_pop, "VARA": F.var_samp, "VARPA": F.var_pop}.items():
    _f(_name)(lambda x, fn=_fn: fn(coerced(x)))


@_f("SKEW")
def skew(x) -> Column:
    n = F.count(num(x)).cast("double")
    return F.skewness(num(x)) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)


@_f("KURT")
def kurt(x) -> Column:
    n = F.count(num(x)).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(num(x)) + 6))


_f("SUMPRODUCT")(lambda *xs: _zero(F.sum(_product(xs))))


def _product(xs) -> Column:
    out = F.lit(1.0)
    for x in xs:
        out = out * F.coalesce(num(x), F.lit(0.0))
    return out


_f("SUMX2MY2")(lambda x, y: F.sum(num(x) * num(x) - num(y) * num(y)))
_f("SUMX2PY2")(lambda x, y: F.sum(num(x) * num(x) + num(y) * num(y)))
_f("SUMXMY2")(lambda x, y: F.sum((num(x) - num(y)) * (num(x) - num(y))))
_f("PERCENTOF")(lambda x, test: F.sum(F.when(test, num(x))) / F.sum(num(x)))

# Conditional: the values, then columns and criteria in turn.
_f("SUMIF")(lambda key, criterion, x=None: _zero(F.sum(F.when(all_of(key, criterion), num(key if x is None else x)))))
_f("AVERAGEIF")(lambda key, criterion, x=None: F.avg(F.when(all_of(key, criterion), num(key if x is None else x))))
_f("COUNTIF")(lambda key, criterion: F.count_if(all_of(key, criterion)))
_f("COUNTIFS")(lambda *pairs: F.count_if(all_of(*pairs)))
_f("SUMIFS")(lambda x, *pairs: _zero(F.sum(F.when(all_of(*pairs), num(x)))))
_f("AVERAGEIFS")(lambda x, *pairs: F.avg(F.when(all_of(*pairs), num(x))))
_f("MAXIFS")(lambda x, *pairs: _zero(F.max(F.when(all_of(*pairs), num(x)))))
_f("MINIFS")(lambda x, *pairs: _zero(F.min(F.when(all_of(*pairs), num(x)))))

# Order statistics. Exact percentiles keep counts of distinct values, which spill; see ``operators.ranking`` for ranks by sort.
_f("PERCENTILE")(lambda x, p: F.percentile(num(x), p))
_f("QUARTILE.INC")(lambda x, q: F.percentile(num(x), q / 4))


def _exclusive(x, p: float) -> Column:
    """Rank p (n + 1), between neighbours in proportion; the inclusive percentile at the rank that means the same."""
    xs = F.sort_array(F.collect_list(num(x)))
    rank = p * (F.size(xs) + 1)
    low = F.floor(rank).cast("int")
    inside = (rank >= 1) & (rank <= F.size(xs))
    a, b = F.get(xs, low - 1), F.coalesce(F.get(xs, low), F.get(xs, low - 1))
    return F.when(inside, a + (rank - low) * (b - a))


_f("PERCENTILE.EXC")(_exclusive)
_f("QUARTILE.EXC")(lambda x, q: _exclusive(x, q / 4))
_f("LARGE")(lambda x, k: F.get(F.sort_array(F.collect_list(num(x)), asc=False), F.lit(k - 1)))
_f("SMALL")(lambda x, k: F.get(F.sort_array(F.collect_list(num(x))), F.lit(k - 1)))
_f("MODE.SNGL")(lambda x: F.mode(num(x)))

# Two columns.
for _name, _fn in {
    "COVARIANCE.P": F.covar_pop, "COVARIANCE.S": F.covar_samp, "COVAR": F.covar_pop, "CORREL": F.corr, "PEARSON": F.corr,
    "SLOPE": F.regr_slope, "INTERCEPT": F.regr_intercept, "RSQ": F.regr_r2,
}.items():
    _f(_name)(lambda y, x, fn=_fn: fn(num(y), num(x)))
_f("STEYX")(lambda y, x: F.sqrt((F.regr_syy(num(y), num(x)) - F.pow(F.regr_sxy(num(y), num(x)), 2) / F.regr_sxx(num(y), num(x))) / (F.regr_count(num(y), num(x)) - 2)))
_f("FORECAST.LINEAR")(lambda at, y, x: F.regr_intercept(num(y), num(x)) + num(at) * F.regr_slope(num(y), num(x)))
_f("LINEST")(lambda y, x: F.array(F.regr_slope(num(y), num(x)), F.regr_intercept(num(y), num(x))))
_f("LOGEST")(lambda y, x: F.array(F.exp(F.regr_slope(F.ln(num(y)), num(x))), F.exp(F.regr_intercept(F.ln(num(y)), num(x)))))
_f("PROB")(lambda x, p, low, high=None: _zero(F.sum(F.when(num(x).between(num(low), num(low if high is None else high)), num(p)))))

for _old, _new in {"STDEV.S": "STDEV", "STDEV.P": "STDEVP", "VAR.S": "VAR", "VAR.P": "VARP", "PERCENTILE.INC": "PERCENTILE", "MODE": "MODE.SNGL", "QUARTILE": "QUARTILE.INC", "FORECAST": "FORECAST.LINEAR"}.items():
    alias(_old, _new)

# The aggregates that SUBTOTAL and AGGREGATE number.
_SUBTOTAL = ["AVERAGE", "COUNT", "COUNTA", "MAX", "MIN", "PRODUCT", "STDEV", "STDEVP", "SUM", "VAR", "VARP"]
_AGGREGATE = [*_SUBTOTAL, "MEDIAN", "MODE.SNGL", "LARGE", "SMALL", "PERCENTILE", "QUARTILE.INC", "PERCENTILE.EXC", "QUARTILE.EXC"]


@_f("SUBTOTAL")
def subtotal(code: int, x) -> Column:
    return value(_SUBTOTAL[code % 100 - 1], x)


@_f("AGGREGATE")
def aggregate(code: int, option: int, x, *k) -> Column:
    """Options 2, 3, 6 and 7 leave errors out, here: cells that are no number."""
    return value(_AGGREGATE[code - 1], col(x).try_cast("double") if option in (2, 3, 6, 7) else x, *k)


#: The database family: the same aggregates over the rows that a criteria range selects (``operators.database``).
DATABASE = {
    "DSUM": "SUM", "DPRODUCT": "PRODUCT", "DCOUNT": "COUNT", "DCOUNTA": "COUNTA", "DMAX": "MAX", "DMIN": "MIN", "DAVERAGE": "AVERAGE",
    "DSTDEV": "STDEV", "DSTDEVP": "STDEVP", "DVAR": "VAR", "DVARP": "VARP",
}
