"""Logic, information and higher-order functions. Truth of a number is being other than zero; blanks are left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.registry import ERROR_CODES, NA, VALUE, col, error, function, num, value

FAMILY = "logic"


def _f(name: str, *guards):
    return function(name, *guards, family=FAMILY)


def truth(x) -> Column:
    if isinstance(x, bool):
        return F.lit(x)
    return col(x).try_cast("boolean")


def _all(xs) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & F.coalesce(truth(x), F.lit(True))
    return out


def _any(xs) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | F.coalesce(truth(x), F.lit(False))
    return out


_f("AND")(lambda *xs: _all(xs))
_f("OR")(lambda *xs: _any(xs))
_f("NOT")(lambda x: ~F.coalesce(truth(x), F.lit(False)))
_f("XOR")(lambda *xs: sum((F.coalesce(truth(x), F.lit(False)).cast("int") for x in xs), F.lit(0)) % 2 == 1)
_f("TRUE")(lambda: F.lit(True))
_f("FALSE")(lambda: F.lit(False))
_f("NA", (lambda: F.lit(True), NA))(lambda: F.lit(None).cast("double"))


@_f("IF")
def if_(test, then, otherwise=False) -> Column:
    """Only the branch that is needed is evaluated."""
    return F.when(F.coalesce(truth(test), F.lit(False)), col(then)).otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


@_f("IFS", (lambda *xs: ~_any(xs[::2]), NA))
def ifs(*xs) -> Column:
    out = None
    for test, then in zip(xs[::2], xs[1::2], strict=True):
        test = F.coalesce(truth(test), F.lit(False))
        out = F.when(test, col(then)) if out is None else out.when(test, col(then))
    return out


def same(a: Column, b) -> Column:
    """Equality without regard to case; null equals a blank."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.lower(a.cast("string")).eqNullSafe(F.lower(b.cast("string")))


@_f("SWITCH")
def switch(subject: Column, *xs) -> Column:
    out, pairs = None, len(xs) // 2
    for k in range(pairs):
        test, then = same(subject, xs[2 * k]), xs[2 * k + 1]
        then = then if isinstance(then, Column) else F.lit(then)
        out = F.when(test, then) if out is None else out.when(test, then)
    if len(xs) % 2:
        out = out.otherwise(xs[-1] if isinstance(xs[-1], Column) else F.lit(xs[-1]))
    return out


@_f("CHOOSE", (lambda i, *xs: (num(i) < 1) | (num(i) >= len(xs) + 1), VALUE))
def choose(i, *xs) -> Column:
    out, k = None, F.floor(num(i))
    for n, x in enumerate(xs, 1):
        x = x if isinstance(x, Column) else F.lit(x)
        out = F.when(k == n, x) if out is None else out.when(k == n, x)
    return out


def if_error(name: str, args: tuple, fallback) -> Column:
    """IFERROR around a catalogue call."""
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(error(name, *args).isNotNull(), fallback).otherwise(value(name, *args))


def if_na(name: str, args: tuple, fallback) -> Column:
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(error(name, *args) == NA, fallback).otherwise(value(name, *args))


# The functions below take a cell: a struct of value and error, as ``registry.cell`` makes it.
_f("IFERROR")(lambda c, fallback: F.when(c["error"].isNotNull(), fallback if isinstance(fallback, Column) else F.lit(fallback)).otherwise(c["value"]))
_f("IFNA")(lambda c, fallback: F.when(c["error"] == NA, fallback if isinstance(fallback, Column) else F.lit(fallback)).otherwise(c["value"]))
_f("ISERROR")(lambda c: c["error"].isNotNull())
_f("ISERR")(lambda c: c["error"].isNotNull() & (c["error"] != NA))
_f("ISNA")(lambda c: F.coalesce(c["error"] == NA, F.lit(False)))
_f("ERROR.TYPE", (lambda c: c["error"].isNull(), NA))(lambda c: F.try_element_at(F.create_map(*(F.lit(x) for pair in ERROR_CODES.items() for x in pair)), c["error"]))

_f("ISBLANK")(lambda x: col(x).isNull())
_f("ISNUMBER")(lambda x: F.typeof(col(x)).isin("double", "float", "int", "bigint", "smallint", "tinyint", "date", "timestamp", "timestamp_ntz") & col(x).isNotNull())
_f("ISTEXT")(lambda x: (F.typeof(col(x)) == "string") & col(x).isNotNull())
_f("ISNONTEXT")(lambda x: (F.typeof(col(x)) != "string") | col(x).isNull())
_f("ISLOGICAL")(lambda x: (F.typeof(col(x)) == "boolean") & col(x).isNotNull())
_f("ISEVEN")(lambda x: F.pmod(F.floor(F.abs(num(x))), F.lit(2)) == 0)
_f("ISODD")(lambda x: F.pmod(F.floor(F.abs(num(x))), F.lit(2)) == 1)
_f("ISREF")(lambda x: F.lit(isinstance(x, Column)))
_f("ISFORMULA")(lambda formula: F.coalesce(F.startswith(col(formula), F.lit("=")), F.lit(False)))
_f("ISOMITTED")(lambda x=None: F.lit(x is None))
_f("N")(lambda x: F.when(F.typeof(col(x)) == "string", 0.0).otherwise(F.coalesce(col(x).cast("string").try_cast("double"), col(x).cast("string").try_cast("boolean").cast("double"), F.lit(0.0))))
_f("TYPE")(lambda x: F.when(F.typeof(col(x)) == "string", 2).when(F.typeof(col(x)) == "boolean", 4).when(F.startswith(F.typeof(col(x)), F.lit("array")), 64).otherwise(1))

# -- higher order: a lambda is a Python function over columns -------------------------------------------------------


@_f("LET")
def let(bindings: list[tuple[str, Callable[..., Column]]], body: Callable[..., Column]) -> Column:
    """Bind names in order; each binding and the body see the names before them as keyword arguments."""
    bound: dict[str, Column] = {}
    for name, make in bindings:
        bound[name.lower()] = make(**bound)
    return body(**bound)


_f("LAMBDA")(lambda body, *args: body(*args))


@_f("MAP")
def map_(*xs_and_f) -> Column:
    *xs, f = xs_and_f
    if len(xs) == 1:
        return F.transform(xs[0], f)
    zipped = F.arrays_zip(*(x.alias(f"_{k}") for k, x in enumerate(xs)))
    return F.transform(zipped, lambda z: f(*(z.getField(f"_{k}") for k in range(len(xs)))))


_f("REDUCE")(lambda initial, xs, f: F.reduce(xs, col(initial), f))


@_f("SCAN")
def scan(initial, xs, f) -> Column:
    """Every step of a fold; for folds that are running sums over rows a window does the same without an array."""
    start = F.struct(col(initial).alias("last"), F.array().cast("array<double>").alias("all"))
    step = lambda s, x: F.struct(f(s["last"], x).alias("last"), F.array_append(s["all"], f(s["last"], x)).alias("all"))
    return F.reduce(xs, start, step)["all"]


_f("BYROW")(lambda rows, f: F.transform(rows, f))


@_f("BYCOL")
def bycol(rows, f) -> Column:
    n = F.size(F.element_at(rows, 1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: f(F.transform(rows, lambda r: F.get(r, k))))


@_f("MAKEARRAY")
def makearray(rows: int, columns: int, f) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(rows)), lambda r: F.transform(F.sequence(F.lit(1), F.lit(columns)), lambda c: f(r, c)))
