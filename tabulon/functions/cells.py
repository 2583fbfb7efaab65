"""Operators between cells: structs of value and error, as ``registry.cell`` makes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.registry import DIV0, NUM


def plain(c: Column) -> Column:
    """A cell without an error."""
    return F.struct(c.alias("value"), F.lit(None).cast("string").alias("error"))


def arithmetic(operator: str, a: Column, b: Column) -> Column:
    """``+ - * / ^`` of two cells: the left error wins, then the right one, then that of the operation; blanks count 0."""
    x, y = (F.coalesce(c["value"].cast("double"), F.lit(0.0)) for c in (a, b))
    own = F.lit(None).cast("string")
    if operator == "/":
        own, out = F.when(y == 0, DIV0), F.try_divide(x, y)
    elif operator == "^":
        out = F.pow(x, y)
        own = F.when(F.isnan(out) | (F.abs(out) == float("inf")), NUM)
    else:
        out = {"+": x + y, "-": x - y, "*": x * y}[operator]
    wrong = F.coalesce(a["error"], b["error"], own)
    return F.struct(F.when(wrong.isNull(), out).alias("value"), wrong.alias("error"))


def _rank(c: Column) -> Column:
    kind = F.typeof(c)
    return F.when(kind == "boolean", 2).when(kind == "string", 1).otherwise(0)


def compare(operator: str, a: Column, b: Column) -> Column:
    """``= <> < > <= >=`` of two columns: numbers before text before truth values, text without regard to case, numbers
    within 1e-15 of their size equal."""
    ranks = _rank(a) - _rank(b)
    x, y = a.cast("string").try_cast("double"), b.cast("string").try_cast("double")
    near = F.abs(x - y) <= F.greatest(F.abs(x), F.abs(y)) * 1e-15
    number = F.when(near, 0).otherwise(F.signum(x - y))
    s, t = F.lower(a.cast("string")), F.lower(b.cast("string"))
    text = F.when(s < t, -1).when(s > t, 1).otherwise(0)
    order = F.when(ranks != 0, ranks).when(_rank(a) == 0, number).otherwise(text)
    return {"=": order == 0, "<>": order != 0, "<": order < 0, ">": order > 0, "<=": order <= 0, ">=": order >= 0}[operator]
