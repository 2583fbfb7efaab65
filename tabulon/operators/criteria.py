"""Criteria such as ``">5"``, ``"<>x"``, ``"ab*"`` or plain values, compiled to predicates that reach the scan."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import wildcard

_OPERATORS = ("<=", ">=", "<>", "<", ">", "=")


def _number(text: str) -> float | None:
    try:
        return float(text.replace(",", ""))
    except ValueError:
        return None


def _as_date(text: str) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(text)
    except ValueError:
        return None


def matches(column: Column | str, criterion, kind: str | None = None) -> Column:
    """True where a cell meets the criterion; never null.

    Numbers compare as numbers (also numeric text), dates as dates, texts without regard to case and with wildcards;
    ``"="`` finds blanks and ``"<>"`` all that are none. ``kind`` may give the column's type ("number", "text" or
    "date"), so that the predicate works on the bare column and can be pushed to the scan.
    """
    c = F.col(column) if isinstance(column, str) else column
    if criterion is None:
        return F.lit(False)
    if isinstance(criterion, bool):
        return F.coalesce(c.cast("string").try_cast("boolean") == F.lit(criterion), F.lit(False))
    if isinstance(criterion, (int, float, datetime.date, datetime.datetime)):
        operator, operand = "=", criterion
    else:
        operator = next((o for o in _OPERATORS if criterion.startswith(o)), "=")
        operand = criterion.removeprefix(operator) if criterion.startswith(operator) else criterion
    if operand == "" and isinstance(criterion, str):
        blank = c.isNull() if kind in ("number", "date") else c.isNull() | (c.cast("string") == "")
        return {"=": blank, "<>": ~blank}.get(operator, F.lit(False))
    if isinstance(operand, str) and (number := _number(operand)) is not None:
        operand = number
    elif isinstance(operand, str) and (day := _as_date(operand)) is not None:
        operand = day
    if isinstance(operand, str):
        text = c if kind == "text" else c.cast("string")
        if operator in ("=", "<>"):
            hit = text.rlike(wildcard(operand)) if any(x in operand for x in "*?~") else F.lower(text) == operand.lower()
            return F.coalesce(hit, F.lit(False)) if operator == "=" else ~F.coalesce(hit, F.lit(False))
        left, right = F.lower(text), F.lit(operand.lower())
    else:
        number = not isinstance(operand, (datetime.date, datetime.datetime))
        if kind in ("number", "date"):
            left = c
        else:
            left = c.cast("string").try_cast("double" if number else "timestamp_ntz")
        right = F.lit(float(operand)) if number else F.lit(operand)
    test = {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[operator]
    return F.coalesce(test, F.lit(operator == "<>"))


def all_of(*pairs) -> Column:
    """Columns and criteria in turn; a row must meet them all."""
    out = F.lit(True)
    for column, criterion in zip(pairs[::2], pairs[1::2], strict=True):
        out = out & matches(column, criterion)
    return out


def criteria_rows(rows: list[dict]) -> Column:
    """A criteria range: the columns of a row are all met, of the rows any; blank conditions do not count."""
    out = F.lit(False)
    for row in rows:
        met = F.lit(True)
        for column, criterion in row.items():
            if criterion not in (None, ""):
                met = met & matches(column, criterion)
        out = out | met
    return out if rows else F.lit(True)


def spread(df: DataFrame, column: str, criteria: list, aggregates: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """SUMIF and its like with an array of criteria: a row per criterion, from one pass over ``df``.

    Each aggregate is given the condition of the criterion, e.g. ``lambda met: F.sum(F.when(met, F.col("x")))``.
    """
    met = [matches(column, c) for c in criteria]
    rows = F.array(*(F.struct(F.lit(str(c)).alias("criterion"), *(f(m).alias(a) for a, f in aggregates.items())) for c, m in zip(criteria, met, strict=True)))
    return df.agg(rows.alias("rows")).select(F.explode("rows").alias("row")).select("row.*")


def offset_sum(df: DataFrame, tested: str, criterion, position: str, shift: int, summed: DataFrame, value: str) -> DataFrame:
    """SUMIF whose sum range lies elsewhere: cells of ``summed`` at the places of the cells that meet the criterion.

    The range is stretched to the size of the tested one: places of it that ``summed`` does not hold count nothing.
    """
    places = df.where(matches(tested, criterion)).select((F.col(position) + shift).alias("_place"))
    return places.join(summed.select(F.col(position).alias("_place"), value), "_place").agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))
