"""The database family: aggregates over the rows of a table that a criteria range selects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.aggregate import DATABASE
from tabulon.functions.registry import NUM, VALUE, value
from tabulon.operators.criteria import criteria_rows


def field_name(table: DataFrame, field: str | int) -> str:
    """A field by its name, without regard to case, or by its place from 1."""
    if isinstance(field, int):
        return table.columns[field - 1]
    return next(c for c in table.columns if c.lower() == field.lower())


def database(table: DataFrame, calls: dict[str, tuple[str, str | int]], criteria: list[dict]) -> DataFrame:
    """One row with a column per call, {alias: (function, field)}; the filter reaches the scan and is shared."""
    chosen = table.where(criteria_rows(criteria))
    return chosen.agg(*(value(DATABASE[f], field_name(table, field)).alias(name) for name, (f, field) in calls.items()))


def dget(table: DataFrame, field: str | int, criteria: list[dict]) -> DataFrame:
    """The single match as value and error; none is #VALUE!, more than one #NUM!."""
    name = field_name(table, field)
    n = F.count(F.lit(1))
    code: Column = F.when(n == 0, VALUE).when(n > 1, NUM)
    return table.where(criteria_rows(criteria)).agg(F.when(n == 1, F.first(name)).alias("value"), code.alias("error"))
