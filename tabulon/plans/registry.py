"""The registered queries: a callable of (spark, folder) each, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


class Later:
    """Arithmetic on a column that is made when the query is: registering needs no session."""

    def __init__(self, make: Callable[[], Column]) -> None:
        self.make = make

    def _with(self, f, other):
        return Later(lambda: f(self.make(), other.make() if isinstance(other, Later) else other))

    def __add__(self, other):
        return self._with(lambda a, b: a + b, other)

    def __sub__(self, other):
        return self._with(lambda a, b: a - b, other)

    def __rsub__(self, other):
        return self._with(lambda a, b: b - a, other)

    def __mul__(self, other):
        return self._with(lambda a, b: a * b, other)

    def __truediv__(self, other):
        return self._with(lambda a, b: a / b, other)

    def __mod__(self, other):
        return self._with(lambda a, b: a % b, other)


def later(name: str) -> Later:
    return Later(lambda: F.col(name))


def made(x):
    return x.make() if isinstance(x, Later) else x

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return wrap


def r(c: Column, digits: int = 4) -> Column:
    """Rounded so that sums in another order agree."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def rs(sql: str, digits: int = 4) -> str:
    return f"floor(({sql}) * {10.0**digits} + 0.5) / {10.0**digits}"


def scalars(name: str, source: str, key: list[str], exprs: dict[str, tuple[Callable[[], Column], str | None]], where: str | None = None, slow: bool = False) -> None:
    """A query of row-wise expressions: {alias: (column, SQL)}; without any SQL it has no oracle. Slow ones get their rows over all cores."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = table(spark, folder, source)
        df = spread(df, 10_000) if slow else df
        return (df.where(where) if where else df).select(*key, *(make().alias(a) for a, (make, _) in exprs.items()))

    sql = None
    if all(s is not None for _, s in exprs.values()):
        sql = f"SELECT {', '.join([*key, *(f'{s} AS {a}' for a, (_, s) in exprs.items())])} FROM {source}" + (f" WHERE {where}" if where else "")
    query(name, sql)(run)
