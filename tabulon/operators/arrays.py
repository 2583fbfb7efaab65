"""Dynamic arrays as DataFrame operations. A relation has no order of its own: what depends on one takes it by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.registry import NA
from tabulon.functions.text import wildcard
from tabulon.operators.lookup import zip_with_position


def filter_rows(df: DataFrame, include: Column) -> DataFrame:
    return df.where(include)


def unique(df: DataFrame, order: str | None = None, exactly_once: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Distinct rows; with ``order`` sorted by first appearance; ``exactly_once`` keeps rows that occur once."""
    columns = columns or [c for c in df.columns if c != order]
    grouped = df.groupBy(*columns).agg(F.count("*").alias("_n"), *([F.min(order).alias("_first")] if order else []))
    if exactly_once:
        grouped = grouped.where("_n = 1")
    return (grouped.orderBy("_first") if order else grouped).select(*columns)


def sort(df: DataFrame, *keys: str, tie: str | None = None) -> DataFrame:
    """By columns, a leading minus for descending; ``tie`` (a row order) makes it stable."""
    cols = [F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in keys]
    return df.orderBy(*cols, *([F.col(tie)] if tie else []))


def take(df: DataFrame, order: str, n: int, columns: int | None = None) -> DataFrame:
    """First n rows in an order, or the last -n; a top-n, so no full sort."""
    out = df.orderBy(order).limit(n) if n >= 0 else df.orderBy(F.col(order).desc()).limit(-n)
    if columns is None:
        return out
    return out.select(*(df.columns[:columns] if columns >= 0 else df.columns[columns:]))


def drop(df: DataFrame, order: str, n: int) -> DataFrame:
    """All but the first n rows (or the last -n): those beyond the n-th in the order."""
    placed = zip_with_position(df, order)
    if n >= 0:
        return placed.where(F.col("position") > n).drop("position")
    size = df.agg(F.count("*").alias("_size"))
    return placed.join(F.broadcast(size), F.col("position") <= F.col("_size") + n).drop("position", "_size")


def expand(df: DataFrame, order: str, rows: int, pad: dict | None = None) -> DataFrame:
    """At least ``rows`` rows; the added ones hold ``pad`` or null, with the row error #N/A."""
    grid = df.sparkSession.range(1, rows + 1).withColumnRenamed("id", "position")
    out = grid.join(zip_with_position(df, order), "position", "full_outer")
    missing = F.col(order).isNull()
    cols = [F.when(missing, F.lit((pad or {}).get(c))).otherwise(F.col(c)).alias(c) for c in df.columns]
    return out.select("position", *cols, F.when(missing, NA).alias("row_error"))


def vstack(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def hstack(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows side by side by their places; the shorter side is filled with nulls."""
    return zip_with_position(left, left_order).join(zip_with_position(right, right_order), "position", "full_outer")


def to_column(df: DataFrame, order: str, columns: list[str], ignore_blanks: bool = False, by_column: bool = False) -> DataFrame:
    """All cells in one column, with their row (``order``) and column place."""
    cells = df.select(order, F.posexplode(F.array(*(F.col(c).cast("string") for c in columns))).alias("column", "value"))
    if ignore_blanks:
        cells = cells.where(F.col("value").isNotNull())
    return cells.orderBy(*(["column", order] if by_column else [order, "column"]))


def to_row(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """All cells as one array; a row of output, so for small tables."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.array(*(F.col(c).cast("string") for c in columns)).alias("_v"))))
    return df.agg(F.flatten(F.transform(rows, lambda r: r["_v"])).alias("value"))


def wrap_rows(df: DataFrame, order: str, value: str, width: int) -> DataFrame:
    """A vector folded into rows of ``width`` cells c1, c2, ..."""
    k = F.col("position") - 1
    placed = zip_with_position(df.select(order, value), order)
    return (
        placed.withColumn("row", F.floor(k / width))
        .groupBy("row")
        .agg(*(F.max(F.when(k % width == c, F.col(value))).alias(f"c{c + 1}") for c in range(width)))
    )


def wrap_columns(df: DataFrame, order: str, value: str, height: int, columns: int) -> DataFrame:
    """A vector folded into columns of ``height`` cells."""
    k = F.col("position") - 1
    placed = zip_with_position(df.select(order, value), order).withColumn("row", k % height)
    return placed.groupBy("row").agg(*(F.max(F.when(F.floor(k / height) == c, F.col(value))).alias(f"c{c + 1}") for c in range(columns)))


def choose_rows(df: DataFrame, order: str, places: list[int]) -> DataFrame:
    """Rows by place, repeats allowed, in the order asked for."""
    asked = df.sparkSession.createDataFrame(list(enumerate(places, 1)), "pick int, position long")
    return zip_with_position(df, order).join(F.broadcast(asked), "position").orderBy("pick").drop("pick", "position")


def choose_columns(df: DataFrame, places: list[int]) -> DataFrame:
    return df.select(*(df.columns[p - 1 if p > 0 else p] for p in places))


def transpose(df: DataFrame, key: str, keys: list) -> DataFrame:
    """Columns become rows: one row per column of ``df``, one column per named key."""
    cells = df.unpivot(key, [c for c in df.columns if c != key], "column", "value")
    return cells.groupBy("column").pivot(key, keys).agg(F.first("value"))


def xmatch(df: DataFrame, value: Column, array: str, mode: int = 0, from_end: bool = False) -> Column:
    """Place of a value in an array column: exact, next smaller (-1), next larger (1), or a text with wildcards (2)."""
    xs = F.col(array)
    if mode == 2:  # ``value`` is a Python string here
        hits = F.filter(F.transform(xs, lambda x, i: F.when(x.rlike(wildcard(value)), i + 1)), lambda i: i.isNotNull())
        return F.get(F.reverse(hits) if from_end else hits, F.lit(0))
    if mode == 0:
        place = F.array_position(F.reverse(xs) if from_end else xs, value)
        return F.when(place > 0, F.size(xs) + 1 - place if from_end else place)
    fit = F.filter(xs, (lambda x: x <= value) if mode == -1 else (lambda x: x >= value))
    return F.nullif(F.array_position(xs, F.array_max(fit) if mode == -1 else F.array_min(fit)), F.lit(0))


# -- matrices as relations of (i, j, v) ----------------------------------------------------------------------------


def mmult(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices: a join on the inner index and a sum, combined map-side."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    return (
        a.withColumnRenamed("j", "k").join(right, "k").groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))
    )


def mtranspose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
