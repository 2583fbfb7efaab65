"""Lookups as joins.

Exact lookups take the first match: the table is reduced to one row per key, so the join never multiplies rows.
Approximate lookups (the last key at or below a value) are as-of joins: both sides are laid into one stream ordered by
key, and a window carries the latest table row along. The stream is cut into ranges of the key first: every range learns
the last table row of the ranges before it from a summary of one row per group and range, and no task ever holds more
than its range, however many rows a group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.registry import NA


def _first_rows(table: DataFrame, key: Column, order: Column, values: list[str], last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    row = F.struct(*values)
    return table.where(key.isNotNull()).groupBy(key.alias("_key")).agg(pick(row, order).alias("_row"))


def _folded(df: DataFrame, c: str) -> Column:
    return F.lower(c) if dict(df.dtypes)[c] == "string" else F.col(c)


def xlookup(
    left: DataFrame, on: str, table: DataFrame, key: str, values: list[str], order: str | None = None, if_not_found: dict | None = None, last: bool = False
) -> DataFrame:
    """``left`` with ``values`` of the first row of ``table`` (by ``order``) whose key equals ``on``; text in any case.

    Columns that are not found hold ``if_not_found`` or null, and ``lookup_error`` tells #N/A.
    """
    firsts = _first_rows(table, _folded(table, key), F.col(order or key), values, last)
    joined = left.withColumn("_on", _folded(left, on)).join(firsts, F.col("_on") == F.col("_key"), "left")
    missing = F.col("_row").isNull()
    out = [F.col(f"_row.{v}") for v in values]
    if if_not_found:
        out = [F.when(missing, F.lit(if_not_found.get(v))).otherwise(c).alias(v) for v, c in zip(values, out, strict=True)]
    return joined.select(*(left[c] for c in left.columns), *out, F.when(missing, NA).alias("lookup_error"))


def vlookup_exact(left: DataFrame, on: str, table: DataFrame, column: int, order: str | None = None) -> DataFrame:
    """The first column of ``table`` is the key; the value is taken from the column of that number."""
    return xlookup(left, on, table, table.columns[0], [table.columns[column - 1]], order)


def hlookup(
    left: DataFrame, on: str, table: DataFrame, order: str, row: int, key_row: int = 1, approximate: bool = False
) -> DataFrame:
    """HLOOKUP: the keys stand in one row of ``table`` (by the number in ``order``), the results in another.

    Two rows of the table are turned into one row per column, and the lookup goes on downwards. The first match from
    the left counts, or with ``approximate`` the last key at or below the value.
    """
    columns = [c for c in table.columns if c != order]
    two = table.where(F.col(order).isin(key_row, row)).select(order, *(F.col(c).cast("string") for c in columns))
    places = F.array(*(F.struct(F.lit(k).alias("place"), F.col(c).alias("v")) for k, c in enumerate(columns)))
    cells = two.select(order, F.explode(places).alias("c")).select(order, "c.*")
    at = lambda n: F.max(F.when(F.col(order) == n, F.col("v")))
    across = cells.groupBy("place").agg(at(key_row).alias("key"), at(row).alias("value"))
    if approximate:
        return asof(left, on, across.where("key IS NOT NULL"), "key", ["value"])
    return xlookup(left.withColumn("_text", F.col(on).cast("string")), "_text", across, "key", ["value"], "place").drop("_text")


def asof(
    left: DataFrame, on: str, table: DataFrame, key: str, values: list[str], by: list[str] | None = None, direction: str = "backward", ranges: int | None = None
) -> DataFrame:
    """``left`` with ``values`` of the table row with the largest key <= ``on`` (or the smallest >= for "forward").

    ``by`` gives columns that must be equal on both sides. Ties in the table go to its last row in value order.
    """
    backward = direction == "backward"
    by = by or []
    row = F.struct(F.col(key).cast("double").alias("_key"), *values)
    nothing = F.lit(None).cast(table.select(row).schema[0].dataType)
    probe = F.struct(*left.columns)
    no_probe = F.lit(None).cast(left.select(probe).schema[0].dataType)
    both = left.select(*by, F.col(on).cast("double").alias("_at"), F.lit(1 if backward else 0).alias("_side"), nothing.alias("_row"), probe.alias("_left")).unionByName(
        table.select(*by, F.col(key).cast("double").alias("_at"), F.lit(0 if backward else 1).alias("_side"), row.alias("_row"), no_probe.alias("_left"))
    )
    step = F.last if backward else F.first
    order = [F.col("_at"), F.col("_side"), F.col("_row")]
    frame = (Window.unboundedPreceding, 0) if backward else (0, Window.unboundedFollowing)
    # Ranges of the values at hand. Each group and range gets one row more, the table row nearest to it from the ranges
    # before (or after) it, so that a group with many rows is spread over many tasks.
    n = ranges or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = both.select(F.percentile_approx("_at", [k / n for k in range(1, n)], 10_000).alias("c")).first().c if n > 1 else None
    place = F.aggregate(F.array(*map(F.lit, sorted(set(cuts)))), F.lit(0), lambda acc, c: acc + F.when(c < F.col("_at"), 1).otherwise(0)) if cuts else F.lit(0)
    ranged = both.withColumn("_range", place)
    edge = (F.max if backward else F.min)(F.when(F.col("_row").isNotNull(), F.struct("_at", "_row")))
    edges = ranged.groupBy(*by, "_range").agg(edge.alias("_edge"))
    others = Window.partitionBy(*by).orderBy("_range").rowsBetween(*((Window.unboundedPreceding, -1) if backward else (1, Window.unboundedFollowing)))
    outside = F.lit(float("-inf" if backward else "inf"))
    carried = edges.select(*by, outside.alias("_at"), F.lit(0 if backward else 1).alias("_side"), step(F.col("_edge._row"), ignorenulls=True).over(others).alias("_row"), no_probe.alias("_left"), "_range")
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(*frame)
    found = ranged.unionByName(carried).withColumn("_hit", step("_row", ignorenulls=True).over(inside))
    picked = [F.col(f"_hit.{v}").alias(v) for v in values]
    return found.where(F.col("_left").isNotNull()).select("_left.*", *picked, F.when(F.col("_hit").isNull(), NA).alias("lookup_error"))


def vlookup_approximate(left: DataFrame, on: str, table: DataFrame, column: int) -> DataFrame:
    return asof(left, on, table, table.columns[0], [table.columns[column - 1]])


def lookup_vector(left: DataFrame, on: str, table: DataFrame, key: str, result: str | None = None) -> DataFrame:
    """LOOKUP: the result beside the last key at or below the value, or that key."""
    return asof(left, on, table, key, [result or key] if (result or key) != on else [result or key])


def match(left: DataFrame, on: str, table: DataFrame, key: str, order: str, mode: int = 0) -> DataFrame:
    """``left`` with ``position``, the place from 1 (by ``order``) of the first match.

    Mode 0 is equality, 1 the largest key at or below, -1 the smallest at or above. Places are numbered by
    ``zip_with_position``, without ordering the table in one task.
    """
    placed = zip_with_position(table.where(F.col(key).isNotNull()), order)
    if mode == 0:
        return xlookup(left, on, placed, key, ["position"], "position")
    return asof(left, on, placed, key, ["position"], direction="backward" if mode == 1 else "forward")


def zip_with_position(df: DataFrame, order: str, name: str = "position", ranges: int = 64) -> DataFrame:
    """Rows with their place from 1 in an order, from ranges of the order column and their sizes."""
    values = df.select(F.percentile_approx(F.col(order).cast("double"), [k / ranges for k in range(1, ranges)], 10_000).alias("c")).first().c or []
    cuts = F.array(*map(F.lit, sorted(set(values)))) if values else F.array().cast("array<double>")
    ranged = df.withColumn("_range", F.aggregate(cuts, F.lit(0), lambda acc, c: acc + F.when(c < F.col(order).cast("double"), 1).otherwise(0)))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_range", "_inside", "_before")


def matched(left: DataFrame, on: str, table: DataFrame, key: str) -> DataFrame:
    """Rows with a match (COUNTIF > 0)."""
    return left.join(table.select(F.col(key).alias("_key")), F.col(on) == F.col("_key"), "left_semi")


def unmatched(left: DataFrame, on: str, table: DataFrame, key: str) -> DataFrame:
    """Rows without a match (ISNA of MATCH)."""
    return left.join(table.select(F.col(key).alias("_key")), F.col(on) == F.col("_key"), "left_anti")


def index(df: DataFrame, order: str, row: int, column: int | None = None) -> DataFrame:
    """INDEX: one row by its place, all columns or one."""
    found = zip_with_position(df, order).where(F.col("position") == row).drop("position")
    return found if not column else found.select(df.columns[column - 1])


def address(row: Column, column: Column, absolute: int = 1, a1: bool = True, sheet: str | None = None) -> Column:
    """ADDRESS: the text of a reference; letters are digits of a base without zero."""
    c, letters = column.cast("int"), F.lit("")
    for _ in range(3):
        letters = F.when(c > 0, F.concat(F.char(65 + (c - 1) % 26), letters)).otherwise(letters)
        c = F.when(c > 0, F.floor((c - 1) / 26).cast("int")).otherwise(c)
    r = row.cast("int").cast("string")
    if a1:
        out = F.concat(F.lit("$" if absolute in (1, 3) else ""), letters, F.lit("$" if absolute in (1, 2) else ""), r)
    else:
        mark = lambda x, fixed: x if fixed else F.concat(F.lit("["), x, F.lit("]"))
        out = F.concat(F.lit("R"), mark(r, absolute in (1, 2)), F.lit("C"), mark(column.cast("int").cast("string"), absolute in (1, 3)))
    return F.concat(F.lit(f"{sheet}!"), out) if sheet else out
