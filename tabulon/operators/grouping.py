"""GROUPBY and PIVOTBY: grouped and crossed summaries with totals, text keys without regard to case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "Total"


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Text keys get a lower-cased twin to group by; the first casing in order is what is shown."""
    kinds = dict(df.dtypes)
    folded = []
    for k in keys:
        if kinds[k] == "string":
            df = df.withColumn(f"_fold_{k}", F.lower(k))
            folded.append(f"_fold_{k}")
        else:
            folded.append(k)
    return df, folded


def groupby(
    df: DataFrame, keys: list[str], aggregates: dict[str, Column], total: bool = False, where: Column | None = None, sort: list | None = None
) -> DataFrame:
    """A row per key, and with ``total`` one more row whose keys are null and whose ``is_total`` is true.

    Rows and total come from one grouping-sets aggregation, so the table is read once.
    """
    if where is not None:
        df = df.where(where)
    df, folded = _keyed(df, keys)
    shown = [F.min(k).alias(f"_show_{k}") for k, f in zip(keys, folded, strict=True) if f != k]
    cols = [F.col(f) for f in folded]
    grouped = df.groupingSets([cols, []], *cols) if total else df.groupBy(*cols)
    marks = [F.grouping_id().alias("_level")] if total else []
    out = grouped.agg(*(c.alias(a) for a, c in aggregates.items()), *shown, *marks)
    is_total = (F.col("_level") > 0) if total else F.lit(False)
    picked = [
        (F.when(is_total, None).otherwise(F.col(f"_show_{k}")) if f != k else F.col(k)).alias(k) for k, f in zip(keys, folded, strict=True)
    ]
    out = out.select(*picked, *aggregates, *([is_total.alias("is_total")] if total else []))
    return out.orderBy(*sort) if sort else out


def groupby_levels(
    df: DataFrame, keys: list[str], aggregates: dict[str, Column], total_depth: int = 1, sort_order: list[int] | None = None, where: Column | None = None
) -> DataFrame:
    """GROUPBY with its options: ``total_depth`` 0 is none, 1 the grand total, 2 and more subtotals as well, below their
    rows if positive and above if negative; ``sort_order`` numbers columns of the result from 1, descending if negative.

    ``level`` is 0 for plain rows and counts the keys that a total has summed over. The result is sorted as a whole, by
    its columns or, without ``sort_order``, by its keys. All levels come from one grouping-sets aggregation.
    """
    if where is not None:
        df = df.where(where)
    df, folded = _keyed(df, keys)
    cols = [F.col(f) for f in folded]
    depths = [len(cols), *range(min(abs(total_depth), len(cols)) - 1, -1, -1)]
    shown = [F.min(k).alias(f"_show_{k}") for k in keys]
    grouped = df.groupingSets([cols[:d] for d in depths], *cols).agg(*(c.alias(a) for a, c in aggregates.items()), *shown, F.grouping_id().alias("_id"))
    level = F.length(F.replace(F.bin(F.col("_id")), F.lit("0"), F.lit("")))
    out = grouped.select(
        *(F.when(F.col(f).isNotNull(), F.col(f"_show_{k}")).alias(k) for k, f in zip(keys, folded, strict=True)), *aggregates, level.alias("level")
    )
    names = [*keys, *aggregates]
    wanted = [(F.col(names[abs(n) - 1]), n < 0) for n in sort_order or []] or [(F.col(k), False) for k in keys]
    last = total_depth > 0
    by_level = [F.col("level").asc() if last else F.col("level").desc()]
    order = [c.desc_nulls_last() if down else (c.asc_nulls_last() if last else c.asc_nulls_first()) for c, down in wanted]
    return out.orderBy(*((by_level + order) if sort_order else (order + by_level)))


def pivotby(df: DataFrame, rows: list[str], column: str, values: list, aggregate: Column, totals: bool = False) -> DataFrame:
    """Row keys down, the given values of ``column`` across; ``totals`` adds a column ``Total`` and a row of nulls.

    The values are named, so that no extra pass has to find them; cells without rows are null.
    """
    if not totals:
        return df.groupBy(*rows).pivot(column, values).agg(aggregate)
    cols = [F.col(r) for r in rows]
    sets = [[*cols, F.col(column)], cols, [F.col(column)], []]
    named = df.where(F.col(column).isin(values))
    long = named.groupingSets(sets, *cols, F.col(column)).agg(aggregate.alias("_v"), F.grouping(column).alias("_c"), F.grouping(rows[0]).alias("is_total"))
    across = F.when(F.col("_c") == 1, TOTAL).otherwise(F.col(column).cast("string"))
    return (
        long.withColumn("_k", across)
        .groupBy(*rows, (F.col("is_total") == 1).alias("is_total"))
        .pivot("_k", [*map(str, values), TOTAL])
        .agg(F.first("_v"))
    )


def get_pivot_data(pivot: DataFrame, keys: dict, column: str) -> DataFrame:
    """One cell of a pivot by its keys."""
    test = F.lit(True)
    for k, v in keys.items():
        test = test & (F.lower(F.col(k).cast("string")) == str(v).lower())
    return pivot.where(test).select(F.col(column).alias("value"))


def subtotals(df: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """All levels of a hierarchy at once, with the level of each row (0 is the finest)."""
    out = df.rollup(*keys).agg(*(c.alias(a) for a, c in aggregates.items()), F.grouping_id().alias("level"))
    return out
