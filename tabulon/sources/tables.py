"""Tables in and out, and the cell relation: one row per cell of a sheet-like table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_any(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV, TSV and JSON by the suffix of the path or by name."""
    kind = (kind or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind in ("csv", "tsv", "txt"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="," if kind == "csv" else "\t", **options)
    return spark.read.format(kind).options(**options).load(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """A report as tab-separated text with a header in each part."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def cells(df: DataFrame, sheet: str, row: str, columns: list[str]) -> DataFrame:
    """(sheet, row, col, value) with values as text; numbers of columns count from 1. One scan, no shuffle."""
    packed = F.posexplode(F.array(*(F.col(c).cast("string") for c in columns))).alias("_p", "value")
    return df.select(F.lit(sheet).alias("sheet"), F.col(row).cast("bigint").alias("row"), packed).select(
        "sheet", "row", (F.col("_p") + 1).alias("col"), "value"
    )


def spread(df: DataFrame, rows: int = 0) -> DataFrame:
    """``df`` over all cores: a small file is one task, which is too few for slow work on each row.

    With ``rows``, a task gets so many at least; counting them reads no column of a Parquet file.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(min(tasks, df.count() // rows + 1) if rows else tasks)
