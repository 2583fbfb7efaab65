"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) leaves this remainder are held out of every fit.
FOLDS = 5
#: A key that more than one in HEAVY of all rows share is handled apart; there are at most HEAVY such keys.
HEAVY = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that ``spark.checkpoint.dir`` names.

    Where none is named a temporary one is made in local mode; a cluster without the setting is an error, since its
    machines would each write to a folder of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tabulon-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that it is computed once and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a Parquet table, for results whose readers need some of the columns each."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fold(doc_id: Column) -> Column:
    """crc32 of the decimal text of the id, modulo ``FOLDS``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def within_share(place: Column, share: float) -> Column:
    """True for about ``share`` of all 64-bit hashes."""
    return place <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_parts(doc_id: Column) -> tuple[Column, Column]:
    """Whether the id is null, and the id or 0: together they order as ids do, null last."""
    whole = doc_id.cast("bigint")
    return whole.isNull(), F.coalesce(whole, F.lit(0).cast("bigint"))


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text with different seeds; null counts as empty."""
    said = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(said), F.xxhash64(F.lit(7), said)


def rest_hash(df: DataFrame) -> Column:
    """A hash of the whole row, to choose between rows that agree in id and text."""
    return F.xxhash64(*(F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` with the columns of their key's one row in ``table``, whose column ``count`` says how many rows have it.

    The rows of heavy keys stay where they are and meet a broadcast of those keys: at most ``HEAVY`` of them, since
    the counts sum to ``total`` or less.
    """
    heavy = F.col(count) * HEAVY > total
    few = F.broadcast(table.where(heavy))
    many = rows.join(few.select(*keys), keys, "left_anti").join(table.where(~heavy), keys)
    return rows.join(few, keys).unionByName(many)
