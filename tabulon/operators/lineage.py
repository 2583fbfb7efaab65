"""Cutting the lineage of frames that are worked on in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode, where all share the machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tabulon-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a Parquet table. Unlike a checkpoint it carries no constraints of its plan along, which grow in rounds
    that name a column again and again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
