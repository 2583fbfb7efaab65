"""Exact deduplication with DataFrame functions only.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. The
normalised texts are grouped by their 128-bit content hash *and* their bytes, so a hash collision never
merges two texts; the grouping combines map-side, so the copies of a hot text meet as one row per task.
The documents then find their group by the two fixed-length hashes of the text: no text moves in that join,
and since a group is one row there, adaptive execution can split the rows of a hot group.

Defined results: a null text counts as empty, so null, empty and blank texts are copies of each other.
Rows that repeat a doc_id with an equal text are the same document: each is returned and carries the same
verdict (``deduplicate`` leaves one of them: the longest, then that with the smallest hash of the whole row). A null
doc_id loses every tie against a non-null one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import id_parts, rest_hash

#: Fixed value: the characters that do not count, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


#: Beyond every id: lengths and ids share a fixed-width number, which keeps the grouping a hash aggregation.
_IDS = f"1{'0' * 20}BD"


def _groups(rows: DataFrame) -> DataFrame:
    """One row per group of equal texts: content_hash, text_sha256, group_size, keep_id, keep_chars.

    ``rows`` has doc_id, n_chars, norm and content_hash.
    """
    code = F.coalesce(F.expr("9223372036854775808BD - doc_id"), F.expr("0BD"))  # greater for smaller ids, 0 for none
    best = (F.col("n_chars").cast("decimal(18,0)") * F.expr(_IDS) + code).cast("decimal(38,0)")
    left = F.pmod(F.col("best"), F.expr(_IDS))
    return (
        rows.groupBy("content_hash", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(best).alias("best"))
        .select(
            "content_hash",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            "group_size",
            F.when(left > 0, (F.expr("9223372036854775808BD") - left).cast("long")).alias("keep_id"),
            F.floor(F.col("best") / F.expr(_IDS)).cast("long").alias("keep_chars"),
        )
    )


def _rows(docs: DataFrame, id_col: str, text_col: str, content_hash: Callable[[Column], Column]) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        normalised(F.col(text_col)).alias("norm"),
    ).withColumn("content_hash", content_hash(F.col("norm").cast("binary")))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, n_chars.

    ``content_hash`` is replaceable so that collisions can be tested.
    """
    rows = _rows(docs, id_col, text_col, content_hash)
    keyed = rows.select("doc_id", "n_chars", "content_hash", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    return keyed.join(_groups(rows), ["content_hash", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of equal texts, with all its columns.

    The groups carry no text; the row that stays is found by its id, its length and the hash of its text. Rows that
    agree in these are one before they are sent.
    """
    names = ["no_id", "id", "n_chars", "sha"]
    no_id, whole = id_parts(F.col("keep_id"))
    stay = _groups(_rows(docs, id_col, text_col, F.md5)).select(
        no_id.alias("no_id"), whole.alias("id"), F.col("keep_chars").alias("n_chars"), F.col("text_sha256").alias("sha")
    )
    no_id, whole = id_parts(F.col(id_col))
    named = docs.select(
        F.struct("*").alias("doc"),
        no_id.alias("no_id"),
        whole.alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("sha"),
        rest_hash(docs).alias("rest"),
    )
    # The same four columns deal the rows for both steps: they move once.
    one = named.groupBy(*names).agg(F.min_by("doc", "rest").alias("doc"))
    return one.join(stay, names, "left_semi").select("doc.*")
