"""Sharding by fixed virtual slots.

Every record hashes into one of ``N_SLOTS`` virtual slots by its id and text, for good. One aggregation adds up the
bytes and rows of each slot; the driver sees those ``N_SLOTS`` sums only. A stored, versioned map deals the slots to
shards. Its first version deals them evenly by number, knowing no sizes; ``rebalance`` edits the latest version: it
moves as few slots as it can until the shards' bytes are nearly equal, and the result is stored as the next version,
while records keep their slots.

The size of a record is the UTF-8 bytes of its text (none for null) plus 1. Within a shard records stand in
the order of their slots and ids; the place of a record (column ``slot`` of the query) is the number of rows of
the shard's earlier slots plus its rank inside its own slot, so no task ever orders a whole shard.

Defined results: records without an id, or with one that repeats, are spread by their texts; rows that agree in id and
text share a virtual slot and take places side by side. An empty table gives an empty result and a map of empty slots.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import shared_folder

N_SLOTS = 4096
N_SHARDS = 16


def virtual_slot(id_col: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """The slot of a record: it depends on its id and text alone."""
    return F.pmod(F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("")), text), F.lit(n_slots)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        virtual_slot(F.col(id_col), text, n_slots).alias("vslot"),
    )


def slot_sizes(rows: DataFrame, n_slots: int = N_SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of every slot, from one pre-aggregated pass; ``n_slots`` rows reach the driver."""
    found = {r.vslot: (r.b, r.n) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    return [found.get(s, (0, 0)) for s in range(n_slots)]


def first_map(n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> list[int]:
    """Shard of each slot in version 1, before any sizes are known."""
    return [slot % n_shards for slot in range(n_slots)]


#: Rebalancing ends when the fullest and the emptiest shard differ by no more than this share of the mean.
TOLERANCE = 0.01


def rebalance(shards: list[int], sizes: list[tuple[int, int]], n_shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The next version of a map for ``n_shards`` shards and new sizes, with few moves.

    Slots of shards that no longer exist move; then the fullest shard that can gives the slot nearest to half of the
    gap to the emptiest, as long as a move narrows a gap beyond the tolerance.
    """
    out = list(shards)
    loads = [0] * n_shards
    homeless = []
    for slot, shard in enumerate(out):
        if shard < n_shards:
            loads[shard] += sizes[slot][0]
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-sizes[s][0], s)):
        to = min(range(n_shards), key=lambda k: (loads[k], k))
        out[slot] = to
        loads[to] += sizes[slot][0]
    owned: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(out):
        owned[shard].append(slot)
    moved = True
    while moved:
        moved = False
        low = min(range(n_shards), key=lambda k: (loads[k], k))
        for high in sorted(range(n_shards), key=lambda k: (-loads[k], k)):
            gap = loads[high] - loads[low]
            if gap <= tolerance * sum(loads) / n_shards:
                break
            fitting = [s for s in owned[high] if 0 < sizes[s][0] < gap]
            if fitting:  # a shard with one slot beyond the gap gives nothing, the next may
                move = min(fitting, key=lambda s: (abs(gap - 2 * sizes[s][0]), s))
                owned[high].remove(move)
                owned[low].append(move)
                loads[high] -= sizes[move][0]
                loads[low] += sizes[move][0]
                out[move] = low
                moved = True
                break
    return out


def map_frame(spark: SparkSession, shards: list[int], sizes: list[tuple[int, int]], version: int = 1) -> DataFrame:
    """The map as a table: one row per slot."""
    before = {k: 0 for k in shards}
    rows = []
    for slot, shard in enumerate(shards):
        rows.append((version, slot, shard, before[shard], sizes[slot][0], sizes[slot][1]))
        before[shard] += sizes[slot][1]
    return spark.createDataFrame(rows, "version int, vslot int, shard int, rows_before long, slot_bytes long, slot_rows long")


def save_map(frame: DataFrame, path: str) -> None:
    """Store one version of the map beside the older ones, which stay readable; a version is never stored twice."""
    version = frame.first()["version"]
    frame.drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select(
        "version", "vslot", "shard", "rows_before", "slot_bytes", "slot_rows"
    )


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records of ``sized`` with their shard and their place in it, gapless from 0 in each shard."""
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")) - 1
    return (
        rows.withColumn("inside", inside)
        .join(F.broadcast(slot_map), "vslot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("rows_before") + F.col("inside")).cast("long").alias("slot"),
            F.col("vslot"),
            F.col("version").alias("map_version"),
        )
    )


def shard_documents(
    docs: DataFrame,
    n_shards: int = N_SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_slots: int = N_SLOTS,
    path: str | None = None,
) -> DataFrame:
    """Each record with its shard and place, by the latest version of the map at ``path`` edited for the sizes of now.

    Where no map is stored yet (or no path given) one is begun.
    """
    spark = docs.sparkSession
    rows = sized(docs, id_col, text_col, n_slots)
    sizes = slot_sizes(rows, n_slots)
    if path is None:
        path = f"{shared_folder(spark)}/shard-map-{uuid.uuid4().hex}"
        save_map(map_frame(spark, first_map(n_slots, n_shards), sizes), path)
    stored = load_map(spark, path).select("vslot", "shard", "version").collect()  # n_slots rows
    shards = [r.shard for r in sorted(stored, key=lambda r: r.vslot)]
    edited = rebalance(shards, sizes, n_shards)
    save_map(map_frame(spark, edited, sizes, stored[0].version + 1), path)
    return assign(rows, load_map(spark, path))
