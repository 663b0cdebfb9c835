"""Sharding by fixed virtual slots and a versioned map from slot to shard.

A record's slot is a hash of its id and text, and never changes. Version 1 of the map deals slots out in turn;
rebalancing looks at the bytes of each slot and edits the map, so that only the moved slots' records move.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.session import shared_folder, stage

#: The map has a row per slot, whatever the input; it is the only thing held on the driver.
SLOTS = 4096
MAP = "slot int, shard int, version int"


def initial_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    return {slot: slot % shards for slot in range(slots)}


def rebalance(current: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The map with slots moved, or exchanged, between the heaviest and the lightest shard while that evens them out.

    ``shards`` may be more or fewer than before: slots of shards that are gone go to the lightest one.
    """
    edited, load = dict(current), [0] * shards
    members: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in sorted(current.items()):
        entry = (sizes.get(slot, 0), slot)
        if shard < shards:
            members[shard].append(entry)
            load[shard] += entry[0]
        else:
            homeless.append(entry)
    for own in members:
        own.sort()

    def put(entry: tuple[int, int], shard: int) -> None:
        members[shard].insert(bisect_left(members[shard], entry), entry)
        load[shard] += entry[0]
        edited[entry[1]] = shard

    def take(entry: tuple[int, int], shard: int) -> None:
        members[shard].remove(entry)
        load[shard] -= entry[0]

    for entry in sorted(homeless, reverse=True):
        put(entry, load.index(min(load)))
    for _ in range(4 * len(current)):
        high, low = load.index(max(load)), load.index(min(load))
        gap = load[high] - load[low]
        best, choice = gap, None
        for out in [None, *members[low]]:
            # moving one entry, or exchanging it for ``out``, should shift about half the gap
            wanted = gap / 2 + (out[0] if out else 0)
            at = bisect_left(members[high], (wanted, -1))
            for entry in members[high][max(0, at - 1) : at + 1]:
                left = abs(gap - 2 * (entry[0] - (out[0] if out else 0)))
                if left < best:
                    best, choice = left, (entry, out)
        if choice is None:
            break
        entry, out = choice
        take(entry, high)
        if out:
            take(out, low)
            put(out, high)
        put(entry, low)
    return edited


def save_map(spark: SparkSession, folder: str, version: int, slots: dict[int, int]) -> None:
    """Adds a version to the store; a version once written is not changed."""
    rows = [(slot, shard, version) for slot, shard in sorted(slots.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    return {r.slot: r.shard for r in spark.read.schema(MAP).parquet(f"{folder}/version={version}").collect()}


def newest_version(spark: SparkSession, folder: str) -> int:
    """The last version in the store; 0 for a store that has none yet."""
    try:
        return spark.read.schema(MAP).parquet(folder).agg(F.max("version")).first()[0] or 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row; a null text counts as no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its shard, by the law that shards have near equal bytes.

    ``slot`` counts a shard's rows from 0 without gaps, in the order of virtual slot, doc_id and text; ``virtual_slot``
    is the fixed hash slot. The newest map in ``folder`` (by default a new one in the shared folder, which starts with the
    slots dealt out in turn) is edited and stored as the next version, so later rows or another number of shards move only
    the slots that must. Null ids
    and texts hash like any value, repeated rows share a virtual slot and get places of their own, an empty table
    gives no rows. Other columns are ignored. One record larger than a shard's share leaves that shard over it.
    """
    spark = docs.sparkSession
    rows = stage(records(docs, slots), "records")
    measured = {r.virtual_slot: r for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    folder = folder or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    version = newest_version(spark, folder)
    if not version:
        version = 1
        save_map(spark, folder, version, initial_map(shards, slots))
    current = load_map(spark, folder, version)
    if len(current) != slots:
        raise ValueError(f"the map in {folder} has {len(current)} slots, not {slots}; a record's slot never changes")
    edited = rebalance(current, {k: r.bytes for k, r in measured.items()}, shards)
    save_map(spark, folder, version + 1, edited)
    filled, placed = [0] * shards, []
    for slot in range(slots):
        placed.append((slot, edited[slot], filled[edited[slot]]))
        filled[edited[slot]] += measured[slot].n if slot in measured else 0
    places = spark.createDataFrame(placed, "virtual_slot int, shard int, before long")
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(F.broadcast(places), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + within - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
