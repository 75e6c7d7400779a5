"""Sharding by fixed virtual slots.

A record's key is hashed into one of some thousands of slots; the number of slots never changes. A slot map, stored
in versions, says which shard holds a slot. Growing or rebalancing edits the map and moves whole slots, so that a
record's shard follows from its key and the map version. Everything here is DataFrame operations; the map and the
slot totals have `SLOTS` rows at most, whatever the input.

Nulls: a null key has a slot like any key; a null text has no bytes. Repeated rows share slot and shard and take
places of their own. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociframe.llm.common import whole_text

SLOTS = 4096
#: Parts of a slot, by the text, in which places are counted apart.
PARTS = 64


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def initial_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt to the shards in turn. Columns version, vslot, shard."""
    return spark.range(slots, numPartitions=1).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def add_shard(slot_map: DataFrame, shards: int) -> DataFrame:
    """Next version with one more shard: each of the `shards` old ones gives it 1 / (shards + 1) of its slots.

    Which slots move follows from the slot numbers alone, not from what they hold.
    """
    w = W.partitionBy("shard")
    place = F.row_number().over(w.orderBy(F.xxhash64("vslot"), "vslot"))
    given = F.count(F.lit(1)).over(w) / F.lit(shards + 1)
    return slot_map.select((F.col("version") + 1).alias("version"), "vslot",
                           F.when(place <= F.round(given), F.lit(shards)).otherwise(F.col("shard")).alias("shard"))


def slot_totals(df: DataFrame, key: Column, size: Column, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of each slot that has rows: vslot, slot_bytes, slot_rows."""
    return (df.select(slot_of(key, slots).alias("vslot"), size.alias("__size"))
            .groupBy("vslot").agg(F.sum("__size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows")))


def rebalance(slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """Next version by bytes: shards above the mean give slots away up to their excess, shards below take them.

    A shard above the mean goes through its slots from the largest and gives each that fits in what is left of its
    excess, so a slot larger than the excess stays and smaller ones go; the slots given, laid end
    to end, fall into the shards' gaps laid end to end. Slots that stay are not touched.
    """
    held = slot_map.join(totals, "vslot", "left").fillna(0, ["slot_bytes"])
    load = held.groupBy("shard").agg(F.sum("slot_bytes").alias("load"))
    mean = load.agg(F.avg("load").alias("mean"))
    load = load.join(mean, F.lit(True)).withColumn("excess", F.col("load") - F.col("mean"))
    own = F.array_sort(F.collect_list(F.struct((-F.col("slot_bytes")).alias("less"), "vslot", "slot_bytes")))
    given = (held.join(load, "shard").filter("slot_bytes > 0 and slot_bytes <= excess").groupBy("shard").agg(own.alias("own"), F.first("excess").alias("left"))
             .select(F.aggregate("own", F.struct("left", F.slice("own", 1, 0).alias("given")), lambda x, y: F.when(
                 y["slot_bytes"] <= x["left"], F.struct((x["left"] - y["slot_bytes"]).alias("left"), F.concat(x["given"], F.array(y)).alias("given"))).otherwise(x)).alias("x")))
    moved = given.select(F.explode("x.given").alias("y")).select("y.vslot", "y.slot_bytes")
    at = W.orderBy("vslot")  # at most one row for each slot
    moved = moved.select("vslot", "slot_bytes", (F.sum("slot_bytes").over(at) - F.col("slot_bytes") / 2).alias("mid"))
    order = W.orderBy("shard")
    gaps = load.filter("excess < 0").select("shard", F.sum(-F.col("excess")).over(order).alias("hi"), (-F.col("excess")).alias("gap"))
    target = moved.join(gaps, (F.col("mid") <= F.col("hi")) & (F.col("mid") > F.col("hi") - F.col("gap"))).select("vslot", F.col("shard").alias("__to"))
    return slot_map.join(target, "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("__to", "shard").alias("shard"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map. Storing the same version again replaces it."""
    (slot_map.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest if none is named."""
    stored = spark.read.schema("vslot int, shard int, version int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version).select("version", "vslot", "shard")


def assign(df: DataFrame, slot_map: DataFrame, grown_map: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """Shard and gapless place of each document.

    doc_id, size, text_crc32, vslot, shard, slot (place in the shard, from 0), grown_shard, map_version, slot_bytes.
    A place is the rank inside a part of the virtual slot, by a hash of the text, plus the rows of the shard's earlier
    parts, so that neither a shard nor a key with a third of the rows is ever ordered in one task.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = df.select("doc_id", size.alias("size"), F.crc32(F.encode(whole_text(), "UTF-8")).alias("text_crc32"), slot_of(F.col("doc_id"), slots).alias("vslot"))
    part = F.pmod(F.xxhash64("text_crc32", "size"), F.lit(PARTS)).cast("int")
    rows = rows.withColumn("part", part)
    totals = rows.groupBy("vslot", "part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    grown = slot_map.select("vslot", F.lit(None).cast("int").alias("grown_shard")) if grown_map is None else grown_map.select("vslot", F.col("shard").alias("grown_shard"))
    before = W.partitionBy("shard").orderBy("vslot", "part").rowsBetween(W.unboundedPreceding, -1)
    placed = (slot_map.join(totals, "vslot").join(grown, "vslot")
              .withColumn("first_place", F.coalesce(F.sum("part_rows").over(before), F.lit(0)))
              .withColumn("slot_bytes", F.sum("part_bytes").over(W.partitionBy("vslot"))))
    rank = F.row_number().over(W.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    return (rows.withColumn("__rank", rank.cast("long")).join(placed, ["vslot", "part"])
            .select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first_place") + F.col("__rank") - 1).alias("slot"),
                    "grown_shard", F.col("version").alias("map_version"), "slot_bytes"))
