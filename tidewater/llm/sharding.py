"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots, bytes and rows are aggregated per slot, and a versioned table
says which shard each slot belongs to. Rebalancing edits that table; records never change their slot. The law that
holds is `bytes`: shard sizes are near equal.

Only the slot tables (n_slots rows, whatever the input) are broadcast or brought into one task.

Defined results: null text counts as empty (size 16, crc32 of nothing); rows with null keys get a slot like any other;
equal rows share a slot and get different places in their shard; an empty table gives an empty result. Extra columns
are ignored. One key held by many rows with different texts is spread, since size and crc32 are hashed with the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import cut, new_path

N_SLOTS = 4096
N_SHARDS = 40
ROW_OVERHEAD = 16


class SlotMapStore:
    """Versions of a slot-to-shard map, one folder each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, version: int, slot_map: DataFrame) -> DataFrame:
        slot_map.select("virtual_slot", "shard").coalesce(1).write.parquet(f"{self.path}/version={version}")
        return self.get(version)

    def get(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot bigint, shard int").parquet(f"{self.path}/version={version}").withColumn("version", F.lit(version))


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(n_slots).cast("long")))


def slot_stats(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """bytes and n_rows of every slot, empty ones too: n_slots rows."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    every = rows.sparkSession.range(0, n_slots, 1, 1).withColumnRenamed("id", "virtual_slot")
    return every.join(found, "virtual_slot", "left").na.fill(0, ["bytes", "n_rows"])


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    return spark.range(0, n_slots, 1, 1).select(F.col("id").alias("virtual_slot"), (F.col("id") % n_shards).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, stats: DataFrame, n_shards: int) -> DataFrame:
    """An edit of slot_map: each shard keeps its largest slots up to the mean; the others go, largest first, to the shard
    that is then the lightest."""
    both = stats.join(F.broadcast(slot_map), "virtual_slot")
    down = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / F.lit(n_shards)
    both = both.withColumn("mean", mean).withColumn("stays", F.sum("bytes").over(down.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("mean"))
    entry = F.struct("bytes", "virtual_slot", "shard")
    one = both.agg(
        F.collect_list(F.when(F.col("stays"), entry)).alias("stay"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), entry)), asc=False).alias("move"),
    ).selectExpr(
        "stay",
        "move",
        f"transform(sequence(0, {n_shards - 1}), s -> aggregate(filter(stay, x -> x.shard = s), 0L, (a, x) -> a + x.bytes)) AS loads",
    )
    step = """aggregate(move, named_struct('loads', loads, 'at', cast(array() AS array<int>)), (acc, m) ->
        transform(array(cast(array_position(acc.loads, array_min(acc.loads)) AS int) - 1), k -> named_struct(
            'loads', transform(acc.loads, (v, i) -> IF(i = k, v + m.bytes, v)), 'at', array_append(acc.at, k)))[0]).at"""
    moved = f"transform({step}, (k, i) -> named_struct('virtual_slot', move[i].virtual_slot, 'shard', k))"
    kept = "transform(stay, x -> named_struct('virtual_slot', x.virtual_slot, 'shard', x.shard))"
    return one.selectExpr(f"inline(concat({kept}, {moved}))")


def grown(slot_map: DataFrame, stats: DataFrame, n_shards: int) -> DataFrame:
    """An edit of slot_map, of n_shards, for one shard more: every old shard gives its smallest slots beyond the new mean
    to the new shard; no slot moves between old shards."""
    both = stats.join(F.broadcast(slot_map), "virtual_slot")
    shard = Window.partitionBy("shard")
    up = shard.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    target = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / F.lit(n_shards + 1)
    both = both.withColumn("goes", F.sum("bytes").over(up) <= F.sum("bytes").over(shard) - target)
    return both.select("virtual_slot", F.when(F.col("goes"), F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> DataFrame:
    """Every row's shard (law `bytes`), its place there (slot) and its virtual slot, by version 2 of the map."""
    spark = docs.sparkSession
    rows = cut(slotted(docs, n_slots), "slotted")
    stats = cut(slot_stats(rows, n_slots).coalesce(1), "slot-stats")
    store = SlotMapStore(spark, new_path(spark, "slot-map"))
    first = store.put(1, first_map(spark, n_shards, n_slots))
    current = store.put(2, rebalanced(first, stats, n_shards))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = current.join(F.broadcast(stats), "virtual_slot").withColumn("base", F.coalesce(F.sum("n_rows").over(before), F.lit(0).cast("long")))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")) - 1
    out = rows.withColumn("place", within).join(F.broadcast(places.select("virtual_slot", "shard", "base", "version")), "virtual_slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


def op7_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_shard_slots": op7_shard_slots}
ORACLE: dict[str, str] = {}
