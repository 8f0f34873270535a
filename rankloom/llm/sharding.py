"""Sharding (operator 9): weighted rendezvous hashing of stable record keys.

A record goes to the shard with the least -ln(u) / weight, u a hash of key and shard in (0, 1). Another shard only adds a
candidate, so the records that move all move into it. Everything is column work; slots come from range partitions of
the key order and their counts, so no shard is numbered in one task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.lineage import cut


def _draw(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u from 52 bits of md5(key:shard)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / F.lit(float(weight))).alias("d"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among shards 0 to len(weights) - 1; equal draws go to the lower number, a null key counts as an empty one."""
    known = F.coalesce(key.cast("string"), F.lit(""))
    return F.array_min(F.array(*[_draw(known, i, w) for i, w in enumerate(weights)]))["shard"]


def assign_shards(docs: DataFrame, n_shards: int = 16, weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of every row.

    Size is the text's UTF-8 bytes plus 1, a null text counts as empty. Slots number a shard's rows from 0 by doc_id (nulls first), then
    text_crc32; rows that repeat both are interchangeable. ``grown_shard`` is the shard with one shard more. No rows, no result rows.
    """
    own = list(weights or [1.0] * n_shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"))
    rows = cut(rows)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("tie").asc()]
    placed = rows.withColumns({"shard": rendezvous(F.col("doc_id"), own), "grown_shard": rendezvous(F.col("doc_id"), [*own, grown_weight])})
    # written once: range borders are drawn from a sample, so both uses must see the same ones
    placed = cut(placed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    return placed.withColumn("within", within).join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), "grown_shard")
