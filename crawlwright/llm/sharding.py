"""Sharding: groups that must stay together go to shards of nearly equal size.

Longest-processing-time scheduling: units sorted by size go to the least-loaded shard through a heap.  The heap runs on the
driver over at most ``2 * units`` rows: a group of at least 1/units of all bytes is a unit of its own (there are at most
``units`` of those), and smaller groups are packed by a hash of their key into ``units`` bundles first.  The heaviest shard
then exceeds the mean by one unit at most, which is under a few thousandths of the bytes unless a single group is larger.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def schedule(units: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """unit -> shard; the largest unit first, each to the least-loaded shard (ties: the lower shard, then the unit's name)."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for unit, size in sorted(units, key=lambda u: (-u[1], str(u[0]))):
        load, shard = heapq.heappop(heap)
        placed[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(docs: DataFrame, shards: int = 8, units: int = 4096, slot_rows: int = 20_000) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``.

    Law ``bytes``: shards hold nearly the same bytes; rows with equal texts share a shard.  The size is the text's UTF-8 bytes
    plus 1.  A null text has no bytes and goes with the empty ones.  ``slot`` counts from 0 without gaps inside a shard, in a
    fixed order.  Repeated rows get slots of their own; an empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.sha2(text.cast("binary"), 256).alias("_group"))
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    total = groups.agg(F.sum("_bytes").alias("b"), F.sum("_rows").alias("n")).first()
    least = max(1, -(-(total["b"] or 0) // units))
    bundle = F.pmod(F.xxhash64("_group"), F.lit(units)).cast("string")
    unit = F.when(F.col("_bytes") >= least, F.col("_group")).otherwise(bundle)
    sizes = groups.groupBy(unit.alias("_unit")).agg(F.sum("_bytes").alias("_bytes"))
    placed = schedule([(r["_unit"], r["_bytes"]) for r in sizes.collect()], shards)  # at most 2 * units rows
    # both tables hold at most 2 * units rows, so they may be broadcast
    known = spark.createDataFrame(list(placed.items()), "_unit string, shard int").coalesce(1)
    large = known.where(F.length("_unit") == 64).select(F.col("_unit").alias("_group"), F.col("shard").alias("_own"))
    small = known.where(F.length("_unit") < 64).select(F.col("_unit").alias("_bundle"), F.col("shard").alias("_packed"))
    put = (rows.join(F.broadcast(large), "_group", "left").withColumn("_bundle", bundle).join(F.broadcast(small), "_bundle", "left")
           .select("doc_id", "size", "text_crc32", F.coalesce("_own", "_packed").alias("shard")))
    # slots: a count per (shard, hash bucket), a running start per bucket, and row numbers inside a bucket
    buckets = max(1, -(-(total["n"] or 0) // slot_rows))
    put = put.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (put.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
              .select("shard", "_b", (F.sum("_n").over(before) - F.col("_n")).alias("_start")))
    inside = Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "size")
    return (put.withColumn("_at", F.row_number().over(inside)).join(starts, ["shard", "_b"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_start") + F.col("_at") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
