"""Contiguous shards from global byte-size prefix sums.

Rows are ranged by (doc_id, hash) into partitions of narrow rows that carry their partition
number; per-partition totals, one row each, give every partition its offset in bytes and rows;
a window inside each partition finishes the prefix sum.  The shard is where the middle of a
row's byte interval falls among equal targets, so shards are contiguous in doc_id order and
each is within one document's size of the target.

Nulls: a null text has no bytes; null doc_ids come first.  Repeated rows are rows of their own.
With fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import materialize


def crc32_of(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def prefix_sums(rows: DataFrame, order: list[str], size: str, partitions: int | None = None) -> DataFrame:
    """Add before (sizes of all earlier rows), index (earlier rows), total_size and total_rows.

    ``order`` names the sort columns; equal rows are told apart by their place in the input.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_tie")
    placed = materialize(ranged.withColumn("_part", F.spark_partition_id()))  # written, so a partition's number is fixed
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    parts = placed.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows")).select(
        "_part",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(everything).alias("total_size"),
        F.sum("_rows").over(everything).alias("total_rows"),
    )
    inside = Window.partitionBy("_part").orderBy(*order, "_tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_upto", F.sum(size).over(upto)).withColumn("_nth", F.row_number().over(inside))
    out = summed.join(F.broadcast(parts), "_part")  # one row for each of the n partitions
    before = F.col("_bytes_before") + F.col("_upto") - F.col(size)
    return out.select(*rows.columns, before.alias("before"), (F.col("_rows_before") + F.col("_nth") - 1).alias("index"), "total_size", "total_rows")


def balanced_shards(docs: DataFrame, shards: int = 8, partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), crc32_of(F.col("text")).alias("text_crc32"))
    summed = prefix_sums(rows, ["doc_id", "text_crc32"], "size", partitions)
    shard = F.least(F.lit(shards - 1).cast("long"), F.expr(f"cast(((2 * before + size) * cast({shards} as decimal(20,0))) div (2 * total_size) as long)"))
    cut = materialize(summed.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "index"), docs.count())
    firsts = cut.groupBy("shard").agg(F.min("index").alias("first"))
    out = cut.join(F.broadcast(firsts), "shard")  # at most one row a shard
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
