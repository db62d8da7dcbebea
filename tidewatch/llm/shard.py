"""Contiguous shards of equal byte size: global prefix sums from per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", order_by: str = "digest") -> DataFrame:
    """Cut the documents, in one global order, into ``shards`` runs of nearly equal bytes.

    The order is (md5 of the text, id), so that equal texts lie side by side and share a shard
    unless a cut falls among them; a group larger than a shard is spread over several. Spark sorts
    by ranges, each partition is summed, and the few totals (one row for each partition) give every
    partition its offset. A document goes where its middle byte falls: ``floor((2*before+size) *
    shards / (2*total))``, so that a shard misses its target by less than one document.

    A null text has size 1 and checksum 0, as the empty text; null ids sort first; repeated rows
    each keep a slot; an empty table gives no rows; further columns are ignored.
    Result: id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("_digest"),
    )
    key = ["_digest", id_col] if order_by == "digest" else [id_col, "_digest"]
    ordered = durable(
        keyed.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_part", F.spark_partition_id()),
        "shard",
    )
    totals = ordered.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
        F.sum("_bytes").over(whole).alias("_total"),
    )
    within = Window.partitionBy("_part").orderBy(*key)
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.join(F.broadcast(offsets), "_part").select(  # one row for each partition
        id_col,
        "size",
        "text_crc32",
        (F.col("_bytes0") + F.coalesce(F.sum("size").over(ahead), F.lit(0))).alias("_before"),
        (F.col("_rows0") + F.row_number().over(within) - 1).alias("_row"),
        "_total",
    )
    placed = placed.withColumn("shard", F.expr(f"least({shards - 1}, (2 * _before + size) * {shards} div (2 * _total))").cast("int"))
    starts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(starts), "shard").select(  # one row for each shard
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
