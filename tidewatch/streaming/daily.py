"""The moving-baseline detector on a stream: daily counts with a watermark, scored batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aberration import ears_sweep


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, event_type, n) of a stream (ts, event_type); a day closes once the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends a batch's closed days to ``path`` under its number, so that a
    repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def daily_scores(counts: DataFrame, recent: int = 4, baseline: int = 8) -> DataFrame:
    """Moving-baseline z for each type and day from (day, event_type, n)."""
    day = F.datediff("day", F.lit("1970-01-01").cast("date"))
    c = counts.groupBy(F.col("event_type").alias("entity"), day.alias("q")).agg(F.sum("n").alias("n"))
    return ears_sweep(c, counts.groupBy(day.alias("q")).agg(F.sum("n").alias("n_total")), recent, baseline)
