"""Trailing windows at every as-of quarter in one job: rows are dealt to the quarters they matter to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_quarters(denom: DataFrame, recent: int = 4, baseline: int = 8) -> DataFrame:
    """(as_of, N_recent, N_base) for the quarters that have a whole window behind them."""
    dealt = denom.select("q", "n_total", F.explode(F.sequence(F.lit(0), F.lit(recent + baseline - 1))).alias("ago")).withColumn("as_of", F.col("q") + F.col("ago"))
    is_recent = F.col("ago") < recent
    per = dealt.groupBy("as_of").agg(
        F.count("*").alias("_k"),
        F.sum(F.when(is_recent, F.col("n_total")).otherwise(0)).alias("total_recent"),
        F.sum(F.when(~is_recent, F.col("n_total")).otherwise(0)).alias("total_base"),
    )
    return per.where(F.col("_k") == recent + baseline).drop("_k")


def trailing_windows(counts: DataFrame, denom: DataFrame, recent: int = 4, baseline: int = 8) -> DataFrame:
    """(entity, as_of, n_recent, n_baseline, total_recent, total_base).

    Each count goes to the as-of quarters q .. q + recent + baseline - 1; a grouped sum does the rest,
    so that a sweep over all quarters is one shuffle. No row at as_of sees a later quarter.
    """
    dealt = counts.select("entity", "n", "q", F.explode(F.sequence(F.lit(0), F.lit(recent + baseline - 1))).alias("ago")).withColumn("as_of", F.col("q") + F.col("ago"))
    is_recent = F.col("ago") < recent
    sums = dealt.groupBy("entity", "as_of").agg(F.sum(F.when(is_recent, F.col("n")).otherwise(0)).alias("n_recent"), F.sum(F.when(~is_recent, F.col("n")).otherwise(0)).alias("n_baseline"))
    return sums.join(F.broadcast(as_of_quarters(denom, recent, baseline)), "as_of")  # one row a quarter


def dense(counts: DataFrame, denom: DataFrame) -> DataFrame:
    """(entity, q, n, n_total) with zero rows on the whole calendar."""
    grid = counts.select("entity").distinct().crossJoin(F.broadcast(denom.select("q", "n_total")))  # one row a quarter
    return grid.join(counts.select("entity", "q", "n"), ["entity", "q"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def islands(rows: DataFrame, key: str = "entity", at: str = "as_of") -> DataFrame:
    """Adds ``island``, equal for rows of a key whose quarters follow each other."""
    return rows.withColumn("island", F.col(at) - F.row_number().over(Window.partitionBy(key).orderBy(at)))
