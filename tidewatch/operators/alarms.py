"""Alarm episodes and histories, the watch list, and the regime table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import dense, islands


def alarms(sweep: DataFrame, score: str, threshold: float) -> DataFrame:
    return sweep.where(F.col(score) > threshold)


def episodes(sweep: DataFrame, score: str, threshold: float) -> DataFrame:
    """(entity, first_q, last_q, quarters, peak): runs of consecutive quarters over the line."""
    hot = islands(alarms(sweep, score, threshold))
    return hot.groupBy("entity", "island").agg(F.min("as_of").alias("first_q"), F.max("as_of").alias("last_q"), F.count("*").alias("quarters"), F.max(score).alias("peak")).drop("island")


def alarm_history(sweep: DataFrame, counts: DataFrame, score: str, threshold: float, baseline: int = 8, emergent_line: float = 2.0) -> DataFrame:
    """One row for each entity that ever breached: first and last breach, lag from its first quarter
    (NULL if that is the first of the data), quarters, episodes, longest, the peak over all rows, still
    open, the latest onset with its baseline a quarter, and emergent."""
    runs = episodes(sweep, score, threshold)
    last = sweep.agg(F.max("as_of").alias("last_as_of"))
    per = runs.groupBy("entity").agg(
        F.min("first_q").alias("first_breach"),
        F.max("last_q").alias("last_breach"),
        F.sum("quarters").alias("n_quarters"),
        F.count("*").alias("n_episodes"),
        F.max("quarters").alias("longest"),
        F.max("first_q").alias("latest_onset"),
    )
    peak = sweep.groupBy("entity").agg(F.max(F.struct(F.col(score).alias("s"), (-F.col("as_of")).alias("q"))).alias("p")).select("entity", F.col("p.s").alias("peak"), (-F.col("p.q")).alias("peak_q"))
    begin = counts.agg(F.min("q").alias("data_q"))
    seen = counts.where("n > 0").groupBy("entity").agg(F.min("q").alias("first_seen")).crossJoin(F.broadcast(begin))  # one row
    onset = sweep.select("entity", F.col("as_of").alias("latest_onset"), (F.col("n_baseline") / F.lit(float(baseline))).alias("onset_baseline"))
    out = per.join(peak, "entity").join(seen, "entity").join(onset, ["entity", "latest_onset"], "left").crossJoin(F.broadcast(last))  # one row
    return out.select(
        "entity",
        "first_breach",
        "last_breach",
        F.when(F.col("first_seen") > F.col("data_q"), F.col("first_breach") - F.col("first_seen")).alias("lag_q"),
        "n_quarters",
        "n_episodes",
        "longest",
        "peak",
        "peak_q",
        (F.col("last_breach") == F.col("last_as_of")).alias("still_open"),
        "latest_onset",
        "onset_baseline",
        (F.col("onset_baseline") < emergent_line).alias("emergent"),
    )


def watch_list(names: DataFrame, counts: DataFrame, sweep: DataFrame, score: str, threshold: float) -> DataFrame:
    """One row for each (label, pattern): entities that match it, their total, first and last quarter,
    the largest score, and whether it has fired. Names without a match have zero rows."""
    per = counts.where("n > 0").groupBy("entity").agg(F.sum("n").alias("n"), F.min("q").alias("first_q"), F.max("q").alias("last_q"))
    best = sweep.groupBy("entity").agg(F.max(score).alias("best"))
    rows = per.join(best, "entity", "left")
    hit = F.broadcast(names).join(rows, F.rlike("entity", "pattern"), "left")  # the list is the caller's
    return hit.groupBy("label").agg(F.count("entity").alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min("first_q").alias("first_q"), F.max("last_q").alias("last_q"), F.max("best").alias("best"), F.coalesce(F.max("best") > threshold, F.lit(False)).alias("has_fired"))


def regime(mentions: DataFrame, counts: DataFrame, denom: DataFrame, sweep: DataFrame, score: str, threshold: float, cluster: int = 3) -> DataFrame:
    """For each quarter: cases, change on the year in percent, mentions a case, distinct entities,
    onsets of episodes, and whether they cluster."""
    per = counts.groupBy("q").agg(F.sum("n").alias("mentions"), F.sum((F.col("n") > 0).cast("int")).alias("entities"))
    onsets = episodes(sweep, score, threshold).groupBy(F.col("first_q").alias("q")).agg(F.count("*").alias("onsets"))
    out = denom.select("q", "n_total").join(per, "q", "left").join(onsets, "q", "left")
    year = F.lag("n_total", 4).over(Window.orderBy("q"))  # one row a quarter
    return out.select(
        "q",
        "n_total",
        F.when(year > 0, 100.0 * (F.col("n_total") - year) / year).alias("yoy_pct"),
        (F.coalesce("mentions", F.lit(0)) / F.col("n_total")).alias("per_case"),
        F.coalesce("entities", F.lit(0)).alias("entities"),
        F.coalesce("onsets", F.lit(0)).alias("onsets"),
        (F.coalesce("onsets", F.lit(0)) >= cluster).alias("clustered"),
    )


def quarterly_series(counts: DataFrame, denom: DataFrame) -> DataFrame:
    """(entity, q, n, share, running): the zero-filled series behind the figures."""
    run = Window.partitionBy("entity").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    return dense(counts, denom).select("entity", "q", "n", (F.col("n") / F.col("n_total")).alias("share"), F.sum("n").over(run).alias("running"))
