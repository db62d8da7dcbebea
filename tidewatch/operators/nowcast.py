"""Reporting-delay correction: completeness by delay, isotonic, and corrected counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly(rows: DataFrame, date_col: str = "event_date") -> DataFrame:
    """(m, n): events in each month, m = year * 12 + month - 1."""
    d = F.to_date(date_col)
    return rows.where(d.isNotNull()).groupBy((F.year(d) * 12 + F.month(d) - 1).alias("m")).agg(F.count("*").alias("n"))


def isotonic(points: DataFrame, at: str = "delay", value: str = "raw", weight: str = "w") -> DataFrame:
    """Adds ``fit``, the weighted least-squares non-decreasing fit, by its min-max form:
    fit_i = max over j <= i of min over k >= i of the weighted mean of j..k. The points are the delays of
    a curve, a table of fixed size."""
    p = points.select(F.col(at).alias("i"), F.col(value).alias("y"), F.col(weight).alias("w"))
    run = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = p.select("i", F.sum(F.col("y") * F.col("w")).over(run).alias("sy"), F.sum("w").over(run).alias("sw"), (F.col("y") * F.col("w")).alias("yw"), "w")
    a = s.select(F.col("i").alias("j"), (F.col("sy") - F.col("yw")).alias("by"), (F.col("sw") - F.col("w")).alias("bw"))
    b = s.select(F.col("i").alias("k"), "sy", "sw")
    mean = a.join(F.broadcast(b), F.col("j") <= F.col("k")).select("j", "k", ((F.col("sy") - F.col("by")) / (F.col("sw") - F.col("bw"))).alias("v"))
    fits = p.select("i").join(F.broadcast(mean), (F.col("j") <= F.col("i")) & (F.col("k") >= F.col("i"))).groupBy("i", "j").agg(F.min("v").alias("v")).groupBy("i").agg(F.max("v").alias("fit"))
    return points.join(fits, F.col(at) == F.col("i")).drop("i")


def delay_curve(early: DataFrame, late: DataFrame, early_as_of: int, settled_until: int, most_delay: int = 15, drift: float = 0.01) -> DataFrame:
    """(delay, n_early, n_late, raw, completeness, se, ok, settled_months): what share of a month's
    final count the early vintage holds ``delay`` months on. The vintages must agree within ``drift``
    on the settled months; ok says so. Gaps take the next known delay."""
    both = early.select("m", F.col("n").alias("n_early")).join(late.select("m", F.col("n").alias("n_late")), "m")
    settled = both.where(F.col("m") <= settled_until).agg(F.count("*").alias("settled_months"), (F.abs(F.sum("n_early") / F.sum("n_late") - 1) <= drift).alias("ok"))
    d = both.withColumn("delay", F.lit(early_as_of) - F.col("m")).where(F.col("delay").between(0, most_delay) & (F.col("n_late") > 0))
    d = d.groupBy("delay").agg(F.sum("n_early").alias("n_early"), F.sum("n_late").alias("n_late")).withColumns({"raw": F.col("n_early") / F.col("n_late"), "w": F.col("n_late").cast("double")})
    fit = isotonic(d).withColumn("fit", F.greatest(F.lit(1e-6), F.least(F.lit(1.0), "fit")))
    grid = early.sparkSession.range(0, most_delay + 1).select(F.col("id").cast("int").alias("delay"))
    out = grid.join(fit, "delay", "left")
    ahead = Window.orderBy("delay").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.orderBy("delay").rowsBetween(0, Window.unboundedFollowing)
    pi = F.coalesce(F.last("fit", ignorenulls=True).over(ahead), F.first("fit", ignorenulls=True).over(behind))
    out = out.withColumn("completeness", pi).withColumn("se", F.sqrt(F.col("completeness") * (1 - F.col("completeness")) / F.greatest(F.coalesce("n_late", F.lit(1)), F.lit(1))))
    return out.crossJoin(F.broadcast(settled)).select("delay", "n_early", "n_late", "raw", "completeness", "se", "ok", "settled_months")  # one row


def apply_curve(counts: DataFrame, curve: DataFrame, as_of: int) -> DataFrame:
    """(m, delay, n, completeness, estimate, se): n / pi; beyond the curve's range its last value."""
    last = curve.agg(F.max(F.struct("delay", "completeness", "se")).alias("t")).select(F.col("t.completeness").alias("tail"), F.col("t.se").alias("tail_se"))
    d = counts.where(F.col("m") <= as_of).withColumn("delay", F.lit(as_of) - F.col("m"))
    out = d.join(F.broadcast(curve.select("delay", "completeness", F.col("se").alias("pi_se"))), "delay", "left").crossJoin(F.broadcast(last))  # the curve is a few rows
    pi, se = F.coalesce("completeness", "tail"), F.coalesce("pi_se", "tail_se")
    rel = F.sqrt((1 - pi) / F.greatest(F.col("n"), F.lit(1)) + (se / pi) * (se / pi))
    return out.select("m", "delay", "n", pi.alias("completeness"), (F.col("n") / pi).alias("estimate"), (F.col("n") / pi * rel).alias("se"))


def transfer_check(counts: DataFrame, curve: DataFrame, as_of: int, base_low: int = 12, base_high: int = 30, most: int = 8) -> DataFrame:
    """(delay, implied, curve, quotient, bad): completeness implied by the recent months against the
    median month of older ones; a quotient over 1.35 or under 0.65 within four months is bad."""
    d = counts.withColumn("delay", F.lit(as_of) - F.col("m"))
    base = d.where(F.col("delay").between(base_low, base_high)).agg(F.median(F.col("n").cast("double")).alias("base"))
    near = d.where(F.col("delay").between(0, most)).crossJoin(F.broadcast(base)).join(F.broadcast(curve.select("delay", "completeness")), "delay")  # a few rows
    q = F.col("n") / F.col("base") / F.col("completeness")
    return near.select("delay", (F.col("n") / F.col("base")).alias("implied"), F.col("completeness").alias("curve"), q.alias("quotient"), ((F.col("delay") <= 4) & ((q > 1.35) | (q < 0.65))).alias("bad"))


def quarterly_estimates(estimates: DataFrame) -> DataFrame:
    """(q, n, estimate, se, low, high) for quarters with all three months."""
    g = estimates.groupBy(F.floor(F.col("m") / 3).cast("int").alias("q")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("estimate").alias("estimate"), F.sqrt(F.sum(F.col("se") * F.col("se"))).alias("se"))
    return g.where("k = 3").select("q", "n", "estimate", "se", (F.col("estimate") - 1.96 * F.col("se")).alias("low"), (F.col("estimate") + 1.96 * F.col("se")).alias("high"))
