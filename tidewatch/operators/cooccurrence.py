"""Co-occurrence: profiles of entities within cases, and dyads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_counts(mentions: DataFrame) -> DataFrame:
    """(entity, partner, n_both) over distinct (case_id, entity) rows: a case's own entities only meet."""
    a = mentions.select("case_id", "entity")
    b = mentions.select("case_id", F.col("entity").alias("partner"))
    return a.join(b, "case_id").where("entity <> partner").groupBy("entity", "partner").agg(F.count("*").alias("n_both"))


def profile(mentions: DataFrame, ordered: DataFrame, marker: str, least_cases: int = 4, partners: int = 3) -> DataFrame:
    """One row for each entity of enough cases: n, alone and with-``marker`` percent, lead and last
    percent and mean place on lines of two or more, ranked lines, its commonest partners with their
    lift, and the verdict on its role."""
    size = mentions.groupBy("case_id").agg(F.count("*").alias("k"), F.max((F.col("entity") == marker).cast("int")).alias("marked"))
    rows = mentions.join(size, "case_id")
    base = rows.groupBy("entity").agg(F.count("*").alias("n"), (100.0 * F.avg((F.col("k") == 1).cast("double"))).alias("alone_pct"), (100.0 * F.avg(F.col("marked").cast("double"))).alias("with_marker_pct")).where(F.col("n") >= least_cases)
    line = ordered.where(F.size("seq") >= 2).select(F.size("seq").alias("len"), F.posexplode("seq").alias("pos", "entity"))
    place = line.groupBy("entity").agg(
        (100.0 * F.avg((F.col("pos") == 0).cast("double"))).alias("lead_pct"),
        (100.0 * F.avg((F.col("pos") == F.col("len") - 1).cast("double"))).alias("last_pct"),
        F.avg(F.col("pos") / (F.col("len") - 1)).alias("mean_rank"),
        F.count("*").alias("n_ranked"),
    )
    total = mentions.agg(F.count_distinct("case_id").alias("cases"))
    each = mentions.groupBy("entity").agg(F.count("*").alias("m"))
    pairs = pair_counts(mentions).join(each, "entity").join(each.select(F.col("entity").alias("partner"), F.col("m").alias("m2")), "partner").crossJoin(F.broadcast(total))  # one row
    w = Window.partitionBy("entity").orderBy(F.desc("n_both"), "partner")
    best = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= partners)
    text = F.concat(F.col("partner"), F.lit(" "), F.round(100.0 * F.col("n_both") / F.col("m")).cast("int"), F.lit("% (x"), F.format_string("%.1f", F.round(F.col("n_both") * F.col("cases") / (F.col("m") * F.col("m2")), 1)), F.lit(")"))
    with_ = best.groupBy("entity").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", text.alias("t")))), lambda x: x["t"]), "; ").alias("partners"))
    out = base.join(place, "entity", "left").join(with_, "entity", "left")
    return out.withColumn("verdict", role_verdict())


# The lines between the roles, in percent and in mean place.
LEAD, ALONE, SELDOM_ALONE, LATE, MARKED = 40, 15, 5, 0.6, 70


def role_verdict():
    alone, lead, rank, marked = (F.col(c) for c in ("alone_pct", "lead_pct", "mean_rank", "with_marker_pct"))
    last = (alone < SELDOM_ALONE) & (rank >= LATE)
    return F.when(lead >= LEAD, "principal driver").when(alone >= ALONE, "independent").when(last & (marked >= MARKED), "adulterant/marker").when(last, "secondary/incidental").otherwise("co-intoxicant")


def dyads(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row for each candidate (label_a, pattern_a, label_b, pattern_b): cases with either and both,
    expected, lift and the conditional percents. Patterns may name families."""
    total = mentions.agg(F.count_distinct("case_id").alias("cases"))
    c = F.broadcast(candidates)  # the caller's list
    hit_a, hit_b = F.rlike("entity", "pattern_a"), F.rlike("entity", "pattern_b")
    per = mentions.crossJoin(c).where(hit_a | hit_b).groupBy("label_a", "label_b", "case_id").agg(F.max(hit_a.cast("int")).alias("a"), F.max(hit_b.cast("int")).alias("b"))
    g = per.groupBy("label_a", "label_b").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both")).crossJoin(F.broadcast(total))  # one row
    expected = F.col("n_a") * F.col("n_b") / F.col("cases").cast("double")
    return g.select("label_a", "label_b", "n_a", "n_b", "n_both", expected.alias("expected"), F.when(expected > 0, F.col("n_both") / expected).alias("lift"), F.when(F.col("n_a") > 0, 100.0 * F.col("n_both") / F.col("n_a")).alias("pct_of_a"), F.when(F.col("n_b") > 0, 100.0 * F.col("n_both") / F.col("n_b")).alias("pct_of_b"))


def recent_mentions(mentions: DataFrame, quarters: int = 4) -> DataFrame:
    """The mentions of the last ``quarters`` quarters that have any."""
    last = mentions.select("quarter").distinct().orderBy(F.desc("quarter")).limit(quarters)
    return mentions.join(F.broadcast(last), "quarter", "left_semi")  # a row a quarter


def dyads_recent(mentions: DataFrame, candidates: DataFrame, quarters: int = 4) -> DataFrame:
    """The dyads over all history, with both and lift over the last quarters beside them, so that what is
    enriched only then or only now is not averaged away."""
    now = dyads(recent_mentions(mentions, quarters), candidates).select("label_a", "label_b", F.col("n_both").alias("recent_n_both"), F.col("lift").alias("recent_lift"))
    return dyads(mentions, candidates).join(now, ["label_a", "label_b"], "left").withColumn("recent_n_both", F.coalesce("recent_n_both", F.lit(0)))
