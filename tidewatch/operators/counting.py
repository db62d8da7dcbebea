"""Case definition and counting: mentions, quarterly counts, denominators, credits, dispersion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import quarter_end, quarter_ordinal, quarter_start
from .windows import as_of_quarters


def distinct_mentions(mentions: DataFrame, rollup: DataFrame | None = None) -> DataFrame:
    """(case_id, entity, quarter), one row for each entity of a case, after the roll-up to canonical
    entities (entity, rollup), where one is given; entities without a roll-up stay as they are."""
    m = mentions.select("case_id", "entity", quarter_start("event_date").alias("quarter"))
    if rollup is not None:
        up = rollup.select(F.col("entity").alias("_e"), "rollup").dropDuplicates(["_e"])
        m = m.join(up, F.col("entity") == F.col("_e"), "left").withColumn("entity", F.coalesce("rollup", "entity")).drop("_e", "rollup")
    return m.distinct()


def complete_quarters(cases: DataFrame, cutoff=None) -> DataFrame:
    """(quarter, q, n_total): cases in each quarter that ends by the last case's date and the cutoff."""
    last = cases.agg(F.max("event_date").alias("last"))
    per = cases.groupBy(quarter_start("event_date").alias("quarter")).agg(F.count("*").alias("n_total"))
    per = per.crossJoin(F.broadcast(last)).where(quarter_end("quarter") <= F.to_date("last"))  # one row
    if cutoff is not None:
        per = per.where(quarter_end("quarter") <= F.lit(cutoff).cast("date"))
    return per.select("quarter", quarter_ordinal("quarter").alias("q"), "n_total")


def quarterly_counts(mentions: DataFrame, denom: DataFrame) -> DataFrame:
    """(entity, quarter, q, n) over the complete quarters; quarters without a mention have no row."""
    m = mentions.groupBy("entity", "quarter").agg(F.count("*").alias("n"))
    return m.join(F.broadcast(denom.select("quarter", "q")), "quarter").select("entity", "quarter", "q", "n")  # one row a quarter


def position_credit(ordered: DataFrame, independent: DataFrame | None = None) -> DataFrame:
    """(case_id, entity, credit) from each case's ordered entities ``seq``.

    Alone on its line 2; last of three or more 0, or 1 for an entity that has led a line by then
    (``independent``: entity, first_lead_q; the case's q must not precede it); else 1.
    """
    rows = ordered.select("case_id", "q", F.size("seq").alias("size"), F.posexplode("seq").alias("pos", "entity"))
    if independent is None:
        led = F.lit(False)
    else:
        rows = rows.join(independent.select(F.col("entity").alias("_e"), "first_lead_q"), F.col("entity") == F.col("_e"), "left").drop("_e")
        led = F.coalesce(F.col("first_lead_q") <= F.col("q"), F.lit(False))
    trailing = (F.col("size") >= 3) & (F.col("pos") == F.col("size") - 1)
    return rows.select("case_id", "q", "entity", F.when(F.col("size") == 1, 2).when(trailing & ~led, 0).otherwise(1).alias("credit"))


def first_leads(ordered: DataFrame) -> DataFrame:
    """(entity, first_lead_q): the first quarter in which each entity leads a line."""
    return ordered.where(F.size("seq") > 0).groupBy(F.col("seq")[0].alias("entity")).agg(F.min("q").alias("first_lead_q"))


def credit_dispersion(credits: DataFrame) -> Column:
    """phi = E[c^2] / E[c], as an aggregate expression."""
    c = F.col("credit").cast("double")
    return F.when(F.avg(c) > 0, F.avg(c * c) / F.avg(c)).otherwise(F.lit(1.0))


def role_dispersion(credits: DataFrame, least_cases: int = 10, floor: float = 0.05) -> DataFrame:
    """(entity, n, phi_s) for entities with enough cases: max(1, 1 / max(mean credit, floor))."""
    g = credits.groupBy("entity").agg(F.count("*").alias("n"), F.avg(F.col("credit").cast("double")).alias("mean"))
    return g.where(F.col("n") >= least_cases).select("entity", "n", F.greatest(F.lit(1.0), 1 / F.greatest("mean", F.lit(floor))).alias("phi_s"))


def weighted_sweep(ordered: DataFrame, denom: DataFrame) -> DataFrame:
    """(entity, as_of, credit, phi): running credits with as-of independence, in one pass.

    A trailing mention counts at ``as_of`` only if its entity has led a line by then. So per entity
    and quarter it is enough to keep the numbers of solo, named and trailing mentions, and to run
    their sums; nothing is recomputed for each quarter.
    """
    rows = ordered.select("q", F.size("seq").alias("size"), F.posexplode("seq").alias("pos", "entity"))
    kind = F.when(F.col("size") == 1, "solo").when((F.col("size") >= 3) & (F.col("pos") == F.col("size") - 1), "trailing").otherwise("named")
    per = rows.groupBy("entity", "q").agg(*[F.sum((kind == k).cast("int")).alias(k) for k in ("solo", "named", "trailing")])
    grid = per.select("entity").distinct().crossJoin(F.broadcast(denom.select("q")))  # one row a quarter
    per = grid.join(per, ["entity", "q"], "left").fillna(0)
    run = Window.partitionBy("entity").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    sums = per.select("entity", "q", *[F.sum(k).over(run).alias(k) for k in ("solo", "named", "trailing")])
    led = sums.join(first_leads(ordered), "entity", "left").withColumn("live", (F.coalesce("first_lead_q", F.lit(1 << 30)) <= F.col("q")).cast("int"))
    first = led.select("entity", F.col("q").alias("as_of"), (2 * F.col("solo") + F.col("named") + F.col("live") * F.col("trailing")).alias("credit"), (4 * F.col("solo") + F.col("named") + F.col("live") * F.col("trailing")).alias("square"))
    total = first.groupBy("as_of").agg((F.sum("square") / F.sum("credit")).alias("phi"))
    return first.join(F.broadcast(total), "as_of").select("entity", "as_of", "credit", "phi")  # one row a quarter


def weighted_windows(ordered: DataFrame, denom: DataFrame, recent: int = 4, baseline: int = 8) -> DataFrame:
    """(entity, as_of, n_recent, n_baseline, total_recent, total_base, phi): trailing windows of credits
    with as-of independence and the as-of dispersion. As in ``weighted_sweep``, the numbers of solo, named
    and trailing mentions are summed, and a trailing one counts if its entity has led a line by then."""
    rows = ordered.select("q", F.size("seq").alias("size"), F.posexplode("seq").alias("pos", "entity"))
    trailing = (F.col("size") >= 3) & (F.col("pos") == F.col("size") - 1)
    per = rows.groupBy("entity", "q").agg(F.sum(F.when(F.col("size") == 1, 2).when(trailing, 0).otherwise(1)).alias("sure"), F.sum(trailing.cast("int")).alias("late"))
    per = per.join(F.broadcast(denom.select("q")), "q")  # one row a quarter
    dealt = per.select("entity", "sure", "late", "q", F.explode(F.sequence(F.lit(0), F.lit(recent + baseline - 1))).alias("ago")).withColumn("as_of", F.col("q") + F.col("ago"))
    new = F.col("ago") < recent
    sums = dealt.groupBy("entity", "as_of").agg(*[F.sum(F.when(w, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for c in ("sure", "late") for k, w in (("r", new), ("b", ~new))])
    live = F.coalesce(F.col("first_lead_q") <= F.col("as_of"), F.lit(False)).cast("int")
    out = sums.join(first_leads(ordered), "entity", "left").select("entity", "as_of", (F.col("sure_r") + live * F.col("late_r")).alias("n_recent"), (F.col("sure_b") + live * F.col("late_b")).alias("n_baseline"))
    phi = weighted_sweep(ordered, denom).select("as_of", "phi").distinct()  # a row a quarter
    return out.join(F.broadcast(as_of_quarters(denom, recent, baseline)), "as_of").join(F.broadcast(phi), "as_of")


def one_hot(cases: DataFrame, mentions: DataFrame, entities: list[str]) -> DataFrame:
    """The rows of ``cases`` (case_id, ...) with a 0/1 column for each entity of the list, in its order:
    those known to be rising first, if the caller puts them so."""
    flags = mentions.where(F.col("entity").isin(entities)).groupBy("case_id").agg(*[F.max((F.col("entity") == e).cast("int")).alias(e) for e in entities])
    return cases.join(flags, "case_id", "left").fillna(0, entities)
