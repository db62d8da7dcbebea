"""Evaluation against labelled intervals: overlap, lags, precision, curves, matched budgets, ensembles."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, wilson
from .windows import islands


def quarter_label_ordinal(label):
    """'YYYYQn' as an ordinal."""
    return (F.substring(label, 1, 4).cast("int") * 4 + F.substring(label, 6, 1).cast("int") - 1).cast("int")


def resolve_intervals(truth: DataFrame, last_q: int) -> DataFrame:
    """(entity, start_q, end_q): ongoing intervals end at the last quarter of the data."""
    end = F.when(F.col("ongoing"), F.lit(last_q)).otherwise(quarter_label_ordinal(F.col("interval_end")))
    return truth.select("entity", quarter_label_ordinal(F.col("interval_start")).alias("start_q"), end.alias("end_q"))


def interval_quarters(intervals: DataFrame) -> DataFrame:
    """(entity, q): the quarters of an entity's intervals, each once."""
    return intervals.where("start_q <= end_q").select("entity", F.explode(F.sequence("start_q", "end_q")).alias("q")).distinct()


def overlap(truth_quarters: DataFrame, detected_quarters: DataFrame) -> DataFrame:
    """(entity, gt, det, overlap, iou, recall, precision) over distinct (entity, q) sets; a quotient
    without quarters below it is NULL."""
    t = truth_quarters.select("entity", "q", F.lit(1).alias("t"))
    d = detected_quarters.select("entity", "q", F.lit(1).alias("d"))
    g = t.join(d, ["entity", "q"], "full").groupBy("entity").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("gt"), F.coalesce(F.sum("d"), F.lit(0)).alias("det"), F.coalesce(F.sum(F.col("t") * F.col("d")), F.lit(0)).alias("overlap"))
    both = F.col("overlap").cast("double")
    return g.withColumns({"iou": ratio(both, F.col("gt") + F.col("det") - F.col("overlap")), "recall": ratio(both, F.col("gt")), "precision": ratio(both, F.col("det"))})


def precision_rate(overlaps: DataFrame) -> DataFrame:
    """n entities that alarmed, k of them with any overlap, the rate and its Wilson interval."""
    g = overlaps.where("det > 0").agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("overlap") > 0).cast("int")), F.lit(0)).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select("n", "k", ratio(F.col("k").cast("double"), F.col("n")).alias("rate"), lo.alias("low"), hi.alias("high"))


def external_onset(counts: DataFrame, floor: int = 10) -> DataFrame:
    """(entity, onset): the first half-year (ordinal h) with at least ``floor`` reports after two under
    it, on the dense calendar from the data's first to last half-year; omitted rows are zeros."""
    span = counts.agg(F.min("h").alias("a"), F.max("h").alias("b"))
    grid = counts.select("entity").distinct().crossJoin(F.broadcast(span)).select("entity", F.explode(F.sequence("a", "b")).alias("h"))  # one row
    rows = grid.join(counts.groupBy("entity", "h").agg(F.sum("n").alias("n")), ["entity", "h"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("entity").orderBy("h")
    low = (F.lag("n", 1).over(w) < floor) & (F.lag("n", 2).over(w) < floor)
    return rows.withColumn("hit", (F.col("n") >= floor) & low).where("hit").groupBy("entity").agg(F.min("h").alias("onset"))


def score_model(sweep: DataFrame, score: str, threshold: float, intervals: DataFrame, negatives: DataFrame) -> DataFrame:
    """One row for each labelled entity: gt, det and overlap quarters, iou, recall, precision, detected,
    and lag from the start of its first interval to the first alarm inside it. ``negatives`` (entity)
    are labelled never to rise."""
    hot = sweep.where(F.col(score) > threshold).select("entity", F.col("as_of").alias("q"))
    labelled = intervals.select("entity").unionByName(negatives.select("entity")).distinct()
    quarters = interval_quarters(intervals)
    over = overlap(quarters, hot.join(labelled, "entity", "left_semi"))
    inside = hot.join(intervals, "entity").where("q between start_q and end_q").groupBy("entity").agg(F.min(F.col("q") - F.col("start_q")).alias("lag_q"))
    out = labelled.join(over, "entity", "left").join(inside, "entity", "left").fillna(0, ["gt", "det", "overlap"])
    return out.withColumn("detected", (F.col("overlap") > 0).cast("int"))


def off_target(sweep: DataFrame, score: str, threshold: float, labelled: DataFrame) -> DataFrame:
    """(entity, quarters) of alarms on entities without a label."""
    return sweep.where(F.col(score) > threshold).join(labelled.select("entity"), "entity", "left_anti").groupBy("entity").agg(F.count("*").alias("quarters"))


def budget_line(sweep: DataFrame, score: str, budget: int) -> float | None:
    """The score of the ``budget``-th largest row, or the least there is; NULLs and minus infinity never alarm. Equal
    scores are counted first and no task ranks all rows."""
    g = sweep.where(F.col(score).isNotNull() & (F.col(score) > float("-inf"))).groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"))
    if budget <= 0 or g.isEmpty():
        return None
    runs = running_sums(g, "score", ["n"], descending=True)
    line, least = runs.agg(F.max(F.when(F.col("run_n") >= budget, F.col("score"))), F.min("score")).first()
    return least if line is None else line


def matched_alarms(sweep: DataFrame, score: str, budget: int) -> DataFrame:
    """(entity, as_of, score, line): the rows at or over the ``budget``-th largest score; ties all alarm."""
    line = F.lit(budget_line(sweep, score, budget)).cast("double")
    return sweep.where(F.col(score) >= line).select("entity", "as_of", F.col(score).alias("score"), line.alias("line"))


def matched_models(models: list[Model], scores: dict[str, DataFrame], budget: int) -> tuple[list[Model], dict[str, float | None]]:
    """The models with their lines moved so that each raises ``budget`` alarms (or as many as it has), and the lines:
    what is left to compare is whom they alarm on and when."""
    lines = {m.name: budget_line(scores[m.name], "score", budget) for m in models}
    # an alarm is a score over the line: the next double under it
    return [replace(m, threshold=math.inf if lines[m.name] is None else math.nextafter(lines[m.name], -math.inf)) for m in models], lines


def trends_backtest(scores: DataFrame, targets: DataFrame, intervals: DataFrame | None = None, line: float = 10.0) -> DataFrame:
    """(as_of, entity, rank, n_recent, n_baseline, ebgm, eb05, eb05_own, treescan_ri, credible_rise): where each of
    ``targets`` (entity) stood at every as-of quarter of a shrinkage sweep.

    The rank is by eb05 among entities with recent cases, ties by name: one more than those that stand above,
    which is counted, so that no quarter is sorted. ``intervals`` (entity, as_of, recurrence_interval; 1 where
    absent) of a scan takes credible_rise from what is under the line.
    """
    live = scores.where("n_recent > 0")
    mine = live.join(targets.select("entity").distinct(), "entity", "left_semi")
    marks = mine.select("as_of", F.col("entity").alias("_t"), F.col("eb05").alias("_s"))
    above = (F.col("eb05") > F.col("_s")) | ((F.col("eb05") == F.col("_s")) & (F.col("entity") < F.col("_t")))
    ranks = live.select("as_of", "entity", "eb05").join(marks, "as_of").groupBy("as_of", "_t").agg((1 + F.sum(above.cast("int"))).alias("rank"))
    out = mine.join(ranks.withColumnRenamed("_t", "entity"), ["as_of", "entity"])
    ri = F.lit(None).cast("double")
    if intervals is not None:
        out = out.join(intervals.select("entity", "as_of", F.col("recurrence_interval").alias("_ri")), ["entity", "as_of"], "left")
        ri = F.coalesce("_ri", F.lit(1.0))
    rise = F.col("credible_rise") & F.coalesce(ri >= line, F.lit(True))
    return out.select("as_of", "entity", "rank", "n_recent", "n_baseline", "ebgm", "eb05", "eb05_own", ri.alias("treescan_ri"), rise.alias("credible_rise"))


def backtest_summary(rows: DataFrame, targets: DataFrame, top: int = 10) -> DataFrame:
    """One row for each target: its peak eb05 with ebgm, recent cases and quarter, its best rank, the first quarter
    in the first ``top`` and the first of a credible rise; NULL for what never came."""
    first = lambda c: F.min(F.when(c, F.col("as_of")))
    peak = F.max(F.struct("eb05", (-F.col("as_of")).alias("at"), "ebgm", "n_recent")).alias("p")
    g = rows.groupBy("entity").agg(peak, F.min("rank").alias("best_rank"), first(F.col("rank") <= top).alias("first_top"), first(F.col("credible_rise")).alias("first_credible"))
    g = g.select("entity", F.col("p.eb05").alias("peak_eb05"), (-F.col("p.at")).alias("peak_as_of"), F.col("p.ebgm").alias("peak_ebgm"), F.col("p.n_recent").alias("peak_n"), "best_rank", "first_top", "first_credible")
    return targets.select("entity").distinct().join(g, "entity", "left")


def running_sums(rows: DataFrame, by: str, cols: list[str], descending: bool = False, buckets: int = 64) -> DataFrame:
    """Adds run_<col>: running sums of ``cols`` in the order of ``by``, whose values are distinct numbers.

    The rows are dealt to ranges of ``by``, cut at quantiles; each range sums for itself and starts from the
    totals of those before it, so that no task holds all rows.
    """
    cuts = sorted(set(rows.approxQuantile(by, [i / buckets for i in range(1, buckets)], 0.01)))
    cuts = [c for c in cuts if c == c and abs(c) != float("inf")]
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(by))) if cuts else F.lit(0)
    rows = rows.withColumn("_b", -bucket if descending else bucket)
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = rows.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols]).select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}") for c in cols])
    run = Window.partitionBy("_b").orderBy(F.desc(by) if descending else F.asc(by)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(before), "_b")
    return out.withColumns({f"run_{c}": F.sum(c).over(run) + F.col(f"_o_{c}") for c in cols}).drop("_b", *[f"_o_{c}" for c in cols])


def percentile_rank(rows: DataFrame, col: str, out: str) -> DataFrame:
    """Adds the average rank of ``col`` divided by the number of its values; NULL stays NULL. Equal values
    are counted first and ranked once."""
    n = rows.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"))
    ranks = running_sums(n, "_v", ["_n"]).crossJoin(F.broadcast(total))  # one row
    ranks = ranks.select("_v", ((F.col("run__n") - (F.col("_n") - 1) / 2.0) / F.col("_all")).alias(out))
    return rows.join(ranks, F.col(col).cast("double") == F.col("_v"), "left").drop("_v")


def ensemble(a: DataFrame, b: DataFrame, kind: str, floor_a: float = 0.0, floor_b: float = 0.0, line_a: float = 1.0, line_b: float = 1.0) -> DataFrame:
    """(entity, as_of, score) of two sweeps (entity, as_of, score) on the union of their keys, absent
    scores at their floors: mean or max of percentile ranks, the larger score over its line, or a veto
    (a's score where b is over its line, else a's floor)."""
    both = a.select("entity", "as_of", F.col("score").alias("a")).join(b.select("entity", "as_of", F.col("score").alias("b")), ["entity", "as_of"], "full")
    both = both.withColumns({"a": F.coalesce("a", F.lit(floor_a)), "b": F.coalesce("b", F.lit(floor_b))})
    if kind in ("mean", "max"):
        both = percentile_rank(percentile_rank(both, "a", "ra"), "b", "rb")
        score = (F.col("ra") + F.col("rb")) / 2 if kind == "mean" else F.greatest("ra", "rb")
    elif kind == "threshold":
        score = F.greatest(F.col("a") / line_a, F.col("b") / line_b)
    else:
        score = F.when(F.col("b") >= line_b, F.col("a")).otherwise(F.lit(floor_a))
    return both.select("entity", "as_of", score.alias("score"))


def entity_scores(sweep: DataFrame, score: str, intervals: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, label, score): each entity's largest score, a positive's only inside its intervals."""
    s = sweep.select("entity", "as_of", F.col(score).alias("score"))
    inside = s.join(intervals, "entity").where("as_of between start_q and end_q").groupBy("entity").agg(F.max("score").alias("inside"))
    positive = intervals.select("entity").distinct().withColumn("label", F.lit(1))
    best = s.groupBy("entity").agg(F.max("score").alias("best"))
    out = entities.join(best, "entity", "left").join(inside, "entity", "left").join(positive, "entity", "left")
    return out.select("entity", F.coalesce("label", F.lit(0)).alias("label"), F.when(F.col("label") == 1, F.col("inside")).otherwise(F.col("best")).alias("score"))


def quarter_scores(sweep: DataFrame, score: str, intervals: DataFrame, entities: DataFrame, floor: float = 0.0) -> DataFrame:
    """(entity, q, label, score): every entity at every as-of quarter of the sweep as a case of its own,
    labelled by its intervals; what the sweep did not score is at the floor. For curves by quarter."""
    quarters = sweep.select(F.col("as_of").alias("q")).distinct()
    grid = entities.select("entity").crossJoin(F.broadcast(quarters))  # a row a quarter
    s = sweep.select("entity", F.col("as_of").alias("q"), F.col(score).cast("double").alias("score"))
    true = interval_quarters(intervals).withColumn("label", F.lit(1))
    out = grid.join(s, ["entity", "q"], "left").join(true, ["entity", "q"], "left")
    return out.select("entity", "q", F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("score", F.lit(floor)).alias("score"))


def rates_at_thresholds(scores: DataFrame) -> DataFrame:
    """(score, tp, fp, tpr, fpr, precision): alarms at or over each distinct score, ties together.

    Each score is a group first; the running sums go over distinct scores of the labelled entities.
    """
    g = scores.where("score IS NOT NULL").groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    totals = scores.agg(F.sum("label").alias("all_p"), F.sum(1 - F.col("label")).alias("all_n"))
    runs = running_sums(g, "score", ["p", "n"], descending=True)
    out = runs.select("score", F.col("run_p").alias("tp"), F.col("run_n").alias("fp")).crossJoin(F.broadcast(totals))  # one row
    d = lambda x: F.col(x).cast("double")
    return out.select("score", "tp", "fp", ratio(d("tp"), F.col("all_p")).alias("tpr"), ratio(d("fp"), F.col("all_n")).alias("fpr"), (d("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def curve_areas(rates: DataFrame) -> DataFrame:
    """(roc_auc, average_precision): trapezoids from (0, 0) to (1, 1), and precision-weighted steps."""
    w = Window.orderBy(F.desc("score"))
    r = rates.select("score", "tpr", "fpr", "precision", F.coalesce(F.lag("tpr").over(w), F.lit(0.0)).alias("t0"), F.coalesce(F.lag("fpr").over(w), F.lit(0.0)).alias("f0"))
    tail = (1 - F.max("fpr")) * (1 + F.max("tpr")) / 2
    return r.agg((F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2) + tail).alias("roc_auc"), F.sum((F.col("tpr") - F.col("t0")) * F.col("precision")).alias("average_precision"))


@dataclass(frozen=True)
class Model:
    """A detector variant: which sweep, which score column, and its line. Ensembles name their parts."""

    name: str
    sweep: str
    score: str
    threshold: float
    kind: str = "single"
    parts: tuple[str, ...] = ()
    weighted: bool = False
    gate: str = ""
    params: tuple = ()

    @property
    def sweep_key(self) -> tuple:
        """Models with equal keys share one sweep."""
        return self.sweep, self.weighted, self.params


#: What a component's score is where its sweep has no row: no evidence, not a missing value.
FLOORS = {"scan": 1.0, "branch": 1.0}


def model_score(sweep: DataFrame, model: Model) -> DataFrame:
    """(entity, as_of, score): the one number that a model's alarm is read off.

    A ratio without expectation is no score (NULL), which never alarms. A dual gate takes the smaller of both
    scores; a flag gate gives rows without the flag no chance (minus infinity).
    """
    score = F.col(model.score).cast("double")
    if model.score == "ratio":
        score = F.when(F.col("expected") > 0, F.col("n_recent") / F.col("expected"))
    if model.gate in ("dual", "both"):
        other = {"eb05": "eb05_own", "z": "own_z", "ratio": "ratio_own"}[model.score]
        score = F.when(score.isNotNull() & F.col(other).isNotNull(), F.least(score, F.col(other).cast("double")))
    elif model.gate:
        score = F.when(F.col(model.gate), score).otherwise(F.lit(float("-inf")))
    return sweep.select("entity", "as_of", score.alias("score"))


def build_scores(models: list[Model], sweeps: dict[tuple, DataFrame], every: dict[str, Model] | None = None) -> dict[str, DataFrame]:
    """(entity, as_of, score) of each model by name. ``sweeps`` holds one sweep for each distinct
    ``Model.sweep_key``, which several models may share; ensembles are made of their parts' scores, chosen
    or not. A part without its sweep raises."""
    every = every or registry()
    out: dict[str, DataFrame] = {}

    def of(model: Model) -> DataFrame:
        if model.name in out:
            return out[model.name]
        if model.kind == "single":
            if model.sweep_key not in sweeps:
                raise KeyError(f"{model.name} needs the sweep {model.sweep_key}")
            out[model.name] = model_score(sweeps[model.sweep_key], model)
        else:
            a, b = (every[p] for p in model.parts)
            line = dict(model.params).get("line", b.threshold)
            out[model.name] = ensemble(of(a), of(b), model.kind, FLOORS.get(a.sweep, 0.0), FLOORS.get(b.sweep, 0.0), a.threshold, line)
        return out[model.name]

    return {m.name: of(m) for m in models}


def run_benchmark(models: list[Model], scores: dict[str, DataFrame], intervals: DataFrame, negatives: DataFrame) -> DataFrame:
    """One row for each model at its own line: labelled entities detected, mean recall, precision and
    overlap over them (no quarters below: 0), mean lag of those detected, alarm-quarters on labelled and
    on other entities, other entities that alarmed, and the rate of alarming entities with any overlap.

    All models' alarms are one table, so that the comparison is a few grouped sums, not one job a model.
    """
    rows = None
    for m in models:
        hot = scores[m.name].where(F.col("score") > m.threshold).select(F.lit(m.name).alias("model"), "entity", F.col("as_of").alias("q"))
        rows = hot if rows is None else rows.unionByName(hot)
    spark = intervals.sparkSession
    names = spark.createDataFrame([(m.name,) for m in models], "model string")
    labelled = intervals.select("entity").unionByName(negatives.select("entity")).distinct()
    grid = labelled.crossJoin(F.broadcast(names))  # the models
    truth = interval_quarters(intervals).crossJoin(F.broadcast(names)).select("model", "entity", "q", F.lit(1).alias("t"))  # the models
    on = rows.join(labelled, "entity", "left_semi").select("model", "entity", "q", F.lit(1).alias("d"))
    sums = truth.join(on, ["model", "entity", "q"], "full").groupBy("model", "entity").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("gt"), F.coalesce(F.sum("d"), F.lit(0)).alias("det"), F.coalesce(F.sum(F.col("t") * F.col("d")), F.lit(0)).alias("overlap"))
    lag = rows.join(intervals, "entity").where("q between start_q and end_q").groupBy("model", "entity").agg(F.min(F.col("q") - F.col("start_q")).alias("lag"))
    per = grid.join(sums, ["model", "entity"], "left").join(lag, ["model", "entity"], "left").fillna(0, ["gt", "det", "overlap"])
    part = lambda a, b: F.avg(F.coalesce(ratio(a.cast("double"), b), F.lit(0.0)))
    gt, det, both = F.col("gt"), F.col("det"), F.col("overlap")
    alarmed, right = F.sum((det > 0).cast("int")), F.sum(((det > 0) & (both > 0)).cast("int"))
    out = per.groupBy("model").agg(
        F.count("*").alias("labelled"),
        F.sum((both > 0).cast("int")).alias("detected"),
        part(both, gt).alias("recall"),
        part(both, det).alias("precision"),
        part(both, gt + det - both).alias("iou"),
        F.avg("lag").alias("lag_q"),
        F.sum("det").alias("alarm_quarters"),
        ratio(right.cast("double"), alarmed).alias("alarm_precision"),
    )
    off = rows.join(labelled, "entity", "left_anti").groupBy("model").agg(F.count("*").alias("off_quarters"), F.count_distinct("entity").alias("off_entities"))
    return out.join(off, "model", "left").fillna(0, ["off_quarters", "off_entities"])


def onset_lags(rows: DataFrame, intervals: DataFrame, external: DataFrame) -> DataFrame:
    """(model, entity, start_q, first_alarm, external_q, ahead): each model's first alarm inside an
    interval, beside an external onset (entity, onset in half-years); ahead is how many quarters the alarm
    came before it. ``rows`` is (model, entity, q) of alarms."""
    first = rows.join(intervals, "entity").where("q between start_q and end_q").groupBy("model", "entity", "start_q").agg(F.min("q").alias("first_alarm"))
    ext = external.select("entity", (F.col("onset") * 2).alias("external_q"))
    return first.join(ext, "entity", "left").withColumn("ahead", F.col("external_q") - F.col("first_alarm"))


def registry() -> dict[str, Model]:
    """The detector variants, by rule from the four families."""
    models = [Model("ratio", "ratio", "ratio", 1.5)]
    for weight, suffix in ((False, ""), (True, "-weighted")):
        models += [Model(f"eb05{suffix}", "eb", "eb05", 1.5, weighted=weight), Model(f"eb05-dual{suffix}", "eb", "eb05", 1.5, weighted=weight, gate="dual")]
        models += [Model(f"ears{suffix}", "ears", "ears_z", 3.0, weighted=weight), Model(f"trend{suffix}", "trend", "z", 1.96, weighted=weight)]
    models += [Model(f"eb05-spatial-{w}", "eb", "eb05", 1.5, params=(("spatial_weight", w),)) for w in (0.15, 0.25, 0.5)]
    models += [Model("trend-confirmed", "trend", "z", 1.96, gate="confirmed"), Model("trend-emergent", "trend", "z", 1.96, gate="emergent"), Model("trend-own", "trend", "own_z", 1.96), Model("trend-both", "trend", "z", 1.96, gate="both")]
    models += [Model("ears-emergent", "ears", "ears_z", 3.0, gate="emergent"), Model("ears-confirmed", "ears", "ears_z", 3.0, gate="confirmed")]
    models += [Model("scan", "scan", "recurrence_interval", 100.0), Model("scan-branches", "branch", "score", 100.0), Model("scan-branches-all", "branch", "score", 100.0, params=(("least_share", None),))]
    singles = ("eb05", "eb05-dual", "ears", "trend", "scan")
    pairs = [(a, b) for i, a in enumerate(singles) for b in singles[i + 1 :] if {a, b} != {"eb05", "eb05-dual"}]
    models += [Model(f"{kind}({a},{b})", "ensemble", "score", 0.95 if kind == "mean" else 1.0, kind, (a, b)) for kind in ("mean", "threshold") for a, b in pairs]
    models += [Model(f"veto({a},scan,{line})", "ensemble", "score", 1.5, "veto", (a, "scan"), params=(("line", line),)) for a in ("eb05", "eb05-dual") for line in (5, 10, 100)]
    return {m.name: m for m in models}
