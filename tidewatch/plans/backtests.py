"""Registered queries that replay the detectors quarter by quarter and compare them at their own and at equal budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aberration, counting, evaluation, treescan
from ..operators import disproportionality as disp
from ..session import stored
from . import domain as d
from .registry import CALM, TRUTH, B, W, _intervals, _located, _r, _ratio, _scanned, query, r6


def _targets(s):
    return s.createDataFrame([(x[0],) for x in [*TRUTH, *CALM]], "entity string")


TARGETS = ", ".join(f"('{x[0]}')" for x in [*TRUTH, *CALM])
REPLAY = f"""
tg(entity) AS (VALUES {TARGETS}), li AS (SELECT *, ratio > 1.5 AND ratio_own > 1.5 AS rise FROM rat WHERE ratio IS NOT NULL),
bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY ratio DESC, entity) AS rk FROM li) WHERE entity IN (FROM tg))"""


def _ratio_replay(s, sf):
    rows = _ratio(s, sf).where("ratio IS NOT NULL")
    rows = rows.withColumns({"ebgm": F.col("ratio"), "eb05": F.col("ratio"), "eb05_own": F.col("ratio_own"), "credible_rise": (F.col("ratio") > 1.5) & (F.col("ratio_own") > 1.5)})
    return evaluation.trends_backtest(stored(rows, "sweep"), _targets(s))


@query(f"WITH {B}, {W}, {REPLAY} SELECT as_of, entity, rk::BIGINT AS rank, n_recent, n_baseline, {_r('ratio', 'ratio')}, {_r('ratio_own', 'ratio_own')}, rise AS credible_rise FROM bt")
def ratio_backtest(s, sf):
    """Where the labelled brands stood at every as-of quarter by the plain ratio."""
    out = _ratio_replay(s, sf).select("as_of", "entity", "rank", "n_recent", "n_baseline", F.col("eb05").alias("ratio"), F.col("eb05_own").alias("ratio_own"), "credible_rise")
    return r6(out, "ratio", "ratio_own")


@query(f"""WITH {B}, {W}, {REPLAY}, g AS (SELECT entity, min(rk)::BIGINT AS best_rank, min(as_of) FILTER (rk <= 10) AS first_top, min(as_of) FILTER (rise) AS first_credible FROM bt GROUP BY 1),
pk AS (SELECT * FROM bt QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ratio DESC, as_of) = 1)
SELECT tg.entity, {_r('ratio', 'peak')}, as_of AS peak_as_of, n_recent AS peak_n, best_rank, first_top, first_credible FROM tg LEFT JOIN pk USING (entity) LEFT JOIN g USING (entity)""")
def ratio_backtest_summary(s, sf):
    """Their peaks, best ranks and first quarters in the first ten and over both gates."""
    out = evaluation.backtest_summary(_ratio_replay(s, sf), _targets(s))
    return r6(out.select("entity", F.col("peak_eb05").alias("peak"), "peak_as_of", "peak_n", "best_rank", "first_top", "first_credible"), "peak")


def _weighted_scores(s, sf, denom):
    """Shrinkage scores of the weighted sweep with the spatial discount, each quarter's dispersion as of then. Steps are
    stored, so that the driver plans them one at a time and orders are read once."""
    con = stored(_located(s, sf).select("entity", "as_of", "weight"), "weights")
    w = counting.weighted_windows(stored(d.ordered(s, sf), "ordered"), denom).join(con, ["entity", "as_of"], "left")
    return disp.eb_scores(stored(disp.gate_columns(w, concentration=F.col("weight")).where("n_recent > 0"), "windows"))


@query()
def trends_backtest(s, sf):
    """Where the labelled brands stood at every as-of quarter by the weighted, discounted and vetoed shrinkage score."""
    c, n, nodes = _scanned(s, sf)
    scores = stored(_weighted_scores(s, sf, n), "scores")
    ri = treescan.backtest(c, n, nodes).where("level = 'substance'").select(F.col("node").alias("entity"), "as_of", "recurrence_interval")
    out = evaluation.trends_backtest(scores, _targets(s), stored(ri, "intervals"))
    return r6(out, "n_recent", "n_baseline", "ebgm", "eb05", "eb05_own", "treescan_ri", places=4)


M = evaluation.Model
#: The detectors at their reading lines, each on a sweep of its own kind.
REAL = [
    M("ratio", "ratio", "ratio", 1.5),
    M("eb05", "eb", "eb05", 1.5),
    M("eb05-dual", "eb", "eb05", 1.5, gate="dual"),
    M("ears", "ears", "ears_z", 3.0),
    M("trend", "trend", "z", 1.96),
    M("trend-both", "trend", "z", 1.96, gate="both"),
    M("scan", "scan", "recurrence_interval", 100.0),
    M("scan-branches", "branch", "score", 100.0),
    M("mean(eb05,trend)", "ensemble", "score", 0.95, "mean", ("eb05", "trend")),
    M("threshold(eb05,ears)", "ensemble", "score", 1.0, "threshold", ("eb05", "ears")),
    M("veto(eb05,scan,10)", "ensemble", "score", 1.5, "veto", ("eb05", "scan"), params=(("line", 10),)),
]


@query()
def benchmark_models(s, sf):
    """Every detector against the labelled intervals, at its own line and at a line that gives each as many alarms as
    the shrinkage score raises: the sweeps are built once each, the scan's by the as-of backtest."""
    c, n, nodes = _scanned(s, sf)
    ratios = stored(disp.ratio_sweep(c, n), "sweep")
    scan = stored(treescan.backtest(c, n, nodes), "backtest")
    leaves = scan.where("level = 'substance'").select(F.col("node").alias("entity"), "as_of", "recurrence_interval")
    branch = treescan.branch_sweep(scan, treescan.scan_cells(c, n, nodes), nodes, score="recurrence_interval", whole_leaves=True)
    built = {"ratio": ratios, "eb": disp.eb_scores(ratios), "ears": aberration.ears_sweep(c, n), "trend": aberration.trend_sweep(c, n), "scan": leaves, "branch": branch}
    sweeps = {m.sweep_key: stored(built[m.sweep], "sweep") for m in REAL if m.kind == "single" and not m.gate}
    scores = evaluation.build_scores(REAL, sweeps, {m.name: m for m in REAL})
    scores = {k: stored(v, "scores") for k, v in scores.items()}
    budget = scores["eb05"].where(F.col("score") > 1.5).count()
    moved, _ = evaluation.matched_models(REAL, scores, budget)
    calm, rows = s.createDataFrame(CALM, "entity string"), None
    for kind, models in (("own line", REAL), ("matched budget", moved)):
        one = evaluation.run_benchmark(models, scores, _intervals(s, sf), calm).withColumn("budget", F.lit(kind))
        rows = one if rows is None else rows.unionByName(one)
    return r6(rows, "recall", "precision", "iou", "lag_q", "alarm_precision")
