"""The as-of tree-scan backtest: planted risers, a plain null, partitions, budgets and first signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluation
from tidewatch.operators.treescan import DRAWS, backtest, branch_sweep, head_to_head, leaf_draws, matched_budget, mention_totals, null_maxima, scan_cells, window_shares, with_p_values
from tidewatch.plans import backtests, domain

QUARTERS = range(100, 118)
GROUPS = {f"g{i}": [f"{'abcdef'[j]}{i}" for j in range(6)] for i in range(4)}


@pytest.fixture(scope="module")
def frame(spark):
    """24 leaves in four groups; a0 rises from quarter 114, and all of g3 a little, each too rare to be seen alone."""
    rng = np.random.default_rng(11)
    counts = []
    for g, leaves in GROUPS.items():
        for leaf in leaves:
            rate = 0.25 if g == "g3" else 6
            for q in QUARTERS:
                more = 5 if leaf == "a0" and q >= 114 else 6 if g == "g3" and q >= 115 else 1
                n = int(rng.poisson(rate * more))
                if n:
                    counts.append((leaf, q, n))
    counts += [("silent", 100, 1)]
    nodes = [("All", "root", x) for v in GROUPS.values() for x in v] + [(g, "category", x) for g, v in GROUPS.items() for x in v] + [(x, "substance", x) for v in GROUPS.values() for x in v]
    nodes += [("All", "root", "silent"), ("silent", "substance", "silent")]
    return (
        spark.createDataFrame(counts, "entity string, q int, n long"),
        spark.createDataFrame([(q, 200 + q % 4) for q in QUARTERS], "q int, n_total long"),
        spark.createDataFrame(nodes, "node string, level string, leaf string"),
    )


def plain_null(counts, reference, nodes, as_of, replicates, study=12, longest=6, least=3, seed=20260810):
    """The maxima of one quarter with a dense membership matrix, from the leaves' own streams."""
    quarters = list(range(as_of - study + 1, as_of + 1))
    ref = {r.q: r.n_total for r in reference.collect()}
    p = np.array([ref[q] for q in quarters], float)
    share = np.array([p[-w:].sum() for w in range(1, longest + 1)]) / p.sum()
    n = {}
    for r in counts.collect():
        if r.q in quarters:
            n[r.entity] = n.get(r.entity, 0) + r.n
    leaves, member = sorted(n), {}
    for r in nodes.collect():
        if r.leaf in n:
            member.setdefault(r.node, set()).add(r.leaf)
    m = np.array([[x in v for x in leaves] for v in member.values()], int)
    out = []
    for block in range(-(-replicates // DRAWS)):
        draws = np.stack([leaf_draws(n[x], share, seed, as_of, x, block) for x in leaves])
        for c in np.einsum("nl,lrw->rnw", m, draws)[: replicates - block * DRAWS]:
            t = (m @ [n[x] for x in leaves])[:, None]
            e = t * share
            ok = (c > e) & (c >= least)
            with np.errstate(all="ignore"):
                v = c * np.log(c / e) + np.where(t > c, (t - c) * np.log((t - c) / (t - e)), 0)
            out.append(np.where(ok, v, 0).max())
    return np.array(out)


def test_null_is_a_plain_one_in_any_partition(spark, frame):
    counts, ref, nodes = frame
    want = plain_null(counts, ref, nodes, 117, 300)
    for chunk, parts in ((512, 4), (5, 3), (1, 7)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {r.replicate: r.max_llr for r in null_maxima(counts.repartition(parts), ref, nodes, 117, replicates=300, chunk=chunk).collect()}
        assert sorted(got) == list(range(300))
        assert np.allclose([got[i] for i in range(300)], want, rtol=1e-9, atol=1e-12), chunk
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_draws_are_multinomial():
    shares = np.array([0.1, 0.15, 0.3, 0.35, 0.5, 0.6])
    d = np.concatenate([leaf_draws(50, shares, 1, 7, "x", b) for b in range(40)])
    assert d.shape == (40 * DRAWS, 6) and (np.diff(d, axis=1) >= 0).all() and (d <= 50).all()
    assert np.allclose(d.mean(axis=0), 50 * shares, atol=0.15)
    assert np.allclose(d.var(axis=0), 50 * shares * (1 - shares), rtol=0.06)
    assert not np.array_equal(leaf_draws(50, shares, 1, 7, "x", 0), leaf_draws(50, shares, 1, 7, "y", 0))
    assert not np.array_equal(leaf_draws(50, shares, 1, 7, "x", 0), leaf_draws(50, shares, 1, 8, "x", 0))
    assert leaf_draws(5, np.array([0.5, 1.0]), 1, 7, "x", 0)[:, 1].tolist() == [5] * DRAWS


@pytest.fixture(scope="module")
def swept(frame):
    counts, ref, nodes = frame
    return backtest(counts, ref, nodes, replicates=999).toPandas()


def test_backtest(frame, swept):
    assert sorted(swept.as_of.unique()) == list(range(111, 118))
    a0 = swept[swept.node == "a0"].set_index("as_of")
    assert a0.recurrence_interval[117] == 1000 and a0.recurrence_interval[115] >= 100
    assert (a0.recurrence_interval[[111, 112, 113]] < 100).all()  # nothing of what comes later
    g3 = swept[(swept.node == "g3") & (swept.as_of == 117)].iloc[0]
    assert g3.recurrence_interval >= 100 and g3.window_q == 3
    assert (swept[(swept.llr <= 0)].p_value == 1).all() and swept[swept.llr <= 0].window_q.isna().all()
    flat = swept[swept.node.isin(GROUPS["g1"] + GROUPS["g2"])]
    assert (flat.recurrence_interval >= 100).mean() < 0.03
    null = plain_null(*frame, 116, 999)
    for r in swept[(swept.as_of == 116) & (swept.llr > 0)].itertuples():
        assert r.p_value == pytest.approx((1 + (null >= r.llr - 1e-9).sum()) / 1000)


def test_quarters_do_not_see_later_ones(frame, swept):
    counts, ref, nodes = frame
    early = backtest(counts.where("q <= 114"), ref.where("q <= 114"), nodes, replicates=999).toPandas()
    cols = ["node", "as_of", "llr", "p_value"]
    a = early[cols].sort_values(cols[:2]).reset_index(drop=True)
    b = swept[swept.as_of <= 114][cols].sort_values(cols[:2]).reset_index(drop=True)
    assert len(a) == len(b) and np.allclose(a[["llr", "p_value"]], b[["llr", "p_value"]])


def test_branch_intervals_reach_leaves(frame):
    counts, ref, nodes = frame
    best = backtest(counts, ref, nodes, replicates=999)
    cells = scan_cells(counts, ref, nodes)
    rows = {(r.entity, r.as_of): r for r in branch_sweep(best, cells, nodes, 0.15, "recurrence_interval", branches_only=True).collect()}
    hit = [x for x in GROUPS["g3"] if (x, 117) in rows and rows[x, 117].node == "g3"]
    assert hit and all(rows[x, 117].score >= 100 and rows[x, 117].excess_share >= 0.15 for x in hit)
    assert not any(r.node == r.entity for r in rows.values())
    whole = {(r.entity, r.as_of): r for r in branch_sweep(best, cells, nodes, 0.15, "recurrence_interval", whole_leaves=True).collect()}
    assert whole["a0", 117].score == 1000 and whole["a0", 117].node == "a0" and whole["a0", 117].excess_share == 1
    loose = branch_sweep(best, cells, nodes, None, "recurrence_interval", branches_only=True).count()
    assert loose > len(rows)


SCAN = "node string, level string, as_of int, window_q int, observed long, n_study long, expected double, llr double, p_value double, recurrence_interval double"


def row(node, level, as_of, llr, p, observed=10, expected=2.0):
    return (node, level, as_of, 2, observed, 40, expected, llr, p, 1 / p)


def test_matched_budget(spark):
    rows = [row("a", "substance", q, llr, p) for q, llr, p in ((1, 5.0, 0.01), (2, 4.0, 0.01), (3, 4.0, 0.01), (4, 3.0, 0.02), (5, 2.0, 0.5))]
    rows += [row("b", "substance", 2, 4.0, 0.01), row("c", "substance", 1, 0.0, 1.0)]
    scan = spark.createDataFrame(rows, SCAN)
    want = [("a", 1), ("a", 2), ("b", 2), ("a", 3), ("a", 4), ("a", 5)]
    for budget in range(8):
        out, ri = matched_budget(scan, budget)
        assert sorted((r.node, r.as_of) for r in out.collect() if r.matched_alarm) == sorted(want[:budget])
        assert out.count() == 7
        assert ri == (None if not budget else pytest.approx([100, 100, 100, 100, 50, 2, 2][budget - 1]))


def test_head_to_head(spark):
    """First signals and lags, worked out by hand."""
    rows = [
        row("x", "substance", 110, 1.0, 0.2), row("x", "substance", 112, 6.0, 0.005), row("x", "substance", 113, 7.0, 0.004),
        row("G", "category", 105, 9.0, 0.001, 20, 5.0), row("G", "category", 109, 8.0, 0.002, 12, 4.0), row("All", "root", 109, 8.5, 0.001, 40, 20.0),
        row("y", "substance", 111, 0.5, 0.9),
    ]
    scan = spark.createDataFrame(rows, SCAN)
    cells = spark.createDataFrame([("x", "substance", 109, 2, 7, 10, 1.0)], "node string, level string, as_of int, window_q int, observed long, n_study long, expected double")
    eb = spark.createDataFrame([("x", 111, 1.6), ("x", 112, 2.0), ("y", 111, 1.2), ("z", 111, 9.0)], "entity string, as_of int, eb05 double")
    counts = spark.createDataFrame([("x", 108, 2), ("x", 107, 0), ("y", 100, 1)], "entity string, q int, n long")
    nodes = spark.createDataFrame([("G", "category", "x"), ("G", "category", "w"), ("All", "root", "x"), ("All", "root", "w"), ("All", "root", "y"), *[(v, "substance", v) for v in "wxy"]], "node string, level string, leaf string")
    out = {r.entity: r for r in head_to_head(scan, cells, eb, counts, nodes, spark.createDataFrame([("x",), ("y",), ("none",)], "entity string")).collect()}
    x, y = out["x"], out["y"]
    assert (x.first_seen, x.eb05_signal, x.tree_leaf_signal, x.tree_branch_signal, x.branch_node) == (108, 111, 112, 109, "G")
    assert x.branch_excess_share == pytest.approx(6 / 8) and x.verdict == "attributable"
    assert (x.eb05_lag_q, x.tree_leaf_lag_q, x.tree_branch_lag_q, x.peak_llr) == (3, 4, 1, 7.0) and x.best_ri == pytest.approx(250)
    # eb05 alarms three times over all entities: the three best rows of the scan are G, All and G
    assert x.tree_leaf_matched_signal is None
    # y is never in a branch's window that signals by itself, but the root fired while it was there
    assert (y.first_seen, y.eb05_signal, y.tree_leaf_signal, y.branch_node, y.branch_excess_share, y.verdict) == (100, None, None, "All", 0.0, "not attributable")
    assert out["none"].first_seen is None and out["none"].branch_node is None and out["none"].verdict is None


def test_p_values_of_salted_groups(spark):
    best = spark.createDataFrame([(f"n{i}", 100 + i % 3, float(i % 7)) for i in range(60)], "node string, as_of int, llr double")
    null = spark.createDataFrame([(100 + q, i, i / 10) for q in range(3) for i in range(70)], "as_of int, replicate int, max_llr double")
    a, b = (sorted(map(tuple, with_p_values(best, null, 70, s).collect())) for s in (1, 5))
    assert a == b and len(a) == 60
    assert {(r[2], round(r[3], 9)) for r in a} == {(float(x), round((71 - 10 * x) / 71, 9) if x else 1.0) for x in range(7)}


def test_mention_reference(spark):
    counts = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("a", 3, 4), ("a", 9, 9)], "entity string, q int, n long")
    ref = spark.createDataFrame([(q, 50) for q in (1, 2, 3)], "q int, n_total long")
    mentions = mention_totals(counts, ref)
    assert {r.q: r.n_total for r in mentions.collect()} == {1: 5, 2: 0, 3: 4}
    assert [r.shares for r in window_shares(mentions, 3, 2).collect()] == [[4 / 9, 4 / 9]]
    assert window_shares(mentions.where(F.lit(False)), 3, 2).count() == 0
    assert window_shares(mentions.withColumn("n_total", F.lit(0)), 3, 2).count() == 0



def sweep_rows():
    rows = [("a", 1, 1.0, 5), ("b", 1, 3.0, 5), ("c", 1, 3.0, 5), ("d", 1, 9.0, 0), ("a", 2, 4.0, 6), ("b", 2, 2.0, 5), ("a", 3, 4.0, 7), ("z", 3, float("nan"), 1)]
    return [(e, q, n, 8, s + 1, s, s, s > 3.5) for e, q, s, n in rows if s == s]


def test_trends_backtest(spark):
    scores = spark.createDataFrame(sweep_rows(), "entity string, as_of int, n_recent int, n_baseline int, ebgm double, eb05 double, eb05_own double, credible_rise boolean")
    targets = spark.createDataFrame([("a",), ("c",), ("never",)], "entity string")
    ri = spark.createDataFrame([("a", 2, 5.0), ("a", 3, 50.0)], "entity string, as_of int, recurrence_interval double")
    out = evaluation.trends_backtest(scores, targets, ri)
    got = {(r.entity, r.as_of): (r["rank"], r.treescan_ri, r.credible_rise) for r in out.collect()}
    assert got == {("a", 1): (3, 1.0, False), ("c", 1): (2, 1.0, False), ("a", 2): (1, 5.0, False), ("a", 3): (1, 50.0, True)}
    plain = evaluation.trends_backtest(scores, targets)
    assert {(r.entity, r.as_of) for r in plain.collect() if r.credible_rise} == {("a", 2), ("a", 3)}
    s = {r.entity: r for r in evaluation.backtest_summary(out, targets, top=2).collect()}
    a = s["a"]
    assert (a.peak_eb05, a.peak_as_of, a.peak_ebgm, a.peak_n, a.best_rank, a.first_top, a.first_credible) == (4.0, 2, 5.0, 6, 1, 2, 3)
    assert (s["c"].first_top, s["c"].first_credible) == (1, None) and s["never"].peak_eb05 is None


def test_budgets_move_lines(spark):
    sweep = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 4.0), ("b", 1, 4.0), ("b", 2, 1.0), ("c", 1, None), ("c", 2, float("-inf"))], "entity string, as_of int, score double")
    assert [evaluation.budget_line(sweep, "score", k) for k in range(6)] == [None, 5.0, 4.0, 4.0, 1.0, 1.0]
    m = evaluation.Model("m", "x", "score", 9.0)
    for budget, alarms in ((0, 0), (1, 1), (2, 3), (9, 4)):
        moved, lines = evaluation.matched_models([m], {"m": sweep}, budget)
        assert sweep.where(F.col("score") > moved[0].threshold).count() == alarms and moved[0].name == "m"
        assert evaluation.matched_alarms(sweep, "score", budget).count() == alarms


def test_weighted_scores_are_planned_on_stored_windows(spark):
    """Fits and joins of the backtest's scores read what is stored, and do not plan the tables' joins again."""
    sf = "/root/testdata/sf0.001"
    scores = backtests._weighted_scores(spark, sf, domain.denom(spark, sf))
    assert scores.count() > 0 and not any(sf in f for f in scores.inputFiles())
