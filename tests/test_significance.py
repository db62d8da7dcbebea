"""Monte Carlo nulls: planted clusters are found, noise is not, and partitions do not matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import special
from tidewatch.operators import counting, disproportionality, significance, spatial

ZONES = [(i, float(i % 5), float(i // 5), 10.0) for i in range(25)]
MAP = "zone long, x double, y double, weight double"


def scan(spark, planted, model, replicates=199):
    """Events spread evenly over zones and quarters; the entity's cases at random, or late around zone 12."""
    rng = np.random.default_rng(5)
    events = [(i, int(rng.integers(25)), int(rng.integers(100, 112))) for i in range(3000)]
    near = {12, 7, 11, 13, 17}
    if planted:
        pool = [i for i, z, q in events if z in near and q >= 109]
        cases = [int(x) for x in rng.choice(pool, 30, replace=False)] + [int(x) for x in rng.choice(3000, 60, replace=False)]
    else:
        cases = [int(x) for x in rng.choice(3000, 90, replace=False)]
    labels = [(i, "a") for i in set(cases)] + [(i, "rare") for i in range(5)] + [(i, "common") for i in range(2000)]
    e = spark.createDataFrame(events, "id long, zone long, q int")
    rows = significance.scan_significance(e, spark.createDataFrame(labels, "id long, entity string"), spark.createDataFrame(ZONES, MAP), 111, model, replicates=replicates).collect()
    assert [r.entity for r in rows] == ["a"]  # too few, too large a share
    return rows[0]


@pytest.mark.parametrize("model", ["bernoulli", "interaction"])
def test_planted_cylinder_is_found(spark, model):
    r = scan(spark, True, model)
    assert r.p_value == pytest.approx(1 / 200) and r.window_q == 3 and r.rate_ratio > 1.5
    assert len(set(r.members.split("|")) & {"12", "7", "11", "13", "17"}) >= 4 and r.p_across == r.p_value
    assert scan(spark, False, model).p_value > 0.05


def test_trend_null(spark):
    zones = spark.createDataFrame(ZONES, MAP)
    years = range(6)
    pop = spark.createDataFrame([(z, t, 1000) for z in range(25) for t in years], "zone long, t int, n long")
    rising = {12, 7, 11, 13, 17}
    rng = np.random.default_rng(2)
    n = [(z, t, int(rng.poisson(20 * (np.exp(0.35 * (t - 2.5)) if z in rising else 1)))) for z in range(25) for t in years]
    r = significance.trend_significance(spark.createDataFrame(n, "zone long, t int, n long"), pop, zones, replicates=199).first()
    assert r.p_value == pytest.approx(1 / 200) and r.beta_in > 0.2 > r.beta_out
    flat = [(z, t, int(rng.poisson(20))) for z in range(25) for t in years]
    r = significance.trend_significance(spark.createDataFrame(flat, "zone long, t int, n long"), pop, zones, replicates=199).first()
    assert r.p_value > 0.05


def test_tolerance_and_zones(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(0, 1000, (3000, 2))
    hot = np.hypot(*(xy - 300).T) < 150
    case = rng.random(3000) < np.where(hot, 0.5, 0.1)
    p = spark.createDataFrame([(float(x), float(y), bool(c)) for (x, y), c in zip(xy, case)], "x double, y double, is_case boolean")
    rows = {(r.ix, r.iy): r for r in significance.tolerance_surface(p, 100.0, 1.0, replicates=199).collect()}
    assert rows[2, 2].p_value == pytest.approx(1 / 200) and rows[2, 2].log_rr > 0.5 and rows[8, 8].p_value > 0.05
    again = {(r.ix, r.iy): r.p_value for r in significance.tolerance_surface(p.repartition(7), 100.0, 1.0, replicates=199).collect()}
    assert again == {k: r.p_value for k, r in rows.items()}
    zone = lambda x, y: F.when(x < 500, "west").when(x < 900, "east")
    out = {r.zone: r for r in significance.zone_summary(spark.createDataFrame(list(rows.values())), 100.0, zone).collect()}
    assert set(out) == {"west", "east"} and out["west"].mean_log_rr > out["east"].mean_log_rr and out["west"].min_p == pytest.approx(1 / 200) and out["west"].n_cells == 50


def test_withheld_entities_get_no_discount(spark):
    pts = spark.createDataFrame([(i, float(i), float(i % 3), 10 + i % 4) for i in range(60)], "id long, x double, y double, q int")
    labels = spark.createDataFrame([(i, "few") for i in range(4)] + [(i, "near") for i in range(10, 24)], "id long, entity string")
    rows = spatial.sweep_concentration(pts, labels, recent=4).collect()
    assert {r.as_of for r in rows} == {13} and {r.entity: (r.withheld, r.weight) for r in rows}["few"] == ("n<10", 0.0)
    assert {r.entity: r.weight for r in rows}["near"] > 0.9


def test_spatial_prior_learns_only_from_information():
    rng = np.random.default_rng(6)
    z = rng.normal(size=400)
    e = rng.uniform(2, 20, 400)
    plain = rng.poisson(e * rng.gamma(8, 1 / 8, 400))
    told = rng.poisson(e * rng.gamma(8, 1 / 8, 400) * np.exp(0.5 * z))
    assert abs(special.fit_gamma_prior_by(plain, e, z)[2]) < 0.1
    a, b, gamma, (mean, sd), ok = special.fit_gamma_prior_by(told, e, z)
    assert gamma == pytest.approx(0.5, abs=0.1) and ok
    assert special.fit_gamma_prior_by(told[:5], e[:5], z[:5])[:3] == (0.5, 0.5, 0.0)


def test_one_hot_and_dispersion_by_quarter(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "case_id long, entity string")
    assert [tuple(r) for r in counting.one_hot(cases, m, ["b", "a", "c"]).orderBy("case_id").collect()] == [(1, 1, 1, 0), (2, 1, 0, 0), (3, 0, 0, 0)]
    w = [(f"e{i}", 5, 4 + i % 7, 9, 6.0, 5.0, phi) for i in range(20) for phi in (1.0,)]
    base = disproportionality.eb_scores(spark.createDataFrame(w, "entity string, as_of int, n_recent long, n_baseline long, expected double, expected_own double, phi double"))
    wide = disproportionality.eb_scores(spark.createDataFrame([(*x[:6], 3.0) for x in w], base.select("entity", "as_of", "n_recent", "n_baseline", "expected", "expected_own", "phi").schema))
    width = lambda df: sum(r.eb95 - r.eb05 for r in df.collect())
    assert width(wide) != width(base) and wide.count() == 20


def test_tables_keep_their_margins():
    rng = np.random.default_rng(3)
    rows, columns = np.array([5, 0, 7, 2]), np.array([4, 4, 6])
    draws = np.stack([significance.random_table(rng, rows, columns) for _ in range(4000)])
    assert (draws.sum(2) == rows).all() and (draws.sum(1) == columns).all() and (draws >= 0).all()
    assert np.allclose(draws.mean(0), np.outer(rows, columns) / 14, atol=0.06)
    # as shuffling the cases' columns among the rows does
    where, when = np.repeat(np.arange(4), rows), np.repeat(np.arange(3), columns)
    plain = np.zeros((4000, 4, 3))
    for p in plain:
        np.add.at(p, (where, rng.permutation(when)), 1)
    assert np.allclose(draws.var(0), plain.var(0), atol=0.12)


def test_circles_are_cut_lists(spark):
    """More zones than the first question names, some very light, so that circles end at different lengths."""
    rng = np.random.default_rng(8)
    xy, w = rng.uniform(0, 10, (90, 2)), rng.choice([0.0, 1.0, 30.0], 90)
    xy[5] = xy[4]
    zones = spark.createDataFrame([(f"z{i:02d}", float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(xy, w))], "zone string, x double, y double, weight double")
    got = {}
    for r in spatial.circles(zones, 0.25, first=4).collect():
        got.setdefault(r.centre, {})[r["rank"]] = r.zone
    for i in range(90):
        d = np.sqrt(((xy - xy[i]) ** 2).sum(1))
        order = sorted(range(90), key=lambda j: (d[j], j))
        run = np.cumsum(w[order])
        keep = [f"z{j:02d}" for k, j in enumerate(order) if k == 0 or run[k] <= 0.25 * w.sum()]
        assert [got[f"z{i:02d}"][k + 1] for k in range(len(keep))] == keep and len(got[f"z{i:02d}"]) == len(keep)


def test_branches_are_scanned_too(spark):
    labels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "id long, entity string")
    nodes = spark.createDataFrame([("G", "category", "a"), ("G", "category", "b"), ("a", "substance", "a")], "node string, level string, leaf string")
    assert sorted(map(tuple, significance.with_branches(labels, nodes).collect())) == [(1, "G"), (1, "a"), (1, "b"), (2, "G"), (2, "b"), (3, "c")]


def test_priors_on_the_cluster_equal_those_in_a_task(spark):
    """All quarters fitted together, with and without z, against the simplex in one task."""
    rng = np.random.default_rng(19)
    rows = []
    for q in (10, 11, 12):
        for i in range(400):
            e, z = float(rng.uniform(0.2, 8)), float(rng.normal())
            rows.append((f"e{i}", q, int(rng.poisson(e * rng.gamma(1.5, 1 / (1.2 * np.exp(-0.4 * z))))), 7, e, e / 2, z))
    rows += [("few", 13, 2, 1, 1.0, 1.0, 0.3), ("none", 13, 2, 1, 0.0, None, 0.1)]
    schema = "entity string, as_of int, n_recent long, n_baseline long, expected double, expected_own double, z_spatial double"
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([r[:6] for r in rows], schema.rsplit(",", 1)[0])):
        one = {(r.entity, r.as_of): r for r in disproportionality.eb_scores(frame).collect()}
        all_ = {(r.entity, r.as_of): r for r in disproportionality.eb_scores(frame, most_cells=0).collect()}
        assert one.keys() == all_.keys() and len(one) == 1202
        for k, r in one.items():
            for c in ("alpha", "beta", "alpha_own", "beta_own", "ebgm", "eb05", "eb95", "eb05_own"):
                assert all_[k][c] == pytest.approx(r[c], rel=2e-6, abs=1e-9), (k, c)
            assert all_[k].converged == r.converged == (k[1] != 13)


def test_ascent_stops_at_bounds():
    from tidewatch.operators.prior_fit import Ascent, likelihood_sums

    n, e = np.full(50, 3.0), np.full(50, 3.0)  # no spread: alpha and beta run off together
    a = Ascent(np.array([12.0, 12.0, 0.0]))
    for _ in range(80):
        if a.done:
            break
        a.told([likelihood_sums(n, e, np.zeros(50), np.ones(50), p) for p in a.trials()])
    assert a.done and abs(a.at[0] - a.at[1]) < 1e-3 and a.at[0] > 8 and a.at[2] == 0
    # derivatives are those of the likelihood
    rng = np.random.default_rng(2)
    n, e, u, w, p = rng.poisson(4, 30).astype(float), rng.uniform(0.1, 9, 30), rng.normal(size=30), rng.uniform(1, 3, 30), np.array([0.3, -0.2, 0.4])
    s, h = likelihood_sums(n, e, u, w, p), 1e-4
    at = lambda d: likelihood_sums(n, e, u, w, p + d)
    for i, d in enumerate(np.eye(3) * h):
        assert (at(d)[0] - at(-d)[0]) / (2 * h) == pytest.approx(s[1 + i], rel=1e-5)
        for j, place in zip(range(3), ((4, 5, 6), (5, 7, 8), (6, 8, 9))[i]):
            assert (at(d)[1 + j] - at(-d)[1 + j]) / (2 * h) == pytest.approx(s[place], rel=1e-5)
    assert s[0] == pytest.approx(special.nb_log_likelihood(n, e, np.exp(0.3), np.exp(-0.2 - 0.4 * u), w))
