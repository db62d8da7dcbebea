"""The registered queries of the library's own operators and their SQL.

Each query builds on the test tables through ``domain``; each SQL text says the same for DuckDB.
Floating-point results are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import ordinal_date, rounded
from ..operators import aberration, alarms, cooccurrence, counting, evaluation, hierarchy, nowcast, significance, spatial, treescan, windows
from ..operators import disproportionality as disp
from ..operators import text as txt
from ..session import stored, table
from . import domain as d

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(df, *cols, places: int = 6):
    return df.withColumns({c: rounded(F.col(c), places) for c in cols})


def _r(x: str, name: str, places: int = 6) -> str:
    return f"round(({x})::DOUBLE, {places}) + 0.0::DOUBLE AS {name}"


B, BS = d.base_sql(), d.base_sql(False)
# trailing windows of every as-of quarter, by range join
W = """
aso AS (SELECT q AS as_of, (SELECT count(*) FROM den x WHERE x.q BETWEEN den.q - 11 AND den.q) AS k,
        (SELECT sum(n_total) FROM den x WHERE x.q BETWEEN den.q - 3 AND den.q)::BIGINT AS total_recent,
        (SELECT sum(n_total) FROM den x WHERE x.q BETWEEN den.q - 11 AND den.q - 4)::BIGINT AS total_base FROM den),
win AS (SELECT entity, as_of, any_value(total_recent) AS total_recent, any_value(total_base) AS total_base,
        coalesce(sum(n) FILTER (cnt.q > as_of - 4), 0)::BIGINT AS n_recent, coalesce(sum(n) FILTER (cnt.q <= as_of - 4), 0)::BIGINT AS n_baseline
        FROM cnt JOIN aso ON cnt.q BETWEEN as_of - 11 AND as_of WHERE k = 12 GROUP BY 1, 2),
gate AS (SELECT *, CASE WHEN total_base <> 0 THEN n_baseline * total_recent / total_base::DOUBLE END AS expected, n_baseline * 0.5::DOUBLE AS expected_own FROM win),
rat AS (SELECT *, n_recent / nullif(expected, 0) AS ratio, n_recent / nullif(expected_own, 0) AS ratio_own FROM gate WHERE n_recent > 0)"""
EARS = """
ears AS (SELECT *, (share - mean) / greatest(sd, sqrt(greatest(mean_n, 0.25)) / mean_total) AS ears_z FROM (
  SELECT entity, as_of, sum(n) FILTER (dn.q > as_of - 4)::BIGINT AS n_recent, sum(n) FILTER (dn.q <= as_of - 4)::BIGINT AS n_baseline,
    sum(n) FILTER (dn.q > as_of - 4) / (sum(n_total) FILTER (dn.q > as_of - 4))::DOUBLE AS share,
    avg(n / n_total::DOUBLE) FILTER (dn.q <= as_of - 4) AS mean, stddev_samp(n / n_total::DOUBLE) FILTER (dn.q <= as_of - 4) AS sd,
    avg(n) FILTER (dn.q <= as_of - 4) AS mean_n, avg(n_total) FILTER (dn.q <= as_of - 4) AS mean_total
  FROM dn JOIN aso ON dn.q BETWEEN as_of - 11 AND as_of WHERE k = 12 GROUP BY 1, 2) WHERE n_recent > 0)"""
HOT = """
hot AS (SELECT *, as_of - row_number() OVER (PARTITION BY entity ORDER BY as_of) AS island FROM rat WHERE ratio > 1.5),
epi AS (SELECT entity, island, min(as_of) AS first_q, max(as_of) AS last_q, count(*)::BIGINT AS quarters, max(ratio) AS peak FROM hot GROUP BY 1, 2)"""


def _ratio(s, sf):
    return disp.ratio_sweep(d.counts(s, sf), d.denom(s, sf))


def _ears(s, sf):
    return aberration.ears_sweep(d.counts(s, sf), d.denom(s, sf))


# --- counting ---------------------------------------------------------------------------------------
@query(f"WITH {B} SELECT entity, quarter, q, n FROM cnt")
def quarterly_counts(s, sf):
    return d.counts(s, sf)


@query(f"WITH {B} SELECT quarter, q, n_total FROM den")
def denominators(s, sf):
    return d.denom(s, sf)


@query(f"WITH {B} SELECT entity, q, n, n_total FROM dn")
def dense_calendar(s, sf):
    return windows.dense(d.counts(s, sf), d.denom(s, sf)).select("entity", "q", "n", "n_total")


@query(f"WITH {B} SELECT entity, q, n, {_r('n / n_total::DOUBLE', 'share')}, sum(n) OVER (PARTITION BY entity ORDER BY q)::BIGINT AS running FROM dn")
def quarterly_series(s, sf):
    return r6(alarms.quarterly_series(d.counts(s, sf), d.denom(s, sf)), "share")


@query(f"WITH {B}, {W} SELECT entity, as_of, n_recent, n_baseline, total_recent, total_base FROM win")
def trailing_windows(s, sf):
    return windows.trailing_windows(d.counts(s, sf), d.denom(s, sf)).select("entity", "as_of", "n_recent", "n_baseline", "total_recent", "total_base")


@query(f"WITH {B} SELECT entity, {', '.join(f'coalesce(sum(n) FILTER (year(quarter) = {y}), 0)::BIGINT AS y{y}' for y in range(1996, 2001))} FROM cnt GROUP BY entity")
def emergence_table(s, sf):
    c = d.counts(s, sf).withColumn("year", F.concat(F.lit("y"), F.year("quarter")))
    return c.groupBy("entity").pivot("year", [f"y{y}" for y in range(1996, 2001)]).sum("n").fillna(0)


ORD = f"""
o1 AS (SELECT o_orderkey AS case_id, any_value({d._ordinal('o_orderdate')}) AS q, p_brand AS entity, min((l_linenumber, l_partkey, l_suppkey)) AS ln_at
       FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderkey, p_brand),
o2 AS (SELECT case_id, q, entity, row_number() OVER (PARTITION BY case_id ORDER BY ln_at, entity) - 1 AS pos, count(*) OVER (PARTITION BY case_id) AS size FROM o1),
lead1 AS (SELECT entity, min(q) AS first_lead_q FROM o2 WHERE pos = 0 GROUP BY entity),
cred AS (SELECT case_id, q, o2.entity, CASE WHEN size = 1 THEN 2 WHEN size >= 3 AND pos = size - 1 AND NOT coalesce(first_lead_q <= q, false) THEN 0 ELSE 1 END::INT AS credit
         FROM o2 LEFT JOIN lead1 USING (entity))"""


@query(f"WITH {ORD} SELECT case_id, q, entity, credit FROM cred")
def position_credits(s, sf):
    o = d.ordered(s, sf)
    return counting.position_credit(o, counting.first_leads(o))


@query(f"WITH {ORD} SELECT {_r('avg(credit * credit) / avg(credit)', 'phi')} FROM cred")
def credit_dispersion(s, sf):
    o = d.ordered(s, sf)
    return counting.position_credit(o, counting.first_leads(o)).agg(rounded(counting.credit_dispersion(None)).alias("phi"))


@query(f"WITH {ORD} SELECT entity, count(*)::BIGINT AS n, {_r('greatest(1.0, 1 / greatest(avg(credit), 0.05))', 'phi_s')} FROM cred GROUP BY entity HAVING count(*) >= 10")
def role_dispersion(s, sf):
    return r6(counting.role_dispersion(counting.position_credit(d.ordered(s, sf), counting.first_leads(d.ordered(s, sf)))), "phi_s")


@query(f"""WITH {B}, {ORD}, a AS (SELECT den.q AS as_of, o2.entity, CASE WHEN size = 1 THEN 2 WHEN size >= 3 AND pos = size - 1 AND NOT coalesce(first_lead_q <= den.q, false) THEN 0 ELSE 1 END AS c
 FROM den JOIN o2 ON o2.q <= den.q JOIN (SELECT q FROM den) v ON v.q = o2.q LEFT JOIN lead1 ON lead1.entity = o2.entity),
p AS (SELECT as_of, sum(c * c) / sum(c)::DOUBLE AS phi FROM a GROUP BY as_of)
SELECT entity, as_of, sum(c)::BIGINT AS credit, {_r('any_value(phi)', 'phi')} FROM a JOIN p USING (as_of) GROUP BY entity, as_of""")
def weighted_sweep(s, sf):
    return r6(counting.weighted_sweep(d.ordered(s, sf), d.denom(s, sf)), "phi")


WW = """
wa AS (SELECT as_of, any_value(total_recent) AS total_recent, any_value(total_base) AS total_base FROM aso WHERE k = 12 GROUP BY 1),
wc AS (SELECT wa.as_of, o2.entity, o2.q, CASE WHEN size = 1 THEN 2 WHEN size >= 3 AND pos = size - 1 AND NOT coalesce(first_lead_q <= wa.as_of, false) THEN 0 ELSE 1 END AS c
       FROM wa JOIN o2 ON o2.q <= wa.as_of JOIN (SELECT q FROM den) v ON v.q = o2.q LEFT JOIN lead1 ON lead1.entity = o2.entity),
wp AS (SELECT as_of, sum(c * c) / sum(c)::DOUBLE AS phi FROM wc GROUP BY 1),
ww AS (SELECT entity, as_of, coalesce(sum(c) FILTER (q > as_of - 4), 0)::BIGINT AS n_recent, coalesce(sum(c) FILTER (q <= as_of - 4), 0)::BIGINT AS n_baseline FROM wc WHERE q > as_of - 12 GROUP BY 1, 2)"""


@query(f"WITH {B}, {W}, {ORD}, {WW} SELECT entity, as_of, n_recent, n_baseline, total_recent, total_base, {_r('phi', 'phi')} FROM ww JOIN wa USING (as_of) JOIN wp USING (as_of)")
def weighted_windows(s, sf):
    return r6(counting.weighted_windows(d.ordered(s, sf), d.denom(s, sf)), "phi")


ONE_HOT = ["Brand#7", "Brand#12", "Brand#21", "Brand#1", "Brand#2", "Brand#3"]


@query(f"""WITH {BS} SELECT o_orderkey AS case_id, {", ".join(f"""coalesce(max((entity = '{e}')::INT), 0)::INT AS "{e}" """ for e in ONE_HOT)} FROM orders LEFT JOIN m ON case_id = o_orderkey GROUP BY 1""")
def one_hot(s, sf):
    return counting.one_hot(d.cases(s, sf).select("case_id"), d.mentions(s, sf, False), ONE_HOT)


# --- disproportionality -------------------------------------------------------------------------------
RANK = "entity, as_of, n_recent, n_baseline, " + ", ".join(_r(c, c) for c in ("expected", "expected_own", "ratio", "ratio_own"))


@query(f"WITH {B}, {W}, l AS (SELECT max(as_of) AS a FROM rat) SELECT {RANK}, row_number() OVER (ORDER BY round(ratio, 6) DESC NULLS LAST, entity)::INT AS rank FROM rat, l WHERE as_of = a")
def rank_ratio(s, sf):
    sweep = _ratio(s, sf)
    last = sweep.agg(F.max("as_of").alias("_a"))
    rows = sweep.join(F.broadcast(last), F.col("as_of") == F.col("_a")).drop("_a")  # one row
    rows = r6(rows, "expected", "expected_own", "ratio", "ratio_own").select("entity", "as_of", "n_recent", "n_baseline", "expected", "expected_own", "ratio", "ratio_own")
    return disp.ranked(rows, "ratio")


@query(f"WITH {B}, {W} SELECT {RANK} FROM rat")
def ratio_sweep(s, sf):
    return r6(_ratio(s, sf), "expected", "expected_own", "ratio", "ratio_own").select("entity", "as_of", "n_recent", "n_baseline", "expected", "expected_own", "ratio", "ratio_own")


@query(f"""WITH {B}, {W}, x AS (SELECT *, 2.0 + n_recent AS a FROM rat)
SELECT entity, as_of, {_r("exp(ln(a+8) - 1/(2*(a+8)) - 1/(12*pow(a+8,2)) + 1/(120*pow(a+8,4)) - 1/(252*pow(a+8,6)) - (1/a+1/(a+1)+1/(a+2)+1/(a+3)+1/(a+4)+1/(a+5)+1/(a+6)+1/(a+7)) - ln(4.0 + expected))", "ebgm")} FROM x""")
def fixed_prior_ebgm(s, sf):
    return r6(disp.fixed_prior_scores(_ratio(s, sf), 2.0, 4.0).select("entity", "as_of", "ebgm"), "ebgm")


@query()
def eb_sweep(s, sf):
    """Shrinkage scores with a prior fitted at each as-of quarter, on name-type-size entities."""
    e = "concat_ws('/', p_name, p_type, cast(p_size as string))"
    c, n = d.counts(s, sf, False, e), d.denom(s, sf)
    scores = disp.eb_scores(disp.ratio_sweep(c, n))
    cols = ["ebgm", "eb05", "eb95", "eb05_own", "alpha", "beta"]
    return r6(scores.select("entity", "as_of", "n_recent", *cols, "converged", "credible_rise"), *cols, places=4)


@query()
def eb_rank_with_veto(s, sf):
    """The latest quarter's shrinkage ranking, with the scan's veto."""
    c, n, nodes = _scanned(s, sf)
    scores = disp.eb_scores(disp.ratio_sweep(c, n))
    cells = treescan.scan_cells(c, n, nodes)
    last = int(n.agg(F.max("q")).first()[0])
    best = treescan.best_windows(cells).where((F.col("as_of") == last) & (F.col("level") == "substance"))
    ri = treescan.with_p_values(best, treescan.null_maxima(c, n, nodes, last), treescan.REPLICATES).select(F.col("node").alias("entity"), "as_of", "recurrence_interval")
    out = disp.veto(scores.where(F.col("as_of") == last), ri)
    return disp.ranked(r6(out.select("entity", "as_of", "n_recent", "ratio", "eb05", "eb05_own", "ri", "credible_rise", "vetoed"), "ratio", "eb05", "eb05_own", "ri", places=4), "eb05")


LOC = """
lp AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, 'Brand#' || label AS entity, (7994 + vec_id % 12)::INT AS q FROM embeddings),
lw AS (SELECT id, x, y, entity, q + ago AS as_of FROM lp, (SELECT unnest(range(0, 4))::INT AS ago) WHERE q + ago BETWEEN (SELECT min(q) + 3 FROM lp) AND (SELECT max(q) FROM lp)),
ln AS (SELECT as_of, count(*)::DOUBLE AS n, greatest(1, least(ceil(0.05 * count(*)), count(*) - 1)) AS k FROM lw GROUP BY 1),
lk AS (SELECT * FROM (SELECT a.as_of, a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.as_of, a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS r FROM lw a JOIN lw b ON a.as_of = b.as_of AND a.id <> b.id) JOIN ln USING (as_of) WHERE r <= k),
lg AS (SELECT as_of, a, b FROM lk UNION SELECT as_of, b, a FROM lk),
ld AS (SELECT as_of, sum(k)::DOUBLE AS a2, sum(k * (k - 1))::DOUBLE AS p2 FROM (SELECT as_of, a, count(*) AS k FROM lg GROUP BY 1, 2) GROUP BY 1),
ls AS (SELECT lg.as_of, u.entity, count(*) AS s FROM lg JOIN lw u ON u.id = a AND u.as_of = lg.as_of JOIN lw v ON v.id = b AND v.as_of = lg.as_of WHERE u.entity = v.entity GROUP BY 1, 2),
lc AS (SELECT as_of, entity, count(*)::DOUBLE AS c FROM lw GROUP BY 1, 2),
lf AS (SELECT as_of, entity, c, n, coalesce(s, 0)::DOUBLE AS s, a2, p2, c*(c-1)/(n*(n-1)) AS f2, c*(c-1)*(c-2)/(n*(n-1)*(n-2)) AS f3, c*(c-1)*(c-2)*(c-3)/(n*(n-1)*(n-2)*(n-3)) AS f4 FROM lc LEFT JOIN ls USING (as_of, entity) JOIN ld USING (as_of) JOIN ln USING (as_of)),
lm AS (SELECT *, a2 * f2 AS mean, greatest(0, 2*a2*f2 + 4*p2*f3 + (a2*a2 - 2*a2 - 4*p2)*f4 - pow(a2*f2, 2)) AS var, CASE WHEN c < 10 THEN 'n<10' WHEN c / n > 0.25 THEN 'case_fraction>0.25' END AS withheld FROM lf),
lz AS (SELECT *, CASE WHEN withheld IS NULL AND var > 0 THEN (s - mean) / sqrt(var) END AS z FROM lm),
lt AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM lz),
lu AS (SELECT *, exp(-z * z / 2) * 0.3989422804014327 * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) AS up FROM lt),
lx AS (SELECT *, CASE WHEN z IS NULL THEN 0 ELSE greatest(0, least(1, 2 * (CASE WHEN z >= 0 THEN 1 - up ELSE up END) - 1)) END AS weight FROM lu)"""


@query(f"WITH {LOC} SELECT entity, as_of, c::BIGINT AS n_cases, s AS statistic, {_r('mean', 'mean', 4)}, {_r('var', 'variance', 3)}, {_r('z', 'z', 4)}, {_r('weight', 'weight', 4)}, withheld FROM lx")
def concentration_sweep(s, sf):
    return r6(r6(r6(_located(s, sf), "mean", places=4), "variance", places=3), "z", "weight", places=4)


def _located(s, sf, only: int | None = None):
    p = d.points(s, sf)
    p = p.select("id", "x", "y", F.concat(F.lit("Brand#"), "label").alias("entity"), (F.lit(7994) + F.col("id") % 12).cast("int").alias("q"))
    return spatial.sweep_concentration(p, p.select("id", "entity"), only=only)


@query(f"""WITH {B}, {W}, {LOC}, j AS (SELECT gate.*, 1 - 0.25 * coalesce(weight, 0) AS less FROM gate LEFT JOIN lx USING (entity, as_of) WHERE n_recent > 0)
SELECT entity, as_of, n_recent, n_baseline, {_r('expected * less', 'expected', 4)}, {_r('expected_own * less', 'expected_own', 4)}, {_r('n_recent / nullif(expected * less, 0)', 'ratio', 4)}, {_r('n_recent / nullif(expected_own * less, 0)', 'ratio_own', 4)} FROM j""")
def discounted_sweep(s, sf):
    """The ratio sweep whose expectations are lowered where an entity's recent cases lie close together."""
    con = _located(s, sf).select("entity", "as_of", "weight")
    w = windows.trailing_windows(d.counts(s, sf), d.denom(s, sf)).where("n_recent > 0").join(con, ["entity", "as_of"], "left")
    out = disp.gate_columns(w, concentration=F.col("weight"))
    return r6(out.select("entity", "as_of", "n_recent", "n_baseline", "expected", "expected_own", "ratio", "ratio_own"), "expected", "expected_own", "ratio", "ratio_own", places=4)


@query(f"""WITH {B}, {W}, {ORD}, {LOC}, x AS (SELECT max(as_of) AS a FROM aso WHERE k = 12),
sn AS (SELECT entity, sum(n)::BIGINT AS n_total, min(q) AS first_seen, max(q) AS last_seen FROM cnt, x WHERE q <= a GROUP BY 1),
ps AS (SELECT entity, greatest(1.0, 1 / greatest(avg(credit), 0.05)) AS phi_s FROM cred, x WHERE q <= a GROUP BY entity HAVING count(*) >= 10),
j AS (SELECT gate.*, coalesce(z, 0) AS z_spatial, coalesce(weight, 0) AS concentration, 1 - 0.25 * coalesce(weight, 0) AS less FROM gate JOIN x ON as_of = a LEFT JOIN lx USING (entity, as_of))
SELECT entity, as_of, n_recent, n_baseline, {_r('z_spatial', 'z_spatial', 4)}, {_r('concentration', 'concentration', 4)}, {_r('expected * less', 'expected', 4)}, {_r('expected_own * less', 'expected_own', 4)},
 {_r('n_recent / nullif(expected * less, 0)', 'ratio', 4)}, {_r('n_recent / nullif(expected_own * less, 0)', 'ratio_own', 4)}, {_r('n_recent / nullif(expected_own, 0)', 'count_ratio', 4)},
 {_r('100.0 * n_recent / total_recent', 'share_recent_pct', 4)}, {_r('100.0 * n_baseline / total_base', 'share_base_pct', 4)}, n_total, first_seen, last_seen, coalesce(first_seen > as_of - 4, false) AS novel, {_r('coalesce(phi_s, 1.0)', 'phi_s', 4)}
FROM j LEFT JOIN sn USING (entity) LEFT JOIN ps USING (entity)""")
def ranking_table(s, sf):
    """The latest ranking's table: windows, shares, novelty, dispersion and concentration of each entity."""
    out = _ranking(s, sf)
    real = ["z_spatial", "concentration", "expected", "expected_own", "ratio", "ratio_own", "count_ratio", "share_recent_pct", "share_base_pct", "phi_s"]
    return r6(out.select("entity", "as_of", "n_recent", "n_baseline", *real, "n_total", "first_seen", "last_seen", "novel"), *real, places=4)


def _ranking(s, sf):
    o = d.ordered(s, sf)
    w = windows.trailing_windows(d.counts(s, sf), d.denom(s, sf))
    last = int(windows.as_of_quarters(d.denom(s, sf)).agg(F.max("as_of")).first()[0])
    return disp.rank_entities(w, d.counts(s, sf), last, counting.position_credit(o, counting.first_leads(o)), _located(s, sf, last))


@query()
def ranking_scores(s, sf):
    """The same ranking with shrinkage scores: counts divided by the roles' dispersion, the prior's rate
    following the spatial score."""
    out = disp.eb_scores(_ranking(s, sf))
    return disp.ranked(r6(out.select("entity", "as_of", "n_recent", "phi_s", "z_spatial", "ebgm", "eb05", "eb95", "eb05_own", "credible_rise"), "phi_s", "z_spatial", "ebgm", "eb05", "eb95", "eb05_own", places=4), "eb05")


@query()
def weighted_eb_sweep(s, sf):
    """Shrinkage scores of the weighted sweep, with the dispersion as of each quarter."""
    w = disp.gate_columns(counting.weighted_windows(d.ordered(s, sf), d.denom(s, sf))).where("n_recent > 0")
    return r6(disp.eb_scores(w).select("entity", "as_of", "n_recent", "n_baseline", "phi", "ebgm", "eb05", "eb95", "eb05_own", "credible_rise"), "phi", "ebgm", "eb05", "eb95", "eb05_own", places=4)


# --- aberration -------------------------------------------------------------------------------------
@query(f"WITH {B}, {W}, {EARS} SELECT entity, as_of, n_recent, n_baseline, {_r('ears_z', 'ears_z')} FROM ears")
def ears_sweep(s, sf):
    return r6(_ears(s, sf), "ears_z")


NEWTON = """
pts AS (SELECT entity, as_of, (q - avg(q) OVER w) / stddev_pop(q) OVER w AS t, stddev_pop(q) OVER w AS sd, n::DOUBLE AS y, {o}::DOUBLE AS o FROM dn JOIN aso ON dn.q BETWEEN as_of - 11 AND as_of WHERE k = 12 WINDOW w AS (PARTITION BY entity, as_of)),
arr AS (SELECT entity, as_of, any_value(sd) AS sd, list(t ORDER BY t) AS ts, list(y ORDER BY t) AS ys, list(o ORDER BY t) AS os, sum(y) AS sy, sum(o) AS so FROM pts GROUP BY 1, 2 HAVING sum(y) > 0),
it(entity, as_of, i, a, b) AS (
  SELECT entity, as_of, 0, ln(sy / so), 0.0::DOUBLE FROM arr
  UNION ALL
  SELECT entity, as_of, i + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT it.entity, it.as_of, i, a, b,
      list_sum(list_transform(range(1, 13), lambda j: ys[j] - os[j] * exp(least(30.0, greatest(-30.0, a + b * ts[j]))))) AS g0,
      list_sum(list_transform(range(1, 13), lambda j: (ys[j] - os[j] * exp(least(30.0, greatest(-30.0, a + b * ts[j])))) * ts[j])) AS g1,
      list_sum(list_transform(range(1, 13), lambda j: os[j] * exp(least(30.0, greatest(-30.0, a + b * ts[j]))))) + 1e-9 AS h00,
      list_sum(list_transform(range(1, 13), lambda j: os[j] * exp(least(30.0, greatest(-30.0, a + b * ts[j]))) * ts[j])) AS h01,
      list_sum(list_transform(range(1, 13), lambda j: os[j] * exp(least(30.0, greatest(-30.0, a + b * ts[j]))) * ts[j] * ts[j])) + 1e-9 AS h11
    FROM it JOIN arr USING (entity, as_of) WHERE i < 25)),
fit AS (SELECT entity, as_of, b / sd AS slope, b / (sqrt(h00 / (h00 * h11 - h01 * h01)) * sqrt(greatest(pear / 10, 1.0))) AS z FROM (
    SELECT it.entity, it.as_of, b, sd,
      list_sum(list_transform(range(1, 13), lambda j: os[j] * exp(least(30.0, greatest(-30.0, a + b * ts[j]))))) + 1e-9 AS h00,
      list_sum(list_transform(range(1, 13), lambda j: os[j] * exp(least(30.0, greatest(-30.0, a + b * ts[j]))) * ts[j])) AS h01,
      list_sum(list_transform(range(1, 13), lambda j: os[j] * exp(least(30.0, greatest(-30.0, a + b * ts[j]))) * ts[j] * ts[j])) + 1e-9 AS h11,
      list_sum(list_transform(range(1, 13), lambda j: pow(ys[j] - os[j] * exp(least(30.0, greatest(-30.0, a + b * ts[j]))), 2) / greatest(os[j] * exp(least(30.0, greatest(-30.0, a + b * ts[j]))), 1e-12))) AS pear
    FROM it JOIN arr USING (entity, as_of) WHERE i = 25))"""


@query(f"WITH RECURSIVE {B}, {W}, {NEWTON.format(o='n_total')} SELECT entity, as_of, n_recent, n_baseline, {_r('slope', 'slope', 4)}, {_r('z', 'z', 4)} FROM fit JOIN win USING (entity, as_of) WHERE n_recent > 0")
def trend_sweep_share(s, sf):
    return r6(aberration.trend_sweep(d.counts(s, sf), d.denom(s, sf)).select("entity", "as_of", "n_recent", "n_baseline", "slope", "z"), "slope", "z", places=4)


@query(f"WITH RECURSIVE {B}, {W}, {NEWTON.format(o='1')} SELECT entity, as_of, {_r('slope', 'own_slope', 4)}, {_r('z', 'own_z', 4)} FROM fit JOIN win USING (entity, as_of) WHERE n_recent > 0")
def trend_sweep_own(s, sf):
    return r6(aberration.trend_sweep(d.counts(s, sf), d.denom(s, sf)).select("entity", "as_of", "own_slope", "own_z"), "own_slope", "own_z", places=4)


@query(f"""WITH {B}, {W}, {HOT}, f AS (SELECT entity, as_of, row_number() OVER (PARTITION BY entity, island ORDER BY as_of) >= 3 AS c FROM hot)
SELECT rat.entity, rat.as_of, coalesce(c, false) AS confirmed FROM rat LEFT JOIN f USING (entity, as_of)""")
def confirmed_flags(s, sf):
    return aberration.confirmed_flags(_ratio(s, sf), "ratio", 1.5).select("entity", "as_of", "confirmed")


@query(f"""WITH {B}, {W}, {HOT}, f AS (SELECT entity, as_of, first_value(n_baseline) OVER (PARTITION BY entity, island ORDER BY as_of) / 8.0 < 2 AS c FROM hot)
SELECT rat.entity, rat.as_of, coalesce(c, false) AS emergent FROM rat LEFT JOIN f USING (entity, as_of)""")
def emergent_flags(s, sf):
    return aberration.emergent_flags(_ratio(s, sf), "ratio", 1.5).select("entity", "as_of", "emergent")


@query(f"""WITH {B}, {W}, {EARS}, x AS (SELECT max(as_of) AS a FROM aso WHERE k = 12)
SELECT coalesce(r.entity, e.entity) AS entity, {_r('ratio', 'ratio')}, {_r('ears_z', 'ears_z')}, coalesce(ratio > 1.5, false) OR coalesce(ears_z > 3, false) AS alarm
FROM (SELECT * FROM rat, x WHERE as_of = a) r FULL JOIN (SELECT * FROM ears, x WHERE as_of = a) e ON r.entity = e.entity""")
def aberration_rank(s, sf):
    last = F.broadcast(windows.as_of_quarters(d.denom(s, sf)).agg(F.max("as_of").alias("_a")))  # one row
    a = _ratio(s, sf).join(last, F.col("as_of") == F.col("_a")).select("entity", "ratio")
    b = _ears(s, sf).join(last, F.col("as_of") == F.col("_a")).select("entity", "ears_z")
    out = a.join(b, "entity", "full")
    alarm = F.coalesce(F.col("ratio") > 1.5, F.lit(False)) | F.coalesce(F.col("ears_z") > 3, F.lit(False))
    return r6(out.withColumn("alarm", alarm), "ratio", "ears_z")


@query()
def dispersion_verdicts(s, sf):
    out = aberration.dispersion_verdict(d.counts(s, sf), d.denom(s, sf))
    return r6(out, "d_flat", "d_trend", "absorbed", "root_d", "p_trend", places=4)


# --- alarms -----------------------------------------------------------------------------------------
@query(f"WITH {B}, {W}, {HOT} SELECT entity, first_q, last_q, quarters, {_r('peak', 'peak')} FROM epi")
def episodes(s, sf):
    return r6(alarms.episodes(_ratio(s, sf), "ratio", 1.5), "peak")


@query(f"""WITH {B}, {W}, {HOT}, e AS (SELECT entity, min(first_q) AS first_breach, max(last_q) AS last_breach, sum(quarters)::BIGINT AS n_quarters, count(*)::BIGINT AS n_episodes, max(quarters) AS longest, max(first_q) AS latest_onset FROM epi GROUP BY entity),
p AS (SELECT entity, max(ratio) AS peak, min(as_of) FILTER (ratio = mx) AS peak_q FROM (SELECT *, max(ratio) OVER (PARTITION BY entity) AS mx FROM rat) GROUP BY entity),
f AS (SELECT entity, min(q) AS fs FROM cnt GROUP BY entity)
SELECT e.entity, first_breach, last_breach, CASE WHEN fs > (SELECT min(q) FROM cnt) THEN first_breach - fs END AS lag_q, n_quarters, n_episodes, longest, {_r('p.peak', 'peak')}, peak_q,
 last_breach = (SELECT max(as_of) FROM rat) AS still_open, latest_onset, {_r('rat.n_baseline / 8.0', 'onset_baseline')}, rat.n_baseline / 8.0 < 2 AS emergent
FROM e JOIN p USING (entity) JOIN f USING (entity) LEFT JOIN rat ON rat.entity = e.entity AND rat.as_of = latest_onset""")
def alarm_history(s, sf):
    return r6(alarms.alarm_history(_ratio(s, sf), d.counts(s, sf), "ratio", 1.5), "peak", "onset_baseline")


WATCH = [("first", "^Brand#1$"), ("twenties", "^Brand#2[0-9]$"), ("planted", "^Brand#(7|12|21)$"), ("absent", "^Brand#99$")]


@query(f"""WITH {B}, {W}, w(label, pattern) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in WATCH)}),
e AS (SELECT entity, sum(n) AS n, min(q) AS f, max(q) AS l FROM cnt GROUP BY entity), s AS (SELECT entity, max(ratio) AS best FROM rat GROUP BY entity)
SELECT label, count(e.entity)::BIGINT AS members, coalesce(sum(n), 0)::BIGINT AS total, min(f) AS first_q, max(l) AS last_q, {_r('max(best)', 'best')}, coalesce(max(best) > 1.5, false) AS has_fired
FROM w LEFT JOIN (e LEFT JOIN s USING (entity)) ON regexp_matches(e.entity, pattern) GROUP BY label""")
def watch_list(s, sf):
    names = s.createDataFrame(WATCH, "label string, pattern string")
    return r6(alarms.watch_list(names, d.counts(s, sf), _ratio(s, sf), "ratio", 1.5), "best")


@query(f"""WITH {B}, {W}, {HOT}, c AS (SELECT q, sum(n) AS mentions, count(*) AS entities FROM cnt GROUP BY q), o AS (SELECT first_q AS q, count(*) AS onsets FROM epi GROUP BY 1)
SELECT den.q, n_total, {_r('100.0 * (n_total - lag(n_total, 4) OVER (ORDER BY den.q)) / lag(n_total, 4) OVER (ORDER BY den.q)', 'yoy_pct')}, {_r('coalesce(mentions, 0) / n_total::DOUBLE', 'per_case')}, coalesce(entities, 0)::BIGINT AS entities, coalesce(onsets, 0)::BIGINT AS onsets, coalesce(onsets, 0) >= 3 AS clustered
FROM den LEFT JOIN c USING (q) LEFT JOIN o USING (q)""")
def regime(s, sf):
    return r6(alarms.regime(d.mentions(s, sf), d.counts(s, sf), d.denom(s, sf), _ratio(s, sf), "ratio", 1.5), "yoy_pct", "per_case")


# --- hierarchy and scan -----------------------------------------------------------------------------
FAMILIES = [("teens", "^Brand#1[0-9]$"), ("twenties", "^Brand#2[0-9]$"), ("sevens", "7$")]
SUPER = [("STANDARD", "Plain"), ("SMALL", "Plain"), ("PROMO", "Offer"), ("ECONOMY", "Offer")]


def _nodes(s, sf):
    cats = hierarchy.modal_category(d.raw_mentions(s, sf, False).select("entity", "category"))
    return hierarchy.build_nodes(cats, s.createDataFrame(FAMILIES, "family string, pattern string"), s.createDataFrame(SUPER, "category string, superclass string"))


_vals = lambda rows: ", ".join(str(r) for r in rows)
NODES = f"""
mc AS (SELECT entity, category FROM (SELECT p_brand AS entity, p_type AS category, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r
       FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) WHERE r = 1),
n0 AS (SELECT 'All' AS node, 'root' AS level, entity AS leaf FROM mc UNION
       SELECT coalesce(s, 'Other'), 'superclass', entity FROM mc LEFT JOIN (VALUES {_vals(SUPER)}) v(c, s) ON c = category UNION
       SELECT category, 'category', entity FROM mc UNION
       SELECT f, 'family', entity FROM mc JOIN (VALUES {_vals(FAMILIES)}) v(f, p) ON regexp_matches(entity, p) UNION
       SELECT entity, 'substance', entity FROM mc),
n1 AS (SELECT node, level, list(leaf ORDER BY leaf) AS leaves FROM n0 GROUP BY 1, 2),
nodes AS (SELECT node, level, unnest(leaves) AS leaf FROM (SELECT *, row_number() OVER (PARTITION BY leaves ORDER BY list_position(['substance','family','category','superclass','root'], level), node) AS r FROM n1) WHERE r = 1)"""
CELLS = """
ncnt AS (SELECT node, level, q, sum(n)::BIGINT AS n FROM cnt JOIN nodes ON leaf = entity GROUP BY 1, 2, 3),
cell0 AS (SELECT node, level, as_of, w.w AS window_q, sum(n)::BIGINT AS n_study, coalesce(sum(n) FILTER (ncnt.q > as_of - w.w), 0)::BIGINT AS observed
          FROM ncnt JOIN aso ON ncnt.q BETWEEN as_of - 11 AND as_of CROSS JOIN (SELECT unnest([1,2,3,4,5,6]) AS w) w WHERE k = 12 GROUP BY 1, 2, 3, 4),
cell1 AS (SELECT c.*, n_study * ((SELECT sum(n_total) FROM den WHERE q BETWEEN as_of - window_q + 1 AND as_of) / (SELECT sum(n_total) FROM den WHERE q BETWEEN as_of - 11 AND as_of)::DOUBLE) AS expected FROM cell0 c),
cells AS (SELECT *, CASE WHEN observed > expected AND expected > 1e-9 THEN observed * ln(observed / expected) + CASE WHEN n_study > observed THEN (n_study - observed) * ln((n_study - observed) / (n_study - expected)) ELSE 0 END ELSE 0 END AS llr FROM cell1),
best AS (SELECT * FROM (SELECT node, level, as_of, window_q, n_study, observed, expected, CASE WHEN observed < 3 THEN 0 ELSE llr END AS llr,
         row_number() OVER (PARTITION BY node, level, as_of ORDER BY round(CASE WHEN observed < 3 THEN 0 ELSE llr END, 9) DESC, window_q) AS r FROM cells) WHERE r = 1)"""


@query(f"WITH {NODES} SELECT entity, category FROM mc")
def modal_categories(s, sf):
    return hierarchy.modal_category(d.raw_mentions(s, sf, False).select("entity", "category"))


@query(f"WITH {NODES} SELECT node, level, leaf FROM nodes")
def hierarchy_nodes(s, sf):
    return _nodes(s, sf)


EDGES = """
sz AS (SELECT node, count(*) AS k FROM nodes GROUP BY node),
ov AS (SELECT a.node AS child, b.node AS parent FROM nodes a JOIN nodes b USING (leaf) JOIN sz x ON x.node = a.node JOIN sz y ON y.node = b.node WHERE y.k > x.k GROUP BY a.node, b.node, x.k HAVING count(*) = x.k),
ed AS (SELECT child, parent FROM ov ANTI JOIN (SELECT x.child, y.parent FROM ov x JOIN ov y ON x.parent = y.child) USING (child, parent))"""


@query(f"WITH {NODES}, {EDGES} SELECT child, parent FROM ed")
def hierarchy_edges(s, sf):
    return hierarchy.edges(_nodes(s, sf))


@query(f"WITH {B}, {W}, {NODES}, {CELLS} SELECT node, level, as_of, window_q, n_study, observed, {_r('expected', 'expected')}, {_r('llr', 'llr')} FROM cells")
def scan_cells(s, sf):
    return r6(treescan.scan_cells(d.counts(s, sf), d.denom(s, sf), _nodes(s, sf)), "expected", "llr").select("node", "level", "as_of", "window_q", "n_study", "observed", "expected", "llr")


@query(f"WITH {B}, {W}, {NODES}, {CELLS} SELECT node, level, as_of, CASE WHEN llr > 0 THEN window_q END::INT AS window_q, {_r('llr', 'llr')}, {_r('CASE WHEN llr > 0 THEN observed / expected END', 'obs_exp')} FROM best")
def scan_best(s, sf):
    return r6(treescan.best_windows(treescan.scan_cells(d.counts(s, sf), d.denom(s, sf), _nodes(s, sf))), "llr", "obs_exp").select("node", "level", "as_of", "window_q", "llr", "obs_exp")


@query(f"""WITH {B}, {W}, {NODES}, {CELLS}, sz AS (SELECT node, count(*) AS k FROM nodes GROUP BY node),
x AS (SELECT b.node, b.as_of, l.node AS entity, b.llr AS score, k, CASE WHEN b.observed > b.expected THEN (l.observed - l.expected) / (b.observed - b.expected) END AS share
      FROM best b JOIN nodes m ON m.node = b.node JOIN cells l ON l.level = 'substance' AND l.node = m.leaf AND l.as_of = b.as_of AND l.window_q = b.window_q JOIN sz ON sz.node = b.node WHERE b.llr > 0 AND l.observed > 0),
y AS (SELECT *, row_number() OVER (PARTITION BY entity, as_of ORDER BY score DESC, k, node) AS r FROM x WHERE share >= 0.15)
SELECT entity, as_of, {_r('score', 'score')}, node, {_r('share', 'excess_share')} FROM y WHERE r = 1""")
def branch_sweep(s, sf):
    nodes = _nodes(s, sf)
    cells = treescan.scan_cells(d.counts(s, sf), d.denom(s, sf), nodes)
    return r6(treescan.branch_sweep(treescan.best_windows(cells), cells, nodes), "score", "excess_share")


@query()
def scan_p_values(s, sf):
    """The latest scan with Monte Carlo p-values and recurrence intervals."""
    c, n, nodes = _scanned(s, sf)
    last = int(n.agg(F.max("q")).first()[0])
    best = treescan.best_windows(treescan.scan_cells(c, n, nodes)).where(F.col("as_of") == last)
    return r6(treescan.with_p_values(best, treescan.null_maxima(c, n, nodes, last), treescan.REPLICATES), "expected", "llr", "obs_exp", "p_value", "recurrence_interval")


def _scanned(s, sf):
    """Counts, denominators and nodes, each computed once."""
    return stored(d.counts(s, sf), "counts"), stored(d.denom(s, sf), "denom"), stored(_nodes(s, sf), "nodes")


@query()
def scan_backtest(s, sf):
    """The scan of every as-of quarter with that quarter's own null: p-values and recurrence intervals of all nodes."""
    return r6(treescan.backtest(*_scanned(s, sf)), "expected", "llr", "obs_exp", "p_value", "recurrence_interval")


@query()
def scan_branch_intervals(s, sf):
    """Each leaf's best recurrence interval among the branches over it that it drives, and its own."""
    c, n, nodes = _scanned(s, sf)
    scan = stored(treescan.backtest(c, n, nodes), "backtest")
    return r6(treescan.branch_sweep(scan, treescan.scan_cells(c, n, nodes), nodes, score="recurrence_interval", whole_leaves=True), "score", "excess_share")


@query()
def scan_head_to_head(s, sf):
    """First signals and lags of the scan and of the shrinkage score on the planted risers and the calm brands."""
    c, n, nodes = _scanned(s, sf)
    eb = disp.eb_scores(disp.ratio_sweep(c, n)).select("entity", "as_of", "eb05")
    targets = s.createDataFrame([(x[0],) for x in [*TRUTH, *CALM]], "entity string")
    out = treescan.head_to_head(stored(treescan.backtest(c, n, nodes), "backtest"), treescan.scan_cells(c, n, nodes), stored(eb, "eb"), c, nodes, targets)
    return r6(out, "branch_excess_share", "peak_llr", "best_ri")


@query(f"""WITH {B}, {W}, {NODES}, mt AS (SELECT den.q, coalesce(sum(n), 0)::BIGINT AS n_total FROM den LEFT JOIN cnt USING (q) GROUP BY 1),
rs AS (SELECT as_of, w AS window_q, (SELECT sum(n_total) FROM mt WHERE q BETWEEN as_of - w + 1 AND as_of) / (SELECT sum(n_total) FROM mt WHERE q BETWEEN as_of - 11 AND as_of)::DOUBLE AS share FROM aso, (SELECT unnest(range(1, 7)) AS w) WHERE k = 12)
SELECT as_of, window_q::INT AS window_q, {_r('share', 'share')} FROM rs""")
def mention_shares(s, sf):
    """The shares of the frame by mentions, the scan's other reference series."""
    ref = treescan.mention_totals(d.counts(s, sf), d.denom(s, sf))
    shares = treescan.window_shares(ref).select("as_of", F.posexplode("shares").alias("i", "share"))
    return r6(shares.select("as_of", (F.col("i") + 1).alias("window_q"), "share"), "share")


# --- co-occurrence ----------------------------------------------------------------------------------
@query(f"WITH {BS} SELECT a.entity, b.entity AS partner, count(*)::BIGINT AS n_both FROM m a JOIN m b USING (case_id) WHERE a.entity <> b.entity GROUP BY 1, 2")
def pair_counts(s, sf):
    return cooccurrence.pair_counts(d.mentions(s, sf, False))


@query(f"""WITH {BS}, {ORD}, k AS (SELECT case_id, count(*) AS k, max((entity = 'Brand#7')::INT) AS mk FROM m GROUP BY 1),
b AS (SELECT entity, count(*)::BIGINT AS n, 100.0 * avg((k = 1)::INT) AS alone_pct, 100.0 * avg(mk) AS with_marker_pct FROM m JOIN k USING (case_id) GROUP BY 1),
p AS (SELECT entity, 100.0 * avg((pos = 0)::INT) AS lead_pct, 100.0 * avg((pos = size - 1)::INT) AS last_pct, avg(pos / (size - 1)::DOUBLE) AS mean_rank, count(*)::BIGINT AS n_ranked FROM o2 WHERE size >= 2 GROUP BY 1)
SELECT entity, n, {_r('alone_pct', 'alone_pct')}, {_r('with_marker_pct', 'with_marker_pct')}, {_r('lead_pct', 'lead_pct')}, {_r('last_pct', 'last_pct')}, {_r('mean_rank', 'mean_rank')}, n_ranked,
CASE WHEN lead_pct >= 40 THEN 'principal driver' WHEN alone_pct >= 15 THEN 'independent' WHEN alone_pct < 5 AND mean_rank >= 0.6 AND with_marker_pct >= 70 THEN 'adulterant/marker' WHEN alone_pct < 5 AND mean_rank >= 0.6 THEN 'secondary/incidental' ELSE 'co-intoxicant' END AS verdict
FROM b LEFT JOIN p USING (entity) WHERE n >= 4""")
def cooccurrence_profile(s, sf):
    out = cooccurrence.profile(d.mentions(s, sf, False), d.ordered(s, sf), "Brand#7").drop("partners")
    return r6(out, "alone_pct", "with_marker_pct", "lead_pct", "last_pct", "mean_rank")


DYADS = [("seven", "^Brand#7$", "twelve", "^Brand#12$"), ("teens", "^Brand#1[0-9]$", "twenties", "^Brand#2[0-9]$"), ("one", "^Brand#1$", "none", "^Brand#99$")]


@query(f"""WITH {BS}, c(label_a, pa, label_b, pb) AS (VALUES {_vals(DYADS)}), t AS (SELECT count(DISTINCT case_id) AS cases FROM m),
x AS (SELECT label_a, label_b, case_id, max(regexp_matches(entity, pa)::INT) AS a, max(regexp_matches(entity, pb)::INT) AS b FROM m, c WHERE regexp_matches(entity, pa) OR regexp_matches(entity, pb) GROUP BY 1, 2, 3),
g AS (SELECT label_a, label_b, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * b)::BIGINT AS n_both, any_value(cases) AS cases FROM x, t GROUP BY 1, 2)
SELECT label_a, label_b, n_a, n_b, n_both, {_r('n_a * n_b / cases::DOUBLE', 'expected')}, {_r('n_both / nullif(n_a * n_b / cases::DOUBLE, 0)', 'lift')}, {_r('100.0 * n_both / nullif(n_a, 0)', 'pct_of_a')}, {_r('100.0 * n_both / nullif(n_b, 0)', 'pct_of_b')} FROM g""")
def dyads(s, sf):
    c = s.createDataFrame(DYADS, "label_a string, pattern_a string, label_b string, pattern_b string")
    return r6(cooccurrence.dyads(d.mentions(s, sf, False), c), "expected", "lift", "pct_of_a", "pct_of_b")


@query(f"""WITH {BS}, c(label_a, pa, label_b, pb) AS (VALUES {_vals(DYADS)}), lq AS (SELECT DISTINCT quarter FROM m ORDER BY quarter DESC LIMIT 4),
mm AS (SELECT m.*, 'all' AS era FROM m UNION ALL SELECT m.*, 'now' FROM m WHERE quarter IN (FROM lq)), t AS (SELECT era, count(DISTINCT case_id) AS cases FROM mm GROUP BY 1),
x AS (SELECT era, label_a, label_b, case_id, max(regexp_matches(entity, pa)::INT) AS a, max(regexp_matches(entity, pb)::INT) AS b FROM mm, c WHERE regexp_matches(entity, pa) OR regexp_matches(entity, pb) GROUP BY 1, 2, 3, 4),
g AS (SELECT era, label_a, label_b, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * b)::BIGINT AS n_both, any_value(cases) AS cases FROM x JOIN t USING (era) GROUP BY 1, 2, 3)
SELECT f.label_a, f.label_b, f.n_a, f.n_b, f.n_both, {_r('f.n_both / nullif(f.n_a * f.n_b / f.cases::DOUBLE, 0)', 'lift')}, coalesce(r.n_both, 0)::BIGINT AS recent_n_both, {_r('r.n_both / nullif(r.n_a * r.n_b / r.cases::DOUBLE, 0)', 'recent_lift')}
FROM g f LEFT JOIN g r ON r.era = 'now' AND r.label_a = f.label_a AND r.label_b = f.label_b WHERE f.era = 'all'""")
def dyads_recent(s, sf):
    c = s.createDataFrame(DYADS, "label_a string, pattern_a string, label_b string, pattern_b string")
    return r6(cooccurrence.dyads_recent(d.mentions(s, sf, False), c).select("label_a", "label_b", "n_a", "n_b", "n_both", "lift", "recent_n_both", "recent_lift"), "lift", "recent_lift")


# --- evaluation -------------------------------------------------------------------------------------
#: The planted risers' true intervals, and brands that are labelled not to rise.
TRUTH = [("Brand#7", "1999Q1", "1999Q4", False), ("Brand#12", "2000Q1", None, True), ("Brand#21", "1998Q2", "1999Q1", False)]
CALM = [("Brand#1",), ("Brand#2",), ("Brand#3",)]
_q = lambda x: "NULL" if x is None else f"'{x}'"
TRUTHS = f"""
gt(entity, a, b, ongoing) AS (VALUES {", ".join(f"('{e}', '{a}', {_q(b)}, {str(o).lower()})" for e, a, b, o in TRUTH)}),
iv AS (SELECT entity, (a[1:4]::INT * 4 + a[6:6]::INT - 1)::INT AS start_q, CASE WHEN ongoing THEN (SELECT max(q) FROM den) ELSE b[1:4]::INT * 4 + b[6:6]::INT - 1 END::INT AS end_q FROM gt),
lab AS (SELECT entity FROM gt UNION SELECT unnest(['Brand#1', 'Brand#2', 'Brand#3'])),
tq AS (SELECT DISTINCT entity, unnest(range(start_q, end_q + 1)) AS q FROM iv),
dq AS (SELECT entity, as_of AS q FROM rat WHERE ratio > 1.5),
ovl AS (SELECT coalesce(tq.entity, dq.entity) AS entity, count(tq.q)::BIGINT AS gt, count(dq.q)::BIGINT AS det, count(*) FILTER (tq.q IS NOT NULL AND dq.q IS NOT NULL)::BIGINT AS overlap
        FROM tq FULL JOIN (SELECT * FROM dq WHERE entity IN (FROM lab)) dq ON tq.entity = dq.entity AND tq.q = dq.q GROUP BY 1)"""


def _intervals(s, sf):
    t = s.createDataFrame(TRUTH, "entity string, interval_start string, interval_end string, ongoing boolean")
    return evaluation.resolve_intervals(t, int(d.denom(s, sf).agg(F.max("q")).first()[0]))


@query(f"""WITH {B}, {W}, {TRUTHS}, lg AS (SELECT entity, min(q - start_q)::INT AS lag_q FROM dq JOIN iv USING (entity) WHERE q BETWEEN start_q AND end_q GROUP BY 1)
SELECT lab.entity, coalesce(gt, 0)::BIGINT AS gt, coalesce(det, 0)::BIGINT AS det, coalesce(overlap, 0)::BIGINT AS overlap, {_r('overlap / nullif(gt + det - overlap, 0)', 'iou')}, {_r('overlap / nullif(gt, 0)', 'recall')}, {_r('overlap / nullif(det, 0)', 'precision')}, lag_q, (coalesce(overlap, 0) > 0)::INT AS detected
FROM lab LEFT JOIN ovl USING (entity) LEFT JOIN lg USING (entity)""")
def score_model(s, sf):
    calm = s.createDataFrame(CALM, "entity string")
    return r6(evaluation.score_model(_ratio(s, sf), "ratio", 1.5, _intervals(s, sf), calm), "iou", "recall", "precision")


@query(f"""WITH {B}, {W}, {TRUTHS}, x AS (SELECT count(*)::BIGINT AS n, coalesce(sum((overlap > 0)::INT), 0)::BIGINT AS k FROM ovl WHERE det > 0)
SELECT n, k, {_r('k / nullif(n, 0)', 'rate')}, {_r('CASE WHEN n > 0 THEN greatest(0.0, (k/n + 3.8416/(2*n)) / (1 + 3.8416/n) - 1.96 * sqrt(k/n * (1 - k/n) / n + 3.8416/(4*n*n)) / (1 + 3.8416/n)) ELSE 0.0 END', 'low')}, {_r('CASE WHEN n > 0 THEN least(1.0, (k/n + 3.8416/(2*n)) / (1 + 3.8416/n) + 1.96 * sqrt(k/n * (1 - k/n) / n + 3.8416/(4*n*n)) / (1 + 3.8416/n)) ELSE 1.0 END', 'high')} FROM x""")
def precision_rate(s, sf):
    over = evaluation.score_model(_ratio(s, sf), "ratio", 1.5, _intervals(s, sf), s.createDataFrame(CALM, "entity string"))
    return r6(evaluation.precision_rate(over), "rate", "low", "high")


@query(f"WITH {B}, {W}, {TRUTHS} SELECT entity, count(*)::BIGINT AS quarters FROM rat WHERE ratio > 1.05 AND entity NOT IN (FROM gt SELECT entity) GROUP BY entity")
def off_target(s, sf):
    return evaluation.off_target(_ratio(s, sf), "ratio", 1.05, _intervals(s, sf))


#: The detectors that are compared, at lines that the planted brands cross.
MODELS = [
    evaluation.Model("ratio", "ratio", "ratio", 1.5),
    evaluation.Model("ratio-dual", "ratio", "ratio", 1.2, gate="dual"),
    evaluation.Model("ratio-confirmed", "ratio", "ratio", 1.5, gate="confirmed"),
    evaluation.Model("ratio-emergent", "ratio", "ratio", 1.5, gate="emergent"),
    evaluation.Model("ears", "ears", "ears_z", 3.0),
    evaluation.Model("mean(ratio,ears)", "ensemble", "score", 0.95, "mean", ("ratio", "ears")),
    evaluation.Model("threshold(ratio,ears)", "ensemble", "score", 1.0, "threshold", ("ratio", "ears")),
    evaluation.Model("veto(ratio,ears)", "ensemble", "score", 1.5, "veto", ("ratio", "ears")),
]


def _benchmark(s, sf):
    sweep = _ratio(s, sf)
    sweep = aberration.emergent_flags(aberration.confirmed_flags(sweep, "ratio", 1.5), "ratio", 1.5)
    sweeps = {("ratio", False, ()): stored(sweep, "sweep"), ("ears", False, ()): stored(_ears(s, sf), "sweep")}
    return evaluation.build_scores(MODELS, sweeps, {m.name: m for m in MODELS})


BENCH = """
br AS (SELECT *, CASE WHEN expected > 0 THEN n_recent / expected END AS rr FROM rat),
bh AS (SELECT *, as_of - row_number() OVER (PARTITION BY entity ORDER BY as_of) AS island FROM br WHERE rr > 1.5),
bf AS (SELECT entity, as_of, row_number() OVER (PARTITION BY entity, island ORDER BY as_of) >= 3 AS confirmed, first_value(n_baseline) OVER (PARTITION BY entity, island ORDER BY as_of) / 8.0 < 2 AS emergent FROM bh),
be AS (SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.as_of, b.as_of) AS as_of, coalesce(rr, 0) AS a, coalesce(ears_z, 0) AS b FROM br a FULL JOIN ears b ON a.entity = b.entity AND a.as_of = b.as_of),
bk AS (SELECT *, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / count(*) OVER () AS ra, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / count(*) OVER () AS rb FROM be),
al AS (SELECT 'ratio' AS model, entity, as_of AS q FROM br WHERE rr > 1.5 UNION ALL
       SELECT 'ratio-dual', entity, as_of FROM br WHERE rr IS NOT NULL AND ratio_own IS NOT NULL AND least(rr, ratio_own) > 1.2 UNION ALL
       SELECT 'ratio-confirmed', entity, as_of FROM bf WHERE confirmed UNION ALL
       SELECT 'ratio-emergent', entity, as_of FROM bf WHERE emergent UNION ALL
       SELECT 'ears', entity, as_of FROM ears WHERE ears_z > 3 UNION ALL
       SELECT 'mean(ratio,ears)', entity, as_of FROM bk WHERE (ra + rb) / 2 > 0.95 UNION ALL
       SELECT 'threshold(ratio,ears)', entity, as_of FROM be WHERE greatest(a / 1.5, b / 3.0) > 1 UNION ALL
       SELECT 'veto(ratio,ears)', entity, as_of FROM be WHERE CASE WHEN b >= 3 THEN a ELSE 0 END > 1.5),
mo AS (SELECT unnest(['ratio', 'ratio-dual', 'ratio-confirmed', 'ratio-emergent', 'ears', 'mean(ratio,ears)', 'threshold(ratio,ears)', 'veto(ratio,ears)']) AS model),
bo AS (SELECT coalesce(t.model, x.model) AS model, coalesce(t.entity, x.entity) AS entity, count(t.q) AS gt, count(x.q) AS det, count(*) FILTER (t.q IS NOT NULL AND x.q IS NOT NULL) AS overlap
       FROM (SELECT model, entity, q FROM tq, mo) t FULL JOIN (SELECT * FROM al WHERE entity IN (FROM lab)) x ON t.model = x.model AND t.entity = x.entity AND t.q = x.q GROUP BY 1, 2),
bl AS (SELECT model, entity, min(q - start_q) AS lag FROM al JOIN iv USING (entity) WHERE q BETWEEN start_q AND end_q GROUP BY 1, 2),
bp AS (SELECT mo.model, lab.entity, coalesce(gt, 0) AS gt, coalesce(det, 0) AS det, coalesce(overlap, 0) AS overlap, lag FROM mo CROSS JOIN lab LEFT JOIN bo ON bo.model = mo.model AND bo.entity = lab.entity LEFT JOIN bl ON bl.model = mo.model AND bl.entity = lab.entity),
bx AS (SELECT model, count(*) AS off_quarters, count(DISTINCT entity) AS off_entities FROM al WHERE entity NOT IN (FROM lab) GROUP BY 1)"""


@query(f"""WITH {B}, {W}, {EARS}, {TRUTHS}, {BENCH}
SELECT model, count(*)::BIGINT AS labelled, sum((overlap > 0)::INT)::BIGINT AS detected, {_r('avg(coalesce(overlap / nullif(gt, 0), 0))', 'recall')}, {_r('avg(coalesce(overlap / nullif(det, 0), 0))', 'precision')}, {_r('avg(coalesce(overlap / nullif(gt + det - overlap, 0), 0))', 'iou')},
 {_r('avg(lag)', 'lag_q')}, sum(det)::BIGINT AS alarm_quarters, {_r('sum((det > 0 AND overlap > 0)::INT) / nullif(sum((det > 0)::INT), 0)', 'alarm_precision')}, coalesce(any_value(off_quarters), 0)::BIGINT AS off_quarters, coalesce(any_value(off_entities), 0)::BIGINT AS off_entities
FROM bp LEFT JOIN bx USING (model) GROUP BY model""")
def benchmark(s, sf):
    """All detectors against the labelled intervals, a row each."""
    out = evaluation.run_benchmark(MODELS, _benchmark(s, sf), _intervals(s, sf), s.createDataFrame(CALM, "entity string"))
    return r6(out, "recall", "precision", "iou", "lag_q", "alarm_precision")


@query(f"""WITH {B}, {W}, {EARS}, {TRUTHS}, {BENCH} SELECT model, entity, start_q, min(q)::INT AS first_alarm FROM al JOIN iv USING (entity) WHERE q BETWEEN start_q AND end_q GROUP BY 1, 2, 3""")
def method_timeline(s, sf):
    """When each detector first alarms inside an interval."""
    rows, scores = None, _benchmark(s, sf)
    for m in MODELS:
        hot = scores[m.name].where(F.col("score") > m.threshold).select(F.lit(m.name).alias("model"), "entity", F.col("as_of").alias("q"))
        rows = hot if rows is None else rows.unionByName(hot)
    none = s.createDataFrame([], "entity string, onset int")
    return evaluation.onset_lags(rows, _intervals(s, sf), none).select("model", "entity", "start_q", "first_alarm")


@query(f"WITH {B}, {W}, t AS (SELECT min(ratio) AS line FROM (SELECT ratio FROM rat WHERE ratio IS NOT NULL ORDER BY ratio DESC, entity, as_of LIMIT 20)) SELECT entity, as_of, {_r('ratio', 'score')}, {_r('line', 'line')} FROM rat, t WHERE ratio >= line")
def matched_alarms(s, sf):
    return r6(evaluation.matched_alarms(_ratio(s, sf), "ratio", 20), "score", "line")


def _pair(s, sf):
    a = _ratio(s, sf).select("entity", "as_of", F.round("ratio", 9).alias("score"))
    b = _ears(s, sf).select("entity", "as_of", F.round("ears_z", 9).alias("score"))
    return a, b


ENS = """
ens AS (SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.as_of, b.as_of) AS as_of, coalesce(round(ratio, 9), 0) AS a, coalesce(round(ears_z, 9), 0) AS b FROM rat a FULL JOIN ears b ON a.entity = b.entity AND a.as_of = b.as_of),
rk AS (SELECT *, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / count(*) OVER () AS ra, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / count(*) OVER () AS rb FROM ens)"""


@query(f"WITH {B}, {W}, {EARS}, {ENS} SELECT entity, as_of, {_r('(ra + rb) / 2', 'score')} FROM rk")
def ensemble_mean(s, sf):
    return r6(evaluation.ensemble(*_pair(s, sf), "mean"), "score")


@query(f"WITH {B}, {W}, {EARS}, {ENS} SELECT entity, as_of, {_r('greatest(ra, rb)', 'score')} FROM rk")
def ensemble_max(s, sf):
    return r6(evaluation.ensemble(*_pair(s, sf), "max"), "score")


@query(f"WITH {B}, {W}, {EARS}, {ENS} SELECT entity, as_of, {_r('greatest(a / 1.5, b / 3.0)', 'score')} FROM ens")
def ensemble_threshold(s, sf):
    return r6(evaluation.ensemble(*_pair(s, sf), "threshold", line_a=1.5, line_b=3.0), "score")


@query(f"WITH {B}, {W}, {EARS}, {ENS} SELECT entity, as_of, {_r('CASE WHEN b >= 3.0 THEN a ELSE 0 END', 'score')} FROM ens")
def ensemble_veto(s, sf):
    return r6(evaluation.ensemble(*_pair(s, sf), "veto", line_b=3.0), "score")


CURVE = """
es AS (SELECT e.entity, (t.entity IS NOT NULL)::INT AS label, CASE WHEN t.entity IS NOT NULL THEN i.s ELSE x.s END AS score FROM (SELECT DISTINCT entity FROM cnt) e
  LEFT JOIN (SELECT DISTINCT entity FROM iv) t USING (entity) LEFT JOIN (SELECT entity, max(round(ratio, 9)) AS s FROM rat GROUP BY 1) x USING (entity)
  LEFT JOIN (SELECT entity, max(round(ratio, 9)) AS s FROM rat JOIN iv USING (entity) WHERE as_of BETWEEN start_q AND end_q GROUP BY 1) i USING (entity)),
cv AS (SELECT score, sum(sum(label)) OVER w::BIGINT AS tp, sum(sum(1 - label)) OVER w::BIGINT AS fp FROM es WHERE score IS NOT NULL GROUP BY score WINDOW w AS (ORDER BY score DESC)),
rt AS (SELECT score, tp, fp, tp / (SELECT sum(label) FROM es)::DOUBLE AS tpr, fp / (SELECT sum(1 - label) FROM es)::DOUBLE AS fpr, tp / (tp + fp)::DOUBLE AS precision FROM cv)"""


def _rates(s, sf):
    sweep = _ratio(s, sf).withColumn("ratio", F.round("ratio", 9))
    return evaluation.rates_at_thresholds(evaluation.entity_scores(sweep, "ratio", _intervals(s, sf), d.counts(s, sf).select("entity").distinct()))


@query(f"WITH {B}, {W}, {TRUTHS}, {CURVE} SELECT {_r('score', 'score')}, tp, fp, {_r('tpr', 'tpr')}, {_r('fpr', 'fpr')}, {_r('precision', 'precision')} FROM rt")
def curve_rates(s, sf):
    return r6(_rates(s, sf), "score", "tpr", "fpr", "precision")


@query(f"""WITH {B}, {W}, {TRUTHS}, {CURVE}, z AS (SELECT *, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS t0, coalesce(lag(fpr) OVER (ORDER BY score DESC), 0) AS f0 FROM rt)
SELECT {_r('sum((fpr - f0) * (tpr + t0) / 2) + (1 - max(fpr)) * (1 + max(tpr)) / 2', 'roc_auc')}, {_r('sum((tpr - t0) * precision)', 'average_precision')} FROM z""")
def curve_areas(s, sf):
    return r6(evaluation.curve_areas(_rates(s, sf)), "roc_auc", "average_precision")


@query(f"""WITH {B}, c AS (SELECT entity, (q // 2)::INT AS h, sum(n)::BIGINT AS n FROM cnt GROUP BY 1, 2), fl AS (SELECT sum(n) / 1000 AS f FROM c),
g AS (SELECT entity, h FROM (SELECT DISTINCT entity FROM c) CROSS JOIN (SELECT unnest(range((SELECT min(h) FROM c), (SELECT max(h) FROM c) + 1))::INT AS h)),
r AS (SELECT g.entity, g.h, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.entity = g.entity AND c.h = g.h),
x AS (SELECT *, n >= floor(f) AND lag(n, 1) OVER w < floor(f) AND lag(n, 2) OVER w < floor(f) AS hit FROM r, fl WINDOW w AS (PARTITION BY entity ORDER BY h))
SELECT entity, min(h)::INT AS onset FROM x WHERE hit GROUP BY entity""")
def external_onset(s, sf):
    c = d.counts(s, sf).groupBy("entity", F.floor(F.col("q") / 2).cast("int").alias("h")).agg(F.sum("n").alias("n"))
    floor = int((c.agg(F.sum("n")).first()[0] or 0) // 1000)
    return evaluation.external_onset(c, floor)


QCURVE = """
es AS (SELECT e.entity, a.as_of, (t.q IS NOT NULL)::INT AS label, coalesce(round(ratio, 9), 0) AS score FROM (SELECT DISTINCT entity FROM cnt) e CROSS JOIN (SELECT DISTINCT as_of FROM rat) a
  LEFT JOIN rat ON rat.entity = e.entity AND rat.as_of = a.as_of LEFT JOIN tq t ON t.entity = e.entity AND t.q = a.as_of),
cv AS (SELECT score, sum(sum(label)) OVER w::BIGINT AS tp, sum(sum(1 - label)) OVER w::BIGINT AS fp FROM es GROUP BY score WINDOW w AS (ORDER BY score DESC)),
rt AS (SELECT score, tp, fp, tp / (SELECT sum(label) FROM es)::DOUBLE AS tpr, fp / (SELECT sum(1 - label) FROM es)::DOUBLE AS fpr, tp / (tp + fp)::DOUBLE AS precision FROM cv)"""


@query(f"""WITH {B}, {W}, {TRUTHS}, {QCURVE}, z AS (SELECT *, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS t0, coalesce(lag(fpr) OVER (ORDER BY score DESC), 0) AS f0 FROM rt)
SELECT {_r('sum((fpr - f0) * (tpr + t0) / 2) + (1 - max(fpr)) * (1 + max(tpr)) / 2', 'roc_auc')}, {_r('sum((tpr - t0) * precision)', 'average_precision')} FROM z""")
def quarter_curve_areas(s, sf):
    """ROC and PR areas when every entity's every quarter is a case."""
    sweep = _ratio(s, sf).withColumn("ratio", F.round("ratio", 9))
    rows = evaluation.quarter_scores(sweep, "ratio", _intervals(s, sf), d.counts(s, sf).select("entity").distinct())
    return r6(evaluation.curve_areas(evaluation.rates_at_thresholds(rows)), "roc_auc", "average_precision")


# --- nowcast: an order's lines are reported when they are shipped -------------------------------------
AS_OF = 2000 * 12 + 11  # December 2000


def _vintage(s, sf, until: str | None):
    li, o = table(s, sf, "lineitem"), table(s, sf, "orders")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    rows = rows.where(F.col("l_shipdate") <= F.lit(until).cast("timestamp_ntz")) if until else rows
    return nowcast.monthly(rows.select(F.col("o_orderdate").alias("event_date")).where("o_orderdate < timestamp_ntz '2001-01-01'"))


VINT = """
ml AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS m, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate < '2001-01-01'),
ea AS (SELECT m, count(*) AS n FROM ml WHERE l_shipdate <= '2000-12-31' GROUP BY m), la AS (SELECT m, count(*) AS n FROM ml GROUP BY m),
dl AS (SELECT 24011 - m AS delay, ea.n AS n_early, la.n AS n_late, ea.n / la.n::DOUBLE AS raw, la.n::DOUBLE AS w FROM ea JOIN la USING (m) WHERE 24011 - m BETWEEN 0 AND 15),
av AS (SELECT j.delay AS j, k.delay AS k, (SELECT sum(raw * w) / sum(w) FROM dl WHERE delay BETWEEN j.delay AND k.delay) AS v FROM dl j JOIN dl k ON j.delay <= k.delay),
ft AS (SELECT delay, least(1.0, greatest(1e-6, max(v))) AS completeness FROM (SELECT d.delay, j, min(v) AS v FROM dl d JOIN av ON j <= d.delay AND k >= d.delay GROUP BY 1, 2) GROUP BY 1),
ok AS (SELECT count(*)::BIGINT AS settled_months, abs(sum(ea.n) / sum(la.n)::DOUBLE - 1) <= 0.01 AS ok FROM ea JOIN la USING (m) WHERE m <= 23975),
cu AS (SELECT delay, n_early, n_late, raw, completeness, sqrt(completeness * (1 - completeness) / greatest(n_late, 1)) AS se FROM dl JOIN ft USING (delay)),
ap AS (SELECT m, 24011 - m AS delay, n, coalesce(completeness, (SELECT max_by(completeness, delay) FROM cu)) AS pi, coalesce(se, (SELECT max_by(se, delay) FROM cu)) AS ps FROM ea LEFT JOIN cu ON cu.delay = 24011 - m),
es AS (SELECT *, n / pi AS estimate, n / pi * sqrt((1 - pi) / greatest(n, 1) + pow(ps / pi, 2)) AS se FROM ap)"""


def _curve(s, sf):
    return nowcast.delay_curve(_vintage(s, sf, "2000-12-31"), _vintage(s, sf, None), AS_OF, 1997 * 12 + 11)


@query(f"WITH {VINT} SELECT delay, n_early, n_late, {_r('raw', 'raw')}, {_r('completeness', 'completeness')}, {_r('se', 'se')}, ok, settled_months FROM cu, ok")
def delay_curve(s, sf):
    return r6(_curve(s, sf), "raw", "completeness", "se")


@query(f"WITH {VINT} SELECT m, delay, n, {_r('pi', 'completeness')}, {_r('estimate', 'estimate', 4)}, {_r('se', 'se', 4)} FROM es")
def nowcast_months(s, sf):
    out = nowcast.apply_curve(_vintage(s, sf, "2000-12-31"), _curve(s, sf), AS_OF)
    return r6(r6(out, "completeness"), "estimate", "se", places=4)


@query(f"WITH {VINT} SELECT (m // 3)::INT AS q, sum(n)::BIGINT AS n, {_r('sum(estimate)', 'estimate', 4)}, {_r('sqrt(sum(se * se))', 'se', 4)}, {_r('sum(estimate) - 1.96 * sqrt(sum(se * se))', 'low', 4)}, {_r('sum(estimate) + 1.96 * sqrt(sum(se * se))', 'high', 4)} FROM es GROUP BY m // 3 HAVING count(*) = 3")
def nowcast_quarters(s, sf):
    return r6(nowcast.quarterly_estimates(nowcast.apply_curve(_vintage(s, sf, "2000-12-31"), _curve(s, sf), AS_OF)), "estimate", "se", "low", "high", places=4)


@query(f"""WITH {VINT}, bs AS (SELECT median(n) AS b FROM ea WHERE 24011 - m BETWEEN 12 AND 30)
SELECT delay, {_r('n / b', 'implied')}, {_r('completeness', 'curve')}, {_r('n / b / completeness', 'quotient')}, delay <= 4 AND (n / b / completeness > 1.35 OR n / b / completeness < 0.65) AS bad FROM ea JOIN cu ON cu.delay = 24011 - m, bs WHERE delay BETWEEN 0 AND 8""")
def transfer_check(s, sf):
    return r6(nowcast.transfer_check(_vintage(s, sf, "2000-12-31"), _curve(s, sf), AS_OF), "implied", "curve", "quotient")


# --- spatial: embeddings as points, their labels as entities -----------------------------------------
PT = "pt AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, label FROM embeddings)"
GRAPH = f"""{PT}, nk AS (SELECT least(greatest(1, ceil(0.05 * count(*))), greatest(1, count(*) - 1)) AS k, count(*)::DOUBLE AS n FROM pt),
nn AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS r FROM pt a JOIN pt b ON a.id <> b.id), nk WHERE r <= k),
gr AS (SELECT a, b FROM nn UNION SELECT b, a FROM nn)"""


@query(f"WITH {GRAPH} SELECT a, b FROM gr")
def knn_graph(s, sf):
    return spatial.knn_graph(d.points(s, sf))


@query(f"""WITH {GRAPH}, dg AS (SELECT a, count(*) AS k FROM gr GROUP BY a), ap AS (SELECT sum(k)::DOUBLE AS a2, sum(k * (k - 1))::DOUBLE AS p2 FROM dg),
st AS (SELECT x.label, count(*) AS s FROM gr JOIN pt x ON x.id = a JOIN pt y ON y.id = b WHERE x.label = y.label GROUP BY 1),
cs AS (SELECT label, count(*)::DOUBLE AS c FROM pt GROUP BY 1),
f AS (SELECT label, c, coalesce(s, 0)::DOUBLE AS s, a2, p2, n, c*(c-1)/(n*(n-1)) AS f2, c*(c-1)*(c-2)/(n*(n-1)*(n-2)) AS f3, c*(c-1)*(c-2)*(c-3)/(n*(n-1)*(n-2)*(n-3)) AS f4 FROM cs LEFT JOIN st USING (label), ap, nk),
g AS (SELECT *, a2 * f2 AS mean, 2*a2*f2 + 4*p2*f3 + (a2*a2 - 2*a2 - 4*p2)*f4 - pow(a2*f2, 2) AS var FROM f)
SELECT label::VARCHAR AS entity, c::BIGINT AS n_cases, s AS statistic, {_r('mean', 'mean', 4)}, {_r('var', 'variance', 3)}, {_r("CASE WHEN c >= 10 AND c / n <= 0.25 AND var > 0 THEN (s - mean) / sqrt(var) END", 'z', 5)}, CASE WHEN c < 10 THEN 'n<10' WHEN c / n > 0.25 THEN 'case_fraction>0.25' END AS withheld FROM g""")
def concentration(s, sf):
    p = d.points(s, sf)
    out = spatial.point_concentration(p, p.select("id", F.col("label").cast("string").alias("entity")))
    return r6(r6(r6(out.select("entity", "n_cases", "statistic", "mean", "variance", "z", "withheld"), "mean", places=4), "variance", places=3), "z", places=5)


@query(f"WITH {PT}, d AS (SELECT a.label, a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS m FROM pt a JOIN pt b ON a.label = b.label AND a.id <> b.id GROUP BY 1, 2) SELECT label::VARCHAR AS entity, count(*)::BIGINT AS n, {_r('avg(m)', 'mean_d')} FROM d GROUP BY 1")
def nearest_case_distance(s, sf):
    p = d.points(s, sf)
    return r6(spatial.mean_nearest_distance(p, p.select("id", F.col("label").cast("string").alias("entity"))), "mean_d")


def _cases(s, sf):
    """Points with flags and zones, and their labels as entities."""
    p = d.points(s, sf)
    zone = F.concat_ws(":", F.floor(F.col("x") / 100), F.floor(F.col("y") / 100))
    near = p.withColumns({"zone": zone, "at_facility": F.col("id") % 5 == 0})
    return near, p.select("id", F.col("label").cast("string").alias("entity"))


@query(f"""WITH {PT}, dd AS (SELECT a.label, a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS m FROM pt a JOIN pt b ON a.label = b.label AND a.id <> b.id GROUP BY 1, 2),
zo AS (SELECT label, floor(x / 100)::BIGINT || ':' || floor(y / 100)::BIGINT AS zone, count(*) AS k FROM pt GROUP BY 1, 2),
tz AS (SELECT * FROM zo QUALIFY row_number() OVER (PARTITION BY label ORDER BY k DESC, zone) = 1),
g AS (SELECT label, count(*)::BIGINT AS n, 100.0 * avg((id % 5 = 0)::INT) AS f FROM pt GROUP BY 1), md AS (SELECT label, avg(m) AS mean_d FROM dd GROUP BY 1), al AS (SELECT count(*)::DOUBLE AS a FROM pt)
SELECT label::VARCHAR AS entity, n, {_r('n / a', 'case_fraction')}, n / a > 0.25 AS out_of_scope, {_r('mean_d', 'mean_d')}, {_r('f', 'pct_at_facility')}, zone AS top_zone, {_r('100.0 * k / n', 'top_zone_pct')} FROM g LEFT JOIN md USING (label) JOIN tz USING (label), al""")
def cluster_observed(s, sf):
    return r6(spatial.cluster_observed(*_cases(s, sf)), "case_fraction", "mean_d", "pct_at_facility", "top_zone_pct")


@query()
def cluster_test(s, sf):
    """Nearest-case distances against 999 random labellings, for all labels."""
    return r6(spatial.cluster_test(*_cases(s, sf)), "case_fraction", "mean_d", "null_mean", "null_sd", "localization", "z", "p_value", "pct_at_facility", "top_zone_pct")


@query(f"WITH {PT} SELECT floor(x / 50)::INT AS ix, floor(y / 50)::INT AS iy, count(*)::BIGINT AS n, sum((label = 0)::INT)::BIGINT AS cases FROM pt GROUP BY 1, 2")
def risk_grid(s, sf):
    return spatial.grid_counts(d.points(s, sf).withColumn("is_case", F.col("label") == 0), 50.0)


@query(f"""WITH {PT}, g AS (SELECT floor(x / 50)::INT AS ix, floor(y / 50)::INT AS iy, count(*) AS n, sum((label = 0)::INT) AS c FROM pt GROUP BY 1, 2), sh AS (SELECT sum(c) / sum(n)::DOUBLE AS s FROM g),
k AS (SELECT a.ix, a.iy, sum(exp(-(pow(a.ix - b.ix, 2) + pow(a.iy - b.iy, 2)) / 4.5) * b.n) AS kn, sum(exp(-(pow(a.ix - b.ix, 2) + pow(a.iy - b.iy, 2)) / 4.5) * b.c) AS kc, sum(b.n)::BIGINT AS local_n FROM g a JOIN g b ON abs(a.ix - b.ix) <= 5 AND abs(a.iy - b.iy) <= 5 GROUP BY 1, 2)
SELECT ix, iy, local_n, {_r('CASE WHEN local_n >= 5 THEN ln((kc + s) / (kn + 1) / s) END', 'log_rr')} FROM k, sh""")
def relative_risk(s, sf):
    g = spatial.grid_counts(d.points(s, sf).withColumn("is_case", F.col("label") == 0), 50.0)
    return r6(spatial.log_relative_risk(g, 1.5), "log_rr")


@query(f"WITH {PT} SELECT {_r('sqrt((var_samp(x) + var_samp(y)) / 2) * pow(count(*), -1.0 / 6)', 'bandwidth')}, count(*)::BIGINT AS n FROM pt")
def normal_reference(s, sf):
    return r6(spatial.normal_reference(d.points(s, sf)), "bandwidth")


@query(f"""WITH {PT}, w AS (SELECT h, a.id, any_value(a.label = 0) AS is_case, sum(exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / (2 * h * h))) AS w, sum(exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / (2 * h * h)) * (b.label = 0)::INT) AS c
 FROM pt a JOIN pt b ON a.id <> b.id CROSS JOIN (SELECT unnest([50.0, 100.0, 200.0])::DOUBLE AS h) GROUP BY 1, 2), sh AS (SELECT avg((label = 0)::INT) AS s FROM pt),
p AS (SELECT h, is_case, least(1 - 1e-9, greatest(1e-9, (c + s * 1e-12) / (w + 1e-12))) AS p FROM w, sh)
SELECT h AS bandwidth, {_r('sum(CASE WHEN is_case THEN ln(p) ELSE ln(1 - p) END)', 'log_likelihood', 4)} FROM p GROUP BY h""")
def bandwidth_scores(s, sf):
    return r6(spatial.bandwidth_scores(d.points(s, sf).withColumn("is_case", F.col("label") == 0), [50.0, 100.0, 200.0]), "log_likelihood", places=4)


def _zones(s, sf):
    """Nations as zones on a square map by key, weighted by customers; an order's nation is its zone."""
    c = table(s, sf, "customer")
    z = c.groupBy(F.col("c_nationkey").alias("zone")).agg(F.count("*").alias("weight"))
    zones = z.select("zone", (F.col("zone") % 5).cast("double").alias("x"), F.floor(F.col("zone") / 5).cast("double").alias("y"), "weight")
    o = table(s, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    day = F.to_date("o_orderdate")
    e = o.select(F.col("c_nationkey").alias("zone"), (F.year(day) * 4 + F.quarter(day) - 1).cast("int").alias("q"), (F.col("o_orderpriority") == "1-URGENT").alias("is_case"))
    return zones, e


ZONE = """
zn AS (SELECT c_nationkey AS zone, (c_nationkey % 5)::DOUBLE AS x, (c_nationkey // 5)::DOUBLE AS y, count(*) AS weight FROM customer GROUP BY 1),
ci AS (SELECT centre, rank, zone FROM (SELECT a.zone AS centre, b.zone, row_number() OVER w AS rank, sum(b.weight) OVER w AS run, sum(b.weight) OVER (PARTITION BY a.zone) AS al FROM zn a CROSS JOIN zn b WINDOW w AS (PARTITION BY a.zone ORDER BY sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), b.zone ROWS UNBOUNDED PRECEDING)) WHERE rank = 1 OR run <= 0.25 * al),
ev AS (SELECT c_nationkey AS zone, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::INT AS q, o_orderpriority = '1-URGENT' AS is_case FROM orders JOIN customer ON c_custkey = o_custkey)"""


@query(f"WITH {ZONE} SELECT centre, rank::INT AS rank, zone FROM ci")
def scan_circles(s, sf):
    return spatial.circles(_zones(s, sf)[0])


@query(f"""WITH {ZONE}, fr AS (SELECT * FROM ev WHERE q BETWEEN 7991 AND 8002), wi AS (SELECT unnest([1,2,3,4,5,6]) AS w)
SELECT a.centre, a.rank::INT AS radius, w AS window_q, count(fr.zone)::BIGINT AS n, coalesce(sum(is_case::INT), 0)::BIGINT AS cases FROM ci a CROSS JOIN wi JOIN ci b ON b.centre = a.centre AND b.rank <= a.rank LEFT JOIN fr ON fr.zone = b.zone AND fr.q > 8002 - w GROUP BY 1, 2, 3""")
def scan_cylinders(s, sf):
    z, e = _zones(s, sf)
    return spatial.cylinders(e, z, 8002)


CYL = """
fr AS (SELECT * FROM ev WHERE q BETWEEN 7991 AND 8002), wi AS (SELECT unnest([1,2,3,4,5,6]) AS w),
cy AS (SELECT a.centre, a.rank AS radius, w, count(fr.zone)::DOUBLE AS n, coalesce(sum(is_case::INT), 0)::DOUBLE AS c FROM ci a CROSS JOIN wi JOIN ci b ON b.centre = a.centre AND b.rank <= a.rank LEFT JOIN fr ON fr.zone = b.zone AND fr.q > 8002 - w GROUP BY 1, 2, 3),
tt AS (SELECT count(*)::DOUBLE AS tn, sum(is_case::INT)::DOUBLE AS tc FROM fr),
sp AS (SELECT a.centre, a.rank AS radius, coalesce(sum(is_case::INT), 0)::DOUBLE AS sc FROM ci a JOIN ci b ON b.centre = a.centre AND b.rank <= a.rank LEFT JOIN fr ON fr.zone = b.zone GROUP BY 1, 2),
tm AS (SELECT w, coalesce(sum(is_case::INT), 0)::DOUBLE AS wc FROM wi LEFT JOIN fr ON fr.q > 8002 - w GROUP BY 1),
xl AS (SELECT 'bernoulli' AS model, centre, radius, w, n, c, n * tc / tn AS e, CASE WHEN n > 0 AND tn > n AND c * (tn - n) > (tc - c) * n THEN
  CASE WHEN c > 0 THEN c * ln(c / n) ELSE 0 END + CASE WHEN n > c THEN (n - c) * ln((n - c) / n) ELSE 0 END + CASE WHEN tc > c THEN (tc - c) * ln((tc - c) / (tn - n)) ELSE 0 END
  + CASE WHEN tn - n > tc - c THEN (tn - n - tc + c) * ln((tn - n - tc + c) / (tn - n)) ELSE 0 END - tc * ln(tc / tn) - (tn - tc) * ln((tn - tc) / tn) ELSE 0 END AS llr FROM cy, tt UNION ALL
  SELECT 'poisson', centre, radius, w, n, c, e, CASE WHEN c > e AND e > 1e-9 THEN c * ln(c / e) + CASE WHEN tc > c AND tc > e THEN (tc - c) * ln((tc - c) / (tc - e)) ELSE 0 END ELSE 0 END
  FROM (SELECT cy.*, sc * wc / tc AS e, tc FROM cy JOIN sp USING (centre, radius) JOIN tm USING (w), tt))"""


@query(f"WITH {ZONE}, {CYL} SELECT model, centre, radius::INT AS radius, w AS window_q, n::BIGINT AS n, c::BIGINT AS cases, {_r('e', 'expected')}, {_r('llr', 'llr')} FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(llr, 9) DESC, radius, w, centre) AS r FROM xl) WHERE r = 1")
def best_cylinders(s, sf):
    """The most likely cluster under both models."""
    z, e = _zones(s, sf)
    rows = [spatial.best_cylinder(e, z, 8002, m).withColumn("model", F.lit(m)) for m in ("bernoulli", "poisson")]
    return r6(rows[0].unionByName(rows[1]), "expected", "llr")


@query()
def trend_variation(s, sf):
    """Circles in which urgent orders rise more steeply than all orders do, against outside."""
    z, e = _zones(s, sf)
    per = e.withColumn("t", F.floor(F.col("q") / 4).cast("int") - 1998)
    pop = per.groupBy("zone", "t").agg(F.count("*").alias("n"))
    return r6(spatial.trend_variation(per.where("is_case").groupBy("zone", "t").agg(F.count("*").alias("n")), pop, z), "beta_in", "beta_out", "llr", places=4)


def _labelled(s, sf):
    """Orders as events in zones, their priorities as entities."""
    c = table(s, sf, "customer")
    o = table(s, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    day = F.to_date("o_orderdate")
    e = o.select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("zone"), (F.year(day) * 4 + F.quarter(day) - 1).cast("int").alias("q"), F.col("o_orderpriority").alias("entity"))
    return e, e.select("id", "entity")


@query()
def scan_significance(s, sf):
    """The most likely cylinder of each order priority under both models, with permutation p-values."""
    e, labels = _labelled(s, sf)
    z, _ = _zones(s, sf)
    rows = [significance.scan_significance(e, labels, z, 8002, m).withColumn("model", F.lit(m)) for m in ("bernoulli", "interaction")]
    return r6(rows[0].unionByName(rows[1]), "radius", "expected", "rate_ratio", "llr", "p_value", "recurrence_interval", "p_across")


@query(f"""WITH {ZONE}, fr AS (SELECT c_nationkey AS zone, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::INT AS q, o_orderpriority AS entity FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) * 4 + quarter(o_orderdate) - 1 BETWEEN 7991 AND 8002),
wi AS (SELECT unnest([1,2,3,4,5,6]) AS w), tn AS (SELECT count(*)::DOUBLE AS tn FROM fr), en AS (SELECT entity, count(*)::DOUBLE AS tc FROM fr, tn GROUP BY entity HAVING count(*) >= 20 AND count(*) <= 0.25 * any_value(tn.tn)),
zq AS (SELECT zone, q, entity, count(*) AS k FROM fr GROUP BY ALL),
nn AS (SELECT a.centre, a.rank, w, coalesce(sum(k), 0)::DOUBLE AS n FROM ci a CROSS JOIN wi JOIN ci b ON b.centre = a.centre AND b.rank <= a.rank LEFT JOIN zq ON zq.zone = b.zone AND zq.q > 8002 - w GROUP BY 1, 2, 3),
cc AS (SELECT a.centre, a.rank, w, entity, sum(k)::DOUBLE AS c FROM ci a CROSS JOIN wi JOIN ci b ON b.centre = a.centre AND b.rank <= a.rank JOIN zq ON zq.zone = b.zone AND zq.q > 8002 - w GROUP BY 1, 2, 3, 4),
sp AS (SELECT a.centre, a.rank, entity, sum(k)::DOUBLE AS sc FROM ci a JOIN ci b ON b.centre = a.centre AND b.rank <= a.rank JOIN zq ON zq.zone = b.zone GROUP BY 1, 2, 3),
tm AS (SELECT entity, w, sum(k)::DOUBLE AS wc FROM zq, wi WHERE zq.q > 8002 - w GROUP BY 1, 2),
al AS (SELECT nn.centre, nn.rank, nn.w, en.entity, tc, tn, n, coalesce(c, 0) AS c, coalesce(sc, 0) * coalesce(wc, 0) / tc AS ei FROM nn CROSS JOIN en CROSS JOIN tn LEFT JOIN cc ON cc.centre = nn.centre AND cc.rank = nn.rank AND cc.w = nn.w AND cc.entity = en.entity
       LEFT JOIN sp ON sp.centre = nn.centre AND sp.rank = nn.rank AND sp.entity = en.entity LEFT JOIN tm ON tm.entity = en.entity AND tm.w = nn.w),
xx AS (SELECT 'bernoulli' AS model, entity, centre, rank, w, tc, n, c, n * tc / tn AS e, CASE WHEN n > 0 AND tn > n AND c * (tn - n) > (tc - c) * n THEN
  CASE WHEN c > 0 THEN c * ln(c / n) ELSE 0 END + CASE WHEN n > c THEN (n - c) * ln((n - c) / n) ELSE 0 END + CASE WHEN tc > c THEN (tc - c) * ln((tc - c) / (tn - n)) ELSE 0 END
  + CASE WHEN tn - n > tc - c THEN (tn - n - tc + c) * ln((tn - n - tc + c) / (tn - n)) ELSE 0 END - tc * ln(tc / tn) - (tn - tc) * ln((tn - tc) / tn) ELSE 0 END AS llr FROM al UNION ALL
  SELECT 'interaction', entity, centre, rank, w, tc, n, c, ei, CASE WHEN c > ei AND ei > 0 AND ei < tc THEN c * ln(c / ei) + CASE WHEN tc > c THEN (tc - c) * ln((tc - c) / (tc - ei)) ELSE 0 END ELSE 0 END FROM al)
SELECT model, entity, tc::BIGINT AS n_cases, centre, rank::INT AS n_zones, w::INT AS window_q, c::BIGINT AS cases, n::BIGINT AS n, {_r('e', 'expected')}, {_r('c / nullif(e, 0)', 'rate_ratio')}, {_r('llr', 'llr')} FROM xx QUALIFY row_number() OVER (PARTITION BY model, entity ORDER BY round(llr, 9) DESC, centre, rank, w) = 1""")
def scan_observed(s, sf):
    """What is seen of each order priority before any null: its most likely cylinder under both models."""
    e, labels = _labelled(s, sf)
    z, _ = _zones(s, sf)
    rows = [significance.scan_observed(e, labels, z, 8002, m).withColumn("model", F.lit(m)) for m in ("bernoulli", "interaction")]
    return r6(rows[0].unionByName(rows[1]).select("model", "entity", "n_cases", "centre", "n_zones", "window_q", "cases", "n", "expected", "rate_ratio", "llr"), "expected", "rate_ratio", "llr")


@query()
def trend_significance(s, sf):
    """The circle in which urgent orders rise most against outside, with its p-value."""
    z, e = _zones(s, sf)
    per = e.withColumn("t", F.floor(F.col("q") / 4).cast("int") - 1998)
    n = lambda rows: rows.groupBy("zone", "t").agg(F.count("*").alias("n"))
    return r6(significance.trend_significance(n(per.where("is_case")), n(per), z), "beta_in", "beta_out", "llr", "p_value", places=4)


@query()
def tolerance_surface(s, sf):
    """The relative-risk surface with pointwise p-values."""
    p = d.points(s, sf).withColumn("is_case", F.col("label") == 0)
    return r6(significance.tolerance_surface(p, 50.0, 1.5), "log_rr", "p_value")


@query(f"""WITH {PT}, g AS (SELECT floor(x / 50)::INT AS ix, floor(y / 50)::INT AS iy, count(*) AS n, sum((label = 0)::INT) AS c FROM pt GROUP BY 1, 2), sh AS (SELECT sum(c) / sum(n)::DOUBLE AS s FROM g),
k AS (SELECT a.ix, a.iy, sum(exp(-(pow(a.ix - b.ix, 2) + pow(a.iy - b.iy, 2)) / 4.5) * b.n) AS kn, sum(exp(-(pow(a.ix - b.ix, 2) + pow(a.iy - b.iy, 2)) / 4.5) * b.c) AS kc, sum(b.n)::BIGINT AS local_n FROM g a JOIN g b ON abs(a.ix - b.ix) <= 5 AND abs(a.iy - b.iy) <= 5 GROUP BY 1, 2),
f AS (SELECT CASE WHEN abs((ix + 0.5) * 50) < 300 THEN (CASE WHEN (ix + 0.5) * 50 < 0 THEN 'w' ELSE 'e' END) || (CASE WHEN (iy + 0.5) * 50 < 0 THEN 's' ELSE 'n' END) END AS zone, CASE WHEN local_n >= 5 THEN ln((kc + s) / (kn + 1) / s) END AS r FROM k, sh)
SELECT zone, count(*)::BIGINT AS n_cells, {_r('avg(r)', 'mean_log_rr')}, {_r('max(r)', 'max_log_rr')}, {_r('exp(avg(r))', 'mean_rr')} FROM f WHERE zone IS NOT NULL GROUP BY 1""")
def zone_risk(s, sf):
    """The relative-risk surface by quadrant; cells far out in the west and east are outside all zones."""
    g = spatial.grid_counts(d.points(s, sf).withColumn("is_case", F.col("label") == 0), 50.0)
    side = lambda v, low, high: F.when(v < 0, low).otherwise(high)
    zone = lambda x, y: F.when(F.abs(x) < 300, F.concat(side(x, F.lit("w"), F.lit("e")), side(y, F.lit("s"), F.lit("n"))))
    return r6(significance.zone_summary(spatial.log_relative_risk(g, 1.5), 50.0, zone).drop("min_p"), "mean_log_rr", "max_log_rr", "mean_rr")


MEMBERS = [("teens", "Brand#11"), ("teens", "Brand#19"), ("sevens", "Brand#7"), ("sevens", "Brand#97")]


@query(f"""WITH {NODES} SELECT 'missing' AS kind, f AS owner, m AS name FROM (VALUES {_vals(MEMBERS)}) v(f, m) WHERE m NOT IN (SELECT entity FROM mc)
UNION SELECT 'unmapped', NULL, category FROM mc WHERE category NOT IN (SELECT c FROM (VALUES {_vals(SUPER)}) w(c, s))""")
def member_checks(s, sf):
    cats = hierarchy.modal_category(d.raw_mentions(s, sf, False).select("entity", "category"))
    return hierarchy.member_checks(cats, s.createDataFrame(MEMBERS, "family string, member string"), s.createDataFrame(SUPER, "category string, superclass string"))


@query(f"WITH {NODES} SELECT node, level, leaf FROM nodes JOIN (SELECT node, level FROM nodes GROUP BY 1, 2 HAVING count(*) >= 2) USING (node, level) WHERE level <> 'family'")
def strict_nodes(s, sf):
    """The tree without families, of nodes with two leaves or more."""
    return hierarchy.select_nodes(_nodes(s, sf), least_leaves=2, strict=True)


# --- text: part names as catalogue, an order's part names as its narrative ----------------------------
def _lexicon(s, sf):
    names = table(s, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("position"))
    return txt.build_lexicon(names.select(F.upper("p_name").alias("canonical"), F.col("p_name").alias("alias"), "position"))


def _narratives(s, sf):
    r = d.raw_mentions(s, sf, False)
    g = r.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name"))), lambda x: x["p_name"]), " and ").alias("narrative"))
    return g


@query("SELECT DISTINCT upper(p_name) AS alias, upper(p_name) AS canonical FROM part")
def lexicon(s, sf):
    return _lexicon(s, sf)


@query("SELECT DISTINCT l_orderkey AS case_id, upper(p_name) AS entity, 'narrative' AS fields FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey")
def extract_mentions(s, sf):
    return txt.extract_by_join(_narratives(s, sf), ["narrative"], _lexicon(s, sf), fuzzy=False)


@query("""SELECT DISTINCT l_orderkey AS case_id, entity, 'narrative,remark' AS fields FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey, unnest([upper(p_name), p_type]) u(entity)
WHERE entity = upper(p_name) OR length(entity) >= 7""")
def extract_misspelt(s, sf):
    """Part names, and types that the remark always and the narrative on odd lines spells without its sixth
    letter: what no alias matches is resolved fuzzily. Types under seven letters are left out."""
    cases, lexicon = _misspelt(s, sf)
    return txt.extract_by_join(cases, ["narrative", "remark"], lexicon)


def _misspelt(s, sf):
    names = table(s, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("position")).select(F.upper("p_name").alias("canonical"), F.col("p_name").alias("alias"), "position")
    types = table(s, sf, "part").select("p_type").distinct().where("length(p_type) >= 7").select(F.col("p_type").alias("canonical"), F.col("p_type").alias("alias"), F.lit(0).cast("long").alias("position"))
    r = d.raw_mentions(s, sf, False)
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name", "category")))  # the same text whenever it is read
    odd = lambda c: F.when(F.length(c) >= 8, F.concat(F.substring(c, 1, 5), F.substring(c, 7, 1 << 30))).otherwise(c)
    kind = lambda c: F.when(F.length(c) >= 7, odd(c)).otherwise(F.lit(""))
    plain = lambda x: F.when((F.length(x["category"]) >= 7) & (x["l_linenumber"] % 2 == 0), x["category"]).otherwise(kind(x["category"]))
    text = lambda k: F.array_join(F.transform("lines", lambda x: F.concat_ws(" and ", x["p_name"], k(x))), " with ")
    cases = r.groupBy("case_id").agg(lines.alias("lines")).select("case_id", text(plain).alias("narrative"), text(lambda x: kind(x["category"])).alias("remark"))
    return cases, txt.build_lexicon(names.unionByName(types))


@query("""SELECT upper(left(p_type, 5) || substr(p_type, 7)) AS token, upper(p_type) AS alias, p_type AS canonical, (count(*) + count(*) FILTER (l_linenumber % 2 <> 0))::BIGINT AS hits
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE length(p_type) >= 8 GROUP BY ALL""")
def fuzzy_audit(s, sf):
    """What was guessed of the misspelt types, and how often."""
    cases, lexicon = _misspelt(s, sf)
    return txt.fuzzy_audit(cases, ["narrative", "remark"], lexicon)


@query("""WITH r AS (SELECT l_orderkey AS case_id, upper(p_name) AS entity, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
u AS (SELECT case_id, CASE WHEN length(entity) % 2 = 0 THEN left(entity, 3) ELSE entity END AS entity, row_number() OVER (PARTITION BY case_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM r),
f AS (SELECT case_id, entity, min(i) AS i FROM u GROUP BY 1, 2)
SELECT case_id, string_agg(entity, ',' ORDER BY i) AS seq FROM f GROUP BY 1""")
def ordered_names(s, sf):
    """The part names of each order's narrative in the order of first mention; names of even length roll up to their first three letters."""
    lexicon = _lexicon(s, sf)
    up = lexicon.select(F.col("canonical").alias("entity"), F.substring("canonical", 1, 3).alias("rollup")).where(F.length("entity") % 2 == 0).distinct()
    return txt.ordered_rolled_up(_narratives(s, sf), "narrative", lexicon, up).select("case_id", F.array_join("seq", ",").alias("seq"))


@query("SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(translate(upper(replace(text, 'ß', 'ss')), '‐‑‒–—―−', '-------'), '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9]),([0-9])', '\\1' || chr(1) || '\\2', 'g'), ',', ' '), '[^A-Z0-9' || chr(1) || '\\-'']+', ' ', 'g'), chr(1), ',', 'g')), ' '), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), lambda w: w <> '' AND w NOT IN ('AND','WITH','OF','THE','PLUS','OR')), ' ')) AS tokens_md5 FROM documents")
def tokenized_documents(s, sf):
    return _tokens_md5(table(s, sf, "documents"))


@query()
def tokenized_documents_all(s, sf):
    """The same under its first name."""
    return _tokens_md5(table(s, sf, "documents"))


def _tokens_md5(docs):
    return docs.select("doc_id", F.md5(F.array_join(txt.tokens(F.col("text")), " ")).alias("tokens_md5"))


@query(f"""WITH ec AS (SELECT event_type AS entity, datediff('day', DATE '2024-01-01', ts::DATE)::INT AS q, count(*)::BIGINT AS n FROM events GROUP BY 1, 2), den AS (SELECT q, sum(n)::BIGINT AS n_total FROM ec GROUP BY 1),
dn AS (SELECT e.entity, den.q, den.n_total, coalesce(ec.n, 0) AS n FROM (SELECT DISTINCT entity FROM ec) e CROSS JOIN den LEFT JOIN ec ON ec.entity = e.entity AND ec.q = den.q),
aso AS (SELECT q AS as_of, (SELECT count(*) FROM den x WHERE x.q BETWEEN den.q - 11 AND den.q) AS k FROM den), {EARS}
SELECT entity, as_of, n_recent, n_baseline, {_r('ears_z', 'ears_z')} FROM ears""")
def daily_ears(s, sf):
    """Moving-baseline z of each event type's daily share: four recent days against eight before."""
    e = table(s, sf, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    c = e.groupBy(F.col("event_type").alias("entity"), day.alias("q")).agg(F.count("*").alias("n"))
    return r6(aberration.ears_sweep(c, e.groupBy(day.alias("q")).agg(F.count("*").alias("n_total"))), "ears_z")


from . import backtests, intake  # noqa: E402, F401  (their queries join the registry)
