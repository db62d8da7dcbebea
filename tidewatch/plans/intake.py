"""Registered queries of sources, sinks, intake and reports, and their SQL.

What a source reads is first written from the given tables into the shared folder, so that readers, writers and
parsers work on data that grow with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import counting, spatial, synthetic
from ..operators import text as txt
from ..session import shared_dir, stored, table
from ..sources import io
from . import domain as d
from .registry import EDGES, NODES, B, BS, _nodes, _r, query, r6


def _folder(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _as_csv(s, df, name: str) -> str:
    path = _folder(s, name)
    io.write_csv(df, path)
    return path


SUPPLIER = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_scan(s, sf):
    """A table written as CSV and read with its schema."""
    return io.read_csv(s, _as_csv(s, table(s, sf, "supplier"), "csv"), SUPPLIER)


@query("SELECT s_acctbal, s_suppkey FROM supplier")
def csv_scan_pruned(s, sf):
    """Two columns of it."""
    return io.read_csv(s, _as_csv(s, table(s, sf, "supplier"), "csv"), SUPPLIER, ["s_acctbal", "s_suppkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 5 THEN date_trunc('month', o_orderdate)::DATE WHEN o_orderkey % 7 < 6 THEN o_orderdate::DATE END AS day FROM orders")
def csv_scan_dated(s, sf):
    """Order dates in five spellings, as a month and year, and as no date at all, read as dates."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    spelt = F.lit("unknown")
    for i, f in enumerate(("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy H:mm", "M/d/yyyy", "d-MMM-yyyy", "MMM yyyy")):
        spelt = F.when(k == i, F.date_format(day, f)).otherwise(spelt)
    path = _as_csv(s, table(s, sf, "orders").select("o_orderkey", spelt.alias("day"), "o_orderstatus"), "csv")
    return io.read_dated_csv(s, path, "o_orderkey long, day string, o_orderstatus string", ["day"], ["o_orderkey", "day"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 3")
def parquet_partitioned(s, sf):
    """A table written by nation and read for one of them."""
    path = _folder(s, "parquet")
    io.write_parquet(table(s, sf, "customer"), path, ["c_nationkey"])
    return io.read_parquet(s, path, ["c_custkey", "c_acctbal", "c_nationkey"]).where("c_nationkey = 3").drop("c_nationkey")


def _boundaries(s, sf):
    """Nations as squares with a square hole each, as one GeoJSON file."""
    x, y = (F.col("n_nationkey") % 5) * 120 - 300, F.floor(F.col("n_nationkey") / 5) * 120 - 300
    corner = lambda dx, dy: F.array((x + dx).cast("double"), (y + dy).cast("double"))
    square = lambda a, b: F.array(corner(a, a), corner(b, a), corner(b, b), corner(a, b), corner(a, a))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(square(0, 100), square(30, 70)).alias("coordinates")).alias("geometry"))
    every = table(s, sf, "nation").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))  # a map's areas
    path = _folder(s, "boundaries")
    every.coalesce(1).write.text(path)
    return io.read_boundaries(s, path, "name")


@query("SELECT n_name AS zone, 5 AS corners, 1 AS holes, ((n_nationkey % 5) * 120 - 300)::DOUBLE AS x, ((n_nationkey // 5) * 120 - 300)::DOUBLE AS y FROM nation")
def boundaries(s, sf):
    """Polygons read from GeoJSON: corners, holes, and the first corner."""
    return _boundaries(s, sf).select("zone", F.size("ring").alias("corners"), F.size("holes").alias("holes"), F.col("ring")[0][0].alias("x"), F.col("ring")[0][1].alias("y"))


@query("""WITH pt AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y FROM embeddings), zn AS (SELECT n_name AS zone, (n_nationkey % 5) * 120 - 300 AS a, (n_nationkey // 5) * 120 - 300 AS b FROM nation)
SELECT id, zone FROM pt LEFT JOIN zn ON x > a AND x < a + 100 AND y > b AND y < b + 100 AND NOT (x > a + 30 AND x < a + 70 AND y > b + 30 AND y < b + 70)""")
def located_points(s, sf):
    """Points with the polygon that holds them; those in holes have none."""
    return io.locate(d.points(s, sf), _boundaries(s, sf), 60.0).select("id", "zone")


@query("""WITH pt AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE * 10) AS x, round(embedding[2]::DOUBLE * 10) AS y FROM embeddings) SELECT id, count(*) OVER (PARTITION BY x, y) >= 5 AS at_facility FROM pt""")
def facility_flags(s, sf):
    """Points that share their coordinate, rounded to a tenth, with four others or more."""
    p = d.points(s, sf).select("id", *[F.round(F.col(c) / 100).alias(c) for c in "xy"])
    return spatial.facility_flags(p).select("id", "at_facility")


YEARS = range(2000, 2004)


def _population(s, sf):
    n = table(s, sf, "nation")
    people = F.when(F.col("n_nationkey") == 3, F.lit("-666666666")).otherwise((F.col("n_nationkey") * 1000 + (F.col("year") - 1999) * (F.col("n_nationkey") + 1) * 10).cast("string"))
    rows = n.withColumn("year", F.explode(F.array(*[F.lit(y) for y in YEARS]))).select("year", F.array(people, F.lit("x"), F.lpad(F.col("n_nationkey").cast("string"), 5, "9")).alias("r"))
    body = F.to_json(F.concat(F.array(F.array(F.lit("POP"), F.lit("NAME"), F.lit("zip"))), F.collect_list("r")))
    path = _folder(s, "responses")
    rows.groupBy("year").agg(body.alias("body")).write.json(path)  # a response a year, as its service sends it
    return io.population_rows(s.read.schema("year int, body string").json(path), F.col("year"))


POPULATION = "po AS (SELECT lpad(n_nationkey::VARCHAR, 5, '9') AS zipcode, y::INT AS year, CASE WHEN n_nationkey <> 3 THEN (n_nationkey * 1000 + (y - 1999) * (n_nationkey + 1) * 10)::DOUBLE END AS population FROM nation, (SELECT unnest(range(2000, 2004)) AS y))"


@query(f"WITH {POPULATION} SELECT zipcode, year, population FROM po")
def population_rows(s, sf):
    """Population tables read from JSON responses; sentinels are NULL."""
    return _population(s, sf)


@query(f"""WITH {POPULATION}, tq AS (SELECT q::INT AS q, greatest(2000.0, least(2003.0, q // 4 + (q % 4 + 0.5) / 4 - 0.5)) AS t FROM (SELECT unnest(range(7996, 8020)) AS q))
SELECT a.zipcode, q, {_r('a.population + (b.population - a.population) * (t - floor(t))', 'population')} FROM tq JOIN po a ON a.year = floor(t) JOIN po b ON b.zipcode = a.zipcode AND b.year = ceil(t) WHERE a.population IS NOT NULL""")
def population_by_quarter(s, sf):
    q = s.range(7996, 8020).select(F.col("id").cast("int").alias("q"))
    return r6(io.population_by_quarter(_population(s, sf), q), "population")


@query("SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '([0-9]{5})', 1), '') AS zip FROM documents")
def first_zip(s, sf):
    """The first five digits in a row of each document."""
    return table(s, sf, "documents").select("doc_id", txt.first_zip(F.col("text")).alias("zip"))


@query("""SELECT o_orderkey AS case_id FROM orders WHERE NOT (o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0 AND NOT contains(lower(o_orderpriority), 'urgent') AND (o_orderstatus <> 'F' OR contains(lower(o_orderpriority), 'low')))""")
def cohort(s, sf):
    """Orders without those that only the one flag marks, that show no acute sign, and that are no accident or chronic."""
    o = table(s, sf, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 2).cast("string").alias("single"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("other"), "o_orderpriority", "o_orderstatus")
    return txt.cohort(o, ["single", "other"], "single", "urgent", "low", ["o_orderpriority"], F.col("o_orderstatus") == "F").select("case_id")


@query(f"WITH {BS} SELECT DISTINCT case_id, CASE WHEN regexp_matches(entity, '^Brand#1[0-9]$') THEN 'teens' ELSE entity END AS entity, quarter FROM m")
def rolled_mentions(s, sf):
    """Mentions after the roll-up of the brands from ten to nineteen."""
    up = s.createDataFrame([(f"Brand#{i}", "teens") for i in range(10, 20)], "entity string, rollup string")
    return counting.distinct_mentions(d.raw_mentions(s, sf, False), up)


@query("""WITH w AS (SELECT unnest(string_split(upper(p_name), ' ')) AS token FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE length(p_name) % 2 = 1) SELECT token, count(*)::BIGINT AS n FROM w GROUP BY 1 HAVING count(*) >= 3""")
def unmatched_report(s, sf):
    """What no alias matches when the lexicon knows part names of even length only."""
    from .registry import _lexicon, _narratives

    return txt.unmatched_by_join(_narratives(s, sf), ["narrative"], _lexicon(s, sf).where(F.length("canonical") % 2 == 0))


def _flagged(s, sf):
    """Orders with two coded flags that their brands bear out but for every tenth order."""
    m = d.mentions(s, sf, False).select("case_id", "entity")
    hit = lambda p: F.max(F.rlike("entity", F.lit(p)).cast("int"))
    per = m.groupBy("case_id").agg(*[hit(p).alias(f) for f, p in FLAGS.items()])
    flip = F.col("case_id") % 10 == 0
    return table(s, sf, "orders").select(F.col("o_orderkey").alias("case_id")).join(per, "case_id", "left").select("case_id", *[F.when(flip, 1 - F.coalesce(f, F.lit(0))).otherwise(F.col(f)).cast("string").alias(f) for f in FLAGS]), m


FLAGS = {"seven": "^Brand#7$", "teens": "^Brand#1[0-9]$"}
FLAGGED = f"""
hi AS (SELECT case_id, max(regexp_matches(entity, '^Brand#7$')::INT) AS seven, max(regexp_matches(entity, '^Brand#1[0-9]$')::INT) AS teens FROM m GROUP BY 1),
fl AS (SELECT o_orderkey AS case_id, flag, coalesce(CASE WHEN flag = 'seven' THEN seven ELSE teens END, 0) = 1 AS hit, CASE WHEN o_orderkey % 10 = 0 THEN NOT (coalesce(CASE WHEN flag = 'seven' THEN seven ELSE teens END, 0) = 1) ELSE coalesce(CASE WHEN flag = 'seven' THEN seven ELSE teens END, 0) = 1 END AS coded
       FROM orders LEFT JOIN hi ON case_id = o_orderkey, (SELECT unnest(['seven', 'teens']) AS flag))"""


@query(f"""WITH {BS}, {FLAGGED}, g AS (SELECT flag, count(*) FILTER (coded AND hit)::BIGINT AS tp, count(*) FILTER (NOT coded AND hit)::BIGINT AS fp, count(*) FILTER (coded AND NOT hit)::BIGINT AS fn FROM fl GROUP BY 1)
SELECT flag, tp, fp, fn, {_r('tp / nullif(tp + fp, 0)', 'precision')}, {_r('tp / nullif(tp + fn, 0)', 'recall')}, {_r('2 * tp / nullif(2 * tp + fp + fn, 0)', 'f1')} FROM g""")
def flag_validation(s, sf):
    """Coded flags against what was extracted."""
    cases, m = _flagged(s, sf)
    return r6(txt.flag_validation(cases, m, FLAGS), "precision", "recall", "f1")


@query(f"WITH {BS}, {FLAGGED} SELECT entity, count(*)::BIGINT AS n FROM m JOIN fl USING (case_id) WHERE flag = 'teens' AND coded AND NOT regexp_matches(entity, '^Brand#1[0-9]$') GROUP BY 1 ORDER BY n DESC, entity LIMIT 25")
def others_content(s, sf):
    """What orders under the second flag hold besides the brands that it names."""
    cases, m = _flagged(s, sf)
    return txt.others_content(cases, m, "teens", [f"Brand#{i}" for i in range(10, 20)])


@query(f"""WITH {BS}, k AS (SELECT o_orderkey, count(entity) AS k FROM orders LEFT JOIN m ON case_id = o_orderkey GROUP BY 1)
SELECT sum(k)::BIGINT AS mentions, {_r('100.0 * avg((k > 0)::INT)', 'covered_pct')}, {_r('avg(k)', 'mean_per_case')}, max(k)::BIGINT AS most_per_case, (SELECT count(DISTINCT entity) FROM m)::BIGINT AS entities FROM k""")
def coverage(s, sf):
    """How much of the orders the mentions cover."""
    out = txt.coverage(table(s, sf, "orders").select(F.col("o_orderkey").alias("case_id")), d.mentions(s, sf, False).select("case_id", "entity"))
    return r6(out, "covered_pct", "mean_per_case")


@query(f"""WITH {B}, re AS (SELECT entity, (q - (SELECT min(q) FROM den))::INT AS t, n::DOUBLE AS y FROM dn),
sy AS (SELECT entity AS name, t + 3 AS t, y AS x FROM re WHERE entity IN ('Brand#1', 'Brand#7', 'Brand#21')),
pr AS (SELECT name, entity, sh AS shift, count(*) AS k, corr(x, y) AS r, avg(y) AS mean FROM sy, (SELECT unnest(range(-12, 13)) AS sh) JOIN re ON re.t = sy.t + sh GROUP BY ALL)
SELECT name, entity, shift::INT AS shift, {_r('r', 'r')}, mean < 3 AS thin FROM pr WHERE k >= 16 AND r IS NOT NULL AND NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(r, 9) DESC, entity, abs(shift), shift) = 1""")
def nearest_series(s, sf):
    """For three brands' series, moved by three quarters, the series that correlates best with each, and at which shift."""
    n = d.denom(s, sf)
    c = d.counts(s, sf)
    dense = c.select("entity").distinct().crossJoin(F.broadcast(n.select("q"))).join(c.select("entity", "q", "n"), ["entity", "q"], "left").fillna(0, ["n"])  # a row a quarter
    real = stored(dense.select("entity", (F.col("q") - int(n.agg(F.min("q")).first()[0])).alias("t"), "n"), "series")
    moved = real.where(F.col("entity").isin("Brand#1", "Brand#7", "Brand#21")).select(F.col("entity").alias("name"), (F.col("t") + 3).alias("t"), "n")
    return r6(synthetic.nearest_series(moved, real), "r")


@query(f"""WITH {NODES}, {EDGES}, o AS (SELECT 'n' || substr(md5(child), 1, 12) AS c, 'n' || substr(md5(parent), 1, 12) AS p FROM ed)
SELECT c || ',' || p AS value FROM o UNION ALL SELECT DISTINCT 'n' || substr(md5(node), 1, 12) || ',' FROM nodes WHERE node NOT IN (SELECT child FROM ed)""")
def scan_export_tree(s, sf):
    """The hierarchy as text lines for other scanners."""
    from ..operators import hierarchy

    nodes = stored(_nodes(s, sf), "nodes")
    return io.scan_export(nodes, hierarchy.edges(nodes), d.counts(s, sf))[0]


@query(f"WITH {B} SELECT 'n' || substr(md5(entity), 1, 12) || ',' || n || ',' || q AS value FROM cnt")
def scan_export_cases(s, sf):
    """Its cases as text lines."""
    nodes = _nodes(s, sf)
    return io.scan_export(nodes, nodes.select(F.col("node").alias("child"), F.col("node").alias("parent")), d.counts(s, sf))[1]


@query("SELECT n_regionkey, count(*)::BIGINT AS n, sum(c_acctbal > 0)::BIGINT AS positive FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey")
def sql_text(s, sf):
    """SQL text over registered views."""
    io.register_views(s, sf, ["customer", "nation"])
    return s.sql("SELECT n_regionkey, count(*) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS positive FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey")


@query(f"WITH {B} SELECT entity, quarter, n FROM cnt")
def cached_counts(s, sf):
    """Counts built once under a key and read from the cache after."""
    path = _folder(s, "cache")
    first = io.cached(s, path, f"{sf}|counts", lambda: d.counts(s, sf).select("entity", "quarter", "n"))
    again = io.cached(s, path, f"{sf}|counts", lambda: first.limit(0))
    return again


# --- data behind figures ------------------------------------------------------------------------------
@query(f"WITH {B} SELECT entity, q, n::BIGINT AS n, {_r('100.0 * n / n_total', 'share_pct')} FROM dn")
def share_heatmap(s, sf):
    """Each brand's share of each quarter's orders, quarters without any included."""
    c, n = d.counts(s, sf), d.denom(s, sf)
    grid = c.select("entity").distinct().crossJoin(F.broadcast(n.select("q", "n_total")))  # a row a quarter
    out = grid.join(c.select("entity", "q", "n"), ["entity", "q"], "left").fillna(0, ["n"])
    return r6(out.select("entity", "q", "n", (100.0 * F.col("n") / F.col("n_total")).alias("share_pct")), "share_pct")


@query(f"WITH {B} SELECT entity, quarter, q, n, n - coalesce(lag(n) OVER (PARTITION BY entity ORDER BY q), 0) AS more, q = min(q) OVER (PARTITION BY entity) AS first_seen FROM cnt")
def emergence_quarters(s, sf):
    """Each brand's counts by quarter, the change since it was last seen, and whether it is new."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("q")
    return d.counts(s, sf).select("entity", "quarter", "q", "n", (F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0))).alias("more"), (F.col("q") == F.min("q").over(Window.partitionBy("entity"))).alias("first_seen"))


@query(f"""WITH {BS}, k AS (SELECT case_id, any_value(quarter) AS quarter, count(*) AS k FROM m GROUP BY 1), g AS (SELECT quarter, least(k, 4)::INT AS entities, count(*)::BIGINT AS cases FROM k GROUP BY 1, 2)
SELECT quarter, entities, cases, {_r('100.0 * cases / sum(cases) OVER (PARTITION BY quarter)', 'share_pct')} FROM g""")
def composition_stack(s, sf):
    """How many of each quarter's orders name one brand, two, three, or four and more."""
    from pyspark.sql import Window

    k = d.mentions(s, sf, False).groupBy("case_id", "quarter").agg(F.least(F.count("*"), F.lit(4)).cast("int").alias("entities"))
    g = k.groupBy("quarter", "entities").agg(F.count("*").alias("cases"))
    return r6(g.withColumn("share_pct", 100.0 * F.col("cases") / F.sum("cases").over(Window.partitionBy("quarter"))), "share_pct")
