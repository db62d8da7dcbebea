"""The test tables as event records: orders are cases, parts on their lines are mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import quarter_ordinal, quarter_start
from ..operators.counting import complete_quarters, distinct_mentions, quarterly_counts
from ..session import table

#: Risers are planted by rule: three brands lose three quarters of their lines before a date each.
PLANTED = [("Brand#7", "1999-01-01"), ("Brand#12", "2000-01-01"), ("Brand#21", "1998-04-01")]


def planted() -> str:
    return " OR ".join(f"(p_brand = '{b}' AND l_partkey % 8 <> 0 AND o_orderdate < DATE '{d}')" for b, d in PLANTED)


def cases(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("event_date"), F.col("o_custkey"), "o_orderpriority", "o_totalprice")


def raw_mentions(spark: SparkSession, sf: str, risers: bool = True, entity: str = "p_brand") -> DataFrame:
    """(case_id, event_date, entity, category, line order) before counting."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    m = li.join(p, li["l_partkey"] == p["p_partkey"]).join(o, li["l_orderkey"] == o["o_orderkey"])
    if risers:
        m = m.where(f"NOT ({planted()})")
    return m.select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("event_date"), F.expr(entity).alias("entity"), F.col("p_type").alias("category"), "p_name", "l_linenumber", "l_partkey", "l_suppkey")


def mentions(spark: SparkSession, sf: str, risers: bool = True, entity: str = "p_brand") -> DataFrame:
    return distinct_mentions(raw_mentions(spark, sf, risers, entity))


def denom(spark: SparkSession, sf: str) -> DataFrame:
    return complete_quarters(cases(spark, sf))


def counts(spark: SparkSession, sf: str, risers: bool = True, entity: str = "p_brand") -> DataFrame:
    return quarterly_counts(mentions(spark, sf, risers, entity), denom(spark, sf))


def ordered(spark: SparkSession, sf: str) -> DataFrame:
    """(case_id, q, seq): the brands of an order in line order, each once."""
    r = raw_mentions(spark, sf, False)
    first = r.groupBy("case_id", "event_date", "entity").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("at"))
    g = first.groupBy("case_id", "event_date").agg(F.sort_array(F.collect_list(F.struct("at", "entity"))).alias("s"))  # an order's lines
    return g.select("case_id", quarter_ordinal(quarter_start("event_date")).alias("q"), F.transform("s", lambda x: x["entity"]).alias("seq"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """(id, x, y, label): the first two coordinates of the embeddings, in units of a thousandth."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 1000).alias("x"), (F.col("embedding")[1].cast("double") * 1000).alias("y"), "label")


# DuckDB forms of the same tables, for the oracles.
def _quarter(x: str) -> str:
    return f"date_trunc('quarter', {x})::DATE"


def _ordinal(x: str) -> str:
    return f"(year({x}) * 4 + quarter({x}) - 1)::INT"


def base_sql(risers: bool = True, entity: str = "p_brand") -> str:
    """CTEs m (case_id, entity, quarter), den (quarter, q, n_total), cnt (entity, quarter, q, n), dn (dense)."""
    keep = f"WHERE NOT ({planted()})" if risers else ""
    return f"""
lastd AS (SELECT max(o_orderdate)::DATE AS d FROM orders),
m AS (SELECT DISTINCT o_orderkey AS case_id, {entity} AS entity, {_quarter("o_orderdate")} AS quarter
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey {keep}),
den AS (SELECT {_quarter("o_orderdate")} AS quarter, any_value({_ordinal("o_orderdate")}) AS q, count(*)::BIGINT AS n_total FROM orders
        GROUP BY 1 HAVING {_quarter("any_value(o_orderdate)")} + INTERVAL 3 MONTH - INTERVAL 1 DAY <= (SELECT d FROM lastd)),
cnt AS (SELECT entity, quarter, any_value(q) AS q, count(*)::BIGINT AS n FROM m JOIN den USING (quarter) GROUP BY 1, 2),
dn AS (SELECT e.entity, den.q, den.n_total, coalesce(cnt.n, 0) AS n FROM (SELECT DISTINCT entity FROM cnt) e CROSS JOIN den LEFT JOIN cnt ON cnt.entity = e.entity AND cnt.q = den.q)"""
