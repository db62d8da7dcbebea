"""Sources and sinks: CSV and Parquet tables with explicit schemas, GeoJSON boundaries, population
tables from JSON responses, and the text export of a hierarchy for other scanners."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import mixed_date

RING = "array<array<double>>"


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of a CSV file with a header; ``columns`` prunes what is parsed. Bad values are NULL."""
    df = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")
    return df.select(*columns) if columns else df


def read_dated_csv(spark: SparkSession, path: str, schema: str, dates: list[str], columns: list[str] | None = None) -> DataFrame:
    """The same with date columns in mixed spellings (or a month and year alone, read as its first day)
    parsed to dates; what no spelling fits is NULL."""
    df = read_csv(spark, path, schema, columns)
    month = lambda c: F.coalesce(*[F.try_to_timestamp(F.concat(F.lit("1 "), c), F.lit(f)).cast("date") for f in ("d MMM yyyy", "d MMMM yyyy", "d M/yyyy")])
    return df.withColumns({c: F.coalesce(mixed_date(F.col(c).cast("string")), month(F.col(c).cast("string"))) for c in dates if c in df.columns})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(by or [])).parquet(path)


def read_boundaries(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(zone, ring, holes): the polygons of a GeoJSON feature collection, multipolygons one by one: each one's
    outer ring and the rings of its holes."""
    feature = "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    text = spark.read.text(path, wholetext=True)
    features = text.select(F.explode(F.from_json("value", f"struct<features: array<{feature}>>")["features"]).alias("f"))
    zone = F.col("f.properties")[key].alias("zone")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", f"array<{RING}>"))).otherwise(F.from_json("f.geometry.coordinates", f"array<array<{RING}>>"))
    return features.select(zone, F.explode(polygons).alias("p")).select("zone", F.col("p")[0].alias("ring"), F.slice("p", 2, 1 << 30).alias("holes"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring: an odd number of edges crosses the ray to its right."""
    edges = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(ring[i].alias("a"), ring[i + 1].alias("b")))

    def crosses(e):
        ax, ay, bx, by = e["a"][0], e["a"][1], e["b"][0], e["b"][1]
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay).otherwise(1.0) + ax)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def locate(points: DataFrame, boundaries: DataFrame, cell: float) -> DataFrame:
    """Points (id, x, y) with the zone that holds them, holes apart: rings are dealt to the cells of their boxes, and
    a point is tested against the rings of its own cell only. Of several zones the least is named."""
    at = lambda c: F.floor(c / cell).cast("int")
    span = lambda i: F.sequence(at(F.array_min(F.transform("ring", lambda p: p[i]))), at(F.array_max(F.transform("ring", lambda p: p[i]))))
    boxes = boundaries.withColumn("cx", F.explode(span(0))).withColumn("cy", F.explode(span(1)))
    cells = points.withColumns({"cx": at(F.col("x")), "cy": at(F.col("y"))})
    within = inside(F.col("x"), F.col("y"), F.col("ring"))
    if "holes" in boundaries.columns:
        within = within & ~F.coalesce(F.exists("holes", lambda h: inside(F.col("x"), F.col("y"), h)), F.lit(False))
    hit = cells.join(boxes, ["cx", "cy"]).where(within).groupBy("id").agg(F.min("zone").alias("zone"))
    return points.join(hit, "id", "left")


def population_rows(responses: DataFrame, year: Column, least: float = -1e6) -> DataFrame:
    """(zipcode, year, population) from (body): JSON arrays whose first row names the columns; values at
    or under ``least`` are sentinels and become NULL."""
    rows = responses.select(year.alias("year"), F.explode(F.slice(F.from_json("body", "array<array<string>>"), 2, 1 << 30)).alias("r"))
    n = F.col("r")[0].try_cast("double")
    return rows.select(F.element_at("r", -1).alias("zipcode"), "year", F.when(n > least, n).alias("population"))


def population_by_quarter(population: DataFrame, quarters: DataFrame) -> DataFrame:
    """(zipcode, q, population) at mid-quarter: linear between mid-year estimates, flat outside them."""
    at = F.floor(F.col("q") / 4) + (F.pmod(F.col("q"), F.lit(4)) + 0.5) / 4 - 0.5
    span = population.where("population IS NOT NULL").groupBy("zipcode").agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    grid = span.crossJoin(F.broadcast(quarters.select("q"))).withColumn("t", F.greatest(F.col("y0").cast("double"), F.least(F.col("y1").cast("double"), at)))  # a row a quarter
    p = population.where("population IS NOT NULL")
    low = p.select("zipcode", F.col("year").alias("ya"), F.col("population").alias("pa"))
    high = p.select("zipcode", F.col("year").alias("yb"), F.col("population").alias("pb"))
    g = grid.withColumns({"ya": F.floor("t").cast("int"), "yb": F.ceil("t").cast("int")}).join(low, ["zipcode", "ya"], "left").join(high, ["zipcode", "yb"], "left")
    return g.select("zipcode", "q", (F.col("pa") + (F.col("pb") - F.col("pa")) * (F.col("t") - F.col("ya"))).alias("population"))


def scan_export(nodes: DataFrame, edges: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text lines of a tree (node, parent) and of its cases (leaf, count, quarter) under opaque ids."""
    opaque = lambda c: F.concat(F.lit("n"), F.substring(F.md5(c), 1, 12))
    tree = edges.select(F.concat_ws(",", opaque(F.col("child")), opaque(F.col("parent"))).alias("value"))
    roots = nodes.select("node").distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti").select(F.concat(opaque(F.col("node")), F.lit(",")).alias("value"))
    return tree.unionByName(roots), counts.select(F.concat_ws(",", opaque(F.col("entity")), F.col("n").cast("string"), F.col("q").cast("string")).alias("value"))


def register_views(spark: SparkSession, folder: str, tables: list[str]) -> None:
    """Parquet tables of a folder as temporary views, for SQL text."""
    for t in tables:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)


def cached(spark: SparkSession, path: str, key: str, build) -> DataFrame:
    """The table at ``path`` if it was written under ``key`` (a text that names inputs and parameters), else
    ``build()``, written there. A table of another key, or one whose writing broke off, is built anew."""
    full = f"{path.rstrip('/')}/{xxhash.xxh64_hexdigest(key)}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(full + "/_SUCCESS")
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        build().write.mode("overwrite").parquet(full)
    return spark.read.parquet(full)


def write_npz(df: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """A table of numbers and texts as one .npz file of arrays, for plotting; its size is checked, since
    the file is written by the driver."""
    n = df.limit(most_rows + 1).count()
    if n > most_rows:
        raise ValueError(f"over {most_rows} rows: write Parquet")
    np.savez(path, **{c: v.to_numpy() for c, v in df.toPandas().items()})
