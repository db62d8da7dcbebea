"""Sources and the streaming detector on small files."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.sources import io
from tidewatch.streaming import daily


def test_boundaries(spark, tmp_path):
    square = lambda x, y: [[x, y], [x + 2, y], [x + 2, y + 2], [x, y + 2], [x, y]]
    shapes = [{"type": "Feature", "properties": {"zip": "a"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0)]}}, {"type": "Feature", "properties": {"zip": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(2, 0)], [square(8, 8)]]}}]
    (tmp_path / "z.json").write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))
    b = io.read_boundaries(spark, str(tmp_path / "z.json"), "zip")
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 0.5), (3, 9.0, 9.0), (4, 5.0, 5.0)], "id long, x double, y double")
    assert {r.id: r.zone for r in io.locate(p, b, 1.5).collect()} == {1: "a", 2: "b", 3: "b", 4: None}


def test_csv_and_population(spark, tmp_path):
    df = spark.createDataFrame([("1", 2.0), (None, None)], "a string, b double")
    io.write_csv(df, str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), "a string, b double", ["b"]).where("b = 2").count() == 1
    body = spark.createDataFrame([('[["P","zip"],["100","90001"],["-666666666","90002"]]',)], "body string")
    got = {r.zipcode: r.population for r in io.population_rows(body, F.lit(2020)).collect()}
    assert got == {"90001": 100.0, "90002": None}
    pop = spark.createDataFrame([("z", 2020, 100.0), ("z", 2021, 200.0)], "zipcode string, year int, population double")
    q = spark.createDataFrame([(2019 * 4,), (2020 * 4 + 3,), (2023 * 4,)], "q int")
    assert [round(r.population, 6) for r in io.population_by_quarter(pop, q).orderBy("q").collect()] == [100.0, 137.5, 200.0]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, 1) + timedelta(days=d, hours=h), "x" if h % 2 else "y") for d in range(16) for h in range(6 + d % 3)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = daily.daily_counts(stream).writeStream.outputMode("append").foreachBatch(daily.append_batches(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    whole = df.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    kept = closed.select("day").distinct()
    assert sorted(map(tuple, closed.select("day", "event_type", "n").collect())) == sorted(map(tuple, whole.join(kept, "day", "left_semi").select("day", "event_type", "n").collect()))
    assert kept.count() >= 13 and daily.daily_scores(whole).count() > 0


def test_dates_views_cache_and_arrays(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id,when\n1,2020-03-04\n2,3/4/2020\n3,Mar 2020\n4,nothing\n")
    got = {r.id: str(r.when) for r in io.read_dated_csv(spark, str(tmp_path / "d.csv"), "id int, when string", ["when"]).collect()}
    assert got == {1: "2020-03-04", 2: "2020-03-04", 3: "2020-03-01", 4: "None"}
    spark.range(5).write.parquet(str(tmp_path / "orders.parquet"))
    io.register_views(spark, str(tmp_path), ["orders"])
    assert spark.sql("SELECT count(*) AS n FROM orders").first().n == 5
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for key in ("a", "a", "b", "a"):
        assert io.cached(spark, str(tmp_path / "cache"), key, build).count() == 3
    assert len(built) == 2
    io.write_npz(spark.range(4), str(tmp_path / "x.npz"))
    import numpy as np

    assert sorted(np.load(tmp_path / "x.npz")["id"].tolist()) == [0, 1, 2, 3]


def test_command_line(spark, tmp_path, capsys):
    from tidewatch.__main__ import main

    main(["list"])
    assert "ratio_sweep" in capsys.readouterr().out
    main(["run", "quarterly_counts", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
