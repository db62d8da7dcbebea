"""The corpus pipeline, stage by stage, against brute force on a small corpus."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidewatch.llm import spm  # noqa: E402
from tidewatch.llm.mix import source_rates  # noqa: E402

RNG = np.random.default_rng(21)
WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(RNG.choice(WORDS, n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    good = [prose(int(RNG.integers(30, 90))) for _ in range(120)]
    passage = prose(30)
    good[7] = good[3]
    good[9] = good[5].replace(good[5].split()[10], "changed", 1)
    good[20], good[21] = prose(20) + " " + passage, prose(25) + " " + passage
    junk = [" ".join(w.upper() + "!!" for w in prose(40).split()) for _ in range(80)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good + junk)]
    rows += [rows[11], rows[11], (500, "", "en", None, 0), (501, None, None, "s1", None), (None, good[0], "en", "s0", 1)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def words_of(t):
    return (t or "").encode().split()


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    names = list(stage)
    assert [n.split()[0] for n in names] == ["quality", "MinHash", "substring", "mixing", "SentencePiece"]

    kept = stage[names[0]](spark, docs, folder).cache()
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert sum(ids[i] > 0 for i in range(120)) >= 115 and sum(ids[i] > 0 for i in range(120, 200)) <= 4 and ids[11] == 3

    unique = stage[names[1]](spark, docs, folder).cache()
    got = Counter(r.doc_id for r in unique.collect())
    assert unique.columns == docs.columns and got[3] == 1 and got[7] == 0 and got[5] == 1 and got[9] == 0 and got[11] == 1 and got[None] == 1 and got[500] == got[501] == 1
    assert sum(got.values()) == len(rows) - 4  # a copy, a near copy, two repeats

    cut = stage[names[2]](spark, docs, folder)
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words_of(t)
        for s in range(len(w) - 12):
            first.setdefault(tuple(w[s : s + 13]), i)
    assert cut.columns == docs.columns
    for r in cut.collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        w = words_of(text)
        gone = {x for s in range(len(w) - 12) if r.doc_id is not None and first[tuple(w[s : s + 13])] < r.doc_id for x in range(s, s + 13)}
        assert words_of(r.text) == [x for k, x in enumerate(w) if k not in gone] and r.n_chars == len(r.text or "")

    mixed = stage[names[3]](spark, docs, folder)
    assert mixed.columns == docs.columns
    rates = {r._source: r._rate for r in source_rates(docs).collect()}
    size = Counter(r.source for r in mixed.collect())
    for source, n in Counter(r[3] for r in rows).items():
        assert abs(size[source] - n * rates[source]) < 6 * (n * rates[source]) ** 0.5 + 1

    sp = spm.load(open(spm.MODEL, "rb").read())
    for r in stage[names[4]](spark, docs, folder).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert list(r.piece_ids) == sp.encode(text or "") and r.n_pieces == len(r.piece_ids) and r.round_trip


def test_run(spark, corpus):
    folder, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    ids = {r.doc_id for r in rows}
    assert rows and 7 not in ids and 9 not in ids and len([i for i in ids if i is not None and 120 <= i < 200]) <= 4
    assert all(r.round_trip and len({s.crc32 for s in r.samples}) == len(r.samples) for r in rows)
    again = corpus_pipeline.run(spark, folder).select("doc_id", F.col("samples.crc32").alias("c")).collect()
    assert Counter((r.doc_id, tuple(s.crc32 for s in r.samples)) for r in rows) == Counter((r.doc_id, tuple(r.c)) for r in again)


def test_empty(spark, corpus, tmp_path):
    folder, _ = corpus
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_texts_go_to_python_in_small_batches(spark, corpus):
    """An executor holds a batch of texts several times, in Spark's, Arrow's and Python's memory."""
    folder, _ = corpus
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(bound)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long = spark.range(0, 4000, 1, 1).withColumn("text", F.repeat(F.lit("a text "), 1000))
    for _, stage in [x for x in corpus_pipeline.STAGES if not x[0].startswith("mixing")]:
        spark.conf.unset(bound)
        stage(spark, docs.limit(0), folder)
        assert long.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0] < 6_000_000
    spark.conf.set(bound, "123456b")
    corpus_pipeline.encoding(spark, docs, folder)
    assert spark.conf.get(bound) == "123456b"
    spark.conf.unset(bound)
