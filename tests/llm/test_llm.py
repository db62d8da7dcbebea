"""The training-data operators on small awkward inputs, against brute force."""

import functools
import hashlib
import itertools
import math
import textwrap
import time
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import ann, licences, quality, spm
from tidewatch.llm.ann import nearest
from tidewatch.llm.components import connected_components
from tidewatch.llm.embed_dedup import near_duplicate_vectors
from tidewatch.llm.licences import LICENCES, scan_licences
from tidewatch.llm.lm import EliasFano, score_documents
from tidewatch.llm.minhash import near_duplicates
from tidewatch.llm.mix import mix_sources, source_rates
from tidewatch.llm.quality import classify_quality, isotonic
from tidewatch.llm.shard import shard_by_bytes
from tidewatch.llm.substring import remove_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size long, label string, id long, key string"
RNG = np.random.default_rng(3)
VOCABULARY = [f"w{i}" for i in range(300)]


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY, n))


@functools.cache
def awkward():
    """Nulls, empties, repeats, near copies, shared passages, a long text, spaces of all kinds."""
    base, passage = sentence(60), sentence(30)
    near = base.split()
    near[5] = "changed"
    texts = [None, "", "   ", "one", base, base, " ".join(near), base.upper(), passage + " " + sentence(20), sentence(25) + "\t" + passage, sentence(9000), "a b c d", "a b c d", "é ü x \x0b y", "Released under the MIT License."]
    rows = [(i, t, None if i % 3 else "en", None if i == 4 else f"s{i % 3}", None, 7, 7, "x", 7, "k") for i, t in enumerate(texts)]
    return rows + [(None, base, None, None, None, 7, 7, "x", 7, "k"), rows[4], rows[4]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(n, pairs):
    par = list(range(n))

    def top(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        par[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    pairs = [(int(a), int(b)) for a, b in RNG.integers(0, 200, (150, 2))]
    df = spark.createDataFrame([*pairs, (5, 5), (None, 3)], "a long, b long")
    want = labels_of(200, pairs)
    for batch in (7, 1 << 20):
        got = {r.node: r.component for r in connected_components(df, batch=batch).collect()}
        assert got and all(want[k] == v for k, v in got.items())
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(path, most_rounds=1, batch=3)
    assert connected_components(df.limit(0)).count() == 0


def test_sharding(spark, docs, none):
    rows = shard_by_bytes(docs, 4).collect()
    text = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in awkward())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == text
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shard_by_bytes(none).count() == 0
    even = spark.createDataFrame([(i, "x" * int(RNG.integers(1, 90)) + str(i)) for i in range(4000)], "doc_id long, text string")
    sizes = [r.b for r in shard_by_bytes(even).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 200


def test_mixing(spark, docs, none):
    assert mix_sources(none).count() == 0
    a = mix_sources(docs).drop("_rate").collect()
    assert sorted(map(repr, a)) == sorted(map(repr, mix_sources(docs.repartition(3)).drop("_rate").collect()))
    many = spark.createDataFrame([(i, "t", "big" if i % 10 else "small") for i in range(20000)], "doc_id long, text string, source string")
    want = spark.createDataFrame([("big", 0.2), ("small", 0.8)], "source string, weight double")
    n = {r.source: r["count"] for r in mix_sources(many, want).groupBy("source").count().collect()}
    assert n["big"] == pytest.approx(4000, rel=0.08) and n["small"] == pytest.approx(16000, rel=0.08)
    counts = np.array([r.c for r in mix_sources(many, want).where("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("c")).collect()])
    assert np.var(np.append(counts, np.zeros(2000 - len(counts)))) == pytest.approx(8, rel=0.15)
    rates = {r._source: r._rate for r in source_rates(many, want).collect()}
    assert rates["small"] == pytest.approx(8) and rates["big"] == pytest.approx(2 / 9)


def test_licences(spark, docs, none):
    got = {r.doc_id: r for r in scan_licences(docs).collect()}
    assert got[14].whole_licence == "MIT" and got[14].licences == "MIT" and got[4].licences == "" and got[0].whole_licence is None
    assert scan_licences(docs).count() == docs.count() and scan_licences(none).count() == 0
    mit = LICENCES["MIT"][-1]
    odd = [(1, "Copyright (c) 2020 Some One\n" + mit.replace(". ", ".\n").upper()), (2, mit + " more"), (3, "RELEASED under the MIT Licence!")]
    out = {r.doc_id: r for r in scan_licences(spark.createDataFrame(odd, "doc_id long, text string")).collect()}
    assert out[1].whole_licence == "MIT" and out[2].whole_licence is None and out[3].whole_licence == "MIT"


def test_large_catalogues_are_joined(spark, docs):
    """Either way of looking digests up gives the same rows."""
    both = [sorted(map(repr, scan_licences(docs, most_known=n).collect())) for n in (licences.MOST_KNOWN, 3)]
    assert both[0] == both[1] and len(both[0]) == docs.count()


def test_published_licence_files(spark):
    """Files as published: titles, wrapped lines, copyright lines of all orders, and the long texts."""
    folder = Path(licences.__file__).parent / "licence_texts"
    wrap = lambda t: textwrap.fill(t, 76)
    mit, isc = LICENCES["MIT"][-1], LICENCES["ISC"][-1]
    bsd = "\n\n".join([wrap(licences._BSD[0]), *(wrap(f"* {x}") for x in licences._BSD[1:4]), wrap(licences._BSD[4])])
    heads = ["Copyright (c) 2020 Jane Doe", "Copyright (c) Jane Doe 2020", "Copyright [yyyy] [name of copyright owner]", "© Jane Doe, 2020", "Copyright Jane Doe and others, 2019-2021. All rights reserved."]
    files = [("MIT", f"MIT License\n\n{h}\n\n{wrap(mit)}") for h in heads]
    files += [("ISC", f"ISC License\n\n{heads[1]}\n\n{wrap(isc)}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{heads[0]}\nAll rights reserved.\n\n{bsd}")]
    files += [(f.stem, f.read_text("utf-8")) for f in sorted(folder.glob("*.txt"))]
    files.append(("Apache-2.0", (folder / "Apache-2.0.txt").read_text("utf-8").replace("[yyyy] [name of copyright owner]", "2021 Jane Doe")))
    files.append((None, wrap(mit)[:-40]))
    rows = scan_licences(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(files)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.whole_licence for r in rows} == {i: k for i, (k, _) in enumerate(files)}


def test_quality(spark, docs, none):
    good = [(i, sentence(int(RNG.integers(5, 80))).capitalize() + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(w + "!!" for w in sentence(int(RNG.integers(5, 80))).upper().split())) for i in range(300)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in bad] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = classify_quality(df, labels).collect()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([(r.doc_id < 1000) == bool(r.predicted) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    mixed = classify_quality(docs, labels).collect()
    assert len(mixed) == docs.count() and all(0 <= r.score <= 1 for r in mixed) and all(r.held_out is False for r in mixed if r.doc_id is None)
    assert classify_quality(none, labels).count() == 0 and all(r.score == 0.5 for r in classify_quality(docs, labels.limit(0)).collect())
    assert isotonic(np.array([0.9, 0.1, 0.5]), np.array([2.0, 3.0, 1.0])) == pytest.approx([0.42, 0.42, 0.5])


def test_quality_equals_a_plain_fit(spark):
    """Standardised statistics, cosine features, ridge and isotonic steps, on one machine with no partitions."""
    rng = np.random.default_rng(12)
    texts = [sentence(int(rng.integers(3, 60))) + ("!!" if i % 3 else ".") * int(rng.integers(1, 4)) for i in range(400)]
    y = np.array([int(rng.random() < (0.2 if i % 3 else 0.8)) for i in range(400)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(v), 0) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify_quality(df, labels).collect()}
    x = np.array([np.nan_to_num(np.asarray(quality.statistics_of(t), np.float32)) for t in texts], float)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(400)])
    learn = fold > 0
    mean, sd = x[learn].mean(0), x[learn].std(0)
    sd[sd < 1e-5] = 1.0
    rng = np.random.default_rng(5)
    freq, phase = rng.standard_normal((x.shape[1], 160)) / np.sqrt(x.shape[1] / 2), rng.uniform(0, 2 * np.pi, 160)
    z = np.clip((x - mean) / sd, -6, 6)
    f = np.hstack([np.ones((400, 1)), z, np.cos(z @ freq + phase) * np.sqrt(2 / 160)])
    ridge = fold > 1
    penalty = 1e-3 * ridge.sum() * np.eye(f.shape[1])
    penalty[0, 0] = 1e-9
    raw = f @ np.linalg.solve(f[ridge].T @ f[ridge] + penalty, f[ridge].T @ y[ridge])
    order = [i for i in np.argsort(raw, kind="stable")]
    rank = [got[i].score for i in order]
    assert all(b >= a - 1e-9 for a, b in zip(rank, rank[1:]))  # calibration keeps the ridge's order
    steps = np.round(raw * 1000).astype(int)
    bins = sorted(set(steps[fold == 1]))
    s, n = (np.array([v[(fold == 1) & (steps == b)].sum() for b in bins], float) for v in (y, np.ones(400)))
    base = s.sum() / n.sum()
    levels = isotonic((s + 0.02 * base) / (n + 0.02), n)
    for i in range(400):
        assert got[i].score == pytest.approx(float(np.interp(raw[i], np.array(bins) / 1000, levels)), abs=2e-3)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_minhash(spark, docs, none):
    rows = [r for r in awkward() if r[0] is not None]
    ids = sorted({r[0] for r in rows})
    sets = {r[0]: shingles(r[1]) for r in rows}
    link = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = labels_of(len(ids), link)
    got = near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_duplicates(none).count() == 0


def test_minhash_crowd(spark):
    """A crowd whose members are like each other around the threshold: links are those of brute force."""
    base = sentence(80).split()
    texts = []
    for i in range(120):
        w = list(base)
        for at in RNG.choice(80, int(RNG.integers(1, 4)), replace=False):
            w[at] = f"x{i}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    want = labels_of(120, [(a, b) for a, b in itertools.combinations(range(120), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))


def test_substring(spark, docs, none):
    rows = awkward()
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (r[1] or "").encode().split()
        for s in range(len(w) - 12):
            first.setdefault(tuple(w[s : s + 13]), r[0])
    got = remove_repeats(docs).collect()
    assert len(got) == len(rows) and set(docs.columns) < set(remove_repeats(docs).columns)
    for r in got:
        w = (r.text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if r.doc_id is not None and first[tuple(w[s : s + 13])] < r.doc_id:
                gone[s : s + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone) if not g]
        assert (r._n_words, r._n_removed, r._kept_sha256) == (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    assert remove_repeats(none).count() == 0


def test_lm(spark, docs, none, tmp_path):
    for n, top in ((0, 1), (1, 5), (4097, 1 << 40), (9000, 100)):
        v = np.sort(RNG.integers(0, top, n).astype(np.uint64))
        e = EliasFano(v, str(tmp_path), f"{n}")
        q = np.sort(np.concatenate([v, RNG.integers(0, top, 50).astype(np.uint64)]))
        assert (e.find(q) == np.searchsorted(v, q)).all() and (e.take(np.arange(n)) == v).all()
    rows = awkward()
    tokens = [[*(r[1] or "").encode().lower().split(), None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    c = Counter(t for ts, h in zip(tokens, held) if not h for t in ts)
    total = sum(c.values())
    got = score_documents(docs).collect()
    model = plain_model([t for t, h in zip(tokens, held) if not h])
    want = Counter((r[0], len(t), sum(c[x] > 0 for x in t), round(sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in t), 4)) for r, t in zip(rows, tokens))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == total for r in got) and score_documents(none).count() == 0
    scores = sorted((r[0] is None, r[0] or 0, model(t), len(t)) for r, t in zip(rows, tokens))
    again = score_documents(docs.repartition(3)).collect()
    for out in (got, again):  # rounding: three parts of a probability, each up to 1/4096 of a digit too low; a smaller T gives more to seen words
        for (_, i, want, n), r in zip(scores, sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in out)):
            assert r[1] == i and -n / 4096 <= want - r[2] <= 3 * n / 4096
    big = spark.createDataFrame([(9007199254740993, "a b"), (9007199254740995, "a"), (None, "b")], "doc_id long, text string")
    assert {r.doc_id for r in score_documents(big).collect()} == {9007199254740993, 9007199254740995, None}


def plain_model(texts):
    """The interpolated trigram model, by dictionaries."""
    n1, n2, n3 = Counter(), Counter(), Counter()
    for t in texts:
        s = ["<s>", *t]
        n1.update(t)
        n2.update(zip(s, s[1:]))
        n3.update(zip(s, s[1:], s[2:]))
    n1["<s>"] = len(texts)
    types2, types3 = Counter(a for a, _ in n2), Counter((a, b) for a, b, _ in n3)
    total, kinds = sum(v for k, v in n1.items() if k != "<s>"), len(n1) - 1

    def score(t):
        s, out = ["<s>", *t], 0.0
        for i, w in enumerate(t):
            b = s[i]
            p = (n1[w] + 1) / (total + kinds + 1)
            p = (n2[b, w] + types2[b] * p) / (n1[b] + types2[b]) if n1[b] else p
            if i and n2[s[i - 1], b]:
                p = (n3[s[i - 1], b, w] + types3[s[i - 1], b] * p) / (n2[s[i - 1], b] + types3[s[i - 1], b])
            out += math.log10(p)
        return out

    return score


def test_vectors(spark):
    x = RNG.normal(size=(90, 8))
    x[30:60] = x[3] + 0.15 * RNG.normal(size=(30, 8))
    vs = [(i, list(map(float, v)), "l") for i, v in enumerate(x)]
    vs += [(90, vs[0][1], "l"), (91, None, "l"), (92, [0.0] * 8, "l"), (93, [float("nan")] * 8, "l"), (94, [1.0], "l"), (95, [None] * 8, "l")]
    schema = "vec_id long, embedding array<double>, label string"
    df = spark.createDataFrame(vs, schema)
    u = np.vstack([x, x[:1]])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    want = labels_of(91, zip(*np.nonzero(s)))
    got = {r.vec_id: r for r in near_duplicate_vectors(df, tile=16).collect()}
    assert len(got) == 96
    for i in range(91):
        assert (got[i].n_links, got[i].component_id) == (s[i].sum(), want[i])
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(91, 96))
    assert near_duplicate_vectors(df.limit(0)).count() == 0
    near = nearest(df, every=10, k=5).collect()
    p = np.vstack([x, x[:1]])
    for q in range(0, 91, 10):
        order = sorted((i for i in range(91) if i != q), key=lambda i: (-round(float(p[q] @ p[i]), 9), i))[:5]
        rows = sorted((r for r in near if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in rows] == order and rows[0].score == pytest.approx(float(p[q] @ p[order[0]]))
    assert {(r.query_id, r.vec_id) for r in nearest(df.where("vec_id in (94, 0, 10)").withColumn("id", F.lit(1)), every=10).collect()} == {(0, 10), (10, 0)}
    assert nearest(df.limit(0)).count() == 0


def test_neighbours_in_islands(spark):
    """Tight clusters of more near copies than a list holds, most without a pivot, and a cell too full."""
    rng = np.random.default_rng(8)
    hubs = rng.normal(size=(30, 16))
    x = np.vstack([np.repeat(hubs, 30, 0) + 1e-3 * rng.normal(size=(900, 16)), hubs[:1] + 1e-2 * rng.normal(size=(300, 16))])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, every=10, k=10, degree=8, leaf=32).collect()
    hit = 0
    for q in range(0, 1200, 10):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:10].tolist()))
    assert len(got) == 1200 and hit >= 0.97 * 1200


def test_clashing_names(spark):
    """Columns that are called like an operator's own, or like its working ones."""
    names = "_rate _copies _copy _ORDER _mix _salt _u _source _draws _cdf _n_words _n_removed _kept_sha256 _kept_text _key _of _wins _i _hs _n_pieces _samples _ids _text h lo w x id key chunk blob bucket label".split()
    text = sentence(40)
    rows = [(i, text if i < 3 else sentence(30), "s", *[7] * len(names)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    assert {r.doc_id: r._n_removed for r in remove_repeats(df).collect()} == {0: 0, 1: 40, 2: 40, 3: 0, 4: 0, 5: 0}
    coded = spm.decode_pieces(spm.encode_and_sample(df, with_ids=True))
    assert all(r._text == r.text and r._round_trip and r._mix == 7 for r in coded.collect())
    mixed = mix_sources(df).collect()
    assert all(abs(r._rate - 1) < 1e-3 and r._copies >= r._copy >= 1 and r._mix == 7 for r in mixed)
    assert sum(r.kept for r in near_duplicates(df).collect()) == 4
    assert shard_by_bytes(df).count() == len(score_documents(df).collect()) == scan_licences(df).count() == 6
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    assert classify_quality(df, labels).count() == 6


def test_neighbours_of_many_clusters(spark):
    """20,000 vectors in clusters of all widths, of unequal lengths: recall at 20 against brute force."""
    rng = np.random.default_rng(17)
    center = rng.normal(size=(300, 24))
    of = rng.integers(0, 300, 20000)
    x = center[of] + rng.uniform(0.02, 0.6, (300, 1))[of] * rng.normal(size=(20000, 24))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.8, 1.25, (20000, 1))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20000), "embedding": list(x)}), "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, every=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 20000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert hit >= 0.9 * 20 * 200


def test_neighbours_of_few_rows_take_few_tasks(spark):
    """A small table in a session of many shuffle partitions: tasks are as many as there is work, not partitions."""
    held = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held if spark.conf.get(k, None) is not None}
    x = np.random.default_rng(4).normal(size=(300, 8))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few", "few rows")
        got = nearest(df, every=10, k=5, beam=64, width=8).collect()
        stages = {n for j in tracker.getJobIdsForGroup("few") for n in tracker.getJobInfo(j).stageIds}
        ran = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k in held:
            spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)
    hit = 0
    for q in range(0, 300, 10):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 150 and hit >= 0.9 * 150
    assert ran < 1_500


def test_visits_of_a_search_are_the_best_open_candidates():
    """The next nodes to visit are listed and closed where lists are merged; a hub's many links are thinned batch by batch."""
    from tidewatch.llm.ann import _merged, _thinned

    state = pa.table({"blk": [0, 0], "id": [7, 3], "vec": [b"a", b"b"], "ids": [[1, 2, 5], [4]], "scores": [[0.9, 0.8, 0.1], [0.5]], "open": [[False, True, True], [False]]})
    found = pa.table({"id": [7, 3], "node": [1, 4], "ids": [[1, 9, 2], [6]], "scores": [[0.7, 0.75, 0.6], [0.6]]})
    rows = {r["id"]: r for r in _merged(4, 2)(state, found).to_pylist()}
    assert (rows[7]["ids"], rows[7]["go"], rows[7]["open"]) == ([2, 9, 1, 5], [2, 9], [False, False, False, True])
    assert (rows[3]["ids"], rows[3]["go"], rows[3]["open"]) == ([6, 4], [6], [False, False])
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(1000), pa.int64()), "ids": [[5, 10 + i] for i in range(1000)], "open": [[i >= 997, True] for i in range(1000)]})
    out = pa.Table.from_batches(_thinned(20)([batch])).to_pylist()
    hub = [r for r in out if r["m"] == 5]
    assert len(out) == 1020 and len(hub) == 20 and {997, 998, 999} == {r["id"] for r in hub if not r["old"]}


def test_dense_groups_shrink_however_they_are_dealt(spark):
    # the rebalanced partitions of a crowd are many and small here, as those of a large crowd are in a large session
    from tidewatch.llm.components import _forests, connected_components, contracted

    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rng = np.random.default_rng(5)
        a, b = rng.integers(0, 400, 20_000), rng.integers(0, 400, 20_000)
        edges = spark.createDataFrame(pd.DataFrame({"lo": np.minimum(a, b), "hi": np.maximum(a, b)})[a != b])
        once = edges.hint("rebalance", F.col("lo")).mapInPandas(_forests(1 << 20), "lo long, hi long").distinct().count()
        e, state = contracted(edges)
        assert once > 5_000 and state[0] == e.count() < once / 2
        assert {r.component for r in connected_components(edges, "lo", "hi").collect()} == {int(min(a.min(), b.min()))}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_node_is_visited_twice():
    """Nodes 1, 2 and 3 are under the floor of 2.9 that node 9 sets, but each one's neighbours have the next one's
    coded product over it; the search goes on while a query has a node to visit."""
    exact, coded, beam = {1: 1.0, 2: 1.5, 3: 2.0, 9: 2.9}, {1: (2, 3.5), 2: (3, 4.0), 3: (1, 5.0), 9: (1, 5.0)}, 2
    lists = dict(ids=pa.list_(pa.int64()), scores=pa.list_(pa.float64()), open=pa.list_(pa.bool_()), go=pa.list_(pa.int64()), seen=pa.list_(pa.int64()))
    start = dict(ids=[[1, 9]], scores=[[5.0, 2.9]], open=[[False, False]], go=[[1, 9]], seen=[[1, 9]])
    state = pa.table([pa.array([0], pa.int32()), pa.array([7], pa.int64()), pa.array([b""]), *[pa.array(start[x], t) for x, t in lists.items()]], names=["blk", "id", "vec", *lists])
    visits = []
    for _ in range(12):
        go = state["go"].to_pylist()[0]
        if not go:
            break
        visits += go
        floor = state["scores"].to_pylist()[0][-1] if len(state["ids"].to_pylist()[0]) >= beam else -math.inf
        hits = [[(n, exact[n])] + [coded[n]] * (coded[n][1] > floor) for n in go]
        found = pa.table([pa.array([0] * len(go), pa.int32()), pa.array([7] * len(go), pa.int64()), pa.array(go, pa.int64()), pa.array([[x for x, _ in h] for h in hits], lists["ids"]), pa.array([[y for _, y in h] for h in hits], lists["scores"])], names=["blk", "id", "node", "ids", "scores"])
        state = ann._merged(beam, 2)(state, found)
    assert sorted(visits) == [1, 2, 3, 9] and 9 in state["ids"].to_pylist()[0]


def test_pieces(spark, docs, none):
    sp = spm.load(open(spm.MODEL, "rb").read())
    out = spm.encode_and_sample(docs, with_ids=True).collect()
    assert len(out) == docs.count() and spm.encode_and_sample(none).count() == 0
    for r in out:
        assert list(r._ids) == sp.encode(r.text or "") and r._round_trip
        assert len({s.crc32 for s in r._samples}) == len(r._samples)
    assert [len(r._samples) for r in out if not r.text] == [0, 0]
    odd = [" ", "  a", "a  b ", "trail ", " lead", "▁x", "a▁b", "a\n\n b", "\u200b x", "日本 語", "e\u0301 o\x00"]
    for r in spm.encode_and_sample(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), with_ids=True).collect():
        assert list(r._ids) == sp.encode(r.text) and r._round_trip == (sp.decode(list(r._ids)) == r.text)


def test_pieces_are_decoded_whole(spark, docs):
    sp = spm.load(open(spm.MODEL, "rb").read())
    texts = ["one two two", "日本 語 x", ""]
    coder, whole = spm.Coder(open(spm.MODEL, "rb").read(), 1.0, 2), []

    class Watched:
        def __getattr__(self, name):
            return getattr(sp, name)

        def decode(self, ids, **_):
            whole.append([int(x) for x in ids])
            return sp.decode(ids) + "!"

    coder.sp = Watched()
    got = [x[2] for x in coder.run(texts, np.arange(3))]
    assert whole == [sp.encode(t) for t in texts if t] and got == [False, False, True]
    for r in spm.encode_and_sample(docs, with_ids=True).where("length(text) < 2000").collect():
        for s in r._samples:
            assert sp.decode(list(s.ids)) == r.text and len(s.ids) == s.n_pieces and zlib.crc32(np.array(s.ids, np.int32).tobytes()) == s.crc32


def test_forgotten_chunks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}é日" for x in rng.zipf(1.3, 60) % 500) for _ in range(80)]
    model = open(spm.MODEL, "rb").read()

    def run():
        coder = spm.Coder(model, 1.0, 2)
        out = [(n, crc, same, [(s["n_pieces"], s["crc32"]) for s in samples]) for i in range(0, 80, 8) for n, crc, same, samples, _ in coder.run(texts[i : i + 8], np.arange(i, i + 8))]
        return out, len(coder.number)

    many, held = run()
    monkeypatch.setattr(spm, "MOST_CHUNKS", 100)
    few, left = run()
    assert few == many and left < held


def test_chunks_that_come_again_are_built_once(monkeypatch):
    """Building a chunk's lattice takes most of a rare chunk's time: 130,000 that come again and again stay."""
    coder, built = spm.Coder(open(spm.MODEL, "rb").read(), 1.0, 1), []
    add = spm.Lattices.add
    monkeypatch.setattr(spm.Lattices, "add", lambda self, chunks: built.append(len(chunks)) or add(self, chunks))
    texts = [" ".join(f"w{i}" for i in range(s, s + 13_000)) for s in range(0, 130_000, 13_000)]
    first, again = ([x[:2] for i, t in enumerate(texts) for x in coder.run([t, t], np.array([i, i]))] for _ in range(2))
    assert first == again and sum(built) == 130_000


def test_forgetting_chunks_takes_little_besides():
    """Kept lattices are copied one array after another, without room to spare; what is kept is the same."""
    lat = spm.Lattices(spm.load(open(spm.MODEL, "rb").read()), 1.0)
    chunks = [f"▁word{i}naïve日" for i in range(20_000)]
    lat.build(chunks)
    stay = np.arange(0, len(chunks), 2)
    tracemalloc.start()
    lat.keep(stay)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    kept = sum(getattr(lat, x).nbytes for x in lat.PARTS)
    assert most < 2 * kept and all(lat.room[x].nbytes == getattr(lat, x).nbytes for x in lat.PARTS)
    got = {x: getattr(lat, x).copy() for x in lat.PARTS}
    lat.build([chunks[i] for i in stay])
    assert all(np.array_equal(got[x], getattr(lat, x)) if got[x].dtype != float else np.allclose(got[x], getattr(lat, x), rtol=1e-9, atol=1e-9) for x in lat.PARTS)
    lat.keep(np.arange(10))
    lat.add(chunks[:3])
    assert len(lat.start) == 13 and len(lat.ptr) == len(lat.codes) + 1


def test_lattices_are_set_up_fast_and_right():
    """Every task sets the lattices up anew; hashes of all pieces and of their beginnings are worked out by length."""
    sp, took = spm.load(open(spm.MODEL, "rb").read()), []
    for _ in range(3):
        began = time.process_time()
        lat = spm.Lattices(sp, 0.7)
        took.append(time.process_time() - began)
    slow = time.process_time()
    pieces = {i: sp.IdToPiece(i) for i in range(sp.GetPieceSize()) if not (sp.IsControl(i) or sp.IsUnknown(i) or sp.IsByte(i) or sp.IsUnused(i))}
    texts = ["▁" + w for w in ("beginnings of the pieces, 日本語 \n\ud800\ud83d\ude00 naïve e\u0301" * 2).split(" ")]
    by_text, most = {x: i for i, x in pieces.items()}, max(map(len, pieces.values()))
    hashed = 0
    for x in pieces.values():  # as long as setting up one by one takes
        for c in x:
            hashed = (hashed * int(spm._BASE) + ord(c) + 1) & spm.MASK
    slow = time.process_time() - slow
    assert min(took) < 10 * slow
    lat.build(texts)
    for c, at in zip(texts, lat.start, strict=True):
        for n in range(len(c)):
            want = {(k, by_text[c[n : n + k]]) for k in range(1, min(most, len(c) - n) + 1) if c[n : n + k] in by_text}
            if not any(k == 1 for k, _ in want):
                want.add((1, -1))
            e = slice(lat.ptr[at + n], lat.ptr[at + n + 1])
            assert set(zip(lat.step[e].tolist(), lat.piece[e].tolist(), strict=True)) == want
    assert all(lat.weights[i] == pytest.approx(-0.7 * math.log(i + 2)) for i in pieces)
    edges = np.flatnonzero(lat.piece < 0)
    places = np.searchsorted(lat.ptr, edges, side="right") - 1
    ids, begin = lat.ids(edges, places)
    for n, p in enumerate(places):
        assert ids[begin[n] : begin[n + 1]].tolist() == lat.byte[list(chr(lat.codes[p]).encode("utf-8", "surrogatepass"))].tolist()
    assert begin[-1] == len(ids) > len(edges)


def test_samples_follow_the_distribution():
    sp = spm.load(open(spm.MODEL, "rb").read())
    lat = spm.Lattices(sp, 0.3)
    lat.build(["▁abc"])

    def paths(at):
        if at == 4:
            yield (), 0.0
        else:
            for e in range(lat.ptr[at], lat.ptr[at + 1]):
                for rest, lp in paths(at + lat.step[e]):
                    yield (int(lat.piece[e]), *rest), lp + lat.logp[e]

    p = {k: math.exp(v) for k, v in paths(0)}
    assert sum(p.values()) == pytest.approx(1)
    got = spm.sample_segmentations(lat, [np.array([0])] * 6000, spm.mix64(np.arange(6000).astype(np.uint64)), 2)
    first, weight = Counter(), Counter()
    for s in got:
        ids = [tuple(x[2].tolist()) for x in s]
        assert len(set(ids)) == 2
        first[ids[0]] += 1 / 6000
        for i, x in zip(ids, s):
            assert x[0] == pytest.approx(math.log(p[i]))
            weight[i] += 1 / math.exp(x[1]) / 6000
    for k, v in p.items():
        assert first[k] == pytest.approx(v, abs=0.03)
        if v > 0.05:
            assert weight[k] == pytest.approx(1, abs=0.2)  # inclusion weights are unbiased
