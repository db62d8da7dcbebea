"""Registered queries against their SQL in DuckDB on the smallest tables."""

import glob
import hashlib
import math
import os
import re
from decimal import Decimal

import duckdb
import pytest

from tidewatch.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


INTAKE = [k for k, f in registry.QUERIES.items() if f.__module__.endswith(".intake")]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return round(v, 4) + 0.0
    return str(v)[:10] if hasattr(v, "year") else v


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", ["quarterly_counts", "denominators", "trailing_windows", "ratio_sweep", "ears_sweep", "trend_sweep_share", "alarm_history", "watch_list", "hierarchy_nodes", "scan_best", "branch_sweep", "dyads", "score_model", "curve_areas", "delay_curve", "concentration", "relative_risk", "scan_cylinders", "extract_mentions", "tokenized_documents", "concentration_sweep", "discounted_sweep", "ranking_table", "weighted_windows", "benchmark", "best_cylinders", "dyads_recent", "zone_risk", "member_checks", "daily_ears", "knn_graph", "cluster_observed", "mention_shares", "fuzzy_audit", "ordered_names", "scan_observed", "scan_circles", *INTAKE])
def test_equals_sql(spark, con, name):
    ours = registry.QUERIES[name](spark, SF)
    cols = sorted(ours.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in ours.collect()]
    cur = con.execute(registry.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, theirs))


def words_of(text):
    """Brute force of the normalised words, by regular expressions alone."""
    t = re.sub("[‐‑‒–—―−]", "-", text.upper())
    t = re.sub("(?<=[0-9]),(?=[0-9])", "\x01", t)
    t = re.sub("[^A-Z0-9\x01\\-']+", " ", t).strip().replace("\x01", ",")
    return [w for x in t.split(" ") if (w := re.sub("^-+|-+$", "", x)) and w not in ("AND", "WITH", "OF", "THE", "PLUS", "OR")]


def test_documents_of_all_languages_are_tokenized(spark, tmp_path):
    texts = [("en", "Salt, of 1,400 kg"), ("de", "Straße – Maß und Größe"), ("fr", "l'été œuvre ‒fin‒"), ("es", "¿Año 2,5 niño?"), (None, "ſee ŉ and x"), ("en", ""), ("de", None)]
    spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.tokens_md5 for r in registry.QUERIES["tokenized_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else hashlib.md5(" ".join(words_of(t)).encode()).hexdigest() for i, (_, t) in enumerate(texts)}
    n = registry.QUERIES["tokenized_documents"](spark, SF).count()
    assert n == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry_imports_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidewatch", tmp_path / "tidewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
