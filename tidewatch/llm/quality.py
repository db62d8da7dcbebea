"""Quality classifier: random Fourier features of document statistics, ridge regression from
partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, row_key, summed_matrix

STATISTICS = (
    "log_bytes log_words mean_word sd_word upper digits marks pipes space high repeated_word repeated_line log_line marked_words loud_words lone_marks common short_line max_line double_mark"
).split()
_UPPER = bytes(range(65, 91))
_LETTER = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGIT = b"0123456789"
_SPACE = b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))
_MARK = bytes(x for x in range(33, 127) if not chr(x).isalnum())
_DOUBLE = re.compile(rb"[!-/:-@\[-`{-~]{2}")


def statistics_of(text: str | None) -> list[float]:
    """Figures of the whole text, from its bytes, words and lines; all zero for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    b = text.encode("utf-8", "surrogatepass")
    n = len(b)
    count = lambda kind: n - len(b.translate(None, kind))
    ws = b.split()
    m = max(1, len(ws))
    lengths = np.fromiter(map(len, ws), np.int64, len(ws)) if ws else np.zeros(1)
    lines = [x for x in b.split(b"\n") if x]
    k = max(1, len(lines))
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1)
    letters = max(1, count(_LETTER))
    pairs = len(_DOUBLE.findall(b))
    marks = count(_MARK)
    return [
        np.log1p(n),
        np.log1p(len(ws)),
        lengths.mean(),
        lengths.std(),
        count(_UPPER) / letters,
        count(_DIGIT) / n,
        marks / n,
        b.count(b"|") / m,
        count(_SPACE) / n,
        count(_HIGH) / n,
        1 - len(set(ws)) / m,
        1 - len(set(lines)) / k,
        np.log1p(sizes.mean()),
        pairs / m,
        b.count(b"!") / m,
        sum(1 for w in ws if len(w) == 1 and w in _MARK) / m,
        float((lengths <= 3).mean()),
        float((sizes < 40).mean()),
        np.log1p(sizes.max()),
        pairs / (1 + marks),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, _key, x): the statistics of each row's whole text."""

    @F.pandas_udf("array<float>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([np.nan_to_num(np.asarray(statistics_of(t), np.float32)) for t in texts])

    return docs.select(F.col(id_col), row_key(id_col, text_col).alias("_key"), stats(F.col(text_col)).alias("x"))


@dataclass(frozen=True)
class QualityModel:
    """Standardisation, frequencies, ridge weights, and the isotonic steps (knots, levels)."""

    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.freq + self.phase) * np.sqrt(2.0 / self.freq.shape[1])
        return np.hstack([np.ones((len(z), 1)), z, wave])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels) if len(self.knots) else np.full(len(x), 0.5)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The weighted least-squares non-decreasing fit (pool adjacent violators)."""
    level, weight, length = [], [], []
    for a, b in zip(y, w, strict=True):
        level.append(float(a))
        weight.append(float(b))
        length.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            t = weight[-2] + weight[-1]
            level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / t]
            weight[-2:] = [t]
            length[-2:] = [length[-2] + length[-1]]
    return np.repeat(level, length)


def _summed(rows: DataFrame, make, width: int) -> np.ndarray:
    """The sum over all rows of ``make(x, y)``'s outer products."""

    def square(pdf: pd.DataFrame) -> np.ndarray:
        f = make(np.stack(pdf.x.to_numpy()).astype(float), pdf.y.to_numpy(float))
        return f.T @ f

    return summed_matrix(rows.select("x", "y"), square, width)


def fit_quality(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", waves: int = 160, ridge: float = 1e-3, most_labelled: int = 1_000_000, seed: int = 5) -> QualityModel:
    """Fit on labelled rows whose crc32(id) mod 5 is 1 to 4: 2 to 4 give the ridge scores, 1 their
    calibration. ``most_labelled`` bounds the labelled rows (by hash of the id; documented bound).

    Null labels are not learned from; an id's several labels count by their mean.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    y = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    rows = stats.join(y, id_col).withColumn("_fold", fold).where("_fold <> 0")
    have = rows.count()
    if have > most_labelled:
        rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(most_labelled / have * (1 << 20)))
    rows = durable(rows.select("x", "y", "_fold"), "labelled")
    d = len(STATISTICS)
    moments = _summed(rows, lambda x, y: np.hstack([np.ones((len(x), 1)), x]), d + 1)
    n = max(1.0, moments[0, 0])
    mean = moments[0, 1:] / n
    scale = np.sqrt(np.maximum(np.diag(moments)[1:] / n - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    rng = np.random.default_rng(seed)
    bandwidth = np.sqrt(d / 2.0)
    model = QualityModel(mean, scale, rng.standard_normal((d, waves)) / bandwidth, rng.uniform(0, 2 * np.pi, waves), np.zeros(1 + d + waves), np.zeros(0), np.zeros(0))
    width = 1 + d + waves
    square = _summed(rows.where("_fold > 1"), lambda x, y: np.hstack([model.features(x), y[:, None]]), width + 1)
    penalty = ridge * max(1.0, square[0, 0]) * np.eye(width)
    penalty[0, 0] = 1e-9
    weights = np.linalg.solve(square[:width, :width] + penalty, square[:width, width])
    model = QualityModel(mean, scale, model.freq, model.phase, weights, np.zeros(0), np.zeros(0))

    def binned(batches):
        for pdf in batches:
            if len(pdf):
                raw = model.raw(np.stack(pdf.x.to_numpy()).astype(float))
                yield pd.DataFrame({"bin": np.clip(np.round(raw * 1000), -2000, 3000).astype(int), "y": pdf.y})

    bins = rows.where("_fold = 1").select("x", "y").mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    got = bins.orderBy("bin").toPandas()  # at most 5,001 bins
    if not len(got):
        return model
    # a prior of two rows with the overall mean keeps every level inside (0, 1)
    base = got.s.sum() / got.n.sum()
    levels = isotonic(((got.s + 0.02 * base) / (got.n + 0.02)).to_numpy(), got.n.to_numpy())
    return QualityModel(mean, scale, model.freq, model.phase, weights, got.bin.to_numpy() / 1000.0, np.clip(levels, 0, 1))


def score_quality(stats: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1, higher: quality 1 likelier) and predicted to rows of statistics."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy()).astype(float)) if len(x) else [], dtype=float)

    return stats.withColumn("score", score("x")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Every text, null and empty ones too, gets a score; without labelled rows it is 0.5 for all.
    A row without id is scored, not held out and not learned from (labels go by id). Repeated rows are
    scored alike; an empty table gives no rows; extra columns are ignored.
    """
    stats = durable(document_statistics(docs, id_col, text_col), "stats")
    model = fit_quality(stats, labels, id_col=id_col, **fit)
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    return score_quality(stats, model).select(id_col, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted", "_key")


def scored_texts(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with _score, from the whole text, in one pass and no join."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = [np.nan_to_num(np.asarray(statistics_of(t), np.float32)) for t in texts]
        return pd.Series(model.score(np.stack(x).astype(float)) if x else [], dtype=float)

    return docs.withColumn("_score", score(F.col(text_col)))
