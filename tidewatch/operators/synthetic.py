"""Synthetic panels: rate curves by profile, sampled counts, and the real series most like them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio


@dataclass(frozen=True)
class Profile:
    """A curve from ``base`` to ``peak``, beginning at quarter ``onset`` and taking ``duration``."""

    name: str
    shape: str
    base: float
    peak: float
    onset: int
    duration: int = 4
    revert: bool = False


def rate_curves(spark: SparkSession, profiles: list[Profile], quarters: int) -> DataFrame:
    """(name, t, rate): step, log_linear, sigmoid or batch (a rise of ``duration`` quarters only)."""
    p = spark.createDataFrame(pd.DataFrame([asdict(x) for x in profiles]))
    rows = p.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(quarters - 1))))
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("t") - F.col("onset")) / F.col("duration").cast("double")))
    mid = F.col("onset") + F.col("duration") / 2
    step = F.when(F.col("t") >= F.col("onset"), F.col("peak")).otherwise(F.col("base"))
    curve = (
        F.when(F.col("shape") == "step", step)
        .when(F.col("shape") == "log_linear", F.col("base") * F.pow(F.col("peak") / F.col("base"), x))
        .when(F.col("shape") == "sigmoid", F.col("base") + (F.col("peak") - F.col("base")) / (1 + F.exp(-(F.col("t") - mid) * 4 / F.col("duration"))))
        .otherwise(F.when((F.col("t") >= F.col("onset")) & (F.col("t") < F.col("onset") + F.col("duration")), F.col("peak")).otherwise(F.col("base")))
    )
    back = F.col("revert") & (F.col("t") >= F.col("onset") + F.col("duration"))
    return rows.select("name", "t", F.when(back, F.col("base")).otherwise(curve).alias("rate"))


def denominator_curve(spark: SparkSession, quarters: int, level: float, kind: str = "flat", change: float = 0.5) -> DataFrame:
    """(t, n_total): flat, or falling or rising by ``change`` of the level over the span."""
    sign = {"flat": 0.0, "declining": -1.0, "rising": 1.0}[kind]
    t = F.col("id")
    return spark.range(quarters).select(t.cast("int").alias("t"), F.round(F.lit(level) * (1 + sign * change * t / max(1, quarters - 1))).cast("long").alias("n_total"))


def sample_counts(rates: DataFrame, kind: str = "poisson", dispersion: float = 2.0, seed: int = 7) -> DataFrame:
    """(name, t, n): Poisson, negative binomial (variance = dispersion * mean) or clustered (counts come
    in clusters of that mean size) draws, each seeded by its name and quarter."""

    def draw(batches):
        for pdf in batches:
            out = []
            for name, t, rate in zip(pdf.name, pdf.t, pdf.rate, strict=True):
                rng = np.random.default_rng([seed, int(t), *name.encode()])
                if kind == "negbin" and dispersion > 1 and rate > 0:
                    k = rate / (dispersion - 1)
                    out.append(rng.negative_binomial(k, k / (k + rate)))
                elif kind == "clustered":
                    out.append(int(rng.poisson(dispersion, rng.poisson(rate / dispersion)).sum()))
                else:
                    out.append(rng.poisson(rate))
            yield pd.DataFrame({"name": pdf.name, "t": pdf.t, "n": np.array(out, np.int64)})

    return rates.mapInPandas(draw, "name string, t int, n long")


def nearest_series(synthetic: DataFrame, real: DataFrame, least_overlap: int = 16, most_shift: int = 12, thin: float = 3.0) -> DataFrame:
    """(name, entity, shift, r, thin): for each synthetic series (name, t, n), the real one (entity, t,
    n) of the largest correlation over shifts with enough overlap; thin if its mean is small."""
    s = synthetic.select("name", F.col("t"), F.col("n").cast("double").alias("x"), F.explode(F.sequence(F.lit(-most_shift), F.lit(most_shift))).alias("shift")).withColumn("u", F.col("t") + F.col("shift"))
    pairs = s.join(real.select("entity", F.col("t").alias("u"), F.col("n").cast("double").alias("y")), "u")
    g = pairs.groupBy("name", "entity", "shift").agg(F.count("*").alias("k"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.avg("y").alias("mean"))
    g = g.withColumn("r", ratio(F.col("c"), F.col("sx") * F.col("sy"))).where((F.col("k") >= least_overlap) & F.col("r").isNotNull())  # a constant series correlates with nothing
    w = Window.partitionBy("name").orderBy(F.desc(F.round("r", 9)), "entity", F.abs("shift"), "shift")
    return g.withColumn("i", F.row_number().over(w)).where("i = 1").select("name", "entity", "shift", "r", (F.col("mean") < thin).alias("thin"))


def generate_panel(spark: SparkSession, profiles: list[Profile], quarters: int = 45, first_q: int = 8056, level: float = 400.0, denominator: str = "flat", noise: str = "poisson", dispersion: float = 2.0, seed: int = 7, emergent_line: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, denom, truth) of one replicate, as the sweeps and the evaluation take them: (entity, q, n)
    without zero rows, (q, n_total), and (entity, interval_start, interval_end, ongoing, no_emergence,
    emergent). A sustained rise is true from its onset to the end; any other profile is labelled never to
    rise, with a placeholder interval at the middle. Each draw is seeded by profile and quarter."""
    counts = sample_counts(rate_curves(spark, profiles, quarters), noise, dispersion, seed).where("n > 0")
    counts = counts.select(F.col("name").alias("entity"), (F.lit(first_q) + F.col("t")).alias("q"), "n")
    denom = denominator_curve(spark, quarters, level, denominator).select((F.lit(first_q) + F.col("t")).alias("q"), "n_total")
    label = lambda t: f"{(first_q + t) // 4}Q{(first_q + t) % 4 + 1}"
    rows = []
    for p in profiles:
        rises = p.peak > p.base and not p.revert and p.shape != "batch" and p.onset < quarters
        a, b = (p.onset, quarters - 1) if rises else (quarters // 2, quarters // 2)
        rows.append((p.name, label(a), label(b), False, not rises, rises and p.base < emergent_line))
    return counts, denom, spark.createDataFrame(rows, "entity string, interval_start string, interval_end string, ongoing boolean, no_emergence boolean, emergent boolean")
