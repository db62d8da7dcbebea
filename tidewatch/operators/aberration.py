"""Moving-baseline (EARS) and trend-slope detectors, swept over all as-of quarters at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import chi2_sf
from .windows import dense, islands


def ears_sweep(counts: DataFrame, denom: DataFrame, recent: int = 4, baseline: int = 8) -> DataFrame:
    """(entity, as_of, n_recent, n_baseline, ears_z): the recent share against the mean of the
    baseline quarters' shares, in units of their sample deviation, floored by a Poisson one.

    Zero quarters count in the baseline. Rows have n_recent > 0.
    """
    rows = dense(counts, denom).select("entity", "q", "n", "n_total", F.explode(F.sequence(F.lit(0), F.lit(recent + baseline - 1))).alias("ago"))
    rows = rows.withColumn("as_of", F.col("q") + F.col("ago"))
    is_recent = F.col("ago") < recent
    n, total = F.col("n").cast("double"), F.col("n_total").cast("double")
    base = lambda x: F.when(~is_recent, x)
    g = rows.groupBy("entity", "as_of").agg(
        F.count("*").alias("_k"),
        F.sum(F.when(is_recent, F.col("n")).otherwise(0)).alias("n_recent"),
        F.sum(F.when(~is_recent, F.col("n")).otherwise(0)).alias("n_baseline"),
        (F.sum(F.when(is_recent, n)) / F.sum(F.when(is_recent, total))).alias("share"),
        F.avg(base(n / total)).alias("mean"),
        F.stddev_samp(base(n / total)).alias("sd"),
        F.avg(base(n)).alias("mean_n"),
        F.avg(base(total)).alias("mean_total"),
    )
    floor = F.sqrt(F.greatest("mean_n", F.lit(0.25))) / F.col("mean_total")
    z = (F.col("share") - F.col("mean")) / F.greatest("sd", floor)
    return g.where((F.col("_k") == recent + baseline) & (F.col("n_recent") > 0)).select("entity", "as_of", "n_recent", "n_baseline", z.alias("ears_z"))


def fit_slopes(t: np.ndarray, y: np.ndarray, o: np.ndarray, iterations: int = 25, ridge: float = 1e-9) -> pd.DataFrame:
    """slope, se, z and pearson of log mu = a + b t + log o, for many series of equal length at once.

    Newton steps on the two coefficients; t is centred and scaled by its population deviation; se is
    Wald's, widened by sqrt(max(D / df, 1)), D Pearson's statistic. NaN where a series has no events.
    """
    sd = t.std(axis=1, keepdims=True)
    x = (t - t.mean(axis=1, keepdims=True)) / np.where(sd > 0, sd, 1.0)
    ok = (y.sum(1) > 0) & (o.sum(1) > 0) & (sd[:, 0] > 0) & (t.shape[1] >= 3)
    with np.errstate(all="ignore"):
        a, b = np.log(y.sum(1) / o.sum(1)), np.zeros(len(y))
        for _ in range(iterations + 1):
            mu = o * np.exp(np.clip(a[:, None] + b[:, None] * x, -30, 30))
            h00, h01, h11 = mu.sum(1) + ridge, (mu * x).sum(1), (mu * x * x).sum(1) + ridge
            det = h00 * h11 - h01 * h01
            if _ < iterations:
                g0, g1 = (y - mu).sum(1), ((y - mu) * x).sum(1)
                a, b = a + (h11 * g0 - h01 * g1) / det, b + (h00 * g1 - h01 * g0) / det
        pearson = ((y - mu) ** 2 / np.maximum(mu, 1e-12)).sum(1)
        se = np.sqrt(h00 / det) * np.sqrt(np.maximum(pearson / max(1, t.shape[1] - 2), 1.0))
        out = pd.DataFrame({"slope": b / sd[:, 0], "slope_se": se / sd[:, 0], "z": b / se, "pearson": pearson})
    out[~ok] = np.nan
    return out


@F.pandas_udf(T.StructType([T.StructField(x, T.DoubleType()) for x in ("slope", "slope_se", "z", "pearson")]))
def poisson_slope(t: pd.Series, y: pd.Series, o: pd.Series) -> pd.DataFrame:
    """Of arrays in order; NULL where undefined. Series of one length are fitted together."""
    out = pd.DataFrame(None, index=t.index, columns=["slope", "slope_se", "z", "pearson"], dtype=float)
    for _, at in t.groupby(t.map(len)).groups.items():
        stack = lambda s: np.stack(s.loc[at].to_numpy()).astype(float)  # noqa: E731, B023
        out.loc[at] = fit_slopes(stack(t), stack(y), stack(o)).to_numpy()
    return out.astype(object).where(out.notna(), None)


def trend_sweep(counts: DataFrame, denom: DataFrame, recent: int = 4, baseline: int = 8) -> DataFrame:
    """(entity, as_of, n_recent, n_baseline, slope, z, own_slope, own_z): log-linear trends over the
    trailing window, of the share (offset: all cases) and of the count itself. Rows have n_recent > 0."""
    width = recent + baseline
    rows = dense(counts, denom).select("entity", "q", "n", "n_total", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("ago")).withColumn("as_of", F.col("q") + F.col("ago"))
    point = F.struct(F.col("q").cast("double").alias("t"), F.col("n").cast("double").alias("y"), F.col("n_total").cast("double").alias("o"))
    g = rows.groupBy("entity", "as_of").agg(
        F.count("*").alias("_k"),
        F.sum(F.when(F.col("ago") < recent, F.col("n")).otherwise(0)).alias("n_recent"),
        F.sum(F.when(F.col("ago") >= recent, F.col("n")).otherwise(0)).alias("n_baseline"),
        F.sort_array(F.collect_list(point)).alias("p"),  # one struct a quarter of the window
    )
    g = g.where((F.col("_k") == width) & (F.col("n_recent") > 0))
    g = g.withColumns({"share": poisson_slope("p.t", "p.y", "p.o"), "own": poisson_slope("p.t", "p.y", F.transform("p.o", lambda x: F.lit(1.0)))})
    return g.select("entity", "as_of", "n_recent", "n_baseline", "share.slope", "share.z", F.col("own.slope").alias("own_slope"), F.col("own.z").alias("own_z"))


def confirmed_flags(sweep: DataFrame, score: str, threshold: float, least: int = 3) -> DataFrame:
    """Adds confirmed: the score is over the line now and in the quarters before, ``least`` in a row."""
    hot = islands(sweep.where(F.col(score) > threshold))
    run = hot.withColumn("run", F.row_number().over(Window.partitionBy("entity", "island").orderBy("as_of")))
    flags = run.select("entity", "as_of", (F.col("run") >= least).alias("confirmed"))
    return sweep.join(flags, ["entity", "as_of"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def emergent_flags(sweep: DataFrame, score: str, threshold: float, baseline: int = 8, line: float = 2.0) -> DataFrame:
    """Adds emergent: in an episode whose baseline a quarter was under ``line`` when it began."""
    hot = islands(sweep.where(F.col(score) > threshold))
    onset = F.first("n_baseline").over(Window.partitionBy("entity", "island").orderBy("as_of"))
    flags = hot.select("entity", "as_of", (onset / F.lit(float(baseline)) < line).alias("emergent"))
    return sweep.join(flags, ["entity", "as_of"], "left").withColumn("emergent", F.coalesce("emergent", F.lit(False)))


def dispersion_verdict(counts: DataFrame, denom: DataFrame, least_total: int = 40) -> DataFrame:
    """(entity, total, d_flat, d_trend, absorbed, root_d, p_trend, verdict): Pearson's D/df of the share
    series around a flat and a log-linear rate, and the chi-square tail of the latter. Fewer than
    ``least_total`` events: too_few. A tail under 5 %: clustered; D under 0.6: smooth; else ok."""
    rows = dense(counts, denom)
    point = F.struct(F.col("q").cast("double").alias("t"), F.col("n").cast("double").alias("y"), F.col("n_total").cast("double").alias("o"))
    g = rows.groupBy("entity").agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.sum("n_total").alias("cases"), F.sort_array(F.collect_list(point)).alias("pts"))  # one struct a quarter
    rate = F.col("total") / F.col("cases")
    flat = F.aggregate("pts", F.lit(0.0), lambda a, p: a + (p["y"] - p["o"] * rate) * (p["y"] - p["o"] * rate) / (p["o"] * rate)) / (F.col("k") - 1)
    g = g.withColumns({"d_flat": F.when(F.col("total") > 0, flat), "d_trend": poisson_slope("pts.t", "pts.y", "pts.o")["pearson"] / (F.col("k") - 2)})

    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(chi2_sf(x.to_numpy(float), df.to_numpy(float)) if len(x) else [], dtype=float)

    df = F.col("k") - 2
    p = F.when(F.col("d_trend").isNotNull() & (df > 0), tail(F.coalesce("d_trend", F.lit(0.0)) * df, df.cast("double")))
    g = g.withColumn("p_trend", p)
    verdict = F.when((F.col("total") < least_total) | F.col("d_trend").isNull(), "too_few").when(F.col("p_trend") < 0.05, "clustered").when(F.col("d_trend") < 0.6, "smooth").otherwise("ok")
    return g.select("entity", "total", "d_flat", "d_trend", (1 - F.col("d_trend") / F.col("d_flat")).alias("absorbed"), F.sqrt("d_trend").alias("root_d"), "p_trend", verdict.alias("verdict"))
