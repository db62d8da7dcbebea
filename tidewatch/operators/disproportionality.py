"""Disproportionality: expected counts of both gates, ratios, the gamma-Poisson shrinkage scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..functions.exprs import ratio
from ..session import stored
from .counting import role_dispersion
from .prior_fit import fit_priors
from .windows import trailing_windows


def gate_columns(windows: DataFrame, recent: int = 4, baseline: int = 8, concentration=None, spatial_weight: float = 0.25) -> DataFrame:
    """Adds expected (gate A: the entity's baseline share of the recent total), expected_own (gate B:
    its own baseline rate), ratio, ratio_own, count_ratio and the shares in percent.

    ``concentration`` (a column in [0, 1]) lowers both expectations by up to ``spatial_weight``.
    """
    n, b = F.col("n_recent").cast("double"), F.col("n_baseline").cast("double")
    less = F.lit(1.0) if concentration is None else 1 - F.lit(spatial_weight) * F.coalesce(concentration, F.lit(0.0))
    out = windows.withColumns({"expected": ratio(b * F.col("total_recent"), F.col("total_base")) * less, "expected_own": b * F.lit(recent / baseline) * less})
    return out.withColumns(
        {
            "ratio": ratio(n, F.col("expected")),
            "ratio_own": ratio(n, F.col("expected_own")),
            "count_ratio": ratio(n, b * F.lit(recent / baseline)),
            "share_recent_pct": ratio(100 * n, F.col("total_recent")),
            "share_base_pct": ratio(100 * b, F.col("total_base")),
        }
    )


def ratio_sweep(counts: DataFrame, denom: DataFrame, recent: int = 4, baseline: int = 8) -> DataFrame:
    return gate_columns(trailing_windows(counts, denom, recent, baseline), recent, baseline).where("n_recent > 0")


def ranked(scores: DataFrame, by: str, group: str | None = "as_of") -> DataFrame:
    """Adds rank by score, largest first, nulls last, ties by entity."""
    w = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    return scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc_nulls_last(by), "entity")))


def eb_scores(windows: DataFrame, phi: float = 1.0, recent: int = 4, baseline: int = 8, most_cells: int = 200_000) -> DataFrame:
    """Adds ebgm, eb05, eb95, eb05_own, alpha, beta, converged and credible_rise.

    ``windows`` is the result of ``gate_columns``, with optional columns phi (the quarter's dispersion,
    as of then), phi_s (the entity's own) and z_spatial. Counts and expectations are divided by the
    dispersions. With z_spatial, the prior's rate is beta * exp(-gamma * z), z standardised among the
    fitted cells and gamma fitted too: 0 where space tells nothing. For each as-of quarter and gate a gamma
    prior is fitted to the marginal negative binomial likelihood of all cells with E > 0 (0.5, 0.5 for fewer
    than ten). Entities of equal counts, expectations and z are one cell, with their number as weight; scores are
    joined back. A quarter of up to ``most_cells`` distinct cells is fitted in one task, by a simplex. Where one has
    more (with z_spatial or phi_s each entity may be a cell of its own), all quarters are fitted together on the
    cluster (``prior_fit``), and no task sees a whole quarter.
    """
    own = F.coalesce(F.col("phi_s"), F.lit(1.0)) if "phi_s" in windows.columns else F.lit(1.0)
    of_quarter = F.coalesce(F.col("phi"), F.lit(1.0)) if "phi" in windows.columns else F.lit(1.0)
    z = F.coalesce(F.col("z_spatial"), F.lit(0.0)) if "z_spatial" in windows.columns else F.lit(None).cast("double")
    rows = windows.withColumn("_d", F.lit(float(phi)) * of_quarter * own).withColumn("_z", z)
    rows = rows.withColumns({"_n": F.col("n_recent") / F.col("_d"), "_e": F.col("expected") / F.col("_d"), "_o": F.col("expected_own") / F.col("_d")})

    def scored(pdf: pd.DataFrame, prior) -> pd.DataFrame:
        """``prior(gate, n, e, z, w)`` gives a gate's parameters."""
        n, w = pdf._n.to_numpy(float), pdf._w.to_numpy(float)
        z = None if pdf._z.isna().all() else pdf._z.to_numpy(float)
        out = {c: pdf[c] for c in keys}
        for gate, names in (("_e", ("ebgm", "eb05", "eb95", "alpha", "beta", "converged")), ("_o", ("ebgm_own", "eb05_own", "eb95_own", "alpha_own", "beta_own", "converged_own"))):
            e = np.nan_to_num(pdf[gate].to_numpy(float))
            a, b, gamma, (middle, spread), ok = prior(gate, n, e, z, w)
            rate = b if z is None else b * np.exp(-gamma * (z - middle) / spread)
            mean, low, high = special.gamma_posterior(n, e, a, rate)
            out |= dict(zip(names, (mean, low, high, a, b, ok), strict=True))
        return pd.DataFrame(out)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return scored(pdf, lambda gate, n, e, z, w: special.fit_gamma_prior_by(n[e > 0], e[e > 0], None if z is None else z[e > 0], w[e > 0]))

    keys = ["as_of", "_n", "_e", "_o", "_z"]
    fields = "as_of int, _n double, _e double, _o double, _z double, ebgm double, eb05 double, eb95 double, alpha double, beta double, converged boolean, ebgm_own double, eb05_own double, eb95_own double, alpha_own double, beta_own double, converged_own boolean"
    cells = stored(rows.groupBy(*keys).agg(F.count("*").alias("_w")), "cells")
    if (cells.groupBy("as_of").count().agg(F.max("count")).first()[0] or 0) <= most_cells:
        scores = cells.groupBy("as_of").applyInPandas(fit, fields)
    else:
        priors = fit_priors(cells, {"_e": "_e", "_o": "_o"})

        def score(batches):
            for pdf in batches:
                for q, part in pdf.groupby("as_of"):
                    yield scored(part, lambda gate, *_, q=q: priors[q, gate])

        scores = cells.mapInPandas(score, fields)
    on = [rows[k].eqNullSafe(scores[k]) for k in keys]
    own_names = [c for c in scores.columns if c not in keys]
    out = rows.join(scores, on).select(*[rows[c] for c in windows.columns], *[scores[c] for c in own_names])
    return out.withColumn("credible_rise", (F.col("eb05") > 1.5) & (F.col("eb05_own") > 1.5))


def fixed_prior_scores(windows: DataFrame, alpha: float, beta: float) -> DataFrame:
    """Adds ebgm at a given prior, as an expression: exp(digamma(alpha + n) - ln(beta + E)).

    digamma shifts its argument by eight and takes the asymptotic series there.
    """
    x = F.lit(float(alpha)) + F.col("n_recent")
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda acc, i: acc + 1 / (x + i))
    y = x + 8
    psi = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y**4) - 1 / (252 * y**6) - shift
    return windows.withColumn("ebgm", F.exp(psi - F.log(F.lit(float(beta)) + F.col("expected"))))


def veto(scores: DataFrame, scan: DataFrame, line: float = 10.0) -> DataFrame:
    """Takes credible_rise from entities whose scan recurrence interval (entity, as_of,
    recurrence_interval; 1 where absent) is under the line. It never gives one."""
    ri = scan.select("entity", "as_of", F.col("recurrence_interval").alias("ri"))
    out = scores.join(ri, ["entity", "as_of"], "left").withColumn("ri", F.coalesce("ri", F.lit(1.0)))
    return out.withColumns({"vetoed": F.col("credible_rise") & (F.col("ri") < line), "credible_rise": F.col("credible_rise") & (F.col("ri") >= line)})


def rank_entities(windows: DataFrame, counts: DataFrame, as_of: int, credits: DataFrame | None = None, concentration: DataFrame | None = None, spatial_weight: float = 0.25, recent: int = 4, baseline: int = 8) -> DataFrame:
    """The ranking's table at one as-of quarter, before scores: windows, both expectations, shares, ratios,
    n_total, first and last quarter seen, novel (first seen in the recent window), phi_s, z_spatial and
    concentration.

    ``windows`` is the result of ``trailing_windows``; ``credits`` (entity, q, credit) gives the roles'
    dispersion of what was seen by then; ``concentration`` (entity, as_of, z, weight) the spatial
    discount. Entities without either have phi_s 1, z_spatial 0. Nothing after ``as_of`` is read.
    """
    rows = windows.where(F.col("as_of") == as_of)
    weight = None
    if concentration is not None:
        con = concentration.where(F.col("as_of") == as_of).select("entity", F.coalesce("z", F.lit(0.0)).alias("z_spatial"), F.coalesce("weight", F.lit(0.0)).alias("concentration"))
        rows = rows.join(con, "entity", "left").fillna(0.0, ["z_spatial", "concentration"])
        weight = F.col("concentration")
    rows = gate_columns(rows, recent, baseline, weight, spatial_weight)
    seen = counts.where((F.col("n") > 0) & (F.col("q") <= as_of)).groupBy("entity").agg(F.sum("n").alias("n_total"), F.min("q").alias("first_seen"), F.max("q").alias("last_seen"))
    rows = rows.join(seen, "entity", "left").withColumn("novel", F.coalesce(F.col("first_seen") > as_of - recent, F.lit(False)))
    if credits is None:
        return rows.withColumn("phi_s", F.lit(1.0))
    phi = role_dispersion(credits.where(F.col("q") <= as_of)).select("entity", "phi_s")
    return rows.join(phi, "entity", "left").fillna(1.0, ["phi_s"])
