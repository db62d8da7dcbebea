"""The gamma priors of all as-of quarters at once: likelihoods summed on the cluster, one job an iteration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special

#: Parts of a Newton step that are tried in one job; the best goes on.
STEPS = (1.0, 0.5, 0.125, 1 / 64)
#: Numbers that a job returns for each trial: the likelihood, its gradient and its second derivatives.
SUMS = 10


def likelihood_sums(n: np.ndarray, e: np.ndarray, u: np.ndarray, w: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The log likelihood at (ln alpha, ln beta, gamma), three first and six second derivatives: counts n whose rate
    is gamma(alpha, beta exp(-gamma u)) times e, each as often as w says."""
    alpha, rate = math.exp(point[0]), np.exp(point[1] - point[2] * u)
    e = np.maximum(e, 1e-9)
    every = rate + e
    one, at = np.unique(n, return_inverse=True)
    head = (special.lgamma(alpha + one) - special.lgamma(alpha) - special.lgamma(one + 1))[at]
    value = head + alpha * np.log(rate / every) + n * np.log(e / every)
    d_a = alpha * ((special.digamma(alpha + one) - special.digamma(alpha))[at] + np.log(rate / every))
    d_r = (alpha * e - n * rate) / every
    d_aa = d_a + alpha * alpha * (special.trigamma(alpha + one) - special.trigamma(alpha))[at]
    d_ar = alpha * e / every
    d_rr = -rate * e * (n + alpha) / every**2
    return np.array([np.sum(w * x) for x in (value, d_a, d_r, -u * d_r, d_aa, d_ar, -u * d_ar, d_rr, -u * d_rr, u * u * d_rr)])


class Ascent:
    """Newton's ascent to one prior's largest likelihood, within bounds; it says where to look and is told what is there."""

    def __init__(self, bounds: np.ndarray):
        self.bounds = bounds
        self.free = bounds > 0
        self.at = np.zeros(3)
        self.sums: np.ndarray | None = None
        self.step = np.zeros(3)
        self.done = self.converged = False

    def trials(self) -> list[np.ndarray]:
        if self.sums is None:
            return [self.at]
        return [np.clip(self.at + t * self.step, -self.bounds, self.bounds) for t in STEPS]

    def told(self, found: list[np.ndarray]) -> None:
        trials = self.trials()
        best = int(np.argmax([s[0] for s in found]))
        if self.sums is None or found[best][0] > self.sums[0]:
            self.at, self.sums = trials[best], found[best]
        else:  # no part of the step is higher: at the top, as far as doubles tell, or the step was too long
            self.step = self.step / 256
            self.done = self.converged = bool(np.abs(self.step).max() < 1e-8)
            return
        g = self.sums[1:4].copy()
        h = self.sums[[4, 5, 6, 5, 7, 8, 6, 8, 9]].reshape(3, 3)
        stuck = (np.abs(self.at) >= self.bounds) & (g * self.at > 0)
        live = np.flatnonzero(self.free & ~stuck)
        value, axes = np.linalg.eigh(h[np.ix_(live, live)]) if len(live) else (np.empty(0), np.empty((0, 0)))
        step = np.zeros(3)
        step[live] = axes @ ((axes.T @ g[live]) / np.maximum(np.abs(value), 1e-9))
        longest = np.abs(step).max()
        self.step = step * min(1.0, 2.0 / longest) if longest > 0 else step
        if longest < 1e-8:
            self.done = self.converged = True


def fit_priors(cells: DataFrame, gates: dict[str, str], by: str = "as_of", most: float = 12.0, most_gamma: float = special.MAX_GAMMA, iterations: int = 60) -> dict:
    """{(quarter, gate): (alpha, beta, gamma, (mean, sd) of z, converged)} that maximise the marginal likelihood of
    each quarter's cells (by, _n, _z, _w and each gate's column of expectations) with E > 0.

    Every iteration is one job over all cells, whatever quarter they belong to: tasks sum the likelihood and its
    derivatives at each quarter's trial points, Spark adds the sums, and the driver moves the points: a few numbers a
    quarter and gate. No quarter is gathered in a group. (0.5, 0.5, False) for fewer than ten rows.
    """
    on = lambda c: F.col(c) > 0
    known = F.col("_z").isNotNull()
    moments = cells.groupBy(by).agg(*[x for g, c in gates.items() for x in (F.sum(F.when(on(c), F.col("_w"))).alias(f"w_{g}"), F.sum(F.when(on(c), F.col("_w") * F.col("_z"))).alias(f"z_{g}"), F.sum(F.when(on(c), F.col("_w") * F.col("_z") ** 2)).alias(f"s_{g}"))], F.max(known).alias("known")).collect()
    scale, points, out = {}, {}, {}
    for r in moments:
        for g in gates:
            w, key = float(r[f"w_{g}"] or 0), (r[by], g)
            if w < 10:
                out[key] = (0.5, 0.5, 0.0, (0.0, 1.0), False)
                continue
            middle = r[f"z_{g}"] / w if r.known else 0.0
            spread = math.sqrt(max(0.0, r[f"s_{g}"] / w - middle**2)) if r.known else 1.0
            scale[key] = (middle, spread if spread > 1e-9 else 1.0)
            points[key] = Ascent(np.array([most, most, most_gamma if r.known else 0.0]))
    columns = list(gates.items())
    for _ in range(iterations):
        asked = {k: p.trials() for k, p in points.items() if not p.done}
        if not asked:
            break

        def work(batches, asked=asked):
            total: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for q, part in pdf.groupby(by):
                    n, w = part._n.to_numpy(float), part._w.to_numpy(float)
                    z = part._z.to_numpy(float)
                    for g, c in columns:
                        e = np.nan_to_num(part[c].to_numpy(float))
                        m = e > 0
                        if (q, g) not in asked or not m.any():
                            continue
                        middle, spread = scale[q, g]
                        u = np.nan_to_num((z[m] - middle) / spread)
                        for i, p in enumerate(asked[q, g]):
                            total[q, g, i] = total.get((q, g, i), 0.0) + likelihood_sums(n[m], e[m], u, w[m], p)
            yield pd.DataFrame([(q, g, i, *s) for (q, g, i), s in total.items()], columns=["q", "g", "i", *[f"s{j}" for j in range(SUMS)]])

        schema = f"q {dict(cells.dtypes)[by]}, g string, i int, {', '.join(f's{j} double' for j in range(SUMS))}"
        sums = cells.mapInPandas(work, schema).groupBy("q", "g", "i").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(SUMS)]).collect()
        found = {(r.q, r.g, r.i): np.array(r[3:], float) for r in sums}
        for k, trials in asked.items():
            points[k].told([found[*k, i] for i in range(len(trials))])
    for k, p in points.items():
        inside = bool((np.abs(p.at[:2]) < most - 0.1).all()) and abs(p.at[2]) < most_gamma - 1e-3
        out[k] = (math.exp(p.at[0]), math.exp(p.at[1]), float(p.at[2]), scale[k], p.converged and inside)
    return out
