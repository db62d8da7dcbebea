"""Special functions in NumPy, for grouped fits: log-gamma, digamma, incomplete gamma and its
inverse, and the gamma-Poisson prior."""

from __future__ import annotations

import math

import numpy as np

def lgamma(x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.fromiter(map(math.lgamma, x.ravel()), float, x.size).reshape(x.shape)


def digamma(x) -> np.ndarray:
    """By recurrence up to 8 and the asymptotic series beyond."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out -= np.where(small, 1 / x, 0.0)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x) -> np.ndarray:
    """The derivative of digamma: shifted by ten, then the asymptotic series."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    for i in range(10):
        out = out + 1 / (x + i) ** 2
    y = x + 10
    return out + 1 / y + 1 / (2 * y**2) + 1 / (6 * y**3) - 1 / (30 * y**5) + 1 / (42 * y**7) - 1 / (30 * y**9)


def gammainc(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x): a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    front = np.exp(np.where(x > 0, a * np.log(np.maximum(x, 1e-300)) - x - lgamma(a), -np.inf))
    low = (x > 0) & (x < a + 1)
    if low.any():
        aa, xx = a[low], x[low]
        term = 1 / aa
        total, k = term.copy(), aa.copy()
        for _ in range(10_000):
            k += 1
            term = term * xx / k
            total += term
            if (np.abs(term) <= np.abs(total) * 1e-16).all():
                break
        out[low] = front[low] * total
    high = x >= a + 1
    if high.any():
        aa, xx = a[high], x[high]
        tiny = 1e-300
        b = xx + 1 - aa
        c, d = np.full_like(b, 1 / tiny), 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h *= step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = 1 - front[high] * h
    return out


def gamma_ppf(p: float, a) -> np.ndarray:
    """The quantile of a gamma variable with shape a and unit rate: Newton steps within bisection."""
    a = np.asarray(a, float)
    lo, hi = np.zeros_like(a), np.maximum(10.0, a * 4 + 40)
    z = math.sqrt(2) * _erfinv(2 * p - 1)
    x = np.clip(a * np.maximum(1 - 1 / (9 * a) + z / (3 * np.sqrt(a)), 1e-3) ** 3, 1e-12, hi / 2)
    x = np.where(a < 1, np.clip(np.exp((math.log(p) + lgamma(a + 1)) / a), 1e-290, hi / 2), x)  # P(a, x) ~ x^a / Gamma(a + 1)
    for _ in range(300):
        f = gammainc(a, x) - p
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        density = np.exp((a - 1) * np.log(np.maximum(x, 1e-300)) - x - lgamma(a))
        with np.errstate(divide="ignore", invalid="ignore"):
            new = x - f / density
        bad = ~np.isfinite(new) | (new <= lo) | (new >= hi)
        new = np.where(bad, np.where(lo > 0, np.sqrt(np.maximum(lo, 1e-300) * hi), hi * 1e-3), new)
        if (np.abs(new - x) <= 1e-13 * new).all():
            x = new
            break
        x = new
    return x


def _erfinv(y: float) -> float:
    lo, hi = -6.0, 6.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid) < y else (lo, mid)
    return (lo + hi) / 2


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi2_sf(x, df) -> np.ndarray:
    return 1 - gammainc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def nb_log_likelihood(n, e, alpha: float, rate, weight=None) -> float:
    """Of counts whose rate is gamma(alpha, rate) times E, each as often as its weight says. The gamma
    functions are taken once for each distinct count."""
    e = np.maximum(np.asarray(e, float), 1e-9)
    n = np.asarray(n, float)
    w = np.ones(len(n)) if weight is None else np.asarray(weight, float)
    one, at = np.unique(n, return_inverse=True)
    head = (lgamma(alpha + one) - lgamma(alpha) - lgamma(one + 1))[at]
    return float(np.sum(w * (head + alpha * np.log(rate / (rate + e)) + n * np.log(e / (rate + e)))))


#: Bound of the spatial coefficient: past it, a fit escapes into a corner that few cells pin down.
MAX_GAMMA = 2.0


def fit_gamma_prior(n, e, weight=None, most: float = 12.0) -> tuple[float, float, bool]:
    """(alpha, beta, converged) that maximise the marginal likelihood, by a simplex over their logs.

    (0.5, 0.5, False) for fewer than ten cells; not converged if a log runs into the bound.
    """
    a, b, _, _, ok = fit_gamma_prior_by(n, e, None, weight, most)
    return a, b, ok


def fit_gamma_prior_by(n, e, z=None, weight=None, most: float = 12.0, most_gamma: float = MAX_GAMMA) -> tuple[float, float, float, tuple[float, float], bool]:
    """(alpha, beta, gamma, (mean, sd) of z, converged): the same with rate beta * exp(-gamma * (z - mean) / sd)."""
    n, e = np.asarray(n, float), np.asarray(e, float)
    w = np.ones(len(n)) if weight is None else np.asarray(weight, float)
    if w.sum() < 10:
        return 0.5, 0.5, 0.0, (0.0, 1.0), False
    middle, spread, u = 0.0, 1.0, np.zeros(len(n))
    if z is not None:
        z = np.asarray(z, float)
        middle = float(np.average(z, weights=w))
        spread = float(np.sqrt(np.average((z - middle) ** 2, weights=w)))
        spread = spread if spread > 1e-9 else 1.0
        u = (z - middle) / spread

    def open_(p):
        a, b = (math.exp(min(max(v, -most), most)) for v in p[:2])
        return a, b, (min(max(p[2], -most_gamma), most_gamma) if z is not None else 0.0)

    def cost(p):
        a, b, gamma = open_(p)
        return -nb_log_likelihood(n, e, a, b * np.exp(-gamma * u) if gamma else b, w)

    best, ok = simplex(cost, np.zeros(2 if z is None else 3))
    inside = bool(np.all(np.abs(best[:2]) < most - 0.1)) and (z is None or abs(best[2]) < most_gamma - 1e-3)
    return *open_(best), (middle, spread), ok and inside


def simplex(f, start, step: float = 0.5, tol: float = 1e-8, most: int = 2000):
    """Nelder and Mead's downhill simplex."""
    d = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + step * np.eye(d)[i] for i in range(d)]
    values = [f(p) for p in points]
    for _ in range(most):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tol and max(np.max(np.abs(p - points[0])) for p in points[1:]) <= tol:
            return points[0], True
        middle = np.mean(points[:-1], axis=0)
        trial = lambda t: middle + t * (middle - points[-1])  # noqa: E731, B023
        mirrored = trial(1.0)
        v = f(mirrored)
        if v < values[0]:
            far = trial(2.0)
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (mirrored, v)
        elif v < values[-2]:
            points[-1], values[-1] = mirrored, v
        else:
            near = trial(0.5 if v < values[-1] else -0.5)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))], False


def gamma_posterior(n, e, alpha: float, beta: float):
    """(ebgm, eb05, eb95): geometric mean and 5 and 95 % points of gamma(alpha + n, beta + E)."""
    n, e = np.asarray(n, float), np.maximum(np.asarray(e, float), 0.0)
    shape, rate = alpha + n, beta + e
    return np.exp(digamma(shape) - np.log(rate)), gamma_ppf(0.05, shape) / rate, gamma_ppf(0.95, shape) / rate
