"""Regressions and saddle-point tests of many scores at once, each given by counted rows of samples that are alike.

A row stands for ``n`` samples of equal covariates and score ``s`` whose phenotypes add up to ``y``. Arrays are (scores x rows); ``x`` is
(scores x rows x terms). Rows of n = 0 fill up. The methods are those of ``models``, whose functions take one sample a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .dist import chi2_1_sf, norm_sf, t_quantile_sf, t_sf
from .models import NONE, cauchy
from .spectrum import CELLS, Spectrum, add_products

#: Variants of a unit whose covariance is one matrix.
FEW = 256
CRITICAL = 3.841458820694124 / 2


def _results(size: int) -> dict[str, np.ndarray]:
    return {k: np.full(size, math.nan) for k in NONE}


def _gram(d, weight):
    return (d * weight[..., None]).swapaxes(1, 2) @ d


def _each(f, *arrays):
    """``f`` of stacked matrices; where one of them is singular, of each on its own. Results, and which were singular."""
    try:
        return f(*arrays), np.zeros(len(arrays[0]), bool)
    except np.linalg.LinAlgError:
        out, bad = [], np.zeros(len(arrays[0]), bool)
        for i, one in enumerate(zip(*arrays, strict=True)):
            try:
                out.append(f(*(a[None] for a in one))[0])
            except np.linalg.LinAlgError:
                out.append(np.zeros(arrays[-1].shape[1:]))
                bad[i] = True
        return np.stack(out), bad


def _solve(a, b):
    got, bad = _each(np.linalg.solve, a, b[..., None])
    return got[..., 0], bad


def _fitted(d, beta):
    return np.clip((d @ beta[..., None])[..., 0], -30, 30)


def logistic(d, n, y, iterations: int = 60):
    """Coefficients, the fitted rows' probabilities and which fits converged."""
    size, _, q = d.shape
    beta, done, live = np.zeros((size, q)), np.zeros(size, bool), np.arange(size)
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-_fitted(d[live], beta[live])))
        step, bad = _solve(_gram(d[live], n[live] * np.maximum(p * (1 - p), 1e-10)), (d[live] * (y[live] - n[live] * p)[..., None]).sum(1))
        beta[live] += step
        rest = ~bad & (np.abs(step).max(1) < 1e-9)
        done[live[rest]] = True
        live = live[~bad & ~rest]
        if not len(live):
            break
    return beta, 1 / (1 + np.exp(-_fitted(d, beta))), done


def _covariance(d, n, p):
    return np.linalg.pinv(_gram(d, n * p * (1 - p)))[:, -1, -1]


def glm(x, s, n, y) -> dict[str, np.ndarray]:
    d = np.concatenate([x, s[..., None]], 2)
    beta, p, done = logistic(d, n, y)
    out, ok = _results(len(s)), done.copy()
    if done.any():
        variance = np.full(len(s), -1.0)
        variance[done] = _covariance(d[done], n[done], p[done])
        ok &= variance > 0
        b, se = beta[ok, -1], np.sqrt(variance[ok])
        z = 1.959963984540054
        for k, v in {"effect": b, "effectSE": se, "effectCIlower": b - z * se, "effectCIupper": b + z * se, "OR": np.exp(np.minimum(b, 700)), "P": 2 * norm_sf(np.abs(b / se))}.items():
            out[k][ok] = v
    return out


class _Penalised:
    """Penalised fits of the scores ``live``: their probabilities, weights, information and log-likelihood at coefficients."""

    def __init__(self, d, n, y):
        self.d, self.n, self.y = d, n, y

    def at(self, live, beta):
        d, n, y = self.d[live], self.n[live], self.y[live]
        eta = _fitted(d, beta)
        p = 1 / (1 + np.exp(-eta))
        w = p * (1 - p)
        info = _gram(d, n * w)
        return p, w, info, (y * eta - n * np.log1p(np.exp(eta))).sum(1) + 0.5 * np.linalg.slogdet(info)[1]

    def last_score(self, live, beta):
        """Slope of the penalised log-likelihood along the last coefficient."""
        p, w, info, _ = self.at(live, beta)
        d, n, y = self.d[live], self.n[live], self.y[live]
        inverse, bad = _each(np.linalg.inv, info)
        h = w * ((d @ inverse) * d).sum(2)
        return np.where(bad, 0.0, (d[..., -1] * (y - n * p + n * h * (0.5 - p))).sum(1))

    def fit(self, live, start, fixed, maxit: int):
        """Coefficients, log-likelihoods and convergence; with ``fixed``, the last coefficient is held."""
        size, q = len(live), start.shape[1]
        free = q - (fixed is not None)
        beta, ok = start.copy(), np.zeros(size, bool)
        if fixed is not None:
            beta[:, -1] = fixed
        p, w, info, ll = self.at(live, beta)
        on = np.arange(size)
        for _ in range(maxit):
            d, n, y = self.d[live[on]], self.n[live[on]], self.y[live[on]]
            inverse, bad = _each(np.linalg.inv, info[on])
            h = w[on] * ((d @ inverse) * d).sum(2)
            score = (d * (y - n * p[on] + n * h * (0.5 - p[on]))[..., None]).sum(1)[:, :free]
            step, worse = _solve(info[on][:, :free, :free], score)
            bad |= worse
            big = np.abs(step).max(1)
            step = step * np.minimum(1, 5 / np.where(big > 0, big, 1))[:, None]
            todo = np.flatnonzero(~bad)
            for _ in range(30):
                if not len(todo):
                    break
                new = beta[on[todo]].copy()
                new[:, :free] += step[todo]
                got = self.at(live[on[todo]], new)
                better = got[3] >= ll[on[todo]] - 1e-12 * np.maximum(1, np.abs(ll[on[todo]]))  # sums of many samples are no more exact
                to = on[todo[better]]
                beta[to], p[to], w[to], info[to], ll[to] = new[better], got[0][better], got[1][better], got[2][better], got[3][better]
                last = (todo[~better], new[~better], [g[~better] for g in got])
                todo = todo[~better]
                step[todo] /= 2
            if len(todo):  # as good as it gets
                to = on[last[0]]
                beta[to], (p[to], w[to], info[to], ll[to]) = last[1], last[2]
            rest = ~bad & (np.abs(score).max(1) < 1e-6) & (np.abs(step).max(1) < 1e-6)
            ok[on[rest]] = True
            on = on[~bad & ~rest]
            if not len(on):
                break
        return beta, ll, ok


def firth(x, s, n, y, maxit: int = 1000, interval: bool = True) -> dict[str, np.ndarray]:
    """Firth's logistic regressions: effect, error, penalised likelihood-ratio test, and the profile-likelihood interval if it is wanted."""
    d = np.concatenate([x, s[..., None]], 2)
    model, every, q = _Penalised(d, n, y), np.arange(len(s)), d.shape[2]
    full, ll, ok = model.fit(every, np.zeros((len(s), q)), None, maxit)
    _, null, ok0 = model.fit(every, np.zeros((len(s), q)), 0.0, maxit)
    out, own = _results(len(s)), np.flatnonzero(ok & ok0)
    if not len(own):
        return out
    b = full[own, -1]
    p = 1 / (1 + np.exp(-_fitted(d[own], full[own])))
    se = np.sqrt(np.maximum(_covariance(d[own], n[own], p), 0))
    found = {"effect": b, "effectSE": se, "OR": np.exp(np.minimum(b, 700)), "P": chi2_1_sf(np.maximum(0, 2 * (ll[own] - null[own])))}
    if interval:
        found["effectCIlower"], found["effectCIupper"] = b + _reach(model, own, full[own], ll[own], se, maxit)
    for name, v in found.items():
        out[name][own] = v
    return out


def _reach(model: _Penalised, own, full, ll, se, maxit: int) -> np.ndarray:
    """How far down and up (2 x scores) from the fits ``full`` profiles of the likelihoods ``ll`` fall by ``CRITICAL``.

    The root of twice the fall is nearly straight and its slope is the score of the held coefficient: Newton steps within a bracket, halving it where they leave it or don't settle.
    """
    size = len(own)
    sign, of = np.repeat([-1.0, 1.0], size), np.tile(np.arange(size), 2)
    b, start = full[of, -1], full[of]
    near = 1e-7 * np.maximum(1, np.abs(b))
    inner, outer = np.zeros(2 * size), np.full(2 * size, np.inf)  # lengths
    at = 1.96 * np.maximum(se, 1e-3)[of]
    k, target = np.arange(2 * size), math.sqrt(2 * CRITICAL)
    for turn in range(100):
        got, value, fine = model.fit(own[of[k]], start[k], b[k] + sign[k] * at[k], maxit)
        start[k[fine]] = got[fine]
        root = np.sqrt(np.maximum(2 * (ll[of[k]] - value), 0))
        out_of = ~fine | (root >= target)
        inner[k], outer[k] = np.where(out_of, inner[k], at[k]), np.where(out_of, at[k], outer[k])
        slope = -sign[k] * model.last_score(own[of[k]], got) / np.where(root > 0, root, 1)
        good = fine & (root > 0) & (slope > 0)
        new = at[k] + np.where(good, target - root, 0) / np.where(good, slope, 1)
        good &= (new >= inner[k]) & (new <= np.minimum(outer[k], 4 * at[k])) & ((turn < 12) | np.isinf(outer[k]))
        new = np.where(good, new, np.where(np.isinf(outer[k]), 2 * at[k], (inner[k] + outer[k]) / 2))
        done = (good & (np.abs(new - at[k]) <= near[k])) | (outer[k] - inner[k] <= near[k])
        at[k] = new
        k = k[~done]
        if not len(k):
            break
    return (sign * at).reshape(2, size)


def lgamma(z: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of numbers above 0: Stirling's series after ten steps of recursion."""
    product = z.copy()
    for k in range(1, 10):
        product = product * (z + k)
    u = z + 10
    r = 1 / (u * u)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / u
    return (u - 0.5) * np.log(u) - u + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def nbinom(x, s, n, y) -> dict[str, float]:
    """``models.nbinom`` of one score: x is (rows x terms), the others are (rows)."""
    d = np.concatenate([np.column_stack([x, np.zeros(len(s))]), np.column_stack([x, np.ones(len(s))])])
    s, n = np.concatenate([s, s]), np.concatenate([n - y, y])
    d, s, n = d[n > 0], np.maximum(s[n > 0], 0.0), n[n > 0]
    beta, theta, size = np.zeros(d.shape[1]), 1.0, n.sum()
    beta[0] = math.log(max(float(n @ s) / size, 1e-8))
    values, at = np.unique(s, return_inverse=True)
    of_value = np.bincount(at, n)
    fixed = float(of_value @ lgamma(values + 1))

    def fit(beta, theta):
        for _ in range(60):
            mu = np.exp(np.clip(d @ beta, -30, 30))
            w = n * mu / (1 + mu / theta)
            step = np.linalg.solve((d * w[:, None]).T @ d, d.T @ (n * (s - mu) / (1 + mu / theta)))
            beta = beta + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        return beta, np.exp(np.clip(d @ beta, -30, 30))

    def log_lik(theta, mu):
        rest = theta * np.log(theta / (theta + mu)) + np.where(s > 0, s * np.log(np.maximum(mu, 1e-300) / (theta + mu)), 0)
        return float(of_value @ lgamma(values + theta) + n @ rest) - size * math.lgamma(theta) - fixed

    try:
        for _ in range(25):
            beta, mu = fit(beta, theta)
            lo, hi = math.log(1e-4), math.log(1e6)
            for _ in range(60):  # golden section on log theta
                a, b = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
                lo, hi = (lo, b) if log_lik(math.exp(a), mu) > log_lik(math.exp(b), mu) else (a, hi)
            new = math.exp((lo + hi) / 2)
            done = abs(new - theta) < 1e-6 * theta
            theta = new
            if done:
                break
        beta, mu = fit(beta, theta)
        w = n * mu / (1 + mu / theta)
        se = math.sqrt(np.linalg.inv((d * w[:, None]).T @ d)[-1, -1])
    except np.linalg.LinAlgError:
        return dict(NONE)
    return {"effect": beta[-1], "effectSE": se, "effectCIlower": beta[-1] - 1.96 * se, "effectCIupper": beta[-1] + 1.96 * se, "OR": math.nan, "P": float(2 * norm_sf(abs(beta[-1] / se)))}


def spa(g, n, mu, q) -> np.ndarray:
    """Two-sided P of score tests by saddle-point approximation: ``g`` is clean of the covariates, ``mu`` fitted by the null model, q the sum of g times residuals."""
    variance = (n * mu * (1 - mu) * g * g).sum(1)
    ok = variance > 0
    z = np.where(ok, q / np.sqrt(np.where(ok, variance, 1)), 0)
    p = np.where(ok, 2 * norm_sf(np.abs(z)), math.nan)
    far = np.flatnonzero(ok & (np.abs(z) >= 2))
    if len(far):
        g, n, mu, q = g[far], n[far], mu[far], q[far]
        p[far] = np.minimum(1.0, _tail(g, n, mu, np.abs(q), z[far]) + _tail(g, n, mu, -np.abs(q), z[far]))
    return p


def _tail(g, n, mu, target, z):
    def k1(t, k):
        e = np.exp(np.clip(g[k] * t[:, None], -500, 500))
        return (n[k] * (mu[k] * g[k] * e / (1 - mu[k] + mu[k] * e) - mu[k] * g[k])).sum(1)

    low = target < 0
    lo, hi = np.where(low, -1.0, 0.0), np.where(low, 0.0, 1.0)
    k = np.arange(len(g))
    for _ in range(60):
        value = k1(np.where(low, lo, hi)[k], k)
        k = k[np.where(low[k], value > target[k], value < target[k])]
        if not len(k):
            break
        lo[k], hi[k] = np.where(low[k], lo[k] * 2, lo[k]), np.where(low[k], hi[k], hi[k] * 2)
    never = k  # no t reaches the statistic
    every = np.arange(len(g))
    for _ in range(100):
        mid = (lo + hi) / 2
        if ((mid == lo) | (mid == hi)).all():
            break
        less = k1(mid, every) < target
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    t = (lo + hi) / 2
    e = np.exp(np.clip(g * t[:, None], -500, 500))
    k0 = (n * (np.log1p(mu * np.expm1(np.clip(g * t[:, None], -500, 500))) - t[:, None] * mu * g)).sum(1)
    k2 = (n * mu * (1 - mu) * g * g * e / (1 - mu + mu * e) ** 2).sum(1)
    w2, v = 2 * (t * target - k0), t * np.sqrt(np.maximum(k2, 0))
    fine = (w2 > 0) & (v != 0)
    w = np.where(fine, np.copysign(np.sqrt(np.where(fine, w2, 1)), t), 1)
    out = np.where(fine, norm_sf(np.abs(w + np.log(np.where(fine, v / w, 1)) / w)), norm_sf(np.abs(z)))
    out[never] = 0.0
    return out


@dataclass
class Null:
    """A null model of classes of samples: sex, design x, size n and phenotype sum y of each; fitted means mu and variances v."""

    sex: np.ndarray
    x: np.ndarray
    n: np.ndarray
    y: np.ndarray
    binary: bool
    within: float = 0.0  #: sum of squares of phenotypes about the means of their classes

    def __post_init__(self):
        self.size = float(self.n.sum())
        if self.binary:
            beta, p, done = logistic(self.x[None], self.n[None], self.y[None])
            self.mu = p[0] if done[0] else np.full(len(self.n), self.y.sum() / self.size)
            self.v = self.mu * (1 - self.mu)
            self.rss = self.s2 = 1.0
        else:
            root = np.sqrt(self.n)
            self.mu = self.x @ np.linalg.lstsq(self.x * root[:, None], self.y / root, rcond=None)[0]
            self.rss = self.within + float((self.n * (self.y / self.n - self.mu) ** 2).sum())
            self.s2 = self.rss / (self.size - self.x.shape[1])
            self.v = np.full(len(self.n), self.s2)
        self.inverse = np.linalg.pinv((self.x * (self.n * self.v)[:, None]).T @ self.x)
        self.left = self.y - self.n * self.mu  # residuals of a class
        self.of_sex = np.stack([self.sex == s for s in range(3)]).astype(float)

    def clean(self, cls, s, n):
        """Scores (scores x rows) without what the covariates explain."""
        if len(s) == 1:  # of many rows: sums by class instead of a design of all rows
            of_class = np.bincount(cls[0], n[0] * self.v[cls[0]] * s[0], len(self.n))
            return s - (self.x @ (self.inverse @ (self.x.T @ of_class)))[cls]
        x = self.x[cls]
        h = (x * (n * self.v[cls] * s)[..., None]).sum(1)
        return s - (x @ (h @ self.inverse)[..., None])[..., 0]

    def lm(self, cls, s, n, y) -> dict[str, np.ndarray]:
        """Least squares with t intervals (a continuous phenotype)."""
        out, df = _results(len(s)), self.size - self.x.shape[1] - 1
        c = self.clean(cls, s, n)
        u, d = ((y - n * self.mu[cls]) * c).sum(1), (n * c * c).sum(1)
        ok = (d > 1e-9 * (n * s * s).sum(1)) & (df > 0)
        b = u[ok] / d[ok]
        se = np.sqrt(np.maximum(self.rss - u[ok] * b, 0) / df / d[ok])
        reach = t_quantile_sf(0.025, df) if df > 0 else math.nan
        p = np.array([2 * t_sf(abs(t), df) for t in b / np.where(se > 0, se, math.nan)])
        for k, v in {"effect": b, "effectSE": se, "effectCIlower": b - reach * se, "effectCIupper": b + reach * se, "P": p}.items():
            out[k][ok] = np.where(se > 0, v, math.nan)
        return out

    def spa(self, cls, s, n, y) -> np.ndarray:
        g = self.clean(cls, s, n)
        return spa(g, n, self.mu[cls], ((y - n * self.mu[cls]) * g).sum(1))

    def tests(self, test: str, cls, s, n, y, maxit: int = 1000) -> dict[str, np.ndarray]:
        """A test of scores (scores x rows)."""
        if test == "lm":
            own = Null(self.sex, self.x, self.n, self.y, False, float((self.y - self.y**2 / self.n).sum())) if self.binary else self
            return own.lm(cls, s, n, y)
        if not self.binary:
            raise ValueError(f"{test} needs cases and controls")
        if test == "glm":
            return glm(self.x[cls], s, n, y)
        if test == "firth":
            return firth(self.x[cls], s, n, y, maxit)
        if test == "scoreSPA":
            return _results(len(s)) | {"P": self.spa(cls, s, n, y)}
        if test == "nbinom":
            got = [nbinom(self.x[c], *one) for c, *one in zip(cls, s, n, y, strict=True)]
            return {k: np.array([g[k] for g in got], float) for k in NONE}
        raise ValueError(f"no such test: {test}")


class Cells:
    """One unit: weights w and baselines b (variants x sexes) of its variants, and their stored cells.

    A cell has the number of its variant, a number of its sample, the sample's class and phenotype, and its imputed genotype.
    """

    def __init__(self, null: Null, w, b, variant, sample, cls, y, value):
        self.null, self.w, self.b = null, w, b
        self.variant, self.sample, self.cls, self.y, self.value = variant, sample, cls, y, value
        self.dev = value - b[variant, null.sex[cls]]
        m, p = len(w), null.x.shape[1]
        self.r = y - null.mu[cls]
        add = lambda v: np.bincount(variant, v, m)
        vx = null.of_sex @ (null.x * (null.n * null.v)[:, None])
        self.u = b @ (null.of_sex @ null.left) + add(self.dev * self.r)
        weighted = self.dev * null.v[cls]
        self.h = b @ vx + np.stack([add(weighted * null.x[cls, j]) for j in range(p)], 1)
        self.by_sex = np.stack([add(weighted * (null.sex[cls] == s)) for s in range(3)], 1)
        self.count = b @ (null.of_sex @ null.n) + add(self.dev)
        total = null.of_sex @ (null.n * null.v)
        square = (b * b) @ total + 2 * (b * self.by_sex).sum(1) + add(weighted * self.dev)
        left = square - ((self.h @ null.inverse) * self.h).sum(1)
        self.variance = np.where(left > 1e-12 * square, left, 0.0)
        self._kernel = None

    def kernel(self) -> np.ndarray:
        """Covariance of the variants' scores: of baselines in closed form, of stored cells by the pairs that share a sample."""
        if self._kernel is None:
            null, m = self.null, len(self.w)
            k = (self.b * (null.of_sex @ (null.n * null.v))) @ self.b.T
            cross = self.b @ self.by_sex.T
            k += cross
            k += cross.T
            del cross
            add_products(k, self.variant, self.sample, self.dev, null.v[self.cls])
            k -= (self.h @ null.inverse) @ self.h.T
            k[np.diag_indices(m)] = self.variance
            self._kernel = k
        return self._kernel

    def covariance(self, weight, kept) -> np.ndarray | Spectrum:
        """Covariance of the weighted scores of variants: a matrix of few, by its parts of over ``FEW``."""
        if len(kept) <= FEW:
            k = self.kernel()
            return (k[np.ix_(kept, kept)] if len(kept) < len(self.w) else k) * np.outer(weight, weight)
        null, place = self.null, np.full(len(self.w), -1)
        place[kept] = np.arange(len(kept))
        own = np.flatnonzero((place[self.variant] >= 0) & (self.dev != 0))
        variant = place[self.variant[own]]
        on = np.flatnonzero(self.b[kept].any(0))
        low = np.column_stack([self.b[kept][:, on], self.by_sex[kept][:, on], self.h[kept]]) * weight[:, None]
        s, p = len(on), self.h.shape[1]
        middle = np.zeros((2 * s + p, 2 * s + p))
        middle[:s, :s] = np.diag((null.of_sex @ (null.n * null.v))[on])
        middle[:s, s : 2 * s] = middle[s : 2 * s, :s] = np.eye(s)
        middle[2 * s :, 2 * s :] = -null.inverse
        return Spectrum.of_cells(variant, self.sample[own], self.dev[own] * weight[variant], null.v[self.cls[own]], low, middle)

    def rows(self, weight) -> tuple[np.ndarray, ...]:
        """class, score, n, y of the variants' weighted sum: a row for each sample with cells, and one for the rest of each class."""
        null = self.null
        ids, first, at = np.unique(self.sample, return_index=True, return_inverse=True)
        return held_rows(null, weight @ self.b, self.cls[first], np.bincount(at, self.dev * weight[self.variant], len(ids)), self.y[first])

    def each(self, variants) -> tuple[np.ndarray, ...]:
        """class, score, n, y (variants x rows) of single variants: the rest of each class, then the cells."""
        null, k = self.null, len(self.null.n)
        place = np.full(len(self.w), -1)
        place[variants] = np.arange(len(variants))
        own = np.flatnonzero(place[self.variant] >= 0)
        own = own[np.argsort(place[self.variant[own]], kind="stable")]
        row, cls = place[self.variant[own]], self.cls[own]
        sizes = np.bincount(row, minlength=len(variants))
        column = k + np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        shape = (len(variants), k + int(sizes.max(initial=0)))
        c, s, n, y = np.zeros(shape, int), np.zeros(shape), np.zeros(shape), np.zeros(shape)
        c[:, :k], n[:, :k], y[:, :k], s[:, :k] = np.arange(k), null.n, null.y, self.b[variants][:, null.sex]
        np.subtract.at(n, (row, cls), 1)
        np.subtract.at(y, (row, cls), self.y[own])
        c[row, column], s[row, column], n[row, column], y[row, column] = cls, self.value[own], 1.0, self.y[own]
        return c, s, n, y

    def single(self, kind: str, variants) -> np.ndarray:
        """P of single variants by saddle points (``spa``) or Firth's regression."""
        out = []
        most = len(self.null.n) + int(np.bincount(self.variant, minlength=len(self.w)).max(initial=1))
        for group in np.array_split(variants, -(-len(variants) * most * self.null.x.shape[1] // CELLS) or 1):
            c, s, n, y = self.each(group)
            out.append(self.null.spa(c, s, n, y) if kind == "spa" else firth(self.null.x[c], s, n, y, interval=False)["P"])
        return np.concatenate(out)

    def burden_variance(self, weight) -> float:
        cls, s, n, _ = self.rows(weight)
        return variance_of(self.null, cls, s, n)

    def acatv(self, kind: str = "score", u=None, mac: float = 10) -> float:
        """``models.acatv``; ``u``: scores of permuted residuals."""
        null, u = self.null, self.u if u is None else u
        kept = np.flatnonzero(self.count > 0)
        if not len(kept):
            return math.nan
        maf = self.count / (2 * null.size)
        rare, rest = kept[self.count[kept] <= mac], kept[self.count[kept] > mac]
        weight = lambda w, f: (w * math.pi) ** 2 * f * (1 - f)
        ps, ws = [], []
        if len(rare):
            own = np.zeros(len(self.w))
            own[rare] = self.w[rare]
            if kind == "score":
                key = "_rare"
                if not hasattr(self, key):
                    setattr(self, key, self.burden_variance(own))
                v = getattr(self, key)
                ps.append(float(chi2_1_sf(float(u @ own) ** 2 / v)) if v > 0 else math.nan)
            else:
                cls, s, n, y = (a[None] for a in self.rows(own))
                ps.append(float(null.spa(cls, s, n, y)[0] if kind == "spa" else firth(null.x[cls], s, n, y, interval=False)["P"][0]))
            ws.append(weight(self.w[rare].mean(), maf[rare].mean()))
        if len(rest):
            v = self.variance[rest]
            if kind != "score":
                p = self.single(kind, rest)
            elif null.binary:
                p = np.where(v > 0, 2 * norm_sf(np.abs(u[rest]) / np.sqrt(np.where(v > 0, v, 1))), math.nan)
            else:
                df = null.size - 1 - null.x.shape[1]
                ssr = u[rest] ** 2 / np.where(v > 0, v / null.s2, math.nan)
                p = np.array([2 * t_sf(math.sqrt(a / ((null.rss - a) / df)), df) for a in ssr])
            ps += list(p)
            ws += list(weight(self.w[rest], maf[rest]))
        ps, ws = np.array(ps), np.array(ws)
        if len(rare) and len(rest) and (ps < 1).any():
            ps, ws = ps[ps != 1], ws[ps != 1]
        return cauchy(ps, ws)


def held_rows(null: Null, base, cls, dev, y) -> tuple[np.ndarray, ...]:
    """class, score, n, y: samples with stored cells (class, what cells add, phenotype), and the rest of each class; ``base`` by sex."""
    k = len(null.n)
    n, left = null.n - np.bincount(cls, minlength=k), null.y - np.bincount(cls, y, k)
    some = np.flatnonzero(n > 0)
    score = base[null.sex[cls]] + dev
    score = np.where(np.abs(score) < 1e-9, 0.0, score)
    return np.r_[some, cls], np.r_[base[null.sex[some]], score], np.r_[n[some], np.ones(len(cls))], np.r_[left[some], y]


def variance_of(null: Null, cls, s, n) -> float:
    c = null.clean(cls[None], s[None], n[None])[0]
    got = float((n * null.v[cls] * c * c).sum())
    return got if got > 1e-12 * float((n * null.v[cls] * s * s).sum()) else 0.0
