"""Regression and variance-component tests in numpy, one unit at a time.

``y`` is the phenotype, ``x`` the null design with a leading column of ones, ``g`` genotypes (samples x variants) and
``s`` a burden score. Tests return dicts of effect, effectSE, effectCIlower, effectCIupper, OR and P; what a test doesn't
have is nan.
"""

from __future__ import annotations

import math

import numpy as np

from .dist import chi2_1_sf, chi2_sf, norm_quantile, norm_sf, t_quantile_sf, t_sf

NONE = {k: math.nan for k in ("effect", "effectSE", "effectCIlower", "effectCIupper", "OR", "P")}


def _wald(b: float, se: float, z: float, p: float, odds: bool) -> dict:
    return {"effect": b, "effectSE": se, "effectCIlower": b - z * se, "effectCIupper": b + z * se, "OR": math.exp(min(b, 700)) if odds else math.nan, "P": p}


def lm(y, x, s) -> dict:
    """Ordinary least squares; t interval and test of the score."""
    d = np.column_stack([x, s])
    df = len(y) - d.shape[1]
    inv = np.linalg.pinv(d.T @ d)
    beta = inv @ (d.T @ y)
    r = y - d @ beta
    if df <= 0:
        return dict(NONE)
    se = math.sqrt(max(r @ r / df * inv[-1, -1], 0))
    return _wald(beta[-1], se, t_quantile_sf(0.025, df), 2 * t_sf(abs(beta[-1]) / se, df), False) if se > 0 else dict(NONE)


def logistic(y, x, iterations: int = 60, offset=0.0):
    """Maximum-likelihood coefficients, fitted probabilities and covariance; None if it doesn't converge."""
    beta = np.zeros(x.shape[1])
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-np.clip(x @ beta + offset, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-10)
        try:
            step = np.linalg.solve((x * w[:, None]).T @ x, x.T @ (y - p))
        except np.linalg.LinAlgError:
            return None
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            p = 1 / (1 + np.exp(-np.clip(x @ beta + offset, -30, 30)))
            return beta, p, np.linalg.pinv((x * (p * (1 - p))[:, None]).T @ x)
    return None


def glm(y, x, s, offset=0.0) -> dict:
    got = logistic(y, np.column_stack([x, s]), offset=offset)
    if got is None or got[2][-1, -1] <= 0:
        return dict(NONE)
    b, se = got[0][-1], math.sqrt(got[2][-1, -1])
    return _wald(b, se, 1.959963984540054, float(2 * norm_sf(abs(b / se))), True)


def _firth(y, x, fixed: float | None, start, offset, maxit: int):
    """Penalised fit; with ``fixed``, the last coefficient is held. Coefficients and penalised log-likelihood, or None."""
    free = x.shape[1] - (fixed is not None)
    beta = start.copy()
    if fixed is not None:
        beta[-1] = fixed

    def at(b):
        eta = np.clip(x @ b + offset, -30, 30)
        p = 1 / (1 + np.exp(-eta))
        w = p * (1 - p)
        info = (x * w[:, None]).T @ x
        return p, w, info, float(y @ eta - np.log1p(np.exp(eta)).sum() + 0.5 * np.linalg.slogdet(info)[1])

    p, w, info, ll = at(beta)
    for _ in range(maxit):
        try:
            inv = np.linalg.inv(info)
        except np.linalg.LinAlgError:
            return None
        h = w * np.einsum("ij,jk,ik->i", x, inv, x)
        score = (x.T @ (y - p + h * (0.5 - p)))[:free]
        step = np.linalg.solve(info[:free, :free], score)
        big = np.abs(step).max()
        step = step * min(1, 5 / big) if big > 0 else step
        for _ in range(30):
            new = beta.copy()
            new[:free] += step
            got = at(new)
            if got[3] >= ll - 1e-12:
                break
            step = step / 2
        beta, (p, w, info, ll) = new, got
        if np.abs(score).max() < 1e-6 and np.abs(step).max() < 1e-6:
            return beta, ll
    return None


def firth(y, x, s, offset=0.0, maxit: int = 1000) -> dict:
    """Firth's logistic regression: profile-likelihood interval and penalised likelihood-ratio test."""
    d = np.column_stack([x, s])
    zero = np.zeros(d.shape[1])
    full, null = _firth(y, d, None, zero, offset, maxit), _firth(y, d, 0.0, zero, offset, maxit)
    if full is None or null is None:
        return dict(NONE)
    b, ll = full[0][-1], full[1]
    p = 1 / (1 + np.exp(-np.clip(d @ full[0] + offset, -30, 30)))
    se = math.sqrt(max(np.linalg.pinv((d * (p * (1 - p))[:, None]).T @ d)[-1, -1], 0))
    crit = 3.841458820694124 / 2

    def bound(sign):
        far, at = sign * max(se, 1e-3), 0.0
        for _ in range(40):
            got = _firth(y, d, b + far, full[0], offset, maxit)
            if got is None or ll - got[1] >= crit:
                break
            at, far = far, far * 2
        for _ in range(50):
            mid = (at + far) / 2
            got = _firth(y, d, b + mid, full[0], offset, maxit)
            if got is not None and ll - got[1] < crit:
                at = mid
            else:
                far = mid
            if abs(far - at) < 1e-6 * max(1, abs(b)):
                break
        return b + (at + far) / 2

    return {"effect": b, "effectSE": se, "effectCIlower": bound(-1), "effectCIupper": bound(1), "OR": math.exp(min(b, 700)), "P": float(chi2_1_sf(max(0, 2 * (ll - null[1]))))}


def nbinom(y, x, s) -> dict:
    """Negative-binomial regression of the score on covariates and the phenotype (in this order of roles); the effect is the phenotype's."""
    d = np.column_stack([x, y])
    s = np.asarray(s, float)
    beta = np.zeros(d.shape[1])
    beta[0] = math.log(max(s.mean(), 1e-8))
    theta = 1.0

    def fit(beta, theta):
        for _ in range(60):
            mu = np.exp(np.clip(d @ beta, -30, 30))
            w = mu / (1 + mu / theta)
            step = np.linalg.solve((d * w[:, None]).T @ d, d.T @ ((s - mu) / (1 + mu / theta)))
            beta = beta + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        return beta, np.exp(np.clip(d @ beta, -30, 30))

    def log_lik(theta, mu):
        lg = np.vectorize(math.lgamma, otypes=[float])
        return float((lg(s + theta) - math.lgamma(theta) - lg(s + 1) + theta * np.log(theta / (theta + mu)) + np.where(s > 0, s * np.log(np.maximum(mu, 1e-300) / (theta + mu)), 0)).sum())

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
        w = mu / (1 + mu / theta)
        se = math.sqrt(np.linalg.inv((d * w[:, None]).T @ d)[-1, -1])
    except np.linalg.LinAlgError:
        return dict(NONE)
    return {"effect": beta[-1], "effectSE": se, "effectCIlower": beta[-1] - 1.96 * se, "effectCIupper": beta[-1] + 1.96 * se, "OR": math.nan, "P": float(2 * norm_sf(abs(beta[-1] / se)))}


class Null:
    """A null model: residuals, variance of the response, and the covariates taken out of genotypes."""

    def __init__(self, y, x, binary: bool):
        self.x, self.binary, self.n = x, binary, len(y)
        if binary:
            got = logistic(y, x)
            self.mu = got[1] if got else np.full(len(y), y.mean())
            self.v = self.mu * (1 - self.mu)
            self.res, self.s2 = y - self.mu, 1.0
        else:
            beta = np.linalg.lstsq(x, y, rcond=None)[0]
            self.res, self.mu = y - x @ beta, x @ beta
            self.s2 = self.res @ self.res / (len(y) - x.shape[1])
            self.v = np.full(len(y), self.s2)
        self.inv = np.linalg.pinv((x * self.v[:, None]).T @ x)

    def clean(self, g):
        """g without what the covariates explain."""
        return g - self.x @ (self.inv @ ((self.x * self.v[:, None]).T @ g))

    def covariance(self, g):
        c = self.clean(g)
        return (c * self.v[:, None]).T @ c


def spa(null: Null, s) -> float:
    """Two-sided P of the score test of s by saddle-point approximation (binary null)."""
    g = null.clean(np.asarray(s, float)[:, None])[:, 0]
    q, var = float(null.res @ g), float((null.v * g * g).sum())
    if var <= 0:
        return math.nan
    z = q / math.sqrt(var)
    if abs(z) < 2:
        return float(2 * norm_sf(abs(z)))
    mu = null.mu

    def k(t):
        return float((np.log1p(mu * np.expm1(np.clip(g * t, -500, 500))) - t * mu * g).sum())

    def k1(t):
        e = np.exp(np.clip(g * t, -500, 500))
        return float((mu * g * e / (1 - mu + mu * e) - mu * g).sum())

    def k2(t):
        e = np.exp(np.clip(g * t, -500, 500))
        return float((mu * (1 - mu) * g * g * e / (1 - mu + mu * e) ** 2).sum())

    def tail(target):
        lo, hi = (-1.0, 0.0) if target < 0 else (0.0, 1.0)
        for _ in range(60):
            if (target < 0 and k1(lo) <= target) or (target > 0 and k1(hi) >= target):
                break
            lo, hi = (lo * 2, hi) if target < 0 else (lo, hi * 2)
        else:
            return 0.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if k1(mid) < target else (lo, mid)
        t = (lo + hi) / 2
        w2 = 2 * (t * target - k(t))
        v = t * math.sqrt(max(k2(t), 0))
        if w2 <= 0 or v == 0:
            return float(norm_sf(abs(z)))
        w = math.copysign(math.sqrt(w2), t)
        return float(norm_sf(abs(w + math.log(v / w) / w)))

    return min(1.0, tail(abs(q)) + tail(-abs(q)))


def score_spa(y, x, s) -> dict:
    return NONE | {"P": spa(Null(y, x, True), s)}


#: Points of Imhof's integral in a block, numbers in a block of points x eigenvalues, and terms of the series, whose arguments are up to 1/2.
GRID, BLOCK, TERMS = 2000, 500_000, 26


def _phases(u, lam) -> tuple[np.ndarray, np.ndarray]:
    """Sums over lam of arctan(u lam) and log(1 + (u lam)^2) for ascending u: series in power sums where u lam is small, the others in blocks."""
    small = lam * u[-1] <= 0.5
    x, t = lam[small] * u[-1], u / u[-1]
    sums, power = [], np.ones(len(x))
    for _ in range(2 * TERMS):
        power = power * x
        sums.append(float(power.sum()))
    turn, damp, square = np.zeros(len(u)), np.zeros(len(u)), t * t
    for k in reversed(range(TERMS)):
        turn = sums[2 * k] / (2 * k + 1) - square * turn
        damp = sums[2 * k + 1] / (k + 1) - square * damp
    turn, damp, rest = t * turn, square * damp, lam[~small]
    step = max(1, BLOCK // max(1, len(rest)))
    for i in range(0, len(u) if len(rest) else 0, step):
        part = u[i : i + step, None] * rest
        turn[i : i + step] += np.arctan(part).sum(1)
        damp[i : i + step] += np.log1p(part * part).sum(1)
    return turn, damp


def mixture_sf(q: float, lam) -> float:
    """P(sum of lam * chi-square(1) > q): inversion of the characteristic function, moment matching where that fails."""
    lam = np.asarray(lam, float)
    lam = lam[lam > lam.max() * 1e-10] if len(lam) and lam.max() > 0 else lam[:0]
    if not len(lam):
        return 1.0
    if len(lam) == 1:
        return float(chi2_1_sf(q / lam[0]))
    scale = lam.sum()
    lam, q = lam / scale, q / scale
    # Imhof's integral on a grid that follows the damping of the integrand
    top = 1.0
    while np.prod((1 + (lam * top) ** 2) ** 0.25) * top < 1e8 and top < 1e7:
        top *= 1.5
    p = imhof(q, top, lambda part: _phases(part, lam))
    return p if 1e-6 < p < 1 else liu_sf(q, lam)


def points(q: float, top: float) -> int:
    """Number of points of Imhof's integral up to ``top``."""
    return int(min(40_000, max(2000, 10 * top * max(q, 1) / (2 * math.pi))))


def imhof(q: float, top: float, phases) -> float:
    """P(sum > q) of eigenvalues that add up to 1; ``phases`` gives the sums of ``_phases`` at ascending points, block after block."""
    n = points(q, top)
    u = (np.arange(n) + 0.5) * (top / n)
    total = 0.0
    for part in np.array_split(u, -(-n // GRID)):
        turn, damp = phases(part)
        total += float((np.sin(0.5 * turn - 0.5 * q * part) / (part * np.exp(0.25 * damp))).sum())
    return 0.5 + total * (top / n) / math.pi


def liu_sf(q: float, lam) -> float:
    """Tail of the mixture by matching moments with a non-central chi-square (Liu, Tang and Zhang 2009; central variant)."""
    return liu(q, power_sums(lam))


def power_sums(lam) -> list[float]:
    return [float((lam**k).sum()) for k in (1, 2, 3, 4)]


def liu(q: float, c: list[float]) -> float:
    """``liu_sf`` by the eigenvalues' sums of powers 1 to 4."""
    s1, s2 = c[2] / c[1] ** 1.5, c[3] / c[1] ** 2
    if s1 * s1 > s2:
        a = 1 / (s1 - math.sqrt(s1 * s1 - s2))
        d = s1 * a**3 - a * a
        df = a * a - 2 * d
    else:
        df, d = 1 / s2, 0.0
        a = math.sqrt(df)
    z = (q - c[0]) / math.sqrt(2 * c[1])
    x = z * math.sqrt(2) * a + df + d
    if d <= 0:
        return chi2_sf(max(x, 0), df)
    # non-central: Poisson mixture
    total, weight, k = 0.0, math.exp(-d / 2), 0
    while k < 2000 and (weight > 1e-18 or k < d):
        total += weight * chi2_sf(max(x, 0), df + 2 * k)
        k += 1
        weight *= d / 2 / k
    return min(1.0, total)


def _weighted(null: Null, g, w):
    gw = g * w
    return null.res @ gw, null.covariance(gw)


def skat(y, x, g, w, binary: bool, null: Null | None = None) -> float:
    """Variance-component test with linear weighted kernel."""
    return skat_of(*_weighted(null or Null(y, x, binary), g, w))


def skat_of(u, k) -> float:
    """SKAT of weighted scores u with covariance k."""
    return mixture_sf(float(u @ u), np.linalg.eigvalsh(k))


def skat_burden(y, x, g, w, binary: bool, null: Null | None = None) -> float:
    return skat_burden_of(*_weighted(null or Null(y, x, binary), g, w))


def skat_burden_of(u, k) -> float:
    v = k.sum()
    return float(chi2_1_sf(u.sum() ** 2 / v)) if v > 0 else math.nan


RHO = (0.0, 0.01, 0.04, 0.09, 0.25, 0.5, 1.0)


def skato(y, x, g, w, binary: bool, null: Null | None = None) -> float:
    """Optimal combination of both, over a grid of rho (Lee, Wu and Lin 2012)."""
    return skato_of(*_weighted(null or Null(y, x, binary), g, w))


def skato_of(u, k) -> float:
    m = len(u)
    if m == 1:
        return skat_burden_of(u, k)
    value, vector = np.linalg.eigh(k)
    value = np.maximum(value, 0)
    root = vector * np.sqrt(value) @ vector.T
    k, one = vector * value @ vector.T, root.sum(1)  # the root's square, and what it makes of ones
    ps, lams = [], []
    for rho in RHO:
        rho = min(rho, 0.999)
        q = (1 - rho) * float(u @ u) + rho * float(u.sum()) ** 2
        # eigenvalues of K^1/2 R K^1/2 with R = (1 - rho) I + rho 11'
        lam = np.linalg.eigvalsh((1 - rho) * k + rho * np.outer(one, one)) if rho else value
        lams.append(np.maximum(lam, 0))
        ps.append(mixture_sf(q, lams[-1]))
    zbar2 = float(one @ one) / m**2  # of the mean column
    mean = root.sum(1) / m
    along = root @ mean  # K^1/2 less its projection on the mean column
    rest = k - np.outer(along, along) / (mean @ mean)
    eta = np.maximum(np.linalg.eigvalsh(rest), 0)
    var_zeta = 4 * float(along @ rest @ along) / float(mean @ mean)
    tau = [m * m * rho * zbar2 + (1 - rho) / zbar2 * float(((mean @ root) ** 2).sum()) for rho in (min(r, 0.999) for r in RHO)]
    return optimal(ps, [power_sums(lam) for lam in lams], tau, power_sums(eta), var_zeta)


def optimal(ps: list[float], sums: list[list[float]], tau: list[float], eta: list[float], var_zeta: float) -> float:
    """SKAT-O's P of those of each rho, by the power sums of their eigenvalues and of what is left without the mean column."""
    least = min(ps)
    if least <= 0 or math.isnan(least):
        return least
    # quantiles of each statistic at the least P
    quantiles = []
    for c in sums:
        lo, hi = 0.0, c[0] * 2 + 1e-12
        while liu(hi, c) > least:
            hi *= 2
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if liu(mid, c) > least else (lo, mid)
        quantiles.append((lo + hi) / 2)
    mu_q, var_q = eta[0], 2 * eta[1]
    shrink = math.sqrt(var_q / (var_q + var_zeta)) if var_q > 0 else 1.0
    grid = np.linspace(0, math.sqrt(40), 101)[1:] - math.sqrt(40) / 200
    width = math.sqrt(40) / 100
    total = 0.0
    for z in grid:  # chi-square(1) as the square of a half-normal
        c = z * z
        limit = min((q - t * c) / (1 - min(rho, 0.999)) for q, t, rho in zip(quantiles, tau, RHO, strict=True))
        inner = liu((limit - mu_q) * shrink + mu_q, eta) if limit > 0 and mu_q > 0 else float(limit <= 0)
        total += (1 - min(1.0, max(0.0, inner))) * 2 * math.exp(-c / 2) / math.sqrt(2 * math.pi) * width
    return min(1.0, max(1 - total, least), len(RHO) * least)


def robust(test, y, x, g, w) -> float:
    """A SKAT-family test whose single-variant variances are calibrated by saddle-point P-values (binary; Zhao and others 2020)."""
    keep = g.sum(0) > 0
    if not keep.any():
        return math.nan
    g, w, null = g[:, keep], w[keep], Null(y, x, True)
    u, v = null.res @ g, np.diag(null.covariance(g))
    scale = np.ones(g.shape[1])
    for j in range(g.shape[1]):
        p = spa(null, g[:, j])
        z = -norm_quantile(p / 2) if 0 < p < 1 else 0.0
        if z > 1e-3 and v[j] > 0 and abs(u[j]) > 0:
            scale[j] = max(u[j] ** 2 / (z * z) / v[j], 1e-3)
    # inflating a variance equals scaling the variant's genotypes for the covariance only
    adjusted = Null(y, x, True)
    root = np.sqrt(np.maximum(scale, 1.0))
    plain = adjusted.covariance
    adjusted.covariance = lambda gw: plain(gw * root) if gw.shape[1] == len(root) else plain(gw)
    return test(y, x, g, w, True, adjusted)


def cauchy(p, w=None) -> float:
    """Combination of P-values; nan if none, an error for 0 and 1 together."""
    p = np.asarray(p, float)
    ok = ~np.isnan(p)
    p, w = p[ok], (np.ones(len(p)) if w is None else np.asarray(w, float))[ok]
    if not len(p) or w.sum() <= 0:
        return math.nan
    if (p == 0).any() and (p == 1).any():
        raise ValueError("P-values of 0 and 1 can't be combined")
    if (p == 0).any():
        return 0.0
    if (p == 1).any():
        return 1.0
    t = float((np.where(p < 1e-15, 1 / (np.maximum(p, 1e-300) * math.pi), np.tan((0.5 - p) * math.pi)) * w).sum() / w.sum())
    return math.atan(1 / t) / math.pi if t > 1 else 0.5 - math.atan(t) / math.pi


def acatv(y, x, g, w, binary: bool, kind: str = "score", null: Null | None = None, mac: float = 10) -> float:
    """Cauchy combination of variants: rare ones (allele count up to ``mac``) as one burden, others each; weights (w / dbeta(maf, 1/2, 1/2))^2."""
    null = null or Null(y, x, binary)
    counts = g.sum(0)
    maf = counts / (2 * len(y))
    g, w, counts, maf = g[:, counts > 0], w[counts > 0], counts[counts > 0], maf[counts > 0]
    if not len(w):
        return math.nan

    def one(column) -> float:
        if kind == "spa":
            return spa(null, column)
        if kind == "firth":
            return firth(y, x, column)["P"]
        c = null.clean(column[:, None])[:, 0]
        u = float(null.res @ column)
        if binary:
            v = float((null.v * c * c).sum())
            return float(2 * norm_sf(abs(u) / math.sqrt(v))) if v > 0 else math.nan
        ssg, sst, df = float(c @ c), float(null.res @ null.res), null.n - 1 - null.x.shape[1]
        ssr = u * u / ssg if ssg > 0 else math.nan
        return 2 * t_sf(math.sqrt(ssr / ((sst - ssr) / df)), df) if ssg > 0 else math.nan

    weight = lambda w, f: (w * math.pi) ** 2 * f * (1 - f)
    rare = counts <= mac
    ps, ws = [], []
    if rare.any():
        s = g[:, rare] @ w[rare]
        if kind == "score":
            v = float(null.covariance(s[:, None])[0, 0])
            ps.append(float(chi2_1_sf((null.res @ s) ** 2 / v)) if v > 0 else math.nan)
        else:
            ps.append(one(s))
        ws.append(weight(w[rare].mean(), maf[rare].mean()))
    for j in np.flatnonzero(~rare):
        ps.append(one(g[:, j]))
        ws.append(weight(w[j], maf[j]))
    ps, ws = np.array(ps), np.array(ws)
    if rare.any() and (~rare).any() and (ps < 1).any():
        ps, ws = ps[ps != 1], ws[ps != 1]
    return cauchy(ps, ws)


def permutation_p(observed: float, permuted) -> float:
    return (float((np.asarray(permuted) < observed).sum()) + 1) / (len(permuted) + 1)


def mixed_null(z, x, r):
    """REML null model of z with fixed effects x and a random effect of correlation r: variances, inverse covariance, residuals."""
    value, vector = np.linalg.eigh(r)
    zt, xt = vector.T @ z, vector.T @ x

    def profile(log_h):
        d = 1 / (np.maximum(value, 0) * math.exp(log_h) + 1)
        xx = (xt * d[:, None]).T @ xt
        beta = np.linalg.solve(xx, (xt * d[:, None]).T @ zt)
        e = zt - xt @ beta
        df = len(z) - x.shape[1]
        s2 = float((d * e * e).sum() / df)
        return -0.5 * (df * math.log(s2) - np.log(d).sum() + np.linalg.slogdet(xx)[1]), s2, d, e

    lo, hi = -12.0, 12.0
    for _ in range(80):
        a, b = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
        lo, hi = (lo, b) if profile(a)[0] > profile(b)[0] else (a, hi)
    _, s2, d, e = profile((lo + hi) / 2)
    return {"ratio": math.exp((lo + hi) / 2), "sigma2": s2, "inverse": (vector * (d / s2)) @ vector.T, "resid": vector @ e, "x": x}


def mixed_score(null, s) -> dict:
    """Score test of a fixed effect given a mixed null model; always two-sided."""
    v, x = null["inverse"], null["x"]
    vx = v @ x
    p_s = v @ s - vx @ np.linalg.solve(x.T @ vx, vx.T @ s)
    info = float(s @ p_s)
    if info <= 1e-12:
        return dict(NONE)
    score = float(s @ (v @ null["resid"]))
    b, se = score / info, 1 / math.sqrt(info)
    return {"effect": b, "effectSE": se, "effectCIlower": b - 1.959963984540054 * se, "effectCIupper": b + 1.959963984540054 * se, "OR": math.nan, "P": float(2 * norm_sf(abs(b / se)))}
