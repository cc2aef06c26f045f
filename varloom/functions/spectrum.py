"""Tests of the SKAT family of units of many variants, without the matrix of their covariance.

The covariance is S + U M U': S of the stored cells, whose entries are of pairs of variants that share a sample, and few columns U of baselines
and covariates. S falls into groups of variants that no sample links, and only these are matrices, if they are small. What the tests need of all eigenvalues are
sums of powers, and determinants on the grid of Imhof's integral: those of S, times those of a matrix as small as M. Both follow from traces of polynomials
of S, which is how larger groups are done (``Linked``).
"""

from __future__ import annotations

import math

import numpy as np

from .dist import chi2_1_sf
from .models import BLOCK, GRID, RHO, TERMS, _phases, imhof, liu, optimal, points

#: Numbers that a batch of scores or of samples holds at most, beside those of a single one.
CELLS = 1_000_000
LARGEST = 32
#: Linked variants that are decomposed as a matrix, steps of the Krylov space of larger groups, and what the logarithm of a damped determinant may be off.
LINKED, STEPS, EXACT = 2_000, 10, 1e-9
#: Numbers of a block of rows of products, small enough for a core's own cache.
NEAR = 125_000


def _spread(cuts, sizes):
    """Places of runs (start, size), one after the other, and the number of each one's run."""
    row = np.repeat(np.arange(len(cuts)), sizes)
    return np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(cuts, sizes), row


def add_products(k, variant, sample, dev, v) -> None:
    """Add to k (variants x variants) the products of the cells that share a sample, times the sample's v."""
    m = len(k)
    order = np.argsort(sample, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(sample[order]) != 0]) if len(order) else order
    sizes = np.diff(np.r_[cuts, len(order)])
    j, dev, v = variant[order], dev[order], v[order]
    heavy = np.minimum(sizes, m) * 16 > m  # their pairs cost more than a dense row
    for group in np.array_split(np.flatnonzero(heavy), -(-int(heavy.sum()) * m // CELLS) or 1):
        at, row = _spread(cuts[group], sizes[group])
        dense = np.zeros((len(group), m))
        dense[row, j[at]] = dev[at]
        weight = v[cuts[group]]
        k += (dense * weight[:, None]).T @ dense
    few = np.flatnonzero(~heavy)
    for size in np.unique(sizes[few]):
        own = few[sizes[few] == size]
        for group in np.array_split(own, -(-len(own) * int(size) ** 2 // CELLS) or 1):
            at = cuts[group][:, None] + np.arange(size)
            product = dev[at][:, :, None] * (dev[at] * v[at])[:, None, :]
            np.add.at(k, (np.repeat(j[at], size, 1).ravel(), np.tile(j[at], (1, size)).ravel()), product.ravel())


def linked(variant, sample, size: int) -> np.ndarray:
    """Of each variant, the smallest one that samples link it with."""
    label, samples = np.arange(size), int(sample.max(initial=-1)) + 1
    while True:
        least = np.full(samples, size)
        np.minimum.at(least, sample, label[variant])
        new = label.copy()
        np.minimum.at(new, variant, least[sample])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(variant, sample, value, m: int):
    """Rows of the products of the cells (values times the roots of their samples' variances) that share a sample: begin, column, value."""
    order = np.argsort(sample, kind="stable")
    variant, value = variant[order], value[order]
    cuts = np.flatnonzero(np.r_[True, np.diff(sample[order]) != 0])
    sizes = np.diff(np.r_[cuts, len(order)])
    of = np.repeat(np.arange(len(cuts)), sizes)  # run of each cell
    other, cell = _spread(cuts[of], sizes[of])
    return _rows(variant[cell], variant[other], value[cell] * value[other], m)


def _rows(row, column, value, m: int):
    """Entries added up and sorted by row and column: begin of each row, column, value."""
    key, at = np.unique(row.astype(np.int64) * m + column, return_inverse=True)
    return np.searchsorted(key // m, np.arange(m + 1)), key % m, np.bincount(at, value, len(key))


def _product(a, rows, b, m: int) -> np.ndarray:
    """Some rows of a product of two tables of rows, dense."""
    cell, row = _spread(a[0][rows], a[0][rows + 1] - a[0][rows])
    j = a[1][cell]
    at, of = _spread(b[0][j], b[0][j + 1] - b[0][j])
    return np.bincount(row[of] * m + b[1][at], a[2][cell][of] * b[2][at], len(rows) * m).reshape(len(rows), m)


def _basis(x, least: float) -> np.ndarray:
    """Orthonormal columns that make those of x, but for what is at most ``least``."""
    u, size, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, size > least]


class Linked:
    """Many variants that samples link: exact traces of Chebyshev polynomials of S, from rows of its products, no matrix of S.

    log(1 - i u x) is a series of these polynomials in closed form, so the determinant of 1 - i u S follows from their traces. Polynomials are added until what is
    left out, damped as Imhof's integral damps it, is under ``EXACT``. Memory grows with the cells and the pairs that share a sample, not with the square of the variants.
    """

    def __init__(self, variant, sample, dev, v, m: int):
        self.m, value = m, dev * np.sqrt(v)
        order = np.argsort(sample, kind="stable")
        self.by_sample = variant[order], value[order][:, None], np.flatnonzero(np.r_[True, np.diff(sample[order]) != 0])
        run = np.cumsum(np.r_[False, np.diff(sample[order]) != 0])
        back = np.argsort(variant[order], kind="stable")
        self.by_variant = run[back], value[order][back][:, None], np.searchsorted(variant[order][back], np.arange(m))
        self.sizes = np.diff(np.r_[self.by_sample[2], len(order)]).astype(float)
        self.cells = variant, sample, value

    def times(self, x) -> np.ndarray:
        """S x, of any number of columns; every variant has cells."""
        for j, value, cuts in (self.by_sample, self.by_variant):
            x = np.add.reduceat(x[j] * value, cuts, axis=0)
        return x

    def krylov(self, start) -> tuple[np.ndarray, np.ndarray]:
        """Ritz values of the space that powers of S make of columns, and the columns as its Ritz vectors see them."""
        norm = np.linalg.norm(start, axis=0)
        held = [_basis(start[:, norm > 0] / norm[norm > 0], 1e-12)]
        images = [self.times(held[0])]
        for _ in range(STEPS):
            every, w = np.column_stack(held), images[-1]
            size = np.linalg.norm(w, axis=0).max(initial=0)
            for _ in range(2):
                w = w - every @ (every.T @ w)
            q = _basis(w, 1e-10 * size)
            if not q.shape[1]:
                break
            held.append(np.linalg.qr(q - every @ (every.T @ q))[0])
            images.append(self.times(held[-1]))
        every = np.column_stack(held)
        value, vector = np.linalg.eigh(every.T @ np.column_stack(images))
        return np.maximum(value, 0), vector.T @ (every.T @ start)

    def measure(self, most: float) -> None:
        """Traces of polynomials (``mu``), with S scaled from 0 to ``most`` to -1 to 1."""
        self.half, steps = most / 2, 4
        while True:
            self.mu = self._traces(steps)
            square = self.power_sum(2)
            u = np.geomspace(0.02, 1, 60) * np.sqrt(8 * math.log(1e8) / square)
            a, (_, damp) = np.abs(self._ratio(u)[0]), self.phases(u)
            left = 2 * self.m * a ** (2 * steps + 1) / (2 * steps + 1) / (1 - a) * np.exp(-0.25 * np.maximum(damp, 0))
            if left.max() < EXACT:
                return
            steps *= 2

    def _traces(self, steps: int) -> np.ndarray:
        m, out = self.m, np.zeros(2 * steps + 1)
        out[0] = m
        width = 1 + float((self.sizes * (self.sizes - 1)).sum()) / m  # entries in a row of S
        if steps == 4 and width**4 < 16 * len(self.cells[0]) and m * min(width**2, m) < 16 * CELLS:  # products of rows from the few rows they are made of
            begin, column, value = _pairs(*self.cells, m)
            begin, column, value = first = _rows(np.r_[np.repeat(np.arange(m), np.diff(begin)), np.arange(m)], np.r_[column, np.arange(m)], np.r_[value / self.half, -np.ones(m)], m)
            size = np.diff(begin)
            parts = []
            for rows in np.array_split(np.arange(m), -(-max(int(size[column].sum()), m * m) // NEAR)):
                dense = 2 * _product(first, rows, first, m)
                dense[np.arange(len(rows)), rows] -= 1
                r, c = np.nonzero(dense)
                parts.append((rows[r], c, dense[r, c]))
            second = _rows(*(np.concatenate(x) for x in zip(*parts, strict=True)), m)
            del parts
            size = np.diff(second[0])
            one, eye = (np.arange(m + 1), np.arange(m), np.ones(m)), np.zeros(0)
            for rows in np.array_split(np.arange(m), min(m, -(-int(size[second[1]].sum()) // NEAR))):
                t = [eye, _product(one, rows, first, m), _product(one, rows, second, m)]
                t.append(2 * _product(second, rows, first, m) - t[1])
                t.append(2 * _product(second, rows, second, m))
                t[4][np.arange(len(rows)), rows] -= 1
                out[1] += t[1][np.arange(len(rows)), rows].sum()
                for k in range(1, 5):
                    out[2 * k] += 2 * float(np.vdot(t[k], t[k]))
                    if k > 1:
                        out[2 * k - 1] += 2 * float(np.vdot(t[k], t[k - 1]))
        else:
            step = max(1, CELLS // max(m, len(self.cells[0])))
            for b in range(0, m, step):
                old = np.eye(m, min(step, m - b), -b)
                new = self.times(old) / self.half - old
                out[1] += float(np.vdot(old, new))
                for k in range(1, steps + 1):
                    out[2 * k] += 2 * float(np.vdot(new, new))
                    if k > 1:
                        out[2 * k - 1] += 2 * float(np.vdot(new, old))
                    if k < steps:
                        old, new = new, 2 * (self.times(new) / self.half - new) - old
        out[2::2] -= m
        out[3::2] -= out[1]
        return out

    def power_sum(self, k: int) -> float:
        c = np.polynomial.chebyshev.chebpow([self.half, self.half], k)
        return float(c @ self.mu[: k + 1])

    def _ratio(self, u) -> tuple[np.ndarray, np.ndarray]:
        """1 - i u x = k (1 - 2 a t + a^2) at x = half (1 + t): a and k."""
        w = 1j * u * self.half
        a = w / (1 - w + np.sqrt(1 - 2 * w))
        return a, (1 - w) / (1 + a * a)

    def phases(self, u) -> tuple[np.ndarray, np.ndarray]:
        """``models._phases`` of the eigenvalues of S."""
        a, k = self._ratio(u)
        got, power = self.m * np.log(k), np.ones(len(u), complex)
        for j in range(1, len(self.mu)):
            power = power * a
            got = got - 2 / j * self.mu[j] * power
        return -got.imag, 2 * got.real


def _orthogonal(u, middle) -> tuple[np.ndarray, np.ndarray]:
    """U M U' with orthogonal columns, so that what cancels in it is gone before powers are taken."""
    q, r = np.linalg.qr(u)
    return q, r @ middle @ r.T


def _traces(value, u, middle, more=(0.0,) * 4) -> list[float]:
    """Traces of powers 1 to 4 of S + U M U', with the ``LARGEST`` eigenvalues of S moved to U, where they may cancel; ``more``: of S alone, what is not in ``value``."""
    k, n = min(LARGEST, len(value)), len(middle)
    held, middle = value[len(value) - k :], np.pad(middle, (0, k))
    middle[n:, n:] = np.diag(held)
    u, middle = _orthogonal(np.column_stack([u, np.eye(len(value), k, k - len(value))]), middle)
    value = np.r_[value[: len(value) - k], np.zeros(k)]
    d = [middle @ ((u * (value**k)[:, None]).T @ u) for k in range(4)]
    s, trace = [float((value**k).sum()) + more[k - 1] for k in (1, 2, 3, 4)], np.trace
    out = (
        s[0] + trace(d[0]),
        s[1] + 2 * trace(d[1]) + trace(d[0] @ d[0]),
        s[2] + 3 * trace(d[2]) + 3 * trace(d[0] @ d[1]) + trace(d[0] @ d[0] @ d[0]),
        s[3] + 4 * trace(d[3]) + 4 * trace(d[0] @ d[2]) + 2 * trace(d[1] @ d[1]) + 4 * trace(d[0] @ d[0] @ d[1]) + trace(d[0] @ d[0] @ d[0] @ d[0]),
    )
    return [float(t) for t in out]


class Spectrum:
    """Ascending eigenvalues of S, the columns of U and one of ones as its eigenvectors see them (``seen``), and M.

    Of ``groups`` the eigenvalues aren't known: theirs in ``value`` are those of spaces that hold U and ones, which tell all but traces and determinants of S.
    ``known`` marks the others.
    """

    def __init__(self, value, seen, middle, known=None, groups=()):
        self.groups = groups
        known = np.ones(len(value), bool) if known is None else known
        order = np.argsort(value)
        self.value, one = np.maximum(value[order], 0), seen[order, -1]
        self.known = self.value[known[order]]
        #: Sums of powers 1 to 4 of the eigenvalues that aren't known, less those that stand for them in ``value``.
        spare = self.value[~known[order]]
        more = [sum(g.power_sum(k) for g in groups) - float((spare**k).sum()) for k in (1, 2, 3, 4)]
        u, self.middle = _orthogonal(seen[order, :-1], middle)
        seen = np.column_stack([u, one])
        self.pair = np.triu_indices(seen.shape[1])
        self.pairs = seen[:, self.pair[0]] * seen[:, self.pair[1]]
        self.ones = float(one @ one)
        times = lambda x: self.value * x + u @ (self.middle @ (u.T @ x))
        first = times(one)
        second = times(first)
        #: Of ones with powers 1 to 4 of the covariance, traces of these powers.
        self.a = [float(x @ y) for x, y in ((one, first), (first, first), (first, second), (second, second))]
        self.t = _traces(self.value, u, self.middle, more)
        #: Of K - K 11' K / (1'K1): traces of powers 1 to 4; and four times its variance along K^1/2 1.
        self.rest, self.along = None, math.nan
        if self.a[0] > 0:
            wider = np.pad(self.middle, (0, 1))
            wider[-1, -1] = -1 / self.a[0]
            self.rest = _traces(self.value, np.column_stack([u, first]), wider, more)
            self.along = 4 * float(first @ (second - first * (self.a[1] / self.a[0]))) / self.a[0]

    @classmethod
    def of_cells(cls, variant, sample, dev, v, low, middle) -> Spectrum:
        """Cells (variant, sample, deviation, variance of the sample), U and M."""
        m = len(low)
        label, seen = linked(variant, sample, m), np.column_stack([low, np.ones(m)])
        value = np.bincount(variant, v * dev * dev, m)  # of variants that share no sample
        size = np.bincount(label, minlength=m)
        members, of_cell = np.argsort(label, kind="stable"), np.argsort(label[variant], kind="stable")
        begin, cells = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(np.bincount(label[variant], minlength=m))]
        place = np.empty(m, int)
        place[members] = np.arange(m)
        known, groups, extra = np.ones(m, bool), [], []
        for g in np.flatnonzero(size > 1):
            own, c = members[begin[g] : begin[g + 1]], of_cell[cells[g] : cells[g + 1]]
            if len(own) > LINKED:
                group = Linked(place[variant[c]] - begin[g], sample[c], dev[c], v[c], len(own))
                extra.append(group.krylov(seen[own]))
                group.measure(1.05 * float(extra[-1][0].max()))
                groups.append(group)
                known[own] = False
                continue
            k = np.zeros((len(own), len(own)))
            add_products(k, place[variant[c]] - begin[g], sample[c], dev[c], v[c])
            value[own], vector = np.linalg.eigh(k)
            seen[own] = vector.T @ seen[own]
        value, seen = (np.concatenate([a[known], *x]) for a, x in ((value, [e[0] for e in extra]), (seen, [e[1] for e in extra])))
        return cls(value, seen, middle, np.arange(len(value)) < known.sum(), groups)

    def _phases(self, u) -> tuple[np.ndarray, np.ndarray]:
        """``models._phases`` of the eigenvalues of S."""
        turn, damp = _phases(u, self.known)
        for g in self.groups:
            more = g.phases(u)
            turn, damp = turn + more[0], damp + more[1]
        return turn, damp

    def sums(self, rho: float) -> list[float]:
        """Power sums of the eigenvalues of (1 - rho) K + rho K^1/2 11' K^1/2."""
        x, y, a, t = 1 - rho, rho, self.a, self.t
        return [
            x * t[0] + y * a[0],
            x**2 * t[1] + 2 * x * y * a[1] + y**2 * a[0] ** 2,
            x**3 * t[2] + 3 * x**2 * y * a[2] + 3 * x * y**2 * a[0] * a[1] + y**3 * a[0] ** 3,
            x**4 * t[3] + 4 * x**3 * y * a[3] + x**2 * y**2 * (4 * a[0] * a[2] + 2 * a[1] ** 2) + 4 * x * y**3 * a[0] ** 2 * a[1] + y**4 * a[0] ** 4,
        ]

    def _resolvent(self, at) -> np.ndarray:
        """seen' (1 - i at S)^-1 seen at ascending points (points x columns x columns): a series where at S is small, the others in blocks."""
        small = np.searchsorted(self.value * at[-1], 0.5, "right")
        x, t = self.value[:small] * at[-1], at / at[-1]
        sums, power = np.empty((2 * TERMS, self.pairs.shape[1])), np.ones(small)
        for k in range(2 * TERMS):
            sums[k] = power @ self.pairs[:small]
            power = power * x
        sign, square = (-1.0) ** np.arange(TERMS), (t * t)[:, None] ** np.arange(TERMS)
        out = square @ (sign[:, None] * sums[::2]) + 1j * (square * t[:, None]) @ (sign[:, None] * sums[1::2])
        rest, pairs = self.value[small:], self.pairs[small:]
        step = max(1, BLOCK // max(1, len(rest)))
        for b in range(0, len(at) if len(rest) else 0, step):
            part = at[b : b + step, None] * rest
            near = 1 / (1 + part * part)
            out[b : b + step] += near @ pairs + 1j * ((part * near) @ pairs)
        i, j = self.pair
        size = len(self.middle) + 1
        full = np.empty((len(at), size, size), complex)
        full[:, i, j] = full[:, j, i] = out
        return full

    def _small(self, at, rho: float) -> tuple[np.ndarray, np.ndarray]:
        """Angle and logarithm of the modulus of what the determinant has beside that of 1 - i at S."""
        r = self._resolvent(at)
        w, u = (1j * at)[:, None, None], r[:, :-1, :-1]
        e = np.eye(u.shape[1]) - w * (self.middle @ u)
        sign, size = np.linalg.slogdet(e)
        if rho:
            side = r[:, :-1, -1:]
            ones = r[:, -1, -1] + (w * (side.swapaxes(1, 2) @ np.linalg.solve(e, self.middle @ side)))[:, 0, 0]
            more = 1 - rho / (1 - rho) * (ones - self.ones)
            sign, size = sign * more, size + np.log(np.abs(more))
        return np.angle(sign), size

    def tail(self, q: float, rho: float = 0.0) -> float:
        """``models.mixture_sf`` of the eigenvalues of (1 - rho) K + rho K^1/2 11' K^1/2."""
        c = self.sums(rho)
        if not c[0] > 0:
            return 1.0
        q, unit = q / c[0], (1 - rho) / c[0]
        damped = lambda x: self._phases(np.array([x * unit]))[1][0] + 2 * self._small(np.array([x * unit]), rho)[1][0]
        top = 1.0
        while 0.25 * damped(top) + math.log(top) < math.log(1e8) and top < 1e7:
            top *= 1.5
        step = top / points(q, top)
        # neither angle grows by more between two points, so that steps of less than pi tell the whole angle
        finer = math.ceil(step * max(1.0, unit * (float(self.known.sum()) + sum(g.power_sum(1) for g in self.groups))) / 2)
        last = 0.0

        def phases(part):
            nonlocal last
            turn, damp = self._phases(part * unit)
            every = part[0] - step + step / finer * np.arange(1, finer * len(part) + 1)
            for block in np.array_split(np.arange(len(every)), -(-len(every) // GRID)):
                on = block[every[block] > 0]
                if not len(on):
                    continue
                angle, size = self._small(every[on] * unit, rho)
                angle = np.unwrap(np.r_[last, angle])[1:]
                last = angle[-1]
                kept = on % finer == finer - 1
                turn[on[kept] // finer] -= angle[kept]
                damp[on[kept] // finer] += 2 * size[kept]
            return turn, damp

        p = imhof(q, top, phases)
        return p if 1e-6 < p < 1 else liu(q * c[0], c)

    def skat(self, u) -> float:
        return self.tail(float(u @ u))

    def skat_burden(self, u) -> float:
        return float(chi2_1_sf(u.sum() ** 2 / self.a[0])) if self.a[0] > 0 else math.nan

    def skato(self, u) -> float:
        grid = [min(rho, 0.999) for rho in RHO]
        ps = [self.tail((1 - rho) * float(u @ u) + rho * float(u.sum()) ** 2, rho) for rho in grid]
        if self.rest is None:
            return math.nan
        tau = [rho * self.a[0] + (1 - rho) * self.a[1] / self.a[0] for rho in grid]
        return float(optimal(ps, [self.sums(rho) for rho in grid], tau, self.rest, self.along))
