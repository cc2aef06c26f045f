"""Numeric kernels of the suffix index: fingerprints, anchors, levels."""

from __future__ import annotations

import numpy as np

from ._common import mix64

LENGTH = 200
GRAM = 32
#: Bases of the polynomial fingerprints (odd, so that they have inverses modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k up to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(20, int(n).bit_length())
        have = tuple(_series(np.uint64(b), size) for b in (base, pow(base, -1, 1 << 64)))
        _POWERS[base] = have
    return have


def _series(b: np.uint64, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done, step = 1, int(b)
    while done < size:
        out[done : 2 * done] = out[: min(done, size - done)] * np.uint64(step)
        done, step = 2 * done, step * step % (1 << 64)
    return out


class Prints:
    """Fingerprints of any part of some bytes."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """The anchors of all windows of ``length`` bytes within texts: text, position in it, key, span, left, right.

    A window's anchor is its gram of least hash, the first of equals. An anchor stands for the windows
    around it that it is the anchor of: they start ``left`` bytes before it and later, and end ``right``
    bytes after its start and earlier. ``span`` is the fingerprint of all the bytes of those windows.
    """
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 6
    prints = Prints(data)
    g = prints.grams(gram)
    ranked = (g & np.uint64(0xFFFFFFFFFF000000)) | (np.arange(len(g), dtype=np.uint64) & np.uint64(0xFFFFFF))
    least = sliding_min(ranked, length - gram + 1)
    starts = np.arange(n - length + 1)
    # the position's low bits, put right: it lies within length - gram of the start
    at = starts + (((least & np.uint64(0xFFFFFF)).astype(np.int64) - starts) & 0xFFFFFF)
    text = np.searchsorted(offsets, starts, side="right") - 1
    inside = starts + length <= offsets[text + 1]
    starts, at, text = starts[inside], at[inside], text[inside]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 6
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    a, lo, hi = at[first], starts[first], starts[last] + length
    left, right = a - lo, hi - a
    span = prints.of(lo, hi) ^ mix64(((left << 16) | right).astype(np.uint64))
    return text[first], a - offsets[text[first]], g[a].view(np.int64), span.view(np.int64), left, right


class Levels:
    """A logarithmic family of suffix arrays.

    Each batch of suffixes gets an array of its own, sorted by the fingerprint of the suffixes' first
    bytes: only matches of the full length count, so any total order of those serves. The batch is
    merge-scanned against the arrays of all levels, which marks matching suffixes on both sides, and
    joins the family; the two smallest levels are merged as long as they are about equal in size. So
    there are never more levels than the logarithm of the number of suffixes.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.matched = np.zeros(0, bool)

    def add(self, first: np.ndarray, second: np.ndarray, twice: np.ndarray) -> None:
        """Suffixes by two fingerprints; ``twice``: those that the batch stands for more than once."""
        ids = len(self.matched) + np.arange(len(first))
        self.matched = np.concatenate([self.matched, twice])
        order = np.argsort(first, kind="stable")
        new = first[order], second[order], ids[order]
        same = (new[0][1:] == new[0][:-1]) & (new[1][1:] == new[1][:-1])
        self.matched[new[2][1:][same]] = True
        self.matched[new[2][:-1][same]] = True
        for level in self.levels:
            self._scan(new, level)
        self.levels.append(new)
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            b, a = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(a, b, strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.levels.append(tuple(x[order] for x in both))

    def _scan(self, new, level) -> None:
        lo, hi = np.searchsorted(level[0], new[0]), np.searchsorted(level[0], new[0], side="right")
        hit = np.flatnonzero(hi > lo)
        hit = hit[level[1][lo[hit]] == new[1][hit]]
        self.matched[new[2][hit]] = True
        change = np.zeros(len(level[0]) + 1, np.int64)
        np.add.at(change, lo[hit], 1)
        np.add.at(change, hi[hit], -1)
        self.matched[level[2][np.cumsum(change[:-1]) > 0]] = True
