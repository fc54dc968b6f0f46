"""Numeric kernels on unit vectors: stable projections, a kd-tree over them, and the chi-square stopping test."""

from __future__ import annotations

import math

import numpy as np


def chi2_cdf(x: float, m: int) -> float:
    """Distribution function of chi-square with an even number m of degrees of freedom."""
    if m % 2:
        raise ValueError("m must be even")
    half, term, total = x / 2, 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= half / (i + 1)
    return 1.0 - math.exp(-half) * total


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 10.0 * m + 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def stable_projection(dim: int, m: int, seed: int = 17) -> np.ndarray:
    """dim x m Gaussian (2-stable) matrix: squared projected distance = squared distance times chi-square(m)."""
    return np.random.default_rng([seed, dim, m]).standard_normal((dim, m)).astype(np.float32)


def kd_leaves(p: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows in kd-tree order, and where each leaf of at most leaf rows begins (with the end).

    A node is cut at the median of its widest coordinate.
    """
    order, starts, stack = np.arange(len(p)), [], [(0, len(p))]
    while stack:
        a, b = stack.pop()
        if b - a <= leaf:
            starts.append(a)
            continue
        rows = order[a:b]
        sub = p[rows]
        axis = int(np.argmax(sub.max(0) - sub.min(0)))
        # leaves are whole multiples of the leaf size, but for the last
        mid = max(leaf, (b - a) // 2 // leaf * leaf)
        order[a:b] = rows[np.argpartition(sub[:, axis], mid)]
        stack += [(a + mid, b), (a, a + mid)]
    return order, np.array([*starts, len(p)])


def boxes(p: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of each leaf; p is in leaf order."""
    if len(p) == 0:
        return np.empty((0, p.shape[1]), p.dtype), np.empty((0, p.shape[1]), p.dtype)
    return np.minimum.reduceat(p, starts[:-1]), np.maximum.reduceat(p, starts[:-1])


def box_gaps(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """Squared distance between one box and each of many: no pair of their rows is nearer."""
    gap = np.maximum(0, np.maximum(los - hi, lo - his))
    return np.einsum("ij,ij->i", gap, gap)


class TopK:
    """Best k (cosine, id) per row, kept as rows arrive; floor[row] is what a new one must reach. least is one for all or one per row."""

    def __init__(self, n: int, k: int, least: float | np.ndarray):
        self.k, self.n = k, n
        self.cos = np.full((n, k), -np.inf, np.float32)
        self.col = np.full((n, k), -1, np.int64)
        self.least = np.array(np.broadcast_to(np.asarray(least, np.float32), n))
        self.floor = self.least.copy()

    def add(self, rows: np.ndarray, cols: np.ndarray, cos: np.ndarray) -> None:
        if not len(rows):
            return
        touched, at = np.unique(rows, return_inverse=True)
        old = self.cos[touched]
        r = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        c = np.concatenate([self.col[touched].ravel(), cols])
        s = np.concatenate([old.ravel(), cos])
        by = np.lexsort((c, -s, r))
        r, c, s = r[by], c[by], s[by]
        first = np.searchsorted(r, np.arange(len(touched)))
        rank = np.arange(len(r)) - first[r]
        keep = rank < self.k
        self.cos[touched[r[keep]], rank[keep]] = s[keep]
        self.col[touched[r[keep]], rank[keep]] = c[keep]
        full = self.cos[touched, self.k - 1]
        # a full row takes only strictly better ones
        least = self.least[touched]
        self.floor[touched] = np.where(full > -np.inf, np.nextafter(np.maximum(full, least), np.float32(2)), least)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, j = np.nonzero(self.col >= 0)
        return row, self.col[row, j], self.cos[row, j]


class Index:
    """Unit vectors of one block in kd-tree order of their projections."""

    def __init__(self, x: np.ndarray, m: int, leaf: int, seed: int = 17):
        p = x @ stable_projection(x.shape[1], m, seed)
        self.order, self.starts = kd_leaves(p, leaf)
        self.x = np.ascontiguousarray(x[self.order])
        self.lo, self.hi = boxes(p[self.order], self.starts)

    def __len__(self) -> int:
        return len(self.starts) - 1


def _chunks(index: Index, leaves: np.ndarray, rows: int):
    """(row numbers, vectors) of the leaves, about so many rows at a time; neighbouring leaves need no copy."""
    group, n = [], 0
    for leaf in leaves:
        group.append(leaf)
        n += index.starts[leaf + 1] - index.starts[leaf]
        if n >= rows:
            yield group
            group, n = [], 0
    if group:
        yield group


def search_both(a: Index, b: Index, top_a: TopK, top_b: TopK, same: bool, quantile: float, rows: int = 4096, shift: int = 0) -> int:
    """All pairs whose cosine reaches the floor of either side, found once and given to both sides.

    Leaves are skipped when the chi-square test says that their rows are farther than the floor with
    the wanted probability. Rows of b are known to a by their number plus shift. Returns how many pairs were verified.
    """
    verified = 0
    if not len(b.x):
        return 0
    for i in range(len(a)):
        s, e = a.starts[i], a.starts[i + 1]
        q = a.x[s:e]
        first = i if same else 0
        gaps = box_gaps(a.lo[i], a.hi[i], b.lo[first:], b.hi[first:])
        lowest = min(float(top_a.floor[s:e].min()), float(top_b.floor.min()))
        near = np.flatnonzero(gaps <= (2 - 2 * lowest) * quantile) + first
        for group in _chunks(b, near, rows):
            at = np.concatenate([np.arange(b.starts[g], b.starts[g + 1]) for g in group])
            cos = q @ b.x[at].T
            verified += cos.size
            low_a, low_b = top_a.floor[s:e], top_b.floor[at]
            least = min(float(low_a.min()), float(low_b.min()))
            if least == max(float(low_a.max()), float(low_b.max())):
                hit = cos >= least
            else:
                hit = cos >= np.minimum(low_a[:, None], low_b[None])
            r, c = np.nonzero(hit)
            if not len(r):
                continue
            v = cos[r, c]
            r, c = r + s, at[c]
            if same:
                keep = r < c
                r, c, v = r[keep], c[keep], v[keep]
                top_a.add(np.concatenate([r, c]), np.concatenate([c, r]), np.concatenate([v, v]))
            else:
                top_a.add(r, c + shift, v)
                top_b.add(c, r, v)
    return verified


def search(q: np.ndarray, b: Index, top: TopK, quantile: float, block: int = 256, rows: int = 4096) -> int:
    """Best k of b for every row of q (both in the same dimension); q is best ordered by place.

    Leaves come in the order of their projected distance; a block of queries stops at the chi-square
    test: when the next leaf's distance over the k-th best distance exceeds the quantile.
    """
    verified = 0
    m = b.lo.shape[1]
    p = q @ stable_projection(q.shape[1], m)
    for s in range(0, len(q), block):
        e = min(len(q), s + block)
        gaps = box_gaps(p[s:e].min(0), p[s:e].max(0), b.lo, b.hi)
        leaves = np.argsort(gaps, kind="stable")
        for group in _chunks(b, leaves, rows):
            if gaps[group[0]] > (2 - 2 * float(top.floor[s:e].min())) * quantile:
                break
            at = np.concatenate([np.arange(b.starts[g], b.starts[g + 1]) for g in group])
            cos = q[s:e] @ b.x[at].T
            verified += cos.size
            r, c = np.nonzero(cos >= top.floor[s:e, None])
            if len(r) > 4 * top.k * (e - s):  # the first chunks: cut down before sorting
                k = min(top.k, cos.shape[1])
                c = np.argpartition(-cos, k - 1, axis=1)[:, :k].ravel()
                r = np.repeat(np.arange(e - s), k)
                ok = cos[r, c] >= top.floor[s + r]
                r, c = r[ok], c[ok]
            top.add(r + s, at[c], cos[r, c])
    return verified
