"""Cells of a vector space: pivots fitted on a bounded sample, and the cells a vector has to visit.

Every vector has one home, the cell of its nearest pivot. Of two vectors with different homes the distances to the
plane half-way between the two pivots add up to no more than their distance projected to the plane's normal, so one
of them is within half of that. The square of such a projection to one direction is the squared distance over the
number of dimensions times chi-square(1): a vector visits the cells whose plane is nearer than half the wanted
quantile, and a pair meets in the home of one of its two vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.vectors import matrix

#: Vectors per model that pivots are fitted on, and pivots of a model at most (before hot cells are split).
SAMPLE, PIVOTS = 40_000, 4_096

#: Distinct vectors of a cell (by the sample's estimate) from which it is split by pivots of its own, into parts of at least a hundredth.
HOT = 40_000


@dataclass
class Space:
    """Pivots of one model, and the task of its first cell."""

    model: str
    code: int
    pivots: np.ndarray
    base: int
    apart: np.ndarray | None = field(default=None, repr=False)

    def distances(self) -> np.ndarray:
        """Distances between the pivots, computed once in a worker."""
        if self.apart is None:
            self.apart = np.sqrt(np.maximum(2 - 2 * self.pivots @ self.pivots.T, 1e-12))
        return self.apart


def digest(x: np.ndarray) -> np.ndarray:
    """A 64-bit key of each unit row, the same for the same direction to six digits."""
    odd = np.random.default_rng(71).integers(-(2**62), 2**62, x.shape[1]) | 1
    return (np.round(x.astype(np.float64) * 1e6).astype(np.int64) * odd).sum(1)


def distinct(x: np.ndarray) -> np.ndarray:
    return x[np.sort(np.unique(digest(x), return_index=True)[1])]


def homes(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest pivot of every row."""
    return np.concatenate([np.argmax(x[s : s + 4096] @ c.T, 1) for s in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def fit_pivots(x: np.ndarray, n: int, seed: int = 23) -> np.ndarray:
    """Spherical k-means over the distinct vectors; at most n pivots, each different and nearest to some vector."""
    x = distinct(x)
    rng = np.random.default_rng([seed, len(x)])
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(8):
        at = homes(x, c)
        by = np.argsort(at, kind="stable")
        used, first = np.unique(at[by], return_index=True)
        sums = np.zeros_like(c)
        sums[used] = np.add.reduceat(x[by], first)
        norm = np.sqrt((sums**2).sum(1))
        c = np.where(norm[:, None] > 1e-6, sums / np.maximum(norm, 1e-6)[:, None], c)
    c = distinct(c.astype(np.float32))
    return c[np.unique(homes(x, c))]


def split_hot(x: np.ndarray, c: np.ndarray, each: float, hot: int) -> np.ndarray:
    """Pivots c, those of cells above `hot` replaced by several; a vector of the sample x stands for `each`."""
    x, part = distinct(x), max(4, hot // 100)
    while True:
        at = homes(x, c)
        size = np.bincount(at, minlength=len(c)) * each
        parts = {i: fit_pivots(x[at == i], max(2, min(int(np.ceil(2 * size[i] / hot)), int(size[i] // part)))) for i in np.flatnonzero(size > hot)}
        parts = {i: p for i, p in parts.items() if len(p) > 1}
        if not parts:
            return c
        c = distinct(np.concatenate([np.delete(c, list(parts), 0), *parts.values()]))
        c = c[np.unique(homes(x, c))]


def fit(rows: DataFrame, keys: DataFrame, cell: int, sample: int = SAMPLE, hot: int = HOT) -> tuple[list[Space], int]:
    """Spaces of all models of rows (model, note_id, vec) with a pivot for every `cell` rows, and how many cells there are.

    Pivots are fitted on some `sample` vectors per model, picked by a hash of note_id; keys has a row (model, ...) for each of rows.
    """
    counts = sorted((r["model"], r["n"]) for r in keys.groupBy("model").agg(F.count("*").alias("n")).collect())  # a row per model
    share = F.lit(0.0)
    for model, n in counts:
        share = F.when(F.col("model") == model, min(1.0, sample / n)).otherwise(share)
    taken = rows.where(F.pmod(F.xxhash64("note_id", F.lit(97)), F.lit(1_000_000)) < share * 1_000_000).select("model", "note_id", "vec").toArrow()
    spaces, tasks = [], 0
    for code, (model, n) in enumerate(counts):
        drawn = taken.filter(pc.equal(taken["model"], model))
        if drawn.num_rows:
            x = matrix(drawn["vec"])
            x = x[np.lexsort((digest(x), drawn["note_id"].to_numpy()))]  # whatever order the rows came in
            c = fit_pivots(x, max(1, min(PIVOTS, len(x), round(n / cell))))
            c = split_hot(x, c, n / len(x), hot)
        else:
            c = np.ones((1, 1), np.float32)
        spaces.append(Space(model, code, c, tasks))
        tasks += len(c)
    return spaces, tasks


def reach(distance: float | np.ndarray, dim: int, certainty: float) -> float | np.ndarray:
    """How near a plane has to be for vectors this far apart to lie on its two sides, with this certainty; half of it if both may visit."""
    return NormalDist().inv_cdf(certainty) * distance / np.sqrt(dim)


def visits(x: np.ndarray, space: Space, within: float | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(home of the rows, guests, their cells) for blocks of rows: the cells beyond planes nearer than `within`, a number or one per row."""
    far = space.distances()
    within = np.broadcast_to(np.asarray(within, np.float32), len(x))
    for s in range(0, len(x), 2048):
        near = x[s : s + 2048] @ space.pivots.T
        home = np.argmax(near, 1)
        at = np.arange(len(near))
        ok = near[at, home][:, None] - near <= within[s : s + 2048, None] * far[home]
        ok[at, home] = False
        i, j = np.nonzero(ok)
        yield home, i + s, j
