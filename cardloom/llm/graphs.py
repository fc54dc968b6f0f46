"""Neighbour graphs and communities of one block of unit vectors, in memory."""

from __future__ import annotations

import numpy as np

from cardloom.llm import projections as P


def _leaves(x: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) of the leaves of a random tree: a node is cut half-way across the line through two means of some of its rows."""
    order, starts, stack = np.arange(len(x)), [], [(0, len(x))]
    while stack:
        a, b = stack.pop()
        if b - a <= leaf:
            starts.append(a)
            continue
        rows = order[a:b]
        some = x[rows[rng.integers(0, b - a, 48)]]
        u, v = some[0], some[1]
        for _ in range(2):
            near = some @ (u - v) > 0
            if near.all() or not near.any():
                break
            u, v = some[near].mean(0), some[~near].mean(0)
        u, v = u / max(1e-9, float(np.sqrt(u @ u))), v / max(1e-9, float(np.sqrt(v @ v)))
        # leaves are whole multiples of the leaf size, but for the last
        mid = max(leaf, (b - a) // 2 // leaf * leaf)
        order[a:b] = rows[np.argpartition(x[rows] @ (u - v), mid)]
        stack += [(a + mid, b), (a, a + mid)]
    return order, np.array([*starts, len(x)])


def _first_lists(x: np.ndarray, k: int, rng: np.random.Generator, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists to start from: the best of each row's leaf in a random tree."""
    n = len(x)
    order, starts = _leaves(x, leaf, rng)
    ids, cos = np.full((n, k), -1, np.int64), np.full((n, k), -2, np.float32)
    full = (len(starts) - 2) * leaf
    blocks = [order[:full].reshape(-1, leaf)] if full else []
    if n - full > 1:
        blocks.append(order[full:].reshape(1, -1))
    for rows in blocks:
        for s in range(0, len(rows), 512):
            r = rows[s : s + 512]
            v = x[r]
            sim = v @ v.transpose(0, 2, 1)
            d = np.arange(r.shape[1])
            sim[:, d, d] = -2
            kk = min(k, r.shape[1] - 1)
            best = np.argpartition(-sim, kk - 1, axis=2)[:, :, :kk]
            ids[r, :kk] = np.take_along_axis(np.broadcast_to(r[:, None, :], sim.shape), best, 2)
            cos[r, :kk] = np.take_along_axis(sim, best, 2)
    return ids, cos


def _merged(ids: np.ndarray, cos: np.ndarray, more: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of two sets of lists, each id once; -1 and -2 where there are fewer."""
    k = ids.shape[1]
    both, sim = np.concatenate([ids, more], 1), np.concatenate([cos, score], 1)
    by = np.argsort(both, axis=1, kind="stable")
    both, sim = np.take_along_axis(both, by, 1), np.take_along_axis(sim, by, 1)
    sim[:, 1:][both[:, 1:] == both[:, :-1]] = -2
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    ids, cos = np.take_along_axis(both, best, 1), np.take_along_axis(sim, best, 1)
    ids[cos <= -2] = -1
    return ids, cos


def _reverse(ids: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """Up to width rows that list each row, at random; -1 where there are fewer."""
    n, k = ids.shape
    src, dst = np.repeat(np.arange(n), k), ids.ravel()
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    mix = rng.permutation(len(dst))
    src, dst = src[mix], dst[mix]
    by = np.argsort(dst, kind="stable")
    src, dst = src[by], dst[by]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
    keep = rank < width
    out = np.full((n, width), -1, np.int64)
    out[dst[keep], rank[keep]] = src[keep]
    return out


def neighbour_descent(x: np.ndarray, k: int, seed: int = 5, rounds: int = 3, tries: int = 24, enough: float = 0.005, leaf: int = 768, trees: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines), n x k: approximate nearest neighbours of each row; -1 where there are fewer.

    Lists start from the leaves of several random trees; then every row tries neighbours of its neighbours, in
    both directions, until a round changes less than `enough` of all entries.
    """
    rng = np.random.default_rng([seed, len(x)])
    ids, cos = _first_lists(x, k, rng, leaf)
    n = len(x)
    if n <= leaf:
        return ids, cos
    for _ in range(trees - 1):
        ids, cos = _merged(ids, cos, *_first_lists(x, k, rng, leaf))
    for _ in range(rounds):
        around = np.concatenate([ids, _reverse(ids, k // 2, rng)], axis=1)
        changed = 0
        for s in range(0, n, 4096):
            e = min(n, s + 4096)
            via = np.take_along_axis(around[s:e], rng.integers(0, around.shape[1], (e - s, tries)), 1)
            cand = around[via, rng.integers(0, around.shape[1], (e - s, tries))]
            cand[(via < 0) | (cand == np.arange(s, e)[:, None])] = -1
            sim = np.empty(cand.shape, np.float32)
            for i in range(0, e - s, 512):
                sim[i : i + 512] = np.matmul(x[cand[i : i + 512]], x[s + i : min(e, s + i + 512), :, None])[:, :, 0]
            # nothing below the worst of a list can enter it
            sim[(cand < 0) | (sim <= cos[s:e].min(1)[:, None])] = -2
            new_ids, new_cos = _merged(ids[s:e], cos[s:e], cand, sim)
            changed += int((np.sort(new_cos, 1) != np.sort(cos[s:e], 1)).sum())
            ids[s:e], cos[s:e] = new_ids, new_cos
        if changed < enough * n * k:
            break
    return ids, cos


def graph(ids: np.ndarray, cos: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Undirected edges (a < b, weight) of the lists; an edge in both lists counts once."""
    n, k = ids.shape
    a, b, w = np.repeat(np.arange(n), k), ids.ravel(), cos.ravel()
    ok = (b >= 0) & (w >= least)
    a, b, w = a[ok], b[ok], w[ok].astype(np.float64)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    _, first = np.unique(lo * n + hi, return_index=True)
    return lo[first], hi[first], w[first]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers from lo up to hi, pair after pair."""
    n = hi - lo
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def _best_moves(active: np.ndarray, begin: np.ndarray, dst: np.ndarray, ww: np.ndarray, com: np.ndarray, degree: np.ndarray, mass: np.ndarray, total: float, resolution: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that gain by moving, and where to."""
    at = _ranges(begin[active], begin[active + 1])
    place = np.repeat(np.arange(len(active)), begin[active + 1] - begin[active])
    key = place * len(com) + com[dst[at]]
    by = np.argsort(key, kind="stable")
    key = key[by]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    if not len(head):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    link = np.add.reduceat(ww[at][by], head)
    place, target = key[head] // len(com), key[head] % len(com)
    node = active[place]
    own = target == com[node]
    gain = link - resolution * degree[node] * (mass[target] - np.where(own, degree[node], 0)) / total
    stay = -resolution * degree[active] * (mass[com[active]] - degree[active]) / total
    stay[place[own]] = gain[own]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    most = np.maximum.reduceat(gain, first)
    # targets ascend within a node: the first of the greatest gains
    is_best = np.flatnonzero(gain == most[np.searchsorted(first, np.arange(len(gain)), "right") - 1])
    best = is_best[np.unique(place[is_best], return_index=True)[1]]
    ok = (gain[best] > stay[place[best]] + 1e-12) & ~own[best]
    return node[best[ok]], target[best[ok]]


def modularity_communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, seed: int = 3) -> np.ndarray:
    """Label per node: local moves by modularity gain, then the same over the communities, until nothing moves.

    In a round a random half of the nodes moves at once, each to the neighbouring community of the
    greatest gain; of equal gains the smallest label. The next round looks at their neighbours and at those
    that did not come to move. A level ends when no node of all would move.
    """
    rng = np.random.default_rng([seed, n])
    label = np.arange(n)
    loops = np.zeros(n)
    while len(a):
        size = len(loops)
        degree = np.bincount(a, w, size) + np.bincount(b, w, size) + 2 * loops
        total = degree.sum()
        if total <= 0:
            break
        com = np.arange(size)
        src, dst, ww = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        by = np.argsort(src, kind="stable")
        dst, ww = dst[by], ww[by]
        begin = np.searchsorted(src[by], np.arange(size + 1))
        mass = degree.copy()
        moved_ever, share, whole, active = False, 0.5, True, np.arange(size)
        while True:
            v, t = _best_moves(active, begin, dst, ww, com, degree, mass, total, resolution)
            if not len(v):
                if whole:
                    break
                whole, active = True, np.arange(size)
                continue
            # moves at once may undo each other's gain, so fewer are made at once later on
            moves = rng.random(len(v)) < share
            share = max(share * 0.97, 0.1)
            if not moves.any():
                moves[rng.integers(len(v))] = True
            go, to = v[moves], t[moves]
            mass += np.bincount(to, degree[go], size) - np.bincount(com[go], degree[go], size)
            com[go] = to
            moved_ever = True
            whole, active = False, np.unique(np.concatenate([v[~moves], dst[_ranges(begin[go], begin[go + 1])]]))
        if not moved_ever:
            break
        names, com = np.unique(com, return_inverse=True)
        label = com[label]
        m = len(names)
        inner = np.bincount(com, loops, m)
        ca, cb = com[a], com[b]
        same = ca == cb
        loops = inner + np.bincount(ca[same], w[same], m)
        lo, hi = np.minimum(ca, cb)[~same], np.maximum(ca, cb)[~same]
        uniq, at = np.unique(lo * m + hi, return_inverse=True)
        a, b, w = uniq // m, uniq % m, np.bincount(at, w[~same], len(uniq)) if len(uniq) else np.empty(0)
    return label


def coherent_communities(x: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, least: float, depth: int = 5) -> np.ndarray:
    """modularity_communities(), and again within every community whose vectors do not share a direction.

    A few edges are enough to join small communities of a large graph; within the joined one alone they
    are not. A community is coherent if the mean of its unit vectors has at least length `least`.
    """
    n = len(x)
    label = modularity_communities(n, a, b, w, resolution)
    done: set[int] = set()
    for _ in range(depth):
        m = int(label.max()) + 1 if n else 0
        sums = np.zeros((m, x.shape[1]))
        np.add.at(sums, label, x)
        count = np.bincount(label, minlength=m)
        length = np.sqrt((sums**2).sum(1)) / np.maximum(count, 1)
        loose = [c for c in np.flatnonzero((length < least) & (count > 2)) if c not in done]
        if not loose:
            break
        inner = label[a] == label[b]
        by = np.argsort(label[a[inner]], kind="stable")
        ea, eb, ew = a[inner][by], b[inner][by], w[inner][by]
        owner = label[ea]
        rows_by = np.argsort(label, kind="stable")
        at = np.searchsorted(label[rows_by], np.arange(m + 1))
        for c in loose:
            rows = np.sort(rows_by[at[c] : at[c + 1]])
            lo, hi = np.searchsorted(owner, [c, c + 1])
            sub = modularity_communities(len(rows), np.searchsorted(rows, ea[lo:hi]), np.searchsorted(rows, eb[lo:hi]), ew[lo:hi], resolution)
            if sub.max() == 0:
                done.add(c)
            else:
                label[rows[sub > 0]] = label.max() + sub[sub > 0]
    return np.unique(label, return_inverse=True)[1]
