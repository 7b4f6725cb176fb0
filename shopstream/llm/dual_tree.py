"""Trees over integer vectors and their exact dual-tree nearest-entry assignment (numpy only)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

LEAF = 64                    # points a leaf holds at least, where there are as many
PAIR_BLOCK = 1 << 16         # (point, entry) pairs whose distances are held at once


class Tree(NamedTuple):
    """A balanced tree: the nodes of level l are slices of the reordered points, halved from level to level."""

    order: np.ndarray        # place in the input of each point in tree order
    lo: list[np.ndarray]     # per level, the least and largest components of each node's points
    hi: list[np.ndarray]
    sums: list[np.ndarray]   # per level, the cached sums of each node's points


def levels_of(n: int, leaf: int) -> int:
    levels = 0
    while n >> (levels + 1) >= leaf:
        levels += 1
    return levels


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end in tree order; node i has the children 2 i and 2 i + 1."""
    cut = np.array([0, n])
    for _ in range(level):
        both = np.empty(2 * len(cut) - 1, np.int64)
        both[::2] = cut
        both[1::2] = (cut[:-1] + cut[1:]) // 2
        cut = both
    return cut


def boxes(points: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(points, cut[:-1]), np.maximum.reduceat(points, cut[:-1])


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halve every node at the median of its widest component, down to leaves of ``leaf`` points or more."""
    n = len(points)
    order, depth = np.arange(n), levels_of(n, leaf)
    for level in range(depth):
        cut = bounds(n, level)
        lo, hi = boxes(points[order], cut)
        widest = np.repeat(np.argmax(hi - lo, axis=1), np.diff(cut))
        node = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        order = order[np.lexsort((points[order, widest], node))]
    placed = points[order]
    lo, hi, sums = [], [], []
    for level in range(depth + 1):
        cut = bounds(n, level)
        low, high = boxes(placed, cut)
        lo.append(low)
        hi.append(high)
        sums.append(np.add.reduceat(placed, cut[:-1]))
    return Tree(order, lo, hi, sums)


def _groups(p: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.r_[True, p[1:] != p[:-1]])


def _near(p, e, plo, phi, elo, ehi):
    """The pairs whose boxes may hold a nearest entry: the least distance is within the best sure distance of the node."""
    a, b, c, d = plo[p], phi[p], elo[e], ehi[e]
    gap = np.maximum(np.maximum(c - b, a - d), 0)
    far = np.maximum(d - a, b - c)
    least, most = np.einsum("ij,ij->i", gap, gap), np.einsum("ij,ij->i", far, far)
    starts = _groups(p)
    sure = np.repeat(np.minimum.reduceat(most, starts), np.diff(np.r_[starts, len(p)]))
    keep = least <= sure
    return p[keep], e[keep]


def _beaten(p, e, plo, phi, entries):
    """The pairs left when the entry next to a node's middle beats others in every corner of the node's box."""
    twice = plo[p] + phi[p] - 2 * entries[e]
    middle = np.einsum("ij,ij->i", twice, twice)
    starts = _groups(p)
    sizes = np.diff(np.r_[starts, len(p)])
    least = np.repeat(np.minimum.reduceat(middle, starts), sizes)
    at = np.flatnonzero(middle == least)
    best = np.repeat(e[at[np.searchsorted(at, starts)]], sizes)          # of equal ones the lower entry
    z, w = entries[e], entries[best]
    away = z - w
    corner = np.where(away > 0, phi[p], plo[p])
    margin = np.einsum("ij,ij->i", z, z) - np.einsum("ij,ij->i", w, w) - 2 * np.einsum("ij,ij->i", corner, away)
    keep = (e == best) | (margin < 0) | ((margin == 0) & (e < best))
    return p[keep], e[keep]


def _children(p, e, of_points: bool):
    """Both children of one side of every pair, ordered by node and entry node."""
    if of_points:
        p, e = np.r_[2 * p, 2 * p + 1], np.r_[e, e]
    else:
        p, e = np.r_[p, p], np.r_[2 * e, 2 * e + 1]
    at = np.lexsort((e, p))
    return p[at], e[at]


def assign(placed: np.ndarray, tree: Tree, entries: np.ndarray, whole=None) -> np.ndarray:
    """The nearest entry (ties: the lower index) of each point in tree order; exact.

    ``placed`` are the points in tree order.  Nodes all of whose points share their nearest entry are assigned
    whole; ``whole(entry, sum, count)`` is told their cached sums, and those of single points otherwise.
    """
    n, k = placed.shape[0], len(entries)
    over = build(entries, 1)
    inner = levels_of(k, 1)
    depth = levels_of(n, LEAF)
    out = np.full(n, -1, np.int64)
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level = 0
    for down in range(1, inner + 1):                                     # both trees downwards in turn
        p, e = _near(*_children(p, e, False), tree.lo[level], tree.hi[level], over.lo[down], over.hi[down])
        if level < depth and down % 2 == 0:
            level += 1
            p, e = _near(*_children(p, e, True), tree.lo[level], tree.hi[level], over.lo[down], over.hi[down])
    cut = bounds(k, inner)                                               # leaves of the entries' tree, one or two entries each
    sizes = np.diff(cut)[e]
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    p, e = np.repeat(p, sizes), over.order[np.repeat(cut[e], sizes) + inside]
    at = np.lexsort((e, p))
    p, e = p[at], e[at]
    while True:
        lo, hi = tree.lo[level], tree.hi[level]
        p, e = _near(p, e, lo, hi, entries, entries)
        p, e = _beaten(p, e, lo, hi, entries)
        starts = _groups(p)
        alone = np.diff(np.r_[starts, len(p)]) == 1
        cut = bounds(n, level)
        for node, entry in zip(p[starts[alone]], e[starts[alone]]):      # assigned whole
            out[cut[node]:cut[node + 1]] = entry
        if whole is not None and alone.any():
            nodes = p[starts[alone]]
            whole(e[starts[alone]], tree.sums[level][nodes], (cut[nodes + 1] - cut[nodes]))
        open_ = np.repeat(~alone, np.diff(np.r_[starts, len(p)]))
        p, e = p[open_], e[open_]
        if not len(p) or level == depth:
            break
        level += 1
        p, e = _children(p, e, True)
    if len(p):
        _points(placed, entries, p, e, cut, out, whole)
    return out


def _points(placed, entries, p, e, cut, out, whole) -> None:
    """Points of uncertain leaves, one by one, by integer distances to the leaf's remaining entries."""
    starts = np.r_[_groups(p), len(p)]
    for i in range(len(starts) - 1):
        a, b = cut[p[starts[i]]], cut[p[starts[i]] + 1]
        mine = e[starts[i]:starts[i + 1]]                                # ascending: argmin takes the lower of equals
        x, z = placed[a:b], entries[mine]
        if (b - a) * len(mine) > PAIR_BLOCK:
            got = np.concatenate([mine[np.argmin(_squares(x[j:j + 1], z), axis=1)] for j in range(b - a)])
        else:
            got = mine[np.argmin(_squares(x, z), axis=1)]
        out[a:b] = got
        if whole is not None:
            whole(got, x, np.ones(b - a, np.int64))


def _squares(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Squared distances less each point's own square: the order among entries is the same."""
    return np.einsum("ij,ij->i", z, z)[None, :] - 2 * (x @ z.T)
