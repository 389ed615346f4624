"""Isolation-tree helpers run inside Spark tasks (NumPy, small inputs).

Definitions follow Liu, Ting and Zhou, "Isolation Forest" (ICDM 2008): a
tree splits a sample of psi rows on a random feature at a uniform random
value between the node's min and max, up to depth ceil(log2 psi); a row's
path length is its leaf depth plus c(size of the leaf), and the anomaly
score is 2 ** (-mean path length / c(psi)).
"""

from __future__ import annotations

import math

import numpy as np

EULER_GAMMA = 0.5772156649015329


def average_path_length(n):
    """c(n): mean path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


def height_limit(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


def build_trees(x: np.ndarray, tree_of_row: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Isolation trees for several samples at once, grown level by level.

    ``x`` holds the rows of all samples, ``tree_of_row`` their tree ids.
    At each depth every open node gets its rows' min and max per feature
    (``reduceat`` over rows sorted by node); a node with one row, only
    constant features or at ``max_depth`` becomes a leaf with value
    depth + c(rows); otherwise its split feature is uniform among the
    non-constant ones and the split value uniform in [min, max). Rows with
    x <= threshold go left.

    Returns (tree, node, feature, threshold, left, right, value) with node
    ids local to each tree (root 0) and feature -1 on leaves."""
    trees, roots_of_row = np.unique(tree_of_row, return_inverse=True)
    n_trees, n = trees.size, x.shape[0]
    cap = 2 * n + n_trees + 1
    owner = np.zeros(cap, np.int64)
    feature = np.full(cap, -1, np.int64)
    threshold = np.zeros(cap)
    left = np.full(cap, -1, np.int64)
    right = np.full(cap, -1, np.int64)
    value = np.zeros(cap)
    owner[:n_trees] = np.arange(n_trees)
    used = n_trees
    node_of_row = roots_of_row.astype(np.int64)
    active = np.arange(n)
    slot = np.full(cap, -1, np.int64)
    for depth in range(max_depth + 1):
        if active.size == 0:
            break
        r = active[np.argsort(node_of_row[active], kind="stable")]
        nr = node_of_row[r]
        uniq, starts, counts = np.unique(nr, return_index=True, return_counts=True)
        xr = x[r]
        mins = np.minimum.reduceat(xr, starts, axis=0)
        maxs = np.maximum.reduceat(xr, starts, axis=0)
        nonconst = maxs > mins
        ncand = nonconst.sum(axis=1)
        split = (counts > 1) & (ncand > 0) & (depth < max_depth)
        value[uniq[~split]] = depth + average_path_length(counts[~split])
        if not split.any():
            break
        su, m = uniq[split], int(split.sum())
        u = rng.random((m, 2))
        nc = ncand[split]
        k = np.minimum((u[:, 0] * nc).astype(np.int64), nc - 1)
        f = np.argmax(np.cumsum(nonconst[split], axis=1) > k[:, None], axis=1)
        idx = np.arange(m)
        lo, hi = mins[split][idx, f], maxs[split][idx, f]
        thr = lo + u[:, 1] * (hi - lo)
        thr = np.where(thr >= hi, lo, thr)
        lid = used + 2 * idx
        feature[su], threshold[su], left[su], right[su] = f, thr, lid, lid + 1
        owner[lid], owner[lid + 1] = owner[su], owner[su]
        used += 2 * m
        slot[su] = idx
        si = slot[nr]
        keep = si >= 0
        r2, s2 = r[keep], si[keep]
        go_left = x[r2, f[s2]] <= thr[s2]
        node_of_row[r2] = np.where(go_left, lid[s2], lid[s2] + 1)
        slot[su] = -1
        active = r2
    owner, feature, threshold = owner[:used], feature[:used], threshold[:used]
    left, right, value = left[:used], right[:used], value[:used]
    # node ids local to each tree, in creation order (root first)
    order = np.lexsort((np.arange(used), owner))
    first = np.searchsorted(owner[order], np.arange(n_trees))
    local = np.empty(used, np.int64)
    local[order] = np.arange(used) - first[owner[order]]
    lft = np.where(left >= 0, local[np.maximum(left, 0)], -1)
    rgt = np.where(right >= 0, local[np.maximum(right, 0)], -1)
    return trees[owner], local, feature, threshold, lft, rgt, value


def build_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """One isolation tree over the rows of ``x``: (feature, threshold, left,
    right, value) indexed by node id."""
    _, node, feature, threshold, left, right, value = build_trees(
        x, np.zeros(x.shape[0], np.int64), rng, max_depth)
    order = np.argsort(node)
    return (feature[order].astype(np.int32), threshold[order], left[order].astype(np.int32),
            right[order].astype(np.int32), value[order])


class PackedForest:
    """All trees of one model concatenated, with global node ids."""

    def __init__(self, feature, threshold, left, right, value, roots, max_depth, c_psi):
        self.feature, self.threshold = feature, threshold
        self.left, self.right, self.value = left, right, value
        self.roots, self.max_depth, self.c_psi = roots, max_depth, c_psi

    @classmethod
    def from_nodes(cls, tree, node, feature, threshold, left, right, value, max_depth, c_psi):
        """Node rows (any order) with per-tree local ids -> packed arrays."""
        order = np.lexsort((node, tree))
        tree, node = tree[order], node[order]
        trees, starts = np.unique(tree, return_index=True)
        base = np.zeros(tree.size, np.int64)
        for s, e in zip(starts, list(starts[1:]) + [tree.size]):
            base[s:e] = s
        lft, rgt = left[order].astype(np.int64), right[order].astype(np.int64)
        lft = np.where(lft >= 0, lft + base, -1)
        rgt = np.where(rgt >= 0, rgt + base, -1)
        return cls(feature[order].astype(np.int64), threshold[order].astype(np.float64), lft, rgt,
                   value[order].astype(np.float64), starts.astype(np.int64), int(max_depth), float(c_psi))

    def mean_path_length(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[0]
        if n == 0:
            return np.zeros(0)
        node = np.repeat(self.roots[:, None], n, axis=1)
        cols = np.arange(n)[None, :]
        for _ in range(self.max_depth + 1):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            xv = x[cols, np.where(inner, f, 0)]
            nxt = np.where(xv <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(inner, nxt, node)
        return self.value[node].mean(axis=0)

    def score_samples(self, x: np.ndarray) -> np.ndarray:
        """-(2 ** (-E[h] / c(psi))): lower = more anomalous. A one-row sample
        (c(psi) = 0) isolates nothing: every row scores -1."""
        if self.c_psi <= 0:
            return np.full(x.shape[0], -1.0)
        return -np.power(2.0, -self.mean_path_length(x) / self.c_psi)
