"""Gradient-boosted trees for two classes, in numpy: binned features, complete trees of one depth, Newton leaf values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """trees of 2 ** depth leaves each. Inner node k of a tree sends a row to child 2k + 2 if its feature exceeds the
    threshold, else to 2k + 1."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    depth: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Each tree fits the gradient of the log loss; a split has to leave a hessian of least on both sides."""
    n, m = x.shape
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    # features of two values go by one product of matrices, the others by histograms
    two = np.flatnonzero([len(e) == 1 and len(np.unique(c)) == 2 for e, c in zip(edges, x.T, strict=True)])
    many = [j for j in range(m) if j not in set(two) and len(edges[j])]
    above = np.ascontiguousarray((binned[:, two] > 0).T, dtype=np.float64)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score, inner = np.full(n, base), 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at, feature, threshold = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = at - first
            best, cut = np.full(width, 1e-6), np.full(width, BINS)
            which = np.zeros(width, np.int64)
            if len(two):
                spread_g, spread_h = np.zeros((n, width)), np.zeros((n, width))
                spread_g[np.arange(n), place], spread_h[np.arange(n), place] = g, h
                gr, hr, gt, ht = above @ spread_g, above @ spread_h, spread_g.sum(axis=0), spread_h.sum(axis=0)
                gain = gr**2 / (hr + ridge) + (gt - gr) ** 2 / (ht - hr + ridge) - gt**2 / (ht + ridge)
                gain[(hr < least) | (ht - hr < least)] = 0
                k = gain.argmax(axis=0)
                top = gain[k, np.arange(width)]
                better = top > best
                best[better], which[better], cut[better] = top[better], two[k[better]], 0
            for j in many:
                code = place * BINS + binned[:, j]
                gs = np.bincount(code, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(code, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], which[better], cut[better] = top[better], j, k[better]
            for k in range(width):
                if cut[k] < BINS:
                    feature[first + k], threshold[first + k] = which[k], edges[which[k]][cut[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        place = at - inner
        leaf = rate * np.bincount(place, g, 2**depth) / (np.bincount(place, h, 2**depth) + ridge)
        score += leaf[place]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Boosted(base, np.array(features), np.array(thresholds), np.array(leaves), depth)
