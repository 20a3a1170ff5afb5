"""Gradient-boosted trees and isotonic calibration in numpy, for models fitted on a bounded sample at the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Depth-limited trees on binned features for the logistic loss; fixed order of everything, so refits agree."""

    rounds: int = 120
    depth: int = 4
    rate: float = 0.1
    bins: int = 32
    least: float = 8.0
    ridge: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b, n_feat = self.binned(x), x.shape[1]
        p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p0 / (1 - p0)))
        raw = np.full(len(y), self.base)
        width = self.bins
        flat = b + np.arange(n_feat) * width
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feat, cut, leaf = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, np.int64), np.zeros(2 ** (self.depth + 1) - 1)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                at = ((node - first)[:, None] * (n_feat * width) + flat).ravel()
                hist = [np.bincount(at, np.repeat(v, n_feat), many * n_feat * width).reshape(many, n_feat, width) for v in (g, h)]
                gl, hl = hist[0].cumsum(2), hist[1].cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < self.least / 4) | (ht - hl < self.least / 4)] = 0
                best = gain.reshape(many, -1).argmax(1)
                good = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
                f, c = best // width, best % width
                feat[first : first + many] = np.where(good, f, -1)
                cut[first : first + many] = c
                k = node - first
                right = good[k] & (b[np.arange(len(y)), f[k]] > c[k])
                node = 2 * node + 1 + right
            first = 2**self.depth - 1
            leaf[first:] = np.bincount(node - first, g, first + 1) / (np.bincount(node - first, h, first + 1) + self.ridge) * self.rate
            self.trees.append((feat, cut, leaf))
            raw += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.trees or not len(x):
            return out
        b, rows = self.binned(x), np.arange(len(x))
        for feat, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feat[node]
                node = 2 * node + 1 + ((f >= 0) & (b[rows, f] > cut[node]))
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the increasing fit of y by pooling adjacent violators; between knots it is linear, so
    that different scores keep their order."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2] + s2]
    knots = np.array([b[2] / b[1] for b in blocks])
    # a block's share, drawn towards the middle by one case of either kind, keeps probabilities off 0 and 1
    return knots, np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks]))


def calibrated(knots: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    """The fit at `score`; beyond the outer knots it approaches 0 and 1, still increasing."""
    x, p = knots
    out = np.interp(score, x, p)
    low, high = score < x[0], score > x[-1]
    out[low] = p[0] * np.exp(np.maximum(score[low] - x[0], -50) / 10)
    out[high] = 1 - (1 - p[-1]) * np.exp(-np.minimum(score[high] - x[-1], 50) / 10)
    return np.clip(out, 0.0, 1.0)
