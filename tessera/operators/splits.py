"""Split points for prebins, from histograms."""

from __future__ import annotations

import heapq
import math

import numpy as np

from .histogram import Histogram

METHODS = ("cart", "mdlp", "quantile", "uniform")


def uniform_splits(low: float, high: float, n_bins: int) -> np.ndarray:
    """Inner edges of ``n_bins`` equally wide bins."""
    return np.unique(np.linspace(low, high, n_bins + 1)[1:-1]) if high > low else np.zeros(0)


def weighted_quantiles(values: np.ndarray, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Linear-interpolation quantiles of a column given by values and integer counts."""
    upto = np.cumsum(counts)
    rank = q * (upto[-1] - 1)
    below, part = np.floor(rank), rank - np.floor(rank)
    at = lambda r: values[np.minimum(np.searchsorted(upto, r, side="right"), len(values) - 1)]
    return at(below) + part * (at(below + 1) - at(below))


def quantile_splits(h: Histogram, n_bins: int) -> np.ndarray:
    """Inner edges of ``n_bins`` equally frequent bins; equal edges are one."""
    if not len(h.low):
        return np.zeros(0)
    return np.unique(weighted_quantiles(h.low.astype(float), h.size(), np.linspace(0, 1, n_bins + 1)[1:-1]))


def quantile_cells(h: Histogram, n_bins: int) -> np.ndarray:
    """The cells of several values that hold a value which :func:`quantile_splits` reads."""
    if not len(h.low):
        return np.zeros(0, int)
    upto = np.cumsum(h.size())
    rank = np.floor(np.linspace(0, 1, n_bins + 1)[1:-1] * (upto[-1] - 1))
    at = np.unique(np.minimum(np.searchsorted(upto, np.concatenate([rank, rank + 1]), side="right"), len(upto) - 1))
    return at[h.low[at] < h.high[at]]


def _impurity(kind: str, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight times gini impurity, or sum of squared errors, of rows of sums."""
    w = np.maximum(weight, 1e-300)
    if kind == "continuous":
        return total[..., 1] - total[..., 0] ** 2 / w
    return weight - (total**2).sum(axis=-1) / w


def cart_splits(h: Histogram, kind: str, max_leaves: int, min_leaf: float, unsure: set[int] | None = None) -> np.ndarray:
    """Thresholds of a best-first tree on one feature.

    Leaves hold at least ``min_leaf`` of the weight.  A threshold lies halfway between
    neighbouring values in single precision, as trees on single-precision features have it.
    ``unsure`` receives the cells of several values inside which a better split of a node may lie
    (binary targets only); if there are none, the tree is the one of the values.
    """
    if not len(h.low):
        return np.zeros(0)
    low, high = h.low.astype(np.float32).astype(float), h.high.astype(np.float32).astype(float)
    if kind == "continuous":
        sums, weight = np.stack([h.moments["s"], h.moments["ss"]], axis=1), h.moments["n"]
    else:
        sums = np.stack(list(h.moments.values()), axis=1)
        weight = sums.sum(axis=1)
    prefix = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)])
    wide = np.concatenate([[0.0], np.cumsum(weight)])
    distinct = np.append(False, low[1:] > high[:-1] + 1e-7)  # a split may stand before this cell

    def best(a: int, b: int) -> tuple[float, int]:
        """(gain, first cell of the right side) of the cells a..b-1."""
        gain, cut = best_edge(a, b)
        if unsure is not None:
            unsure.update(better_inside(a, b, gain))
        return gain, cut

    def better_inside(a: int, b: int, gain: float) -> list[int]:
        """Cells whose inner splits may gain as much: a gain is convex in the sums at the left, so corners bound it."""
        c = a + np.flatnonzero(h.low[a:b] < h.high[a:b])
        left, right = wide[c + 1] - wide[a], wide[b] - wide[c]
        c = c[(left >= min_leaf - 1e-9) & (right >= min_leaf - 1e-9)]
        bound = np.full(len(c), -np.inf)
        for share in ((0, 0), (0, 1), (1, 0), (1, 1)):
            l = prefix[c] - prefix[a] + sums[c] * np.array(share)  # noqa: E741
            r = prefix[b] - prefix[a] - l
            loss = _impurity(kind, l, l.sum(axis=1)) + _impurity(kind, r, r.sum(axis=1))
            bound = np.maximum(bound, _impurity(kind, prefix[b] - prefix[a], wide[b] - wide[a]) - loss)
        return c[(bound >= gain - tiny) & (bound > tiny)].tolist()

    def best_edge(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        at = at[distinct[at]]
        left, right = wide[at] - wide[a], wide[b] - wide[at]
        at = at[(left >= min_leaf - 1e-9) & (right >= min_leaf - 1e-9)]
        if not len(at):
            return 0.0, -1
        whole = _impurity(kind, prefix[b] - prefix[a], wide[b] - wide[a])
        gain = whole - _impurity(kind, prefix[at] - prefix[a], wide[at] - wide[a]) - _impurity(kind, prefix[b] - prefix[at], wide[b] - wide[at])
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    tiny = 1e-12 * max(1.0, float(abs(_impurity(kind, prefix[-1], wide[-1]))))
    heap, cuts, order = [], [], 0

    def push(a: int, b: int) -> None:
        nonlocal order
        gain, cut = best(a, b)
        if cut > 0 and gain > tiny:
            heapq.heappush(heap, (-gain, order, a, b, cut))
            order += 1

    push(0, len(low))
    while heap and len(cuts) < max_leaves - 1:
        _, _, a, b, cut = heapq.heappop(heap)
        cuts.append(cut)
        push(a, cut)
        push(cut, b)
    return np.unique([(high[c - 1] + low[c]) / 2 for c in cuts]) if cuts else np.zeros(0)


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log(p)).sum())


def mdlp_candidates(h: Histogram, max_candidates: int = 32) -> np.ndarray:
    """Midpoints between neighbouring values whose classes differ; percentiles if there are too many."""
    counts = np.stack(list(h.moments.values()), axis=1)
    x = h.low.astype(float)
    pure = (counts > 0).sum(axis=1) == 1
    top = counts.argmax(axis=1)
    same = pure[1:] & pure[:-1] & (top[1:] == top[:-1])
    found = ((x[1:] + x[:-1]) / 2)[~same]
    if len(found) > max_candidates:
        found = np.unique(np.percentile(np.repeat(x, h.size().astype(int)) if h.size().sum() < 1e6 else weighted_quantiles(x, h.size(), np.linspace(0, 1, 1001)), np.linspace(1, 100, max_candidates)))
    return found


def mdlp_splits(h: Histogram, min_samples_split: int = 2, min_samples_leaf: int = 2, max_candidates: int = 32) -> np.ndarray:
    """Splits by recursive minimum-description-length partitioning.

    A node's split is taken before the stopping rule is tested, so the node at which the recursion
    stops still gives one.
    """
    x, counts = h.low.astype(float), np.stack(list(h.moments.values()), axis=1)
    out: list[float] = []

    def part(a: int, b: int) -> Histogram:
        return Histogram(True, x[a:b], x[a:b], {str(i): counts[a:b, i] for i in range(counts.shape[1])}, {}, [])

    def recurse(a: int, b: int) -> None:
        total = counts[a:b].sum(axis=0)
        n = total.sum()
        if b - a < 2 or n < min_samples_split:
            return
        best = None
        for split in mdlp_candidates(part(a, b), max_candidates):
            m = a + int(np.searchsorted(x[a:b], split, side="left"))
            left, right = counts[a:m].sum(axis=0), counts[m:b].sum(axis=0)
            if min(left.sum(), right.sum()) < max(min_samples_leaf, 1):
                continue
            gain = _entropy(total) - (left.sum() * _entropy(left) + right.sum() * _entropy(right)) / n
            if best is None or gain > best[0]:
                best = (gain, float(split), m, left, right)
        if best is None:
            return
        gain, split, m, left, right = best
        out.append(split)
        k, k1, k2 = ((c > 0).sum() for c in (total, left, right))
        delta = math.log(3.0**k - 2) - (k * _entropy(total) - k1 * _entropy(left) - k2 * _entropy(right))
        if gain > (math.log(n - 1) + delta) / n:
            recurse(a, m)
            recurse(m, b)

    recurse(0, len(x))
    return np.unique(out)


def prebin_splits(h: Histogram, kind: str, method: str, max_n_prebins: int, min_leaf: float, **kwargs) -> np.ndarray:
    """Inner edges of at most ``max_n_prebins`` prebins."""
    if method not in METHODS:
        raise ValueError(f"prebinning_method is one of {METHODS}")
    if method == "mdlp" and kind == "continuous":
        raise ValueError("mdlp needs a class target")
    if not len(h.low):
        return np.zeros(0)
    if method == "uniform":
        return uniform_splits(float(h.low[0]), float(h.high[-1]), max_n_prebins)
    if method == "quantile":
        return quantile_splits(h, max_n_prebins)
    if method == "mdlp":
        return mdlp_splits(h, **kwargs)
    return cart_splits(h, kind, max_n_prebins, min_leaf)
