"""Exact choice of disjoint rectangles that cover a grid of prebins.

The best cover under rules on neighbouring rectangles is found by depth-first
search: the first free cell, row by row, must be the upper left corner of some
rectangle.  The bound is the best value that each free cell could still get,
which counts a rectangle's value by the cell.  With equal best values the cover
with fewer rectangles wins, then the one found first.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np


@dataclass
class Rectangle:
    top: int
    left: int
    bottom: int  # included
    right: int
    value: int
    rate: int
    size: float

    def cells(self) -> tuple[slice, slice]:
        return slice(self.top, self.bottom + 1), slice(self.left, self.right + 1)


def prefix_sums(grid: np.ndarray) -> np.ndarray:
    out = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1))
    out[1:, 1:] = grid.cumsum(axis=0).cumsum(axis=1)
    return out


def rectangle_sum(prefix: np.ndarray, top: int, left: int, bottom: int, right: int) -> float:
    return float(prefix[bottom + 1, right + 1] - prefix[top, right + 1] - prefix[bottom + 1, left] + prefix[top, left])


def all_rectangles(m: int, n: int):
    for top in range(m):
        for left in range(n):
            for bottom in range(top, m):
                for right in range(left, n):
                    yield top, left, bottom, right


def solve(
    rectangles: list[Rectangle], m: int, n: int, trend_x: str | None = None, trend_y: str | None = None, min_diff_x: int = 0, min_diff_y: int = 0,
    min_bins: int | None = None, max_bins: int | None = None, gamma: int = 0, time_limit: float = 100,
) -> tuple[list[int], str]:
    """Indices of the chosen rectangles and a status: OPTIMAL, FEASIBLE (time is up) or INFEASIBLE.

    ``trend_x`` holds from left to right, ``trend_y`` from top to bottom, between rectangles that touch.
    """
    by_corner: dict[tuple[int, int], list[int]] = {}
    per_cell = np.full((m, n), -np.inf)
    for i, r in enumerate(rectangles):
        by_corner.setdefault((r.top, r.left), []).append(i)
        area = (r.bottom - r.top + 1) * (r.right - r.left + 1)
        per_cell[r.cells()] = np.maximum(per_cell[r.cells()], r.value / area)
    for k in by_corner:
        by_corner[k].sort(key=lambda i: -rectangles[i].value)
    if not np.isfinite(per_cell).all():
        return [], "INFEASIBLE"
    owner = np.full((m, n), -1)
    best: list = [None, []]
    until = time.monotonic() + time_limit
    late = False

    def fits(a: int, b: int, trend: str | None, diff: int) -> bool:
        step = rectangles[b].rate - rectangles[a].rate
        if diff and abs(step) < diff:
            return False
        return not (trend == "ascending" and step < 0 or trend == "descending" and step > 0)

    def neighbours_fit(i: int) -> bool:
        r = rectangles[i]
        if (trend_x or min_diff_x) and r.left > 0:
            for a in set(owner[r.top : r.bottom + 1, r.left - 1].tolist()) - {-1}:
                if not fits(a, i, trend_x, min_diff_x):
                    return False
        if (trend_x or min_diff_x) and r.right + 1 < n:
            for b in set(owner[r.top : r.bottom + 1, r.right + 1].tolist()) - {-1}:
                if not fits(i, b, trend_x, min_diff_x):
                    return False
        if (trend_y or min_diff_y) and r.top > 0:
            for a in set(owner[r.top - 1, r.left : r.right + 1].tolist()) - {-1}:
                if not fits(a, i, trend_y, min_diff_y):
                    return False
        return True

    def go(at: int, chosen: list[int], value: int, bound: float) -> None:
        nonlocal late
        while at < m * n and owner[at // n, at % n] >= 0:
            at += 1
        if at == m * n:
            if min_bins and len(chosen) < min_bins:
                return
            sizes = [rectangles[i].size for i in chosen]
            total = value - int(gamma * (max(sizes) - min(sizes)))
            if best[0] is None or (total, -len(chosen)) > best[0]:
                best[0], best[1] = (total, -len(chosen)), list(chosen)
            return
        if max_bins is not None and len(chosen) >= max_bins or best[0] is not None and value + bound < best[0][0]:
            return
        if time.monotonic() > until:
            late = True
            return
        for i in by_corner.get((at // n, at % n), ()):
            r = rectangles[i]
            cells = r.cells()
            if (owner[cells] >= 0).any() or not neighbours_fit(i):
                continue
            rest = bound - float(per_cell[cells].sum())
            if best[0] is not None and value + r.value + rest + 1e-6 < best[0][0]:
                continue
            owner[cells] = i
            go(at + 1, [*chosen, i], value + r.value, rest)
            owner[cells] = -1
            if late:
                return

    go(0, [], 0, float(per_cell.sum()))
    if best[0] is None:
        return [], "UNKNOWN" if late else "INFEASIBLE"
    return best[1], "FEASIBLE" if late else "OPTIMAL"
