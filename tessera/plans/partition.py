"""Exact choice of which neighbouring prebins to merge.

A bin is an interval (first, last) of prebins.  The value of a partition is the
sum of its bins' values; bins must be allowed one by one, neighbouring bins must
be allowed next to each other, and some rules look at all bins.  Rules on
neighbours are solved by dynamic programming over (first, last, phase), the
others by depth-first search bounded by the best rest under the rules on
neighbours.  A search that meets the time limit returns the best partition found,
with the status FEASIBLE, or UNKNOWN if it has found none.  Values are integers,
so results do not depend on summation order; ties go to fewer bins, then to
earlier ends.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

SCALE = 1_000_000
TRENDS = ("ascending", "descending", "peak", "valley", "peak_heuristic", "valley_heuristic", "convex", "concave")


@dataclass
class Problem:
    """``value[i][k]`` and ``rate[c][i][k]`` of the bin of prebins k..i, ``rate`` for each target column."""

    value: np.ndarray
    rates: list[np.ndarray]
    trends: list[str | None]
    size: np.ndarray  # records of bin k..i
    allowed: np.ndarray  # whether the bin k..i may be used
    min_bins: int | None = None
    max_bins: int | None = None
    min_diff: float = 0
    changes: list[int | None] = field(default_factory=list)  # prebin where a heuristic trend turns
    conflict: Callable[[int, int, int, int], bool] | None = None  # (first, last) of an earlier and a later bin
    all_pairs: bool = False  # whether conflict looks at all pairs of bins
    fixed: list[int] = field(default_factory=list)  # prebins at which a bin must end
    gamma: int = 0  # price of each record by which the largest bin exceeds the smallest
    time_limit: float | None = None  # seconds after which a search returns the best found


@dataclass
class Solution:
    ends: list[int]  # last prebin of each bin
    value: int
    status: str


def triangle(prefix: np.ndarray) -> np.ndarray:
    """``out[i][k]`` = sum over prebins k..i."""
    total = np.concatenate([[0], np.cumsum(prefix)])
    return total[1:, None] - total[None, :-1]


def _steps(p: Problem, first: int, last: int, next_last: int) -> tuple[bool, list[float]]:
    """Whether the bin last+1..next_last may follow first..last as far as all columns agree, and the columns' steps."""
    steps = [r[next_last][last + 1] - r[last][first] for r in p.rates]
    if p.min_diff and any(abs(s) < p.min_diff for s in steps):
        return False, steps
    return not (p.conflict and not p.all_pairs and p.conflict(first, last, last + 1, next_last)), steps


def _phases(p: Problem) -> list[int]:
    """Columns whose turn is free: each has one bit of the phase."""
    return [c for c, t in enumerate(p.trends) if t in ("peak", "valley")]


def _follows(p: Problem, free: list[int], steps: list[float], phase: int, last: int, next_last: int) -> list[int]:
    """Phases of the next bin that the trends allow."""
    out = [0]
    for c, trend in enumerate(p.trends):
        s = steps[c]
        if trend == "ascending" and s < 0 or trend == "descending" and s > 0:
            return []
        if trend in ("peak_heuristic", "valley_heuristic"):
            sign = s if trend == "peak_heuristic" else -s
            before, after = last < p.changes[c], next_last < p.changes[c]
            if before and after and sign < 0 or not before and not after and sign > 0:
                return []
        if trend in ("peak", "valley"):
            sign = s if trend == "peak" else -s
            bit = 1 << free.index(c)
            turned = bool(phase & bit)
            options = ([bit] if sign <= 0 else []) if turned else ([0] if sign >= 0 else []) + [bit]
            out = [o | x for o in out for x in options]
    return out


def _usable(p: Problem) -> np.ndarray:
    n = len(p.value)
    ok = p.allowed.copy()
    ok &= np.tril(np.ones((n, n), bool))
    for f in p.fixed:  # no bin may hold a fixed end inside
        for i in range(f + 1, n):
            ok[i, : f + 1] = False
    return ok


def solve(p: Problem) -> Solution:
    """The best partition; status INFEASIBLE and one bin if no partition is allowed."""
    n = len(p.value)
    ok = _usable(p)
    ended = True
    if p.all_pairs and p.conflict or p.gamma or any(t in ("convex", "concave") for t in p.trends):
        best, ended = _search(p, ok)
    else:
        best = _dynamic(p, ok)
    if best is None:
        return Solution([n - 1], int(p.value[n - 1][0]), "INFEASIBLE" if ended else "UNKNOWN")
    return Solution(best[1], best[0], "OPTIMAL" if ended else "FEASIBLE")


def _dynamic(p: Problem, ok: np.ndarray) -> tuple[int, list[int]] | None:
    n, free = len(p.value), _phases(p)
    counted = p.min_bins is not None or p.max_bins is not None
    # state (last, first, phase, bins) -> (value, -number of bins, ends from the first on, negated)
    table: list[dict] = [{} for _ in range(n)]
    for i in range(n):
        for k in range(i + 1):
            if not ok[i, k]:
                continue
            here: dict = {}
            value = int(p.value[i][k])
            if k == 0:
                for phase in range(1 << len(free)):
                    here[phase, 1 if counted else 0] = (value, -1, (-i,))
            else:
                for (j, phase, bins), (v, m, ends) in table[k - 1].items():
                    if p.max_bins is not None and bins >= p.max_bins:
                        continue
                    fits, steps = _steps(p, j, k - 1, i)
                    if not fits:
                        continue
                    new = (v + value, m - 1, (*ends, -i))
                    for to in _follows(p, free, steps, phase, k - 1, i):
                        key = (to, bins + 1 if counted else 0)
                        if key not in here or new > here[key]:
                            here[key] = new
            for (phase, bins), best in here.items():
                table[i][k, phase, bins] = best
    final = [b for (_, _, bins), b in table[n - 1].items() if not counted or (p.min_bins or 1) <= bins <= (p.max_bins or n)]
    if not final:
        return None
    value, _, ends = max(final)
    return value, [-e for e in ends]


def _rest(p: Problem, ok: np.ndarray) -> dict[tuple[int, int, int], float]:
    """The best value after the bin (first, last) in a phase, under the rules on neighbours alone; absent if there is no rest.

    A convex (concave) sequence falls (rises) to some bin and then rises (falls), so that trend counts as one with a free turn.
    """
    n = len(p.value)
    loose = replace(p, trends=[{"convex": "valley", "concave": "peak"}.get(t or "", t) for t in p.trends], all_pairs=False)
    free = _phases(loose)
    out: dict[tuple[int, int, int], float] = {(k, n - 1, phase): 0 for k in range(n) if ok[n - 1, k] for phase in range(1 << len(free))}
    for last in range(n - 2, -1, -1):
        after = [i for i in range(last + 1, n) if ok[i, last + 1]]
        for first in range(last + 1):
            if not ok[last, first]:
                continue
            for i in after:
                fits, steps = _steps(loose, first, last, i)
                if not fits:
                    continue
                own = int(p.value[i][last + 1])
                for phase in range(1 << len(free)):
                    best = max((out.get((last + 1, i, to), float("-inf")) for to in _follows(loose, free, steps, phase, last, i)), default=float("-inf"))
                    if best > float("-inf"):
                        out[first, last, phase] = max(out.get((first, last, phase), float("-inf")), own + best)
    return out


def _bent(p: Problem, columns: list[int], bins: list[tuple[int, int]], k: int, i: int) -> bool:
    """Whether the bin k..i keeps the convex and concave columns so: 2 r_b >= r_a + r_new (concave) for all earlier a < b."""
    for c in columns:
        sign, r = (1, p.rates[c]) if p.trends[c] == "concave" else (-1, p.rates[c])
        new, most = sign * r[i][k], None
        for a, b in bins:
            x = sign * r[b][a]
            if most is not None and 2 * x - new < most:
                return False
            most = x if most is None else max(most, x)
    return True


def _search(p: Problem, ok: np.ndarray) -> tuple[tuple[int, list[int]] | None, bool]:
    """(the best partition found, whether it is known to be the best)."""
    n = len(p.value)
    rest = _rest(p, ok)
    columns = [c for c, t in enumerate(p.trends) if t in ("convex", "concave")]
    loose = replace(p, trends=[{"convex": "valley", "concave": "peak"}.get(t or "", t) for t in p.trends])
    free = _phases(loose)
    stop = None if p.time_limit is None else time.monotonic() + p.time_limit
    best: tuple | None = None
    # a stack of (bins, phases, value, smallest size, largest size); the most promising next bin is on top
    stack: list[tuple] = [((), frozenset(range(1 << len(free))), 0, float("inf"), float("-inf"))]
    steps_done = 0
    while stack:
        steps_done += 1
        if stop is not None and steps_done % 256 == 0 and time.monotonic() > stop:
            return ((best[0], [-e for e in best[2]]) if best else None), False
        bins, phases, value, small, large = stack.pop()
        spread = p.gamma * int(large - small) if p.gamma and bins else 0
        k = bins[-1][1] + 1 if bins else 0
        if k == n:
            if not p.min_bins or len(bins) >= p.min_bins:
                key = (value - spread, -len(bins), tuple(-b for _, b in bins))
                best = key if best is None or key > best else best
            continue
        if p.max_bins is not None and len(bins) >= p.max_bins:
            continue
        if best is not None and bins and value + max(rest.get((*bins[-1], ph), float("-inf")) for ph in phases) - spread < best[0]:
            continue
        more = []
        for i in range(k, n):
            if not ok[i, k]:
                continue
            after = phases
            if bins:
                fits, steps = _steps(p, *bins[-1], i)
                if not fits:
                    continue
                after = frozenset(q for ph in phases for q in _follows(loose, free, steps, ph, bins[-1][1], i))
                if not after or columns and not _bent(p, columns, bins, k, i):
                    continue
                if p.all_pairs and p.conflict and any(p.conflict(a, b, k, i) for a, b in bins):
                    continue
            bound = max((rest.get((k, i, ph), float("-inf")) for ph in after), default=float("-inf"))
            if bound == float("-inf"):
                continue
            size, own = float(p.size[i][k]), value + int(p.value[i][k])
            low, high = min(small, size), max(large, size)
            if p.gamma:  # the spread of the bins so far stays
                bound -= p.gamma * int(high - low)
            if best is None or own + bound >= best[0]:
                more.append((own + bound, -i, ((*bins, (k, i)), after, own, low, high)))
        stack.extend(m[2] for m in sorted(more, key=lambda m: m[:2]))
    return ((best[0], [-e for e in best[2]]) if best else None), True


def enumerate_partitions(n: int):
    """All lists of bin ends, for checks on small n."""
    for mask in range(1 << (n - 1)):
        yield [i for i in range(n - 1) if mask >> i & 1] + [n - 1]
