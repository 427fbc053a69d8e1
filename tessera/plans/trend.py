"""Choice and description of a monotonic trend over prebins."""

from __future__ import annotations

import numpy as np

#: Decision trees as (feature, threshold, branch if feature <= threshold, other branch); leaves are trends (fixed values).
#: Areas are shares of the box around the rates; records left and right of the smallest and largest rate are shares of all.
AUTO = (
    "triangle_area", 0.22145836800336838,
    ("slope_is_positive", 0,
        ("hull_area", 0.48331470787525177,
            ("right_of_smallest", 0.010740397498011589, "descending", ("right_of_smallest", 0.022145185619592667, "valley", "descending")),
            ("right_of_largest", 0.6426683664321899, "valley", "descending")),
        "ascending"),
    ("right_of_smallest", 0.06137961149215698,
        ("hull_area", 0.23837491869926453, "descending",
            ("left_of_largest", 0.10170064494013786, ("left_of_largest", 0.01817034650593996, "valley", "descending"), "peak")),
        ("left_of_smallest", 0.05336669087409973,
            ("right_of_largest", 0.0695494469255209, "ascending", ("left_of_largest", 0.14705360680818558, "ascending", "peak")),
            ("left_of_smallest", 0.8308950066566467, "valley", ("right_of_largest", 0.1587613895535469, "valley", "peak")))),
)
ASC_DESC = (
    "slope_is_positive", 0,
    ("triangle_area", 0.4890555590391159, ("right_of_largest", 0.029244758188724518, "ascending", "descending"), ("hull_area", 0.5553120970726013, "ascending", "descending")),
    ("left_of_largest", 0.03698493912816048, "descending",
        ("left_of_smallest", 0.7991077601909637, ("triangle_area", 0.48206718266010284, "ascending", ("left_of_largest", 0.8631451725959778, "ascending", "descending")),
            ("change_share", 0.5277777910232544, ("left_of_smallest", 0.8155287206172943, "descending", "ascending"), "descending"))),
)


def trend_changes(rates) -> int:
    steps = np.sign(np.diff(np.asarray(rates, float)))
    return int((steps[1:] != steps[:-1]).sum())


def _hull_area(y: np.ndarray) -> float:
    """Area of the convex hull of the points (i, y_i)."""
    points = list(enumerate(y.tolist()))
    sides = []
    for line in (points, points[::-1]):
        side: list[tuple[float, float]] = []
        for p in line:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        sides += side[:-1]
    return 0.5 * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(sides, sides[1:] + sides[:1], strict=True)))


def features(rates, records) -> dict[str, float]:
    y, records = np.asarray(rates, float), np.asarray(records, float)
    n, low, high = len(y), int(np.argmin(y)), int(np.argmax(y))
    spread = y[high] - y[low]
    triangle = lambda *p: 0.5 * abs((p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) - (p[2][0] - p[0][0]) * (p[1][1] - p[0][1]))
    bottom, top = (low, y[low]), (high, y[high])
    area = triangle((0, y[0]), bottom, top) + triangle(bottom, top, (n, y[-1])) if n > 2 else 0.0
    box = spread * n
    share = lambda part: float(part.sum() / records.sum())
    return {
        "triangle_area": area / box if box else 0.0,
        "hull_area": _hull_area(y) / box if box and n > 2 else 0.0,
        "slope_is_positive": float(np.polyfit(np.arange(n), y, 1)[0] > 0) if n > 1 else 0.0,
        "change_share": trend_changes(y) / n,
        "left_of_smallest": share(records[:low]),
        "right_of_smallest": share(records[low + 1 :]),
        "left_of_largest": share(records[:high]),
        "right_of_largest": share(records[high + 1 :]),
    }


def choose(mode: str, rates, records) -> str:
    """The trend that ``auto``, ``auto_heuristic`` or ``auto_asc_desc`` stands for."""
    node = ASC_DESC if mode == "auto_asc_desc" else AUTO
    values = features(rates, records)
    while not isinstance(node, str):
        feature, threshold, low, high = node
        node = low if values[feature] <= threshold else high
    return f"{node}_heuristic" if mode == "auto_heuristic" and node in ("peak", "valley") else node


def label(rates) -> str:
    """A description of the trend of the rates; a plateau between rises counts as a change."""
    y = np.asarray(rates, float)
    if len(y) < 2:
        return "undefined"
    if trend_changes(y) == 0:
        return "ascending" if (np.diff(y) >= 0).all() else "descending"
    for name, shape, s in (("peak", "concave", y), ("valley", "convex", -y)):
        t = int(np.argmax(s))
        if (np.diff(s[: t + 1]) >= 0).all() and (np.diff(s[t:]) <= 0).all():
            return f"{name} ({shape})" if (np.diff(s, 2) <= 0).all() else name
    return "no monotonic"
