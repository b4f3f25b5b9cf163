"""Filling polygons on a pixel grid."""

from __future__ import annotations

import math


def filled(points: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Pixels (y, x) of a polygon with integer vertices (x, y): the inside by the even-odd rule, and the outline."""
    out: set[tuple[int, int]] = set()
    ring = list(zip(points, points[1:] + points[:1], strict=True))
    for (x0, y0), (x1, y1) in ring:  # outline: one pixel for each step of the longer side
        n = max(abs(x1 - x0), abs(y1 - y0))
        for k in range(n + 1):
            x = x0 + math.floor((x1 - x0) * k / n + 0.5) if n else x0
            y = y0 + math.floor((y1 - y0) * k / n + 0.5) if n else y0
            out.add((y, x))
    for y in range(min(p[1] for p in points), max(p[1] for p in points) + 1):
        cuts = sorted(x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in ring if min(y0, y1) <= y < max(y0, y1))
        for a, b in zip(cuts[::2], cuts[1::2], strict=False):
            out.update((y, x) for x in range(math.ceil(a), math.floor(b) + 1))
    return out
