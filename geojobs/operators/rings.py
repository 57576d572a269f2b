"""Rings that come without a structure, as shapefile records have them, made into polygons with holes."""

from __future__ import annotations

import numpy as np

from geojobs.operators.sides import Grid, Point, on_side


def _ring_area(r: np.ndarray) -> float:
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return 0.5 * float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) if len(r) else 0.0


def _free_point(ring: list[Point], k: int, grid: Grid) -> Point | None:
    """A point of the ring that lies on no other ring: a corner, else the middle of a side."""
    for p in [*ring, *(((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(ring, ring[1:]))]:
        if not any(other[0] != k and (p == a or p == b or on_side(p, a, b)) for other, a, b in grid.near(p, p)):
            return p
    return None


def nest(rings: list[np.ndarray]) -> list[list[int]]:
    """Numbers of the rings (closed) by polygon, the outer ring first, in the order of their outer rings.

    A ring that an even number of others contain is an outer one, another is a hole of the smallest ring about it; which rings contain
    a point is told by a ray to the left through a grid of all sides, so that many rings don't cost their square. Where a ring lies on
    another throughout, its turn decides: a clockwise ring is an outer one, as the format has it. Rings without area belong to the
    polygon that contains them, else to the first one.
    """
    areas = [_ring_area(r) for r in rings]
    solid = [k for k, a in enumerate(areas) if a != 0]
    if len(solid) < 2:
        first = solid[:1] or list(range(min(1, len(rings))))
        return [first + [k for k in range(len(rings)) if k not in first]] if rings else []
    corners = [[tuple(p) for p in r[:, :2].tolist()] for r in rings]
    flat = [p for c in corners for p in c]
    low, high = (min(p[0] for p in flat), min(p[1] for p in flat)), (max(p[0] for p in flat), max(p[1] for p in flat))
    grid = Grid(low, high, len(flat))
    for k in solid:
        for i, (a, b) in enumerate(zip(corners[k], corners[k][1:])):
            grid.add((k, i), a, b)
    about: list[set[int]] = []
    for k, c in enumerate(corners):
        p = _free_point(c, k, grid) or (c[0] if c else None)
        met: set = set()
        if p is not None:
            for name, a, b in grid.near((low[0], p[1]), p):
                if name[0] != k and (a[1] > p[1]) != (b[1] > p[1]) and (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] < p[0]:
                    met.add(name)
        odd: set[int] = set()
        for ring, _ in met:
            odd ^= {ring}
        if areas[k] and p is not None and _free_point(c, k, grid) is None and areas[k] < 0:
            odd = set()
        about.append(odd)
    outer = [k for k in solid if len(about[k]) % 2 == 0]
    parts = {k: [k] for k in outer}
    for k in range(len(rings)):
        if k not in parts:
            holders = [h for h in about[k] if h in parts]
            parts[min(holders, key=lambda h: abs(areas[h])) if holders else outer[0]].append(k)
    return list(parts.values())
