"""Simplification of polygons that keeps their topology: Douglas-Peucker in which no new side may touch a ring or leave one on its other side.

A stretch of a ring is flattened to one side if its corners are within the tolerance of it, the side meets no other side of any ring of
the polygon, and neither another ring nor the rest of its own lies between the stretch and the side; else the stretch is halved at its
farthest corner. Sides stand in one grid for all rings: those of stretches still to come as they are, those done as they have become.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from geojobs.functions.geometry import RINGS
from geojobs.operators.sides import Grid, crossing, hits, within
from geojobs.operators.triangulate import once, ring_arrays


def _farthest(r: np.ndarray, i: int, j: int) -> tuple[int, float]:
    """The corner between ``i`` and ``j`` that is farthest from their side, and its distance."""
    a, d = r[i, :2], r[j, :2] - r[i, :2]
    n, p = float((d * d).sum()), r[i + 1 : j, :2] - a
    t = np.clip((p @ d) / n, 0, 1) if n else np.zeros(len(p))
    dist = np.sqrt(((p - t[:, None] * d) ** 2).sum(axis=1))
    m = int(dist.argmax())
    return i + 1 + m, float(dist[m])


def simplify_rings(rings: list[np.ndarray], tolerance: float) -> list[np.ndarray]:
    """The rings (closed, of positions) with fewer corners; each keeps four positions at least, and a valid polygon stays valid."""
    if tolerance <= 0 or not any(len(r) > 4 for r in rings):
        return rings
    corners = [[tuple(p) for p in r[:, :2].tolist()] for r in rings]
    grids: list[Grid] = []

    def stand() -> tuple[Grid, Grid]:
        """Sides and first corners; what keeps all its corners asks for neither."""
        if not grids:
            flat = np.concatenate([r[:, :2] for r in rings if len(r)])
            spans = tuple(map(float, flat.min(axis=0))), tuple(map(float, flat.max(axis=0))), len(flat)
            grids.extend((Grid(*spans), Grid(*spans[:2], len(rings))))
            for k, c in enumerate(corners):
                if c:
                    grids[1].add(k, c[0])  # a ring's first corner stays and stands for all of it
                for i, (p, q) in enumerate(zip(c, c[1:])):
                    grids[0].add((k, i), p, q)
        return grids[0], grids[1]

    def free(k: int, i: int, j: int, rest: int) -> bool:
        """Whether the stretch from ``i`` to ``j`` may become a side; ``rest`` is a corner of the ring beyond it."""
        c, (sides, starts) = corners[k], stand()
        p, q = c[i], c[j]
        for (ring, at), a, b in sides.near(p, q):
            if not (ring == k and i <= at < j) and hits(p, q, a, b):
                return False
        lens = c[i : j + 1]
        low, high = (min(x for x, _ in lens), min(y for _, y in lens)), (max(x for x, _ in lens), max(y for _, y in lens))
        if any(ring != k and within(s, lens) for ring, s, _ in starts.box(low, high)):
            return False
        return not within(c[rest], lens)

    out = []
    for k, r in enumerate(rings):
        c, last = corners[k], len(r) - 1
        if len(r) <= 4 or c[0] != c[-1]:
            out.append(r)
            continue
        far = int(((r[:, :2] - r[0, :2]) ** 2).sum(axis=1).argmax())
        if far in (0, last):
            out.append(r)
            continue
        kept, stack = [0], [(far, last), (0, far)]
        while stack:
            i, j = stack.pop()
            if j - i > 1:
                at, distance = _farthest(r, i, j)
                if distance > tolerance or not free(k, i, j, j + 1 if j < last else kept[-2]):
                    stack += [(at, j), (i, at)]
                    continue
                sides, _ = stand()
                for m in range(i, j):
                    sides.remove((k, m), c[m], c[m + 1])
                sides.add((k, i), c[i], c[j])
            kept.append(j)
        out.append(r[kept])
    return out


#: Positions up to which rings of one length are looked at together.
FEW = 10


def _keeps(rows: list[list[np.ndarray] | None], tolerances: list[float | None]) -> list[bool]:
    """For each polygon whether it surely keeps all its corners: some corner of every stretch of its rings is beyond the tolerance."""
    out, alike = [True] * len(rows), {}
    for i, (r, t) in enumerate(zip(rows, tolerances)):
        if r is None or t is None or t <= 0:
            continue
        for ring in r:
            if len(ring) > FEW:
                out[i] = False
            elif len(ring) > 4:
                alike.setdefault(len(ring), []).append((i, ring, t))
    for n, those in alike.items():
        xy, far = np.array([r[:, :2] for _, r, _ in those]), np.array([t for _, _, t in those])
        stays = np.ones(len(xy), bool)
        for i in range(n - 2):
            for j in range(i + 2, n if i else n - 1):
                d, p = xy[:, j] - xy[:, i], xy[:, i + 1 : j] - xy[:, i : i + 1]
                long = (d * d).sum(axis=1)[:, None]
                t = np.clip(np.divide((p * d[:, None]).sum(axis=2), long, out=np.zeros(p.shape[:2]), where=long > 0), 0, 1)
                apart = ((p - t[:, :, None] * d[:, None]) ** 2).sum(axis=2).max(axis=1) ** 0.5
                stays &= apart > far * (1 + 1e-9) + 1e-12 * np.abs(p).max(axis=(1, 2))  # beyond what rounding takes
        for (i, _, _), s in zip(those, stays.tolist()):
            out[i] = out[i] and s
    return out


def simplify_ring(ring, tolerance: float) -> list[list[float]]:
    """One closed ring of two or three ordinates on its own."""
    return simplify_rings([np.array([[*p, 0.0][:3] for p in ring], float).reshape(-1, 3)], tolerance)[0].tolist()


def crosses(rings: list[list]) -> bool:
    """Whether two sides of closed rings cross."""
    flat = [tuple(p[:2]) for r in rings for p in r]
    if not flat:
        return False
    xs, ys = zip(*flat)
    grid = Grid((min(xs), min(ys)), (max(xs), max(ys)), len(flat))
    for k, r in enumerate(rings):
        for i, (p, q) in enumerate(zip(r, r[1:])):
            p, q = tuple(p[:2]), tuple(q[:2])
            if any(crossing(p, q, a, b) for _, a, b in grid.near(p, q)):
                return True
            grid.add((k, i), p, q)
    return False


def simplify(rings: Column, tolerance: Column) -> Column:
    """A polygon's rings simplified by its row's tolerance; null leaves them as they are. None of them vanishes."""

    @F.arrow_udf(RINGS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, tolerances in batches:
            rows, far = list(ring_arrays(column)), tolerances.to_pylist()
            rows = [r if kept else simplify_rings(r, t) for r, t, kept in zip(rows, far, _keeps(rows, far))]
            flat = [p for r in rows if r is not None for p in r]
            values = np.concatenate([p.reshape(-1) for p in flat] or [np.empty(0)])
            places = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, 3), pa.int32()), pa.array(values))
            ends = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            closed = pa.ListArray.from_arrays(ends([len(p) for p in flat]), places)
            yield pa.ListArray.from_arrays(ends([0 if r is None else len(r) for r in rows]), closed, mask=pa.array([r is None for r in rows]))

    return once(run)(rings, tolerance)
