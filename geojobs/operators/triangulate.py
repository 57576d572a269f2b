"""Triangulation of polygons with holes: ear clipping after bridging every hole to the outer ring. Double precision.

Corners stand in a linked ring; an ear is looked at again only when a neighbour has gone, and only reflex corners near it, found in a
grid, are tested against it. Rings of 10^5 corners take seconds, and so do 10^4 holes.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from geojobs.functions.geometry import RINGS
from geojobs.operators.sides import Few, Grid, Point, hits, on_side, turn


def _area(r: np.ndarray) -> float:
    """Signed area, about the ring's first corner: far from the origin products of coordinates would drown it."""
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return 0.5 * float((x * np.concatenate((y[1:], y[:1])) - np.concatenate((x[1:], x[:1])) * y).sum())


def _open(ring) -> np.ndarray:
    r = ring if isinstance(ring, np.ndarray) and ring.ndim == 2 else np.array([[*p, 0.0][: max(3, len(p))] for p in ring], float)
    r = r if r.ndim == 2 else r.reshape(0, 3)
    if len(r) > 1 and (r[0, :2] == r[-1, :2]).all():
        r = r[:-1]
    keep = np.ones(len(r), bool)
    if len(r) > 1:
        keep = (r[:, :2] != np.concatenate((r[-1:, :2], r[:-1, :2]))).any(axis=1)
    return r[keep]


def _extent(points: list) -> tuple[Point, Point, int]:
    """Lowest and highest ordinates, and how many points there are."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return (min(xs), min(ys)), (max(xs), max(ys)), len(points)


#: Corners up to which rings of one size are clipped together, and polygons are bridged without a grid.
FEW = 64


def _room(points: list) -> Few | Grid:
    return Few() if len(points) <= FEW else Grid(*_extent(points))


def _meet(rings: list[list[list[float]]]) -> list[list[list[float]]]:
    """The rings with a corner more wherever another ring's corner lies on a side: rings then touch at corners alone."""
    grid = _room([p for r in rings for p in r])
    for k, r in enumerate(rings):
        for i, p in enumerate(r):
            grid.add((k, i), tuple(p[:2]))
    out = []
    for k, r in enumerate(rings):
        made = []
        for p, q in zip(r, r[1:] + r[:1]):
            made.append(p)
            a, b = tuple(p[:2]), tuple(q[:2])
            there = {c for (other, _), c, _ in grid.near(a, b) if other != k and on_side(c, a, b)}
            for c in sorted(there, key=lambda c: (c[0] - a[0]) ** 2 + (c[1] - a[1]) ** 2):
                t = (c[0] - a[0]) / (b[0] - a[0]) if abs(b[0] - a[0]) >= abs(b[1] - a[1]) else (c[1] - a[1]) / (b[1] - a[1])
                made.append([*c, *((1 - t) * u + t * v for u, v in zip(p[2:], q[2:]))])
        out.append(made)
    return out


def _opens_to(before: Point, p: Point, after: Point, to: Point) -> bool:
    """Whether the inside at a corner of a ring (on its left) holds the way to ``to``, its own sides left out."""
    if turn(before, p, after) > 0:
        return turn(p, after, to) > 0 and turn(p, to, before) > 0
    return not (turn(p, before, to) >= 0 and turn(p, to, after) >= 0)


def _bridged(outer: list[list[float]], holes: list[list[list[float]]]) -> list[list[float]] | None:
    """One ring of the outer one and all holes, joined by bridges; None if a hole finds none.

    Holes come from the right. A hole's rightmost corner is joined to the nearest corner of the ring so far that it sees: the way stays
    inside both corners' angles (a corner that carries a bridge stands in the ring twice, with half an angle each), no side of any
    ring, bridged or not, bars it, and it doesn't lead to the left, where holes are still to come. A hole that touches the ring is joined there.
    """
    outer, *holes = _meet([outer, *holes])
    points = [p for r in (outer, *holes) for p in r]
    flat = [tuple(p[:2]) for p in points]
    before, after, at = [], [], 0
    rings = []
    for r in (outer, *holes):
        n = len(r)
        before += [at + (i - 1) % n for i in range(n)]
        after += [at + (i + 1) % n for i in range(n)]
        rings.append(range(at, at + n))
        at += n
    sides, corners = _room(flat), _room(flat)
    places: dict[Point, list[int]] = {}
    for i, p in enumerate(flat):
        sides.add(i, p, flat[after[i]])

    def enter(i: int) -> None:
        corners.add(i, flat[i])
        places.setdefault(flat[i], []).append(i)

    def again(i: int) -> int:
        points.append(points[i])
        flat.append(flat[i])
        before.append(before[i])
        after.append(after[i])
        return len(flat) - 1

    def join(i: int, h: int, bridge: bool) -> None:
        """Corner ``i`` of the ring and ``h`` of the hole: i -> h … hole … h' -> i'."""
        i2, h2 = again(i), again(h)
        before[after[i]], after[before[h]] = i2, h2
        after[i], before[h], after[h2], before[i2] = h, i, i2, h2
        for c in (i2, h2):
            enter(c)
        if bridge:
            sides.add(("bridge", i2), flat[i], flat[h])

    def sees(h: int, i: int) -> bool:
        p, q = flat[h], flat[i]
        if not (_opens_to(flat[before[h]], p, flat[after[h]], q) and _opens_to(flat[before[i]], q, flat[after[i]], p)):
            return False
        return not any(hits(p, q, a, b) for _, a, b in sides.near(p, q))

    for i in rings[0]:
        enter(i)
    for ring in sorted(rings[1:], key=lambda r: -max(flat[i][0] for i in r)):
        made = False
        for h in ring:  # a hole that touches what is there
            p = flat[h]
            i = next((i for i in places.get(p, ()) if _opens_to(flat[before[i]], p, flat[after[i]], flat[after[h]])), None)
            if i is not None:
                join(i, h, False)
                made = True
                break
        if not made:
            h = max(ring, key=lambda i: (flat[i][0], -flat[i][1]))
            p, waiting = flat[h], []
            for safe, found in corners.outward(p):
                waiting += [((c[0] - p[0]) ** 2 + (c[1] - p[1]) ** 2, i) for i, c, _ in found if c[0] >= p[0]]
                near = sorted(w for w in waiting if w[0] <= safe**2)
                waiting = [w for w in waiting if w[0] > safe**2]
                i = next((i for _, i in near if sees(h, i)), None)
                if i is not None:
                    break
            else:
                i = next((i for _, i in sorted(waiting) if sees(h, i)), None)
            if i is None:
                return None
            join(i, h, True)
        for c in ring:
            enter(c)
    out, i = [], rings[0][0]
    while True:
        out.append(points[i])
        i = after[i]
        if i == rings[0][0]:
            return out


def ears(points: list[list[float]]) -> list[tuple[int, int, int]] | None:
    """Index triples of the triangles of a counter-clockwise ring; None if it can't be clipped to the end."""
    points, n = [tuple(p) for p in points], len(points)
    before, after, out = [*range(-1, n - 1)], [*range(1, n), 0], []
    before[0] = n - 1
    bend = lambda j: turn(points[before[j]], points[j], points[after[j]])
    there, left, reflex = [True] * n, n, {j for j in range(n) if bend(j) <= 0}
    (low, high, _), spots = _extent(points), None
    if reflex:
        spots = Grid(low, high, len(reflex))
        for j in reflex:
            spots.add(j, points[j])

    def clear(i: int, j: int, m: int) -> bool:
        """No reflex corner in a triangle, its sides included; places of the triangle's own corners don't count, but for a ring that
        touches the ear's tip from inside."""
        if not reflex:
            return True
        (ax, ay), (bx, by), (cx, cy) = a, b, c = points[i], points[j], points[m]
        for k, p, _ in spots.box((min(ax, bx, cx), min(ay, by, cy)), (max(ax, bx, cx), max(ay, by, cy))):
            x, y = p
            if (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 and (cx - bx) * (y - by) - (cy - by) * (x - bx) >= 0 and (ax - cx) * (y - cy) - (ay - cy) * (x - cx) >= 0:
                if p != a and p != b and p != c:
                    return False
                if p == b and k != j and any(turn(b, c, q) > 0 and turn(b, q, a) > 0 for q in (points[before[k]], points[after[k]])):
                    return False
        return True

    def cut(j: int) -> None:
        i, m = before[j], after[j]
        after[i], before[m], there[j] = m, i, False
        if j in reflex:
            reflex.discard(j)
            spots.remove(j, points[j])
        for k in (i, m):
            if k in reflex and bend(k) > 0:
                reflex.discard(k)
                spots.remove(k, points[k])

    def waits(j: int) -> tuple[float, int]:
        """Ears with short cuts come first: triangles stay small, and few corners are near them."""
        (ax, ay), (bx, by) = points[before[j]], points[after[j]]
        return (ax - bx) * (ax - bx) + (ay - by) * (ay - by), j

    queue, at = list(map(waits, range(n))), 0
    heapify(queue)
    while left > 3:
        clipped = 0
        while queue and left > 3:
            length, j = heappop(queue)
            if there[j] and length == waits(j)[0] and bend(j) > 0 and clear(before[j], j, after[j]):
                out.append((before[j], j, after[j]))
                cut(j)
                left, clipped, at = left - 1, clipped + 1, before[j]
                for k in (after[j], before[j]):
                    heappush(queue, waits(k))
        if left <= 3:
            break
        at = next(j for j in range(n) if there[j]) if not there[at] else at
        rest, j = [at], after[at]
        while j != at:
            rest.append(j)
            j = after[j]
        if not clipped:  # no ear: a corner on a line goes without a triangle
            j = next((j for j in rest if bend(j) == 0), None)
            if j is None:
                return None
            at = before[j]
            cut(j)
            left -= 1
            queue = [waits(after[j]), waits(before[j])]
        else:
            queue = list(map(waits, rest))
        heapify(queue)
    at = at if there[at] else next(j for j in range(n) if there[j])
    if bend(at) > 0:
        out.append((before[at], at, after[at]))
    return out


def _ears_of_many(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ears`` of many rings of one size (m, n, 2), the same triples in the same order: (m, n - 2, 3), how many of them count, and
    whether a ring was clipped to the end. Each step looks at the next corner of every ring."""
    m, n, _ = xy.shape
    x, y = np.ascontiguousarray(xy[:, :, 0]), np.ascontiguousarray(xy[:, :, 1])
    before, after = (np.tile(np.roll(np.arange(n), k), (m, 1)) for k in (1, -1))
    there, queued, ended = np.ones((m, n), bool), np.ones((m, n), bool), np.ones(m, bool)
    left, clipped, at = np.full(m, n), np.zeros(m, bool), np.zeros(m, np.int64)
    out, count = np.zeros((m, max(n - 2, 0), 3), np.int64), np.zeros(m, np.int64)

    def bend(r: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (x[r, j] - x[r, i]) * (y[r, k] - y[r, i]) - (y[r, j] - y[r, i]) * (x[r, k] - x[r, i])

    def cut_length(r: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        dx, dy = x[r, i] - x[r, k], y[r, i] - y[r, k]
        return dx * dx + dy * dy

    every = np.arange(m)[:, None], np.arange(n)[None]
    waits, reflex = cut_length(every[0], before, after), bend(every[0], before, every[1], after) <= 0
    live = np.flatnonzero(left > 3)
    while live.size:
        j = np.where(queued[live], waits[live], np.inf).argmin(axis=1)
        some = queued[live, j]
        empty = live[~some]
        ended[empty[~clipped[empty]]] = False
        queued[empty], clipped[empty] = there[empty], False
        r, j = live[some], j[some]
        queued[r, j] = False
        turned = bend(r, before[r, j], j, after[r, j]) > 0
        r, j = r[turned], j[turned]
        i, k = before[r, j], after[r, j]
        (ax, ay), (bx, by), (cx, cy) = ((x[r, c][:, None], y[r, c][:, None]) for c in (i, j, k))
        px, py = x[r], y[r]
        inside = reflex[r] & ((bx - ax) * (py - ay) - (by - ay) * (px - ax) >= 0) & ((cx - bx) * (py - by) - (cy - by) * (px - bx) >= 0) & ((ax - cx) * (py - cy) - (ay - cy) * (px - cx) >= 0)
        tip = (px == bx) & (py == by)
        free = ~(inside & ~tip & ~((px == ax) & (py == ay)) & ~((px == cx) & (py == cy))).any(axis=1)
        which, corner = np.nonzero(inside & tip & (every[1] != j[:, None]))
        for q in (before[r[which], corner], after[r[which], corner]):
            free[which[(bend(r[which], j[which], k[which], q) > 0) & (bend(r[which], j[which], q, i[which]) > 0)]] = False
        r, i, j, k = r[free], i[free], j[free], k[free]
        out[r, count[r]] = np.stack((i, j, k), axis=1)
        count[r] += 1
        left[r] -= 1
        after[r, i], before[r, k], there[r, j], reflex[r, j], clipped[r], at[r] = k, i, False, False, True, i
        for c in (i, k):
            reflex[r, c] &= bend(r, before[r, c], c, after[r, c]) <= 0
            waits[r, c], queued[r, c] = cut_length(r, before[r, c], after[r, c]), True
        live = live[(left[live] > 3) & ended[live]]
    r = np.flatnonzero(ended)
    i, k = before[r, at[r]], after[r, at[r]]
    last = bend(r, i, at[r], k) > 0
    r, i, k = r[last], i[last], k[last]
    out[r, count[r]] = np.stack((i, at[r], k), axis=1)
    count[r] += 1
    return out, count, ended


NOTHING = np.empty((0, 3)), np.empty((0, 3), np.int64)


def _prepared(rings) -> tuple[np.ndarray, list[np.ndarray], float, float] | None:
    """(outer ring, holes, area, area of the outer ring) of a polygon, turned and without repeated corners; None for one without area."""
    outer = _open(rings[0])
    size = _area(outer) if len(outer) >= 3 else 0.0
    if abs(size) < 1e-30:
        return None
    outer, size = (outer, size) if size > 0 else (outer[::-1], -size)
    inner = [(h, _area(h)) for h in map(_open, rings[1:]) if len(h) >= 3]
    area = size - sum(abs(a) for _, a in inner)
    return None if area <= 1e-12 * size else (outer, [h if a < 0 else h[::-1] for h, a in inner if a != 0], area, size)


def _prepared_alike(rows: list[list[np.ndarray]]) -> tuple[list, np.ndarray]:
    """``_prepared`` of polygons whose rings have the same lengths, and which of them are usual: closed, without repeated corners and
    rings without area. Others are to be looked at on their own."""
    usual, rings, sizes = np.ones(len(rows), bool), [], []
    for k in range(len(rows[0])):
        closed = np.stack([r[k] for r in rows])
        ring = closed[:, :-1]
        usual &= (closed[:, 0, :2] == closed[:, -1, :2]).all(axis=1) & (ring[:, :, :2] != np.concatenate((ring[:, -1:, :2], ring[:, :-1, :2]), axis=1)).any(axis=2).all(axis=1)
        x, y = ring[:, :, 0] - ring[:, :1, 0], ring[:, :, 1] - ring[:, :1, 1]
        size = 0.5 * (x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1)
        usual &= np.abs(size) >= 1e-30
        rings.append(np.where(((size > 0) == (k == 0))[:, None, None], ring, ring[:, ::-1]))
        sizes.append(np.abs(size))
    areas = sizes[0] - sum(sizes[1:])
    usual &= areas > 1e-12 * sizes[0]
    return [(rings[0][i], [r[i] for r in rings[1:]], areas[i], sizes[0][i]) for i in range(len(rows))], usual


def _same(p: list[np.ndarray] | None, q: list[np.ndarray] | None) -> bool:
    return p is q or p is not None and q is not None and len(p) == len(q) and all(len(a) == len(b) for a, b in zip(p, q)) and all(a.tobytes() == b.tobytes() for a, b in zip(p, q))


def _meshes(rows: list[list[np.ndarray] | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each polygon: corners (two or more heights behind x and y) of the bridged ring and the triangles between them; none for a
    polygon without area; None for one that has area and can't be cut into triangles of just this area, as one whose rings cross.

    Rings of one size are looked at together; a polygon like the one before, as its levels of detail often are, isn't looked at.
    """
    out: list = [NOTHING] * len(rows)
    like, alone, alike, ready, sized = list(range(len(rows))), [], {}, [], {}
    for i, r in enumerate(rows):
        if r is None or not len(r):
            continue
        if i and _same(rows[i - 1], r):
            like[i] = like[i - 1]
        elif all(3 < len(x) <= FEW for x in r):
            alike.setdefault(tuple(x.shape for x in r), []).append(i)
        else:
            alone.append(i)
    for which in alike.values():
        made, usual = _prepared_alike([rows[i] for i in which])
        ready += [(i, m) for i, m, u in zip(which, made, usual) if u]
        alone += [i for i, u in zip(which, usual) if not u]
    for i, made in ready + [(i, _prepared(rows[i])) for i in alone]:
        if made is not None:
            outer, holes, area, size = made
            if not np.isfinite(area):
                out[i] = None
                continue
            # About the outer ring's first corner, where doubles are finest.
            origin = np.zeros((1, outer.shape[1]))
            origin[0, :2] = outer[0, :2]
            ring = outer - origin
            if holes:
                bridged = _bridged(ring.tolist(), [(h - origin).tolist() for h in holes])
                if bridged is None:
                    out[i] = None
                    continue
                ring = np.array(bridged)
            sized.setdefault(ring.shape, []).append((i, ring, origin, area, size, bool(holes)))
    for (n, _), parts in sized.items():
        which, ring, origin, area, size, holes = map(np.array, zip(*parts))
        for i, corners, triples in zip(which, ring + origin, _cut_up(ring, area, size, holes)):
            out[i] = None if triples is None else (corners, triples)
    return [out[k] for k in like]


def _cut_up(ring: np.ndarray, area: np.ndarray, size: np.ndarray, holes: np.ndarray) -> list[np.ndarray | None]:
    """Triples of rings of one size: fans of those that are convex, ears of others; None where they don't make up the area."""
    m, n, _ = ring.shape
    x, y = ring[:, :, 0], ring[:, :, 1]
    turns = lambda i, j, k: (x[:, j] - x[:, i]) * (y[:, k] - y[:, i]) - (y[:, j] - y[:, i]) * (x[:, k] - x[:, i])
    at = np.arange(n)
    bent = holes | (turns(at - 2, at - 1, at) <= 0).any(axis=1) | (turns(np.zeros(n - 2, np.int64), at[1:-1], at[2:]) <= 0).any(axis=1)
    triples, count, ended = np.zeros((m, n - 2, 3), np.int64), np.full(m, n - 2), np.ones(m, bool)
    triples[:] = np.stack((np.zeros(n - 2, np.int64), at[1:-1], at[2:]), axis=1)
    if n <= FEW and bent.any():
        triples[bent], count[bent], ended[bent] = _ears_of_many(ring[bent])
    rest = np.flatnonzero(bent if n > FEW else ~ended)
    for i in rest:
        made = np.array(ears(ring[i, :, :2].tolist()) or [], np.int64).reshape(-1, 3)  # none make up no area
        triples[i, : len(made)], count[i] = made, len(made)
    each = np.arange(m)[:, None]
    (ax, bx, cx), (ay, by, cy) = ([v[each, triples[:, :, k]] for k in range(3)] for v in (x, y))
    parts = np.where(np.arange(n - 2) < count[:, None], 0.5 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)), 0.0)
    whole = np.abs(parts.sum(axis=1) - area) <= 1e-9 * size
    return [triples[i, : count[i]] if whole[i] else None for i in range(m)]


def _mesh(rings) -> tuple[np.ndarray, np.ndarray] | None:
    """``_meshes`` of one polygon."""
    return _meshes([None if rings is None else [_positions(r) for r in rings]])[0]


def _closed(corners: np.ndarray, triples: np.ndarray, reverse: bool = False, height: int = 2) -> np.ndarray:
    """Triangles of four positions each."""
    return corners[triples[:, (0, 2, 1, 0) if reverse else (0, 1, 2, 0)]][:, :, (0, 1, height)]


def triangles(rings, reverse: bool = False) -> list[list[list[float]]] | None:
    """Closed triangles, counter-clockwise unless reversed; none for a polygon without area, None for one that can't be cut into triangles."""
    made = _mesh(rings)
    return None if made is None else _closed(*made, reverse).tolist()


def both_sides(upper, lower) -> tuple[list, list] | tuple[None, None]:
    """Triangles of the upper rings and, turned, of the lower ones, which differ in height alone: the footprint is clipped once."""
    made = _sides([tuple(None if x is None else [_positions(r) for r in x] for x in (upper, lower))])[0]
    return (None, None) if made is None else tuple(x.tolist() for x in made)


def _sides(pairs: list[tuple]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    none = np.empty((0, 4, 3))
    made = _meshes([None if up is None or low is None else [np.concatenate((a, b[:, 2:]), axis=1) for a, b in zip(up, low)] for up, low in pairs])
    return [None if m is None else (_closed(*m), _closed(*m, True, 3)) if m[1].size else (none, none) for m in made]


def _positions(ring) -> np.ndarray:
    return ring if isinstance(ring, np.ndarray) and ring.ndim == 2 else np.array([[*p, 0.0][:3] for p in ring], float).reshape(-1, 3)


def _positions_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, z) of all positions of an Arrow column of polygons, where rings and where rows begin among them, and which rows are not null."""
    rings, positions, ordinates = column.values, column.values.values, column.values.values.values
    at = positions.offsets.to_numpy()
    n, values = np.diff(at), ordinates.to_numpy(zero_copy_only=False)
    if (n == 3).all():
        flat = values[at[0] : at[-1]].reshape(-1, 3)  # a row for each position
    else:
        flat = np.zeros((n.size, 3))
        for i in range(3):
            flat[n > i, i] = values[at[:-1][n > i] + i]
    if ordinates.null_count:  # an unknown height is none
        unknown = np.flatnonzero(n > 2)
        flat[unknown[ordinates.is_null().to_numpy(zero_copy_only=False)[at[:-1][unknown] + 2]], 2] = 0.0
    return flat, rings.offsets.to_numpy(), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


def ring_arrays(column: pa.Array) -> Iterator[list[np.ndarray] | None]:
    """The polygons of an Arrow column, each ring an array of (x, y, z): no value passes through Python on its own."""
    flat, of_rings, of_rows, known = _positions_of(column)
    for i in range(len(column)):
        yield [flat[of_rings[k] : of_rings[k + 1]] for k in range(of_rows[i], of_rows[i + 1])] if known[i] else None


def _column(rows: list[np.ndarray | None]) -> pa.Array:
    """Triangles as an Arrow column; null for None."""
    flat = np.concatenate([r.reshape(-1) for r in rows if r is not None] or [np.empty(0)])
    counts = [0 if r is None else len(r) for r in rows]
    positions = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, 3), pa.int32()), pa.array(flat))
    closed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(positions) + 1, 4), pa.int32()), positions)
    mask = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), closed, mask=mask)


def once(udf):
    """A function whose results a filter above doesn't ask for anew: filters aren't moved below what isn't told to be deterministic."""
    return udf.asNondeterministic()


def triangulate(rings: Column, reverse: bool = False) -> Column:
    """Closed triangles of a polygon's rings; an empty array where it has no area, null where it has and can't be cut into triangles."""

    @F.arrow_udf(RINGS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            made = _meshes(list(ring_arrays(column)))
            yield _column([None if m is None else _closed(*m, reverse) if len(m[1]) else np.empty((0, 4, 3)) for m in made])

    return once(run)(rings)


#: Triangles of a solid, how many they are and how many of them are its roof (null where the footprint can't be cut into triangles),
#: the middle of the footprint's box, lowest and highest x, y and z of the triangles.
SOLID = f"triangles {RINGS}, count int, roof int, center array<double>, box array<double>"


def _lifted(z: np.ndarray, each: np.ndarray, limit: pa.Array, lift: np.ndarray) -> np.ndarray:
    """Heights of positions: the limit of their row unless null or zero, else their own, and the lift."""
    values = limit.to_numpy(zero_copy_only=False)
    fixed = limit.is_valid().to_numpy(zero_copy_only=False) & (values != 0)
    return np.where(fixed[each], values[each], z) + lift[each]


def _walls(low: np.ndarray, high: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Two closed triangles for each side between the lower and the upper rings: (sides, 2, 4, 3)."""
    bl, br, tl, tr = low[inner], low[inner + 1], high[inner], high[inner + 1]
    return np.stack((np.stack((bl, tl, br, bl), axis=1), np.stack((br, tl, tr, br), axis=1)), axis=1)


def solid(rings: Column, lower: Column, upper: Column, lift: Column, bottom: bool) -> Column:
    """``SOLID`` between two heights over a polygon's rings: roof, walls and, if asked for, the bottom with its faces turned.

    A height that is null or zero leaves the positions' own; without both there is the roof alone. Lower and upper change places where the
    lower outer ring stands higher on average. No triangles without area or where the rings can't be cut into triangles.
    """

    @F.arrow_udf(SOLID)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, down, up, lifts in batches:
            flat, of_rings, of_rows, known = _positions_of(column)
            begins = of_rings[of_rows]  # rows among positions
            flat, of_rings, of_rows, begins = flat[begins[0] : begins[-1]], of_rings[of_rows[0] : of_rows[-1] + 1] - begins[0], of_rows - of_rows[0], begins - begins[0]
            each = np.repeat(np.arange(len(column)), np.diff(begins))
            lift = lifts.to_numpy(zero_copy_only=False)
            xyz = [flat.copy(), flat.copy()]
            for which, limit in zip(xyz, (down, up)):
                which[:, 2] = _lifted(flat[:, 2], each, limit, lift)
            some = np.flatnonzero(np.diff(of_rows) > 0)
            some = some[of_rings[of_rows[some] + 1] > of_rings[of_rows[some]]]  # rows with a first ring
            swap = np.zeros(len(column), bool)
            if some.size:
                ends = np.stack((of_rings[of_rows[some]], of_rings[of_rows[some] + 1]), axis=1)
                means = [np.add.reduceat(np.append(which[:, 2], 0.0), ends.ravel())[::2] / (ends[:, 1] - ends[:, 0]) for which in xyz]
                swap[some] = (means[0] > means[1]) | np.isnan(means[0]) & ~np.isnan(means[1])
            turned = swap[each][:, None]
            low, high = np.where(turned, xyz[1], xyz[0]), np.where(turned, xyz[0], xyz[1])
            level = ~np.logical_or(*[x.is_valid().to_numpy(zero_copy_only=False) & (x.to_numpy(zero_copy_only=False) != 0) for x in (down, up)])
            cut = lambda at: [[at[of_rings[k] : of_rings[k + 1]] for k in range(of_rows[i], of_rows[i + 1])] if known[i] else None for i in range(len(column))]
            made = _meshes(cut(np.concatenate((high, low[:, 2:]), axis=1) if bottom else high))
            inner = np.ones(len(flat), bool)
            inner[of_rings[1:][of_rings[1:] > 0] - 1] = False  # a ring's last position begins no side
            inner = np.flatnonzero(inner)
            walls, of_walls = _walls(low, high, inner).reshape(-1, 4, 3), 2 * np.searchsorted(inner, begins)
            rows, none = [], np.empty((0, 4, 3))
            for i, m in enumerate(made):
                if m is None or not len(m[1]):
                    rows.append(none)
                elif level[i]:
                    rows.append(_closed(*m))
                else:
                    rows.append(np.concatenate((_closed(*m), walls[of_walls[i] : of_walls[i + 1]], *([_closed(*m, True, 3)] if bottom else []))))
            counts = np.array([len(r) for r in rows])
            yield pa.StructArray.from_arrays(
                [_column(rows), pa.array(counts, pa.int32()), pa.array([None if m is None else len(m[1]) for m in made], pa.int32()), _middles(flat, begins), _boxes(np.concatenate([r.reshape(-1, 3) for r in rows] or [flat]), 4 * counts)],
                names=["triangles", "count", "roof", "center", "box"],
            )

    return once(run)(rings, lower.cast("double"), upper.cast("double"), F.coalesce(lift.cast("double"), F.lit(0.0)))


def _ends(at: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Lowest and highest ordinates (rows, 6) of stretches that aren't empty."""
    some = begins[:-1][counts > 0]
    return np.concatenate([f.reduceat(at, some, axis=0) for f in (np.fmin, np.maximum)], axis=1) if some.size else np.empty((0, 6))


def _arrays(values: np.ndarray, there: np.ndarray) -> pa.Array:
    """Rows of ``values`` as an Arrow column of arrays; null where nothing is there."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.where(there, values.shape[1], 0)))), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)), mask=pa.array(~there))


def _middles(flat: np.ndarray, begins: np.ndarray) -> pa.Array:
    ends = _ends(flat, begins, np.diff(begins))
    return _arrays((ends[:, :2] + ends[:, 3:5]) / 2, np.diff(begins) > 0)


def _boxes(at: np.ndarray, counts: np.ndarray) -> pa.Array:
    return _arrays(_ends(at, np.concatenate(([0], np.cumsum(counts))), counts), counts > 0)
