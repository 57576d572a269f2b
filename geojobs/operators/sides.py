"""Sides of rings in the cells of a grid: what may cross a segment, touch it or lie on it."""

from __future__ import annotations

from collections.abc import Hashable, Iterator

Point = tuple[float, float]


def turn(o: Point, a: Point, b: Point) -> float:
    """Twice the signed area of a triangle: over zero where ``o``, ``a``, ``b`` turn left."""
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def on_side(p: Point, a: Point, b: Point) -> bool:
    """Whether ``p`` lies on the side between its ends, neither of them."""
    return turn(a, b, p) == 0 and p != a and p != b and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def crossing(p: Point, q: Point, a: Point, b: Point) -> bool:
    """Whether two sides cross at a point that is no end of either."""
    d1, d2 = turn(p, q, a), turn(p, q, b)
    if not (d1 > 0 > d2 or d1 < 0 < d2):
        return False
    d3, d4 = turn(a, b, p), turn(a, b, q)
    return d3 > 0 > d4 or d3 < 0 < d4


def hits(p: Point, q: Point, a: Point, b: Point) -> bool:
    """Whether the side ``ab`` bars the way from ``p`` to ``q``: it crosses it, an end of one lies on the other, or both are the same."""
    if crossing(p, q, a, b) or on_side(a, p, q) or on_side(b, p, q) or on_side(p, a, b) or on_side(q, a, b):
        return True
    return a == p and b == q or a == q and b == p


def within(p: Point, ring: list[Point]) -> bool:
    """Whether ``p`` lies inside a ring (open list of corners)."""
    inside, (x, y) = False, p
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


class Grid:
    """Things under names in about as many cells as are told; sides lie in the cells that they pass, points in one."""

    def __init__(self, low: Point, high: Point, n: int):
        self.n = max(1, int(n**0.5))
        self.x, self.y = low
        self.w, self.h = (high[0] - low[0]) / self.n or 1.0, (high[1] - low[1]) / self.n or 1.0
        self.cells: dict[tuple[int, int], dict] = {}

    def _column(self, x: float) -> int:
        return max(0, min(self.n - 1, int((x - self.x) / self.w)))

    def _row(self, y: float) -> int:
        return max(0, min(self.n - 1, int((y - self.y) / self.h)))

    def passed(self, a: Point, b: Point) -> Iterator[tuple[int, int]]:
        """Cells of a side, column by column, a little more than it needs at their borders."""
        (ax, ay), (bx, by) = (a, b) if a[0] <= b[0] else (b, a)
        i0, i1 = self._column(ax), self._column(bx)
        for i in range(i0, i1 + 1):
            if i0 == i1:
                y0, y1 = ay, by
            else:
                slope = (by - ay) / (bx - ax)
                y0 = ay + slope * (max(ax, self.x + (i - 1e-9) * self.w) - ax)
                y1 = ay + slope * (min(bx, self.x + (i + 1 + 1e-9) * self.w) - ax)
            low, high = (y0, y1) if y0 <= y1 else (y1, y0)
            for j in range(self._row(low - 1e-9 * self.h), self._row(high + 1e-9 * self.h) + 1):
                yield i, j

    def add(self, name: Hashable, a: Point, b: Point | None = None) -> None:
        for c in self.passed(a, a if b is None else b):
            self.cells.setdefault(c, {})[name] = (a, b)

    def remove(self, name: Hashable, a: Point, b: Point | None = None) -> None:
        for c in self.passed(a, a if b is None else b):
            self.cells.get(c, {}).pop(name, None)

    def near(self, a: Point, b: Point) -> Iterator[tuple[Hashable, Point, Point | None]]:
        """What lies in the cells of the side; what passes several of them comes several times."""
        for c in self.passed(a, b):
            for name, (p, q) in self.cells.get(c, {}).items():
                yield name, p, q

    def box(self, low: Point, high: Point) -> Iterator[tuple[Hashable, Point, Point | None]]:
        i0, i1, j0, j1 = self._column(low[0]), self._column(high[0]), self._row(low[1]), self._row(high[1])
        if (i1 - i0 + 1) * (j1 - j0 + 1) > len(self.cells):
            chosen = [c for c in self.cells if i0 <= c[0] <= i1 and j0 <= c[1] <= j1]
        else:
            chosen = [(i, j) for i in range(i0, i1 + 1) for j in range(j0, j1 + 1)]
        for c in chosen:
            for name, (p, q) in self.cells.get(c, {}).items():
                yield name, p, q

    def outward(self, p: Point) -> Iterator[tuple[float, list]]:
        """Rounds of cells about ``p``: what lies in each, with a distance within which later rounds hold nothing."""
        i0, j0 = self._column(p[0]), self._row(p[1])
        for r in range(self.n + 1):
            ring = {(i, j) for i in (i0 - r, i0 + r) for j in range(j0 - r, j0 + r + 1)} | {(i, j) for j in (j0 - r, j0 + r) for i in range(i0 - r, i0 + r + 1)}
            yield r * min(self.w, self.h), [(name, a, b) for c in ring for name, (a, b) in self.cells.get(c, {}).items()]


class Few:
    """What ``Grid`` tells of bridges, for a few things that stand in a list: what has a box that meets the asked side's is near it."""

    def __init__(self):
        self.things: list[tuple] = []

    def add(self, name: Hashable, a: Point, b: Point | None = None) -> None:
        c = a if b is None else b
        self.things.append((min(a[0], c[0]), max(a[0], c[0]), min(a[1], c[1]), max(a[1], c[1]), name, a, b))

    def near(self, a: Point, b: Point) -> list[tuple[Hashable, Point, Point | None]]:
        (x0, x1), (y0, y1) = ((a[k], b[k]) if a[k] <= b[k] else (b[k], a[k]) for k in (0, 1))
        return [(name, p, q) for left, right, low, high, name, p, q in self.things if left <= x1 and right >= x0 and low <= y1 and high >= y0]

    def outward(self, p: Point) -> Iterator[tuple[float, list]]:
        yield float("inf"), [(name, a, b) for *_, name, a, b in self.things]
