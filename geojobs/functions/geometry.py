"""Geometry as nested arrays: heights, wall triangles, surface text.

A ring is ``array<array<double>>`` of positions with 2 or 3 ordinates, a polygon an array of rings, the outer first. A geometry is
``struct<type string, rings array<ring>>``; a point has one ring of one position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<array<double>>>"
GEOMETRY = f"struct<type:string,rings:{RINGS}>"


def _z(position: Column) -> Column:
    return F.when(F.size(position) == 3, position[2]).otherwise(F.lit(0.0))


def min_max_z(geom: Column) -> tuple[Column, Column]:
    """Lowest and highest z of a point or polygon (0 for positions without one); null for other types."""
    zs = F.transform(F.flatten(geom["rings"]), _z)
    known = geom["type"].isin("Point", "Polygon")
    return F.when(known, F.array_min(zs)), F.when(known, F.array_max(zs))


def set_z(rings: Column, limit: Column, translate: Column) -> Column:
    """Rings with z := (limit, unless null or zero, else z or 0) + (translate or 0)."""
    lift = F.coalesce(translate.cast("double"), F.lit(0.0))
    fixed = F.when(limit.isNotNull() & (limit != 0), limit.cast("double"))
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p[0], p[1], F.coalesce(fixed, F.coalesce(F.get(p, F.lit(2)), F.lit(0.0))) + lift)))


def walls(lower: Column, upper: Column) -> Column:
    """Two closed triangles per ring edge between the lower and the upper rings."""

    def ring(lo: Column, hi: Column) -> Column:
        def edge(i: Column) -> Column:
            bl, br, tl, tr = F.get(lo, i), F.get(lo, i + 1), F.get(hi, i), F.get(hi, i + 1)
            return F.array(F.array(bl, tl, br, bl), F.array(br, tl, tr, br))

        edges = F.when(F.size(lo) > 1, F.sequence(F.lit(0), F.size(lo) - 2)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(edges, edge))

    return F.flatten(F.zip_with(lower, upper, ring))


def double_text(value: Column) -> Column:
    """A double as Python prints it, between 1e-4 and 1e16; Spark's own text beyond."""
    plain = F.abs(value)
    decimal = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,17)").cast("string"), r"0+$", ""), r"\.$", ".0")
    exponent = value.cast("string").contains("E")
    return F.when((value == 0) | ~exponent, value.cast("string")).when((plain >= 1e-4) & (plain < 1e16), decimal).otherwise(F.lower(value.cast("string")))


def surface_wkt(triangles: Column) -> Column:
    """``POLYHEDRALSURFACE Z(((x y z, ...)), ...)`` of closed triangles; null without any."""
    position = lambda p: F.array_join(F.transform(p, double_text), " ")
    face = lambda t: F.concat(F.lit("(("), F.array_join(F.transform(t, position), ","), F.lit("))"))
    return F.when(F.size(triangles) > 0, F.concat(F.lit("POLYHEDRALSURFACE Z("), F.array_join(F.transform(triangles, face), ","), F.lit(")")))
