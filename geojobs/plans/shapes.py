"""Geometry of the polygon fixtures, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geojobs.functions.geometry import RINGS
from geojobs.operators.storage import spread
from geojobs.plans.fixtures import FIXTURES, fixture

#: (dx in w, dy in h) of the open rings by kind.
RECTANGLE = [(0, 0), (1, 0), (1, 1), (0, 1)]
ELL = [(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)]
HOLE = [(0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25)]
#: Five courtyards, one nested in the view of another, and one that touches a side's line of another.
COURTS = [[(x, y), (x, y + b), (x + a, y + b), (x + a, y)] for x, y, a, b in ((0.125, 0.125, 0.125, 0.125), (0.375, 0.375, 0.25, 0.25), (0.75, 0.125, 0.125, 0.25), (0.75, 0.625, 0.125, 0.25), (0.125, 0.625, 0.125, 0.25))]
#: A gable a little higher than the eaves, and a light well that reaches into it.
GABLE, LIGHT_WELL = [(0, 0), (1, 0), (1, 1), (0.5, 1.09), (0, 1)], [(0.5, 1.06), (0.6, 0.5), (0.4, 0.5)]
KINDS = {0: [RECTANGLE], 1: [ELL], 2: [RECTANGLE, HOLE], 3: [RECTANGLE], 4: [RECTANGLE, *COURTS]}


def ring(shape: list[tuple[float, float]]) -> Column:
    at = lambda i: F.array(F.col("lon0") + F.col("w") * F.lit(float(shape[i][0])), F.col("lat0") + F.col("h") * F.lit(float(shape[i][1])), F.col("z0") + F.lit(0.25 * (i % 2)))
    return F.array(*[at(i) for i in range(len(shape))], at(0))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``poly_params`` with ``geom``, dealt over tasks by their number: shapes cost time, the parts' file is small."""
    rings = F.when(F.lit(False), F.expr(f"cast(array() as {RINGS})"))
    for kind, shapes in KINDS.items():
        rings = rings.when(F.col("kind") == kind, F.array(*map(ring, shapes)))
    return spread(fixture(spark, sf_dir, "poly_params")).withColumn("geom", F.struct(F.lit("Polygon").alias("type"), rings.alias("rings")))


def _positions() -> str:
    rows = [f"({k}, {r}, {i}, {float(s[i % len(s)][0])}, {float(s[i % len(s)][1])}, {0.25 * (i % len(s) % 2)})" for k, rings in KINDS.items() for r, s in enumerate(rings) for i in range(len(s) + 1)]
    return f"(VALUES {', '.join(rows)}) v(kind, ring, seq, dx, dy, dz)"


#: (gid, ring, seq, x, y, z) of all positions, closing ones included; follows the fixture poly_params.
POSITIONS = f", positions AS (SELECT p.gid, v.ring, v.seq, p.lon0 + p.w * v.dx AS x, p.lat0 + p.h * v.dy AS y, p.z0 + v.dz AS z FROM poly_params p JOIN {_positions()} ON v.kind = p.kind)"
assert "poly_params" in FIXTURES
