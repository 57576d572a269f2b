"""Queries over vector features: expressions, heights, solids, instances, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from geojobs.functions import expr, geodesy, geometry
from geojobs.operators import surfaces, tiling
from geojobs.operators.simplify import simplify
from geojobs.operators.triangulate import triangulate
from geojobs.plans import jobs
from geojobs.plans.fixtures import fixture, over
from geojobs.plans.registry import query
from geojobs.plans.shapes import GABLE, LIGHT_WELL, POSITIONS, polygons, ring

UPPER = ["*", ["property", "p_size"], 1.5]
ROOFS = "CASE kind WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 4 THEN 32 ELSE 0 END"
WALLS = "CASE kind WHEN 0 THEN 8 WHEN 1 THEN 12 WHEN 2 THEN 16 WHEN 4 THEN 48 ELSE 0 END"


def budget_sql(rows: str, axes: str, budget: int, level: int) -> str:
    """SQL of the adaptive tree over ``rows``(id, axes): (id, level, one tile number per axis)."""
    names = axes.split()
    span = ", ".join(f"max({a}) - min({a})" for a in names)
    cell = ", ".join(f"least(greatest(CAST(floor((r.{a} - e.low_{a}) / e.span * {1 << level}) AS BIGINT), 0), {(1 << level) - 1}) AS c_{a}" for a in names)
    up = lambda p: ", ".join(f"{p}c_{a} >> ({level} - l.level) AS t_{a}" for a in names)
    same = " AND ".join(f"n.t_{a} = (c.c_{a} >> ({level} - n.level))" for a in names)
    return f"""
, ext AS (SELECT {', '.join(f'min({a}) AS low_{a}' for a in names)}, greatest({span}) AS span FROM ({rows}) q),
cells AS (SELECT r.*, {cell} FROM ({rows}) r CROSS JOIN ext e),
lv AS (SELECT range AS level FROM range({level + 1})),
nodes AS (SELECT l.level, {up('c.')}, count(*) AS n FROM cells c CROSS JOIN lv l GROUP BY ALL),
leafs AS (SELECT c.*, min(n.level) AS level FROM cells c JOIN nodes n ON (n.n <= {budget} OR n.level = {level}) AND {same} GROUP BY ALL)
"""


@query("expr_eval", over("SELECT gid, p_size * 1.5::DOUBLE AS upper, CASE WHEN p_size - 10 = 0 THEN 7.0 ELSE p_retailprice / (p_size - 10) END AS ratio, lower(p_brand) || '.glb' AS model, 'None-' || p_type AS label, 3.0::DOUBLE AS missing, NULL::VARCHAR AS nothing FROM poly_params", "poly_params"))
def expr_eval(spark, d):
    df = fixture(spark, d, "poly_params")
    make = lambda kind, value, default=None: expr.compile_expression(kind, value, df.schema, None, default)
    return df.select(
        "gid", make("number", UPPER).alias("upper"), make("number", ["/", ["property", "p_retailprice"], ["-", ["property", "p_size"], 10]], 7).alias("ratio"),
        make("string", ["concat", ["lowercase", ["property", "p_brand"]], ".glb"]).alias("model"), make("string", ["concat", ["concat", None, "-"], ["property", ["concat", "p_", "type"]]]).alias("label"),
        make("number", ["+", ["property", "absent"], 1], 3).alias("missing"), make("string", ["unknown", 1], "x").cast("string").alias("nothing"),
    )


@query("geom_minmax_z", over(POSITIONS + "SELECT gid, round(min(z), 9) AS min_z, round(max(z), 9) AS max_z FROM positions GROUP BY gid", "poly_params"))
def geom_minmax_z(spark, d):
    low, high = geometry.min_max_z(F.col("geom"))
    return polygons(spark, d).select("gid", F.round(low, 9).alias("min_z"), F.round(high, 9).alias("max_z"))


@query("geom_set_z", over(POSITIONS + "SELECT gid, CAST(ring AS INTEGER) AS ring, CAST(seq AS INTEGER) AS seq, round((CASE WHEN gid % 3 = 0 THEN z WHEN gid % 3 = 1 THEN z ELSE 4.5 END) + 2.0, 9) AS z FROM positions", "poly_params"))
def geom_set_z(spark, d):
    limit = F.when(F.col("gid") % 3 == 1, F.lit(0.0)).when(F.col("gid") % 3 == 2, F.lit(4.5))  # null, zero (no override) and a height
    rows = polygons(spark, d).select("gid", F.posexplode(geometry.set_z(F.col("geom.rings"), limit, F.lit(2.0))).alias("ring", "r"))
    return rows.select("gid", "ring", F.posexplode("r").alias("seq", "p")).select("gid", "ring", "seq", F.round(F.col("p")[2], 9).alias("z"))


@query("triangulate", over(f"SELECT gid, {ROOFS} AS n, round(w * h * CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.75 WHEN 4 THEN 0.828125 ELSE 0.0 END, 12) AS area FROM poly_params", "poly_params"))
def triangulate_(spark, d):
    rows = polygons(spark, d).withColumn("t", triangulate(F.col("geom.rings")))
    area = F.aggregate("t", F.lit(0.0), lambda s, t: s + ((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[2][0] - t[0][0]) * (t[1][1] - t[0][1])) / 2)
    return rows.select("gid", F.size("t").alias("n"), F.round(area, 12).alias("area"))


@query("walls", over("SELECT gid, CASE kind WHEN 0 THEN 8 WHEN 1 THEN 12 WHEN 2 THEN 16 WHEN 4 THEN 48 ELSE 8 END AS n, round(3.0 * (2 * w + 2 * h + CASE kind WHEN 2 THEN w + h WHEN 4 THEN 1.5 * w + 2.25 * h ELSE 0.0 END), 9) AS area FROM poly_params", "poly_params"))
def walls(spark, d):
    low, high = (geometry.set_z(F.col("geom.rings"), F.lit(z), F.lit(0.0)) for z in (1.0, 4.0))
    rows = polygons(spark, d).withColumn("t", geometry.walls(low, high))
    # Every edge has two triangles of half its rectangle: base times height over two, the base being the first with the last but one.
    base = lambda a, b: F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))
    area = F.aggregate("t", F.lit(0.0), lambda s, t: s + F.greatest(base(t[0], t[1]), base(t[0], t[2]), base(t[1], t[2])) * 3.0 / 2)
    return rows.select("gid", F.size("t").alias("n"), F.round(area, 9).alias("area"))


_SOLID = f"SELECT gid, {ROOFS} + {WALLS} + {ROOFS} AS n, round(p_size * 1.5::DOUBLE + 0.5, 6) AS top, 1.5::DOUBLE AS bottom FROM poly_params WHERE kind <> 3"


@query("extrude", over(_SOLID, "poly_params"))
def extrude(spark, d):
    df = polygons(spark, d)
    upper = expr.compile_expression("number", ["+", UPPER, 0.5], df.schema)
    lower = F.lit(1.5)
    solids, _ = surfaces.drop_empty(surfaces.extrude(df, lower, F.greatest(upper, F.lit(2.0)), F.lit(0.0), remove_bottom=False))
    zs = F.transform(F.flatten("triangles"), lambda p: p[2])
    return solids.select("gid", F.size("triangles").alias("n"), F.round(F.array_max(zs), 6).alias("top"), F.array_min(zs).alias("bottom"))


@query("drop_empty_surface", over("SELECT gid FROM poly_params WHERE kind = 3", "poly_params"))
def drop_empty_surface(spark, d):
    _, empty = surfaces.drop_empty(surfaces.extrude(polygons(spark, d), F.lit(None).cast("double"), F.lit(5.0), F.lit(0.0)))
    return empty.select("gid")


#: Within the tolerance a courtyard of a times b loses the corner beside its diagonal, and so half its area; an ell loses the corners at its
#: notch's end, one on each side of the line that stays, and so no area.
_LODS = """
, lods AS (SELECT gid, kind, w, h, CAST(lod AS INTEGER) AS lod, CASE lod WHEN 0 THEN 5 / 111194.87428468118::DOUBLE ELSE -1 END AS far FROM poly_params CROSS JOIN (VALUES (0), (1)) l(lod)),
gaps AS (SELECT gid, lod, a * b AS area, a * w * b * h / sqrt(a * w * a * w + b * h * b * h) <= far AS cut FROM lods JOIN (VALUES (2, 0.5, 0.5), (4, 0.125, 0.125), (4, 0.25, 0.25), (4, 0.125, 0.25), (4, 0.125, 0.25), (4, 0.125, 0.25)) v(kind, a, b) USING (kind)),
holes AS (SELECT gid, lod, CAST(sum(CASE WHEN cut THEN 4 ELSE 5 END) AS INTEGER) AS others, sum(CASE WHEN cut THEN area / 2 ELSE area END) AS area FROM gaps GROUP BY gid, lod)
SELECT gid, lod, CASE WHEN kind <> 1 OR w * h / 4 / sqrt(w * w + h * h / 4) <= far THEN 5 ELSE 7 END AS positions, coalesce(others, 0) AS others,
  round(CAST(CASE kind WHEN 1 THEN 0.75 WHEN 3 THEN 0 ELSE 1 - coalesce(area, 0) END AS DOUBLE), 7) AS share
FROM lods LEFT JOIN holes USING (gid, lod)
"""


@query("lod_explode", over(_LODS, "poly_params"))
def lod_explode(spark, d):
    """Both levels at the default tolerance: positions of the outer ring and of the others, and the area as a share of width times height."""
    rows = surfaces.lod_explode(polygons(spark, d), True)
    turn = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (q[0] - o[0]) * (p[1] - o[1])
    area = lambda r: F.abs(F.aggregate(F.sequence(F.lit(2), F.size(r)), F.lit(0.0), lambda s, i: s + turn(r[0], F.element_at(r, i - 1), F.element_at(r, i)))) / 2
    outer, holes = F.col("geom.rings")[0], F.filter("geom.rings", lambda _, i: i > 0)
    share = F.try_divide(area(outer) - F.aggregate(holes, F.lit(0.0), lambda s, r: s + area(r)), F.col("w") * F.col("h"))
    return rows.select("gid", "lod", F.size(outer).alias("positions"), F.size(F.flatten(holes)).alias("others"), F.round(F.coalesce(share, F.lit(0.0)), 7).alias("share"))


_KEPT = "SELECT gid, 'kinds' AS shape, CASE kind WHEN 1 THEN 4 ELSE 5 END AS positions, CASE kind WHEN 2 THEN 2 WHEN 4 THEN 6 ELSE 1 END AS rings, CASE kind WHEN 2 THEN 4 WHEN 4 THEN 20 ELSE 0 END AS others FROM poly_params"
_GABLE = "SELECT gid, 'gable', CASE WHEN gid % 2 = 0 THEN 6 ELSE 5 END, CASE WHEN gid % 2 = 0 THEN 2 ELSE 1 END, CASE WHEN gid % 2 = 0 THEN 4 ELSE 0 END FROM poly_params WHERE kind <> 3"


@query("simplify", over(f"SELECT *, 0::BIGINT AS crossings, 0::BIGINT AS outside, true AS near FROM ({_KEPT} UNION ALL {_GABLE}) q", "poly_params"))
def simplify_(spark, d):
    """Shapes by kind, and gables within the tolerance of their eaves: they go, but where a courtyard reaches into them."""
    shapes = polygons(spark, d)
    gables = shapes.where("kind <> 3").withColumn("geom", F.struct(F.lit("Polygon").alias("type"), F.when(F.col("gid") % 2 == 0, F.array(ring(GABLE), ring(LIGHT_WELL))).otherwise(F.array(ring(GABLE))).alias("rings")))
    rows = shapes.select("gid", F.lit("kinds").alias("shape"), "geom.rings", (F.col("w") / 2).alias("tolerance")).unionByName(gables.select("gid", F.lit("gable").alias("shape"), "geom.rings", (F.col("h") / 10).alias("tolerance")))
    rows = rows.select("gid", "shape", "tolerance", F.col("rings").alias("old"), simplify(F.col("rings"), F.col("tolerance")).alias("new"))
    side = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.struct(F.element_at(r, i).alias("a"), F.element_at(r, i + 1).alias("b")))
    bend = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    cross = lambda s, t: (bend(s["a"], s["b"], t["a"]) * bend(s["a"], s["b"], t["b"]) < 0) & (bend(t["a"], t["b"], s["a"]) * bend(t["a"], t["b"], s["b"]) < 0)
    sides = F.flatten(F.transform("new", side))
    # A corner is inside a ring where a ray to the right meets an odd number of its sides.
    meets = lambda p, s: ((s["a"][1] > p[1]) != (s["b"][1] > p[1])) & (p[0] < (s["b"][0] - s["a"][0]) * (p[1] - s["a"][1]) / F.nullif(s["b"][1] - s["a"][1], F.lit(0.0)) + s["a"][0])
    inside = lambda p: F.size(F.filter(side(F.col("new")[0]), lambda s: F.coalesce(meets(p, s), F.lit(False)))) % 2 == 1
    holes = F.slice("new", 2, 99)
    # The distance of a corner that went to the nearest side that stayed.
    along = lambda p, s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((p[0] - s["a"][0]) * (s["b"][0] - s["a"][0]) + (p[1] - s["a"][1]) * (s["b"][1] - s["a"][1]), F.pow(s["b"][0] - s["a"][0], 2) + F.pow(s["b"][1] - s["a"][1], 2))))
    apart = lambda p, s: F.sqrt(F.pow(s["a"][0] + along(p, s) * (s["b"][0] - s["a"][0]) - p[0], 2) + F.pow(s["a"][1] + along(p, s) * (s["b"][1] - s["a"][1]) - p[1], 2))
    checked = rows.withColumns({"_s": sides, "_p": F.flatten("old")})
    return checked.select(
        "gid", "shape", F.size(F.col("new")[0]).alias("positions"), F.size("new").alias("rings"), F.size(F.flatten(holes)).alias("others"),
        F.size(F.filter("_s", lambda s: F.exists("_s", lambda t: cross(s, t)))).cast("long").alias("crossings"),
        F.size(F.filter(F.flatten(holes), lambda p: ~inside(p))).cast("long").alias("outside"),
        F.forall("_p", lambda p: F.exists("_s", lambda s: apart(p, s) <= F.col("tolerance") * 1.000001)).alias("near"),
    )


@query("surface_wkt", over("SELECT gid, 'POLYHEDRALSURFACE Z(((0.0 0.0 ' || zs || ',1.0 0.0 ' || zs || ',0.0 0.0001 ' || zs || ',0.0 0.0 ' || zs || ')))' AS wkt FROM (SELECT gid, printf('%.1f', z0) AS zs FROM poly_params) q", "poly_params"))
def surface_wkt(spark, d):
    z = F.col("z0")
    face = F.array(*[F.array(F.lit(x), F.lit(y), z) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 0.0001), (0.0, 0.0))])
    return fixture(spark, d, "poly_params").select("gid", geometry.surface_wkt(F.array(face)).alias("wkt"))


@query("lod_tolerance", "SELECT CAST(level AS INTEGER) AS level, CASE WHEN level < 3 THEN round(5.0 / pow(2, level) / 111194.87428468118, 15) END AS tolerance, n FROM (SELECT range AS level FROM range(4)) l CROSS JOIN (SELECT count(*) AS n FROM part) c")
def lod_tolerance(spark, d):
    levels = spark.range(4).select(F.col("id").cast("int").alias("level"))
    n = spark.read.parquet(f"{d}/part.parquet").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(n).select("level", F.round(tiling.lod_tolerance(F.col("level"), 4, F.lit(5.0)), 15).alias("tolerance"), "n")


@query(
    "tags_json",
    "SELECT o_orderkey, '[{\"o_orderstatus\":\"' || o_orderstatus || '\"},{\"o_custkey\":' || o_custkey || '},{\"o_orderdate\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\"},{\"nothing\":null}]' AS tags FROM orders",
)
def tags_json(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet").withColumns({"nothing": F.lit(None).cast("string"), "o_orderdate": F.col("o_orderdate").cast("date")})
    return df.select("o_orderkey", surfaces.tags_json(df, ["o_orderstatus", "o_custkey", "o_orderdate", "nothing"]).alias("tags"))


POINT_CONFIG = {"translate_z": ["/", ["property", "c_acctbal"], 1000], "scale": ["+", ["func", "$maxZ"], 1], "rotation": 45, "model": ["concat", ["lowercase", ["property", "c_mktsegment"]], ".glb"]}


@query(
    "point_instances",
    over("SELECT gid, x, y, round(z + c_acctbal / 1000, 9) AS z, round(z + c_acctbal / 1000 + 1, 9) AS scale, 45.0::DOUBLE AS rotation, lower(c_mktsegment) || '.glb' AS model, '[{\"c_mktsegment\":\"' || c_mktsegment || '\"}]' AS tags FROM feat_point", "feat_point"),
)
def point_instances(spark, d):
    points = fixture(spark, d, "feat_point")
    out = surfaces.point_instances(points, POINT_CONFIG, ["c_mktsegment", "c_acctbal"])
    tags = F.concat(F.regexp_extract("tags", r"^(\[\{[^}]*\})", 1), F.lit("]"))
    return out.select("gid", "x", "y", F.round("z", 9).alias("z"), F.round("scale", 9).alias("scale"), "rotation", "model", tags.alias("tags"))


@query("layer_bbox", over(POSITIONS + "SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, (min(x) + max(x)) / 2 AS center_x, (min(y) + max(y)) / 2 AS center_y FROM positions", "poly_params"))
def layer_bbox(spark, d):
    at = lambda i: F.transform(F.flatten("geom.rings"), lambda p: p[i])
    rows = polygons(spark, d).select(*[f(at(i)).alias(n + c) for i, c in enumerate("xy") for n, f in (("min_", F.array_min), ("max_", F.array_max))])
    box = rows.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
    return box.select("*", ((F.col("min_x") + F.col("max_x")) / 2).alias("center_x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("center_y"))


@query("tile_budget", over(budget_sql("SELECT gid, x, y FROM feat_point", "x y", 50, 10) + "SELECT gid, CAST(level AS INTEGER) AS level, c_x >> (10 - level) AS tx, c_y >> (10 - level) AS ty FROM leafs", "feat_point"))
def tile_budget(spark, d):
    placed = tiling.tile_budget(fixture(spark, d, "feat_point"), ["x", "y"], 50, 10)
    return placed.select("gid", F.col("level").cast("int").alias("level"), F.col("tile")[0].alias("tx"), F.col("tile")[1].alias("ty"))


@query("attr_schema", "SELECT * FROM (VALUES (0, 'c_name', 'string', NULL::DOUBLE, NULL::DOUBLE), (1, 'c_mktsegment', 'string', NULL, NULL)) v(position, name, kind, minimum, maximum) UNION ALL SELECT 2, 'c_acctbal', 'double', min(c_acctbal), max(c_acctbal) FROM customer")
def attr_schema(spark, d):
    df = fixture(spark, d, "feat_point").select("gid", "c_name", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return tiling.attr_schema(df, real_stats=True)


_CENTROIDS = "SELECT gid, lod, (min(x) + max(x)) / 2 AS x, (min(y) + max(y)) / 2 AS y FROM (SELECT q.*, CAST(l.lod AS INTEGER) AS lod FROM positions q CROSS JOIN (VALUES (0)) l(lod)) z GROUP BY gid, lod"


@query(
    "job_polygon_tiles",
    over(
        POSITIONS
        + f", solids AS (SELECT c.gid, c.x, c.y, {ROOFS} + {WALLS} AS triangles, p.p_size * 1.5::DOUBLE AS top FROM ({_CENTROIDS}) c JOIN poly_params p USING (gid) WHERE p.kind <> 3)"
        + budget_sql("SELECT * FROM solids", "x y", 100, 12)
        + "SELECT CAST(level AS INTEGER) AS level, c_x >> (12 - level) AS tx, c_y >> (12 - level) AS ty, count(*) AS features, CAST(sum(triangles) AS BIGINT) AS triangles, max(top) AS top FROM leafs GROUP BY ALL",
        "poly_params",
    ),
)
def job_polygon_tiles(spark, d):
    config = {"upper_limit_height": UPPER, "lower_limit_height": 0.5, "max_features_per_tile": 100}
    out = jobs.polygon_tiles(polygons(spark, d), config, max_level=12)
    top = F.array_max(F.transform(F.flatten("triangles"), lambda p: p[2]))
    rows = out["features"].select("level", "tile", F.size("triangles").alias("n"), top.alias("top"))
    tiles = rows.groupBy(F.col("level").cast("int").alias("level"), F.col("tile")[0].alias("tx"), F.col("tile")[1].alias("ty"))
    return tiles.agg(F.count(F.lit(1)).alias("features"), F.sum("n").alias("triangles"), F.max("top").alias("top"))


_REGION = "min(x0) AS west, min(y0) AS south, max(x1) AS east, max(y1) AS north, 0.5::DOUBLE AS low, max(top) AS high"


@query(
    "job_polygon_tileset",
    over(
        POSITIONS
        + f", solids AS (SELECT gid, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, (min(x) + max(x)) / 2 AS x, (min(y) + max(y)) / 2 AS y, any_value(p_size) * 1.5::DOUBLE AS top FROM positions JOIN (SELECT gid, p_size FROM poly_params WHERE kind <> 3) k USING (gid) GROUP BY gid)"
        + budget_sql("SELECT * FROM solids", "x y", 60, 12)
        + f", inner_ AS (SELECT q.range AS level, c_y >> (12 - q.range) AS ty, c_x >> (12 - q.range) AS tx, {_REGION}, CASE WHEN any_value(leafs.level) = max(q.range) THEN count(*) END AS features FROM leafs JOIN range(13) q ON q.range <= leafs.level GROUP BY ALL)"
        + ", kids AS (SELECT level - 1 AS level, ty >> 1 AS ty, tx >> 1 AS tx, count(*) AS n FROM inner_ WHERE level > 0 GROUP BY ALL)"
        + ", nodes_ AS (SELECT 0 AS lod, i.*, CASE WHEN level > 0 THEN '0_' || (level - 1) || '_' || (ty >> 1) || '_' || (tx >> 1) END AS parent, CASE WHEN features IS NULL THEN n ELSE 1 END AS children FROM inner_ i LEFT JOIN kids USING (level, ty, tx)"
        + " UNION ALL SELECT 1, i.*, '0_' || level || '_' || ty || '_' || tx, 0 FROM inner_ i WHERE features IS NOT NULL)"
        + " SELECT lod || '_' || level || '_' || ty || '_' || tx AS id, parent, children, features, round(west, 9) AS west, round(south, 9) AS south, round(east, 9) AS east, round(north, 9) AS north, low, high, CASE WHEN children > 0 THEN 400.0 / pow(2, lod + level) ELSE 0.0 END AS geometric_error FROM nodes_",
        "poly_params",
    ),
)
def job_polygon_tileset(spark, d):
    """The nodes of both levels of detail: the second ones hang below the leaves of the first."""
    config = {"upper_limit_height": UPPER, "lower_limit_height": 0.5, "max_features_per_tile": 60, "add_lod": "true", "lod_max_simplify_tolerance": 0.001, "max_geometric_error": 400, "geometric_error_factor": 2}
    nodes = jobs.polygon_tiles(polygons(spark, d), config, max_level=12)["nodes"]
    sides = [F.round(F.col("region")[i], 9).alias(n) for i, n in enumerate(("west", "south", "east", "north"))]
    return nodes.select("id", "parent", F.col("children").cast("long").alias("children"), "features", *sides, F.col("region")[4].alias("low"), F.col("region")[5].alias("high"), "geometric_error")


@query(
    "job_point_tiles",
    over(
        budget_sql("SELECT gid, x, y, c_mktsegment, z + c_acctbal / 1000 AS zz FROM feat_point", "x y", 100, 12)
        + "SELECT CAST(level AS INTEGER) AS level, c_x >> (12 - level) AS tx, c_y >> (12 - level) AS ty, count(*) AS features, count(DISTINCT c_mktsegment) AS models, round(max(zz), 9) AS top FROM leafs GROUP BY ALL",
        "feat_point",
    ),
)
def job_point_tiles(spark, d):
    out = jobs.point_tiles(fixture(spark, d, "feat_point"), POINT_CONFIG | {"max_features_per_tile": 100}, fixture(spark, d, "assets"), ["c_mktsegment", "c_acctbal"], max_level=12)
    tiles = out["instances"].groupBy(F.col("level").cast("int").alias("level"), F.col("tile")[0].alias("tx"), F.col("tile")[1].alias("ty"))
    return tiles.agg(F.count(F.lit(1)).alias("features"), F.countDistinct("model").alias("models"), F.round(F.max("z"), 9).alias("top"))


@query("ecef_lonlat", over("SELECT gid, round((40680631590769.0::DOUBLE * nx) / g + nx * z, 3) AS x, round((40680631590769.0::DOUBLE * ny) / g + ny * z, 3) AS y, round((40408299984661.445::DOUBLE * nz) / g + nz * z, 3) AS z FROM (SELECT *, sqrt(40680631590769.0::DOUBLE * nx * nx + 40680631590769.0::DOUBLE * ny * ny + 40408299984661.445::DOUBLE * nz * nz) AS g FROM (SELECT gid, z, cos(radians(y)) * cos(radians(x)) AS nx, cos(radians(y)) * sin(radians(x)) AS ny, sin(radians(y)) AS nz FROM feat_point) q) r", "feat_point"))
def ecef_lonlat(spark, d):
    p = geodesy.ecef_lonlat(F.col("x"), F.col("y"), F.col("z"))
    return fixture(spark, d, "feat_point").select("gid", p.alias("p")).select("gid", *[F.round(f"p.{c}", 3).alias(c) for c in "xyz"])


_LLA = "(SELECT gid, radians(y) AS la, radians(x) AS lo, z AS alt FROM feat_point)"
_ECEF = f"(SELECT gid, la, lo, (r + alt) * cos(la) * cos(lo) AS x, (r + alt) * cos(la) * sin(lo) AS y, (0.9933056200098025::DOUBLE * r + alt) * sin(la) AS z FROM (SELECT *, 40680631590769.0::DOUBLE / sqrt(40680631590769.0::DOUBLE * cos(la) * cos(la) + 40408299984659.16::DOUBLE * sin(la) * sin(la)) AS r FROM {_LLA} q) s)"


@query("ecef_from_lla", over(f"SELECT gid, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM {_ECEF} e", "feat_point"))
def ecef_from_lla(spark, d):
    p = geodesy.ecef_from_lla(F.col("y"), F.col("x"), F.col("z"))
    return fixture(spark, d, "feat_point").select("gid", p.alias("p")).select("gid", *[F.round(f"p.{c}", 3).alias(c) for c in "xyz"])


@query("lla_from_ecef", over("SELECT gid, round(y, 8) AS lat, round(x, 8) AS lon, round(z, 2) AS alt FROM feat_point", "feat_point"))
def lla_from_ecef(spark, d):
    p = geodesy.ecef_from_lla(F.col("y"), F.col("x"), F.col("z"))
    back = fixture(spark, d, "feat_point").select("gid", p.alias("p")).select("gid", geodesy.lla_from_ecef(F.col("p.x"), F.col("p.y"), F.col("p.z")).alias("q"))
    return back.select("gid", F.round("q.lat", 8).alias("lat"), F.round("q.lon", 8).alias("lon"), F.round("q.alt", 2).alias("alt"))


REF = (43.75, 11.25, 50.0)
_REF_ECEF = "(SELECT la, lo, (r + 50.0) * cos(la) * cos(lo) AS x, (r + 50.0) * cos(la) * sin(lo) AS y, (0.9933056200098025::DOUBLE * r + 50.0) * sin(la) AS z FROM (SELECT la, lo, 40680631590769.0::DOUBLE / sqrt(40680631590769.0::DOUBLE * cos(la) * cos(la) + 40408299984659.16::DOUBLE * sin(la) * sin(la)) AS r FROM (SELECT radians(43.75) AS la, radians(11.25) AS lo) q) s)"


@query(
    "enu_from_lla",
    over(
        f"SELECT e.gid, round(-sin(o.lo) * (e.x - o.x) + cos(o.lo) * (e.y - o.y), 3) AS x, round(-sin(o.la) * cos(o.lo) * (e.x - o.x) - sin(o.la) * sin(o.lo) * (e.y - o.y) + cos(o.la) * (e.z - o.z), 3) AS y, round(cos(o.la) * cos(o.lo) * (e.x - o.x) + cos(o.la) * sin(o.lo) * (e.y - o.y) + sin(o.la) * (e.z - o.z), 3) AS z FROM {_ECEF} e CROSS JOIN {_REF_ECEF} o",
        "feat_point",
    ),
)
def enu_from_lla(spark, d):
    p = geodesy.enu_from_lla(F.col("y"), F.col("x"), F.col("z"), tuple(map(F.lit, REF)))
    return fixture(spark, d, "feat_point").select("gid", p.alias("p")).select("gid", *[F.round(f"p.{c}", 3).alias(c) for c in "xyz"])


@query("lla_from_enu", over("SELECT gid, round(y, 8) AS lat, round(x, 8) AS lon, round(z, 2) AS alt FROM feat_point", "feat_point"))
def lla_from_enu(spark, d):
    ref = tuple(map(F.lit, REF))
    rows = fixture(spark, d, "feat_point").select("gid", geodesy.enu_from_lla(F.col("y"), F.col("x"), F.col("z"), ref).alias("p"))
    back = rows.select("gid", geodesy.lla_from_enu(F.col("p.x"), F.col("p.y"), F.col("p.z"), ref).alias("q"))
    return back.select("gid", F.round("q.lat", 8).alias("lat"), F.round("q.lon", 8).alias("lon"), F.round("q.alt", 2).alias("alt"))


_CHORD = "(r * cos(la) * cos(lo) - o.x0) ** 2 + (r * cos(la) * sin(lo) - o.y0) ** 2 + (0.9933056200098025::DOUBLE * r * sin(la) - o.z0) ** 2"


@query(
    "gps_distance",
    over(
        f"SELECT gid, round(sqrt({_CHORD}), 3) AS metres FROM (SELECT gid, la, lo, 40680631590769.0::DOUBLE / sqrt(40680631590769.0::DOUBLE * cos(la) * cos(la) + 40408299984659.16::DOUBLE * sin(la) * sin(la)) AS r FROM {_LLA} q) s CROSS JOIN (SELECT r * cos(la) * cos(lo) AS x0, r * cos(la) * sin(lo) AS y0, 0.9933056200098025::DOUBLE * r * sin(la) AS z0 FROM (SELECT la, lo, 40680631590769.0::DOUBLE / sqrt(40680631590769.0::DOUBLE * cos(la) * cos(la) + 40408299984659.16::DOUBLE * sin(la) * sin(la)) AS r FROM (SELECT radians(43.75) AS la, radians(11.25) AS lo) a) b) o",
        "feat_point",
    ),
)
def gps_distance(spark, d):
    return fixture(spark, d, "feat_point").select("gid", F.round(geodesy.gps_distance(F.col("y"), F.col("x"), F.lit(REF[0]), F.lit(REF[1])), 3).alias("metres"))


@query(
    "enu_transform16",
    over(
        "SELECT gid, round(-sin(lo) * 2, 9) AS m0, round(cos(lo) * 2, 9) AS m1, round(-sin(la) * cos(lo) * 2, 9) AS m4, round(cos(la) * 2, 9) AS m6, round(sin(la) * 2, 9) AS m10, round((40680631590769.0::DOUBLE / sqrt(40680631590769.0::DOUBLE * cos(la) * cos(la) + 40408299984087.055::DOUBLE * sin(la) * sin(la)) + alt) * cos(la) * cos(lo), 3) AS m12, 1.0::DOUBLE AS m15 FROM " + _LLA + " q",
        "feat_point",
    ),
)
def enu_transform16(spark, d):
    m = geodesy.enu_transform16(F.col("y"), F.col("x"), F.col("z"), F.lit(2.0))
    rows = fixture(spark, d, "feat_point").select("gid", m.alias("m"))
    return rows.select("gid", *[F.round(F.col("m")[i], 3 if i == 12 else 9).alias(f"m{i}") for i in (0, 1, 4, 6, 10, 12)], F.col("m")[15].alias("m15"))


@query("box_transform", over("SELECT gid, x * 2 + 10 AS b0, y * 3 + 20 AS b1, z * 4 + 30 AS b2, x / 2 * 2 AS b3, y / 2 * 3 AS b7, 2.0::DOUBLE AS b11 FROM feat_point", "feat_point"))
def box_transform(spark, d):
    m = F.array(*[F.lit(float(v)) for v in (2, 0, 0, 0, 0, 3, 0, 0, 0, 0, 4, 0, 10, 20, 30, 1)])
    box = geodesy.box_from_size(F.array("x", "y", "z"), F.array(F.col("x"), F.col("y"), F.lit(1.0)))
    rows = fixture(spark, d, "feat_point").select("gid", geodesy.box_transform(box, m).alias("b"))
    return rows.select("gid", *[F.col("b")[i].alias(f"b{i}") for i in (0, 1, 2, 3, 7, 11)])


@query(
    "mesh_footprint",
    over(
        "SELECT gid, CASE WHEN gid % 7 <> 0 THEN round(x + 5 / k - (10 + gid % 5) / k / 2, 9) END AS west, CASE WHEN gid % 7 <> 0 THEN round(y + 3 / 111320.0 - 20.0 / 111320.0 / 2, 9) END AS south FROM (SELECT *, 111320.0 * cos(radians(y)) AS k FROM feat_point) q",
        "feat_point",
    ),
)
def mesh_footprint(spark, d):
    width = F.when(F.col("gid") % 7 == 0, F.lit("wide")).otherwise((F.col("gid") % 5 + 10).cast("string"))
    box = geodesy.mesh_footprint(F.col("y").cast("string"), F.col("x").cast("string"), width, F.lit("20"), F.lit("5"), F.lit("3"))
    return fixture(spark, d, "feat_point").select("gid", box.alias("b")).select("gid", F.round("b.west", 9).alias("west"), F.round("b.south", 9).alias("south"))


#: The turn from the anchor's up to +Z by angle and axis, then the fixed turn.
_TURNED = f"SELECT gid, dx * c + ay * dz * s + ax * (ax * dx + ay * dy) * (1 - c) AS tx, dy * c - ax * dz * s + ay * (ax * dx + ay * dy) * (1 - c) AS ty, dz * c + (ax * dy - ay * dx) * s AS tz FROM (SELECT e.gid, e.x - o.x AS dx, e.y - o.y AS dy, e.z - o.z AS dz, o.uz AS c, sqrt(1 - o.uz * o.uz) AS s, o.uy / sqrt(1 - o.uz * o.uz) AS ax, -o.ux / sqrt(1 - o.uz * o.uz) AS ay FROM {_ECEF} e CROSS JOIN (SELECT x, y, z, x / sqrt(x * x + y * y + z * z) AS ux, y / sqrt(x * x + y * y + z * z) AS uy, z / sqrt(x * x + y * y + z * z) AS uz FROM {_REF_ECEF} q) o) w"


@query("local_frame", over(f"SELECT gid, round(ty, 3) AS x, round(tz, 3) AS y, round(tx, 3) AS z FROM ({_TURNED}) t", "feat_point"))
def local_frame(spark, d):
    anchor = geodesy.ecef_from_lla(*map(F.lit, REF))
    p = geodesy.ecef_from_lla(F.col("y"), F.col("x"), F.col("z"))
    rows = fixture(spark, d, "feat_point").select("gid", p.alias("p"), anchor.alias("a"))
    f = geodesy.local_frame(F.col("p.x"), F.col("p.y"), F.col("p.z"), (F.col("a.x"), F.col("a.y"), F.col("a.z")))
    return rows.select("gid", f.alias("f")).select("gid", *[F.round(f"f.{c}", 3).alias(c) for c in "xyz"])


#: Forward transverse Mercator (zone 32) of the reference and of a metre east and north of it, and the corners in the frame that these span.
_FRAME = """
, k AS (SELECT *, e2 / (1 - e2) AS ep, sqrt(1 - e2 * sin(radians(43.75)) * sin(radians(43.75))) AS w FROM (SELECT 6378137.0::DOUBLE AS a, 1 - (@B@::DOUBLE / 6378137.0::DOUBLE) * (@B@::DOUBLE / 6378137.0::DOUBLE) AS e2) q),
place AS (SELECT 0 AS i, 43.75::DOUBLE AS lat, 11.25::DOUBLE AS lon UNION ALL SELECT 1, 43.75, 11.25 + degrees(1 / (a / w * cos(radians(43.75)))) FROM k UNION ALL SELECT 2, 43.75 + degrees(1 / (a * (1 - e2) / (w * w * w))), 11.25 FROM k),
term AS (SELECT i, e2, ep, a AS r, la, a / sqrt(1 - e2 * sin(la) * sin(la)) AS n, tan(la) * tan(la) AS t, ep * cos(la) * cos(la) AS c, cos(la) * radians(lon - 9) AS a FROM (SELECT *, radians(lat) AS la FROM place CROSS JOIN k) q),
arc AS (SELECT *, r * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * la - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * la) + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * la) - 35 * e2 * e2 * e2 / 3072 * sin(6 * la)) AS m FROM term),
grid AS (SELECT i, 0.9996 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a ** 5 / 120) + 500000 AS x, 0.9996 * (m + n * tan(la) * (a ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a ** 6 / 720)) AS y FROM arc),
axes AS (SELECT o.x AS x0, o.y AS y0, e.x - o.x AS ex, e.y - o.y AS ey, n.x - o.x AS nx, n.y - o.y AS ny FROM grid o, grid e, grid n WHERE o.i = 0 AND e.i = 1 AND n.i = 2),
corner AS (SELECT s_suppkey, 680000.0 + dx + s_suppkey - x0 AS dx, 4840000.0 + dy - y0 AS dy, ex, ey, nx, ny FROM supplier CROSS JOIN (VALUES (0, 0), (0, 50), (100, 0), (100, 50)) v(dx, dy) CROSS JOIN axes),
frame AS (SELECT s_suppkey, (dx * ny - dy * nx) / (ex * ny - ey * nx) AS u, (ex * dy - ey * dx) / (ex * ny - ey * nx) AS v FROM corner)
SELECT s_suppkey, round(min(u), 3) AS b0, round(min(v), 3) AS b1, round(max(u), 3) AS b2, round(max(v), 3) AS b3 FROM frame GROUP BY s_suppkey
""".replace("@B@", str(geodesy.B))


@query("extent_to_local", over(_FRAME, "feat_point"))
def extent_to_local(spark, d):
    """One extent per supplier, around its place in UTM zone 32."""

    def run(batches):
        for pdf in batches:
            pdf["box"] = [geodesy.extent_to_local((43.75, 11.25, 0.0), [680000.0 + k, 4840000.0, 680100.0 + k, 4840050.0], 32632) for k in pdf["s_suppkey"]]
            for i in range(4):
                pdf[f"b{i}"] = [round(b[i], 3) for b in pdf["box"]]
            yield pdf[["s_suppkey", "b0", "b1", "b2", "b3"]]

    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey").mapInPandas(run, "s_suppkey long, b0 double, b1 double, b2 double, b3 double")


@query("height_ramp", over("SELECT pid, 0.5 + 0.4 * (z - a) / (b - a) AS hue FROM cloud_points CROSS JOIN (SELECT min(z) AS a, max(z) AS b FROM cloud_points) m", "cloud_points"))
def height_ramp(spark, d):
    from geojobs.operators import cloud

    return cloud.height_ramp(fixture(spark, d, "cloud_points").drop("red", "green", "blue")).select("pid", "hue")
