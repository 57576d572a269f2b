"""Queries over point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from geojobs.operators import cloud, tiling
from geojobs.plans import jobs
from geojobs.plans.fixtures import fixture, over
from geojobs.plans.registry import query
from geojobs.plans.vector_queries import budget_sql

GEOTRANSFORM = (0.0, 2.0, 200.0, -2.0)
GEOID = ((11.0, 43.5), 0.01)


def points(spark, d):
    return fixture(spark, d, "cloud_points")


_SIZES = ", ".join(f"max({c}) - min({c}) AS size_{c}, min({c}) + (max({c}) - min({c})) / 2 AS center_{c}" for c in "xyz")


@query("cloud_meta", over(f"SELECT count(*) AS count, {', '.join(f'min({c}) AS min_{c}, max({c}) AS max_{c}' for c in 'xyz')}, {_SIZES} FROM cloud_points", "cloud_points"))
def cloud_meta(spark, d):
    return cloud.metadata(points(spark, d))


DIMS = ["x", "y", "z", "intensity", "red", "green", "blue", "classification"]


@query(
    "cloud_stats",
    over(" UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS name, count({c}) AS count, min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum, round(avg({c}), 6) AS average, round(stddev_samp({c}), 6) AS stddev, round(var_samp({c}), 4) AS variance FROM cloud_points" for i, c in enumerate(DIMS)), "cloud_points"),
)
def cloud_stats(spark, d):
    out = cloud.stats(points(spark, d), DIMS)
    return out.select("position", "name", "count", "minimum", "maximum", F.round("average", 6).alias("average"), F.round("stddev", 6).alias("stddev"), F.round("variance", 4).alias("variance"))


_STEP = "CAST(ceil((SELECT count(*) FROM {0}) / 700.0) AS BIGINT)"


@query("decimate_step", over(f", gaps AS (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS rank FROM cloud_points WHERE pid % 7 NOT IN (0, 3)) SELECT 'whole' AS cloud, pid, x, y, z FROM cloud_points WHERE pid % {_STEP.format('cloud_points')} = 0 UNION ALL SELECT 'gaps', pid, x, y, z FROM gaps WHERE rank % {_STEP.format('gaps')} = 0", "cloud_points"))
def decimate_step(spark, d):
    """A cloud as it is, and one whose record numbers have gaps."""
    whole = points(spark, d)
    both = [cloud.decimate(p, 700).select(F.lit(n).alias("cloud"), "pid", "x", "y", "z") for n, p in (("whole", whole), ("gaps", whole.where("pid % 7 not in (0, 3)")))]
    return both[0].unionByName(both[1])


@query("divide_capacity", over("SELECT pid, CAST(floor(rank / each) AS BIGINT) AS part FROM (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS rank, ceil(n / ceil(n / 1300.0)) AS each FROM cloud_points CROSS JOIN (SELECT count(*) AS n FROM cloud_points) c) q", "cloud_points"))
def divide_capacity(spark, d):
    return cloud.divide(points(spark, d), 1300).select("pid", "part")


@query("crop_xy", over("SELECT pid, x, y, z FROM cloud_points WHERE x BETWEEN 20 AND 60.5 AND y BETWEEN 100 AND 150", "cloud_points"))
def crop_xy(spark, d):
    return cloud.crop_xy(points(spark, d), [20, 100, 60.5, 150]).select("pid", "x", "y", "z")


@query("class_assign", over("SELECT pid, 2 AS classification FROM cloud_points", "cloud_points"))
def class_assign(spark, d):
    return cloud.class_assign(points(spark, d), "classification", 2).select("pid", "classification")


@query("class_range", over("SELECT pid, red FROM cloud_points WHERE NOT red BETWEEN 7 AND 70", "cloud_points"))
def class_range(spark, d):
    return cloud.class_range(points(spark, d), "red", 7, 70, keep=False).select("pid", "red")


@query("class_color", over("SELECT pid, CASE WHEN pid % 9 IN (1, 2) THEN '#FFDEAD' WHEN pid % 9 IN (3, 4) THEN '#63FF7E' WHEN pid % 9 = 5 THEN '#22B33A' WHEN pid % 9 = 6 THEN '#ff0000' ELSE '#808080' END AS color FROM cloud_points", "cloud_points"))
def class_color(spark, d):
    return points(spark, d).select("pid", cloud.class_color(F.col("pid") % 9).alias("color"))


@query("affine", over("SELECT pid, x - cx AS x, y - cy AS y, z - cz AS z FROM cloud_points CROSS JOIN (SELECT min(x) + (max(x) - min(x)) / 2 AS cx, min(y) + (max(y) - min(y)) / 2 AS cy, min(z) + (max(z) - min(z)) / 2 AS cz FROM cloud_points) c", "cloud_points"))
def affine(spark, d):
    p = points(spark, d)
    return cloud.centred(p, cloud.metadata(p)).select("pid", "x", "y", "z")


@query("affine_matrix", over("SELECT pid, round(y * -2 + 5, 6) AS x, round(x * 2 + 6, 6) AS y, round(z + 7, 6) AS z FROM cloud_points", "cloud_points"))
def affine_matrix(spark, d):
    return cloud.affine(points(spark, d), [0, -2, 0, 5, 2, 0, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1]).select("pid", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("merge_clouds", over("SELECT pid, x, CASE WHEN pid % 2 = 0 THEN red END AS red FROM cloud_points", "cloud_points"))
def merge_clouds(spark, d):
    p = points(spark, d)
    return cloud.merge([p.where("pid % 2 = 0").select("pid", "x", "red"), p.where("pid % 2 = 1").select("pid", "x")])


@query("colorize", over("SELECT pid, coalesce(r, red) AS red, coalesce(g, green) AS green, coalesce(b, blue) AS blue FROM cloud_points LEFT JOIN raster ON r_col = floor(x / 2) AND r_row = floor((y - 200) / -2)", "cloud_points", "raster"))
def colorize(spark, d):
    return cloud.colorize(points(spark, d), fixture(spark, d, "raster"), GEOTRANSFORM).select("pid", "red", "green", "blue")


_N = lambda a, b: f"(SELECT gi - {a} AS gi, gj - {b} AS gj, n AS n{a}{b} FROM geoid) n{a}{b}"


@query(
    "height_datum",
    over(
        f"SELECT gid, round(z + n00 * (1 - f) * (1 - g) + n01 * (1 - f) * g + n10 * f * (1 - g) + n11 * f * g, 6) AS z FROM (SELECT *, (y - 43.5) / 0.01 - floor((y - 43.5) / 0.01) AS f, (x - 11.0) / 0.01 - floor((x - 11.0) / 0.01) AS g, CAST(floor((y - 43.5) / 0.01) AS BIGINT) AS gi, CAST(floor((x - 11.0) / 0.01) AS BIGINT) AS gj FROM feat_point) p LEFT JOIN {_N(0, 0)} USING (gi, gj) LEFT JOIN {_N(0, 1)} USING (gi, gj) LEFT JOIN {_N(1, 0)} USING (gi, gj) LEFT JOIN {_N(1, 1)} USING (gi, gj)",
        "feat_point", "geoid",
    ),
)
def height_datum(spark, d):
    return cloud.height_datum(fixture(spark, d, "feat_point"), fixture(spark, d, "geoid"), *GEOID).select("gid", F.round("z", 6).alias("z"))


@query(
    "elm_noise",
    over(
        "SELECT pid, CASE WHEN min(coalesce(gap, -1)) OVER (PARTITION BY i, j ORDER BY z, pid ROWS UNBOUNDED PRECEDING) >= 1 THEN 7 ELSE classification END AS classification FROM (SELECT *, lead(z) OVER (PARTITION BY i, j ORDER BY z, pid) - z AS gap FROM (SELECT *, floor(x / 10) AS i, floor(y / 10) AS j FROM cloud_points) q) r",
        "cloud_points",
    ),
)
def elm_noise(spark, d):
    return cloud.elm(points(spark, d)).select("pid", "classification")


#: Every point's eighth neighbour is nearer than 30, so that cells of 30 and those about them hold all that count.
_CELLS = "SELECT *, CAST(floor(x / 30) AS BIGINT) AS i, CAST(floor(y / 30) AS BIGINT) AS j FROM cloud_points"
_KNN = f"SELECT pid, avg(d) AS m FROM (SELECT pid, d, row_number() OVER (PARTITION BY pid ORDER BY d) AS n FROM (SELECT a.pid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM (SELECT c.*, o.range - 1 AS oi, q.range - 1 AS oj FROM ({_CELLS}) c CROSS JOIN range(3) o CROSS JOIN range(3) q) a JOIN ({_CELLS}) b ON b.i = a.i + a.oi AND b.j = a.j + a.oj AND a.pid <> b.pid) p WHERE d < 30) q WHERE n <= 8 GROUP BY pid"


@query("knn_mean", over(f"SELECT pid, round(m, 6) AS mean_distance FROM ({_KNN}) k", "cloud_points"))
def knn_mean(spark, d):
    return cloud.knn_mean(points(spark, d), 8).select("pid", F.round("mean_distance", 6).alias("mean_distance"))


@query("outlier_stat", over(f"SELECT pid, CASE WHEN m > (SELECT avg(m) + 2.0 * stddev_samp(m) FROM ({_KNN}) k) THEN 7 ELSE 0 END AS classification FROM ({_KNN}) k", "cloud_points"))
def outlier_stat(spark, d):
    return cloud.outlier(points(spark, d), 8, 2.0).select("pid", "classification")


def greedy_sql(name: str, radius: float, rows: str) -> str:
    """SQL of the pass by pid over ``rows``(part, pid, x, y, z): ``name``(part, pid, x, y, z) of the points that stay.

    Rounds settle what earlier neighbours allow: a point with a kept one goes, one without undecided ones stays.
    """
    cell = ", ".join(f"CAST(floor({c} / {radius}) AS BIGINT) AS c{c}" for c in "xyz")
    apart = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in "xyz")
    return f"""
, {name}_rows AS MATERIALIZED (SELECT part, pid, x, y, z, {cell} FROM ({rows}) r),
{name}_near AS MATERIALIZED (SELECT p.pid AS p, q.pid AS q FROM (SELECT r.*, i.range - 1 AS di, j.range - 1 AS dj, k.range - 1 AS dk FROM {name}_rows r CROSS JOIN range(3) i CROSS JOIN range(3) j CROSS JOIN range(3) k) p
  JOIN {name}_rows q ON q.part = p.part AND q.cx = p.cx + di AND q.cy = p.cy + dj AND q.cz = p.cz + dk WHERE q.pid < p.pid AND {apart} < {radius * radius}),
{name}_state(round, pid, state) AS (SELECT 0, pid, 0 FROM {name}_rows
  UNION ALL SELECT s.round + 1, s.pid, CASE WHEN any_value(s.state) <> 0 THEN any_value(s.state) WHEN bool_or(t.state = 1) THEN 2 WHEN bool_or(t.state = 0) THEN 0 ELSE 1 END
  FROM {name}_state s LEFT JOIN {name}_near n ON n.p = s.pid LEFT JOIN {name}_state t ON t.pid = n.q WHERE EXISTS (SELECT 1 FROM {name}_state u WHERE u.state = 0) GROUP BY s.round, s.pid),
{name} AS MATERIALIZED (SELECT r.part, r.pid, r.x, r.y, r.z FROM {name}_rows r JOIN {name}_state s USING (pid) WHERE s.state = 1 AND s.round = (SELECT max(round) FROM {name}_state))
"""


@query("poisson_sample", over(greedy_sql("kept", 2.0, "SELECT 0 AS part, pid, x, y, z FROM cloud_points") + "SELECT pid, x FROM kept", "cloud_points").replace("WITH ", "WITH RECURSIVE ", 1))
def poisson_sample(spark, d):
    return cloud.poisson_sample(points(spark, d).select("pid", "x", "y", "z"), 2.0).select("pid", "x")


@query("smrf_ground")
def smrf_ground(spark, d):
    return cloud.smrf(cloud.elm(points(spark, d)), block=64).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


def octree_sql(budget: int, level: int = 8, rows: str = "SELECT pid, x, y, z FROM cloud_points") -> str:
    """SQL of the octree over ``rows``: ``nodes3(pid, level, tx, ty, tz)``, a point in the shallowest node that it stands for."""
    fine = ", ".join(f"c_{a} >> CAST(greatest(0, {level} - q.range - 3) AS BIGINT) AS f_{a}" for a in "xyz")
    return (
        budget_sql(rows, "x y z", budget, level)
        + f", firsts AS (SELECT up_, min(pid) AS pid FROM (SELECT pid, q.range AS up_, {fine} FROM leafs JOIN range({level}) q ON q.range < level) i GROUP BY up_, f_x, f_y, f_z), ups AS (SELECT pid, min(up_) AS up_ FROM firsts GROUP BY pid)"
        + f", nodes3 AS (SELECT pid, n AS level, c_x >> ({level} - n) AS tx, c_y >> ({level} - n) AS ty, c_z >> ({level} - n) AS tz FROM (SELECT l.*, coalesce(u.up_, l.level) AS n FROM leafs l LEFT JOIN ups u USING (pid)) w)"
    )


def _tile(rows, *more):
    return rows.select("pid", F.col("level").cast("long").alias("level"), *[F.col("tile")[i].alias(n) for i, n in enumerate(("tx", "ty", "tz"))], *more)


@query("octree_tiles", over(octree_sql(200) + " SELECT pid, CAST(level AS BIGINT) AS level, tx, ty, tz FROM nodes3", "cloud_points"))
def octree_tiles(spark, d):
    return _tile(tiling.octree_tiles(points(spark, d), 200, 8))


@query("job_cloud_inspect", over(f"SELECT pid, x - c.center_x AS x, y - c.center_y AS y, z - c.center_z AS z FROM cloud_points CROSS JOIN (SELECT {_SIZES} FROM cloud_points) c WHERE pid % CAST(ceil((SELECT count(*) FROM cloud_points) / 500.0) AS BIGINT) = 0", "cloud_points"))
def job_cloud_inspect(spark, d):
    return jobs.cloud_inspect(points(spark, d), cap=500)["preview"].select("pid", "x", "y", "z")


@query(
    "job_cloud_tiles",
    over(
        octree_sql(400)
        + " SELECT pid, CAST(level AS BIGINT) AS level, tx, ty, tz, coalesce(r, red) AS red, coalesce(g, green) AS green, coalesce(b, blue) AS blue FROM nodes3 JOIN cloud_points USING (pid) LEFT JOIN raster ON r_col = floor(x / 2) AND r_row = floor((y - 200) / -2)",
        "cloud_points", "raster",
    ),
)
def job_cloud_tiles(spark, d):
    out = jobs.cloud_tiles(points(spark, d), {"colorization_image": "image.tif"}, fixture(spark, d, "raster"), GEOTRANSFORM, budget=400, max_level=8)
    return _tile(out["tiles"].join(out["points"].select("pid", "red", "green", "blue"), "pid"), "red", "green", "blue")


@query(
    "job_cloud_tiles_full",
    over(
        greedy_sql("kept", 2.0, "SELECT 0 AS part, pid, x, y, z FROM cloud_points")
        + f", lifted AS MATERIALIZED (SELECT pid, x, y, z + n00 * (1 - f) * (1 - g) + n01 * (1 - f) * g + n10 * f * (1 - g) + n11 * f * g AS z FROM (SELECT *, y / 10.0 - floor(y / 10.0) AS f, x / 10.0 - floor(x / 10.0) AS g, CAST(floor(y / 10.0) AS BIGINT) AS gi, CAST(floor(x / 10.0) AS BIGINT) AS gj FROM kept) p LEFT JOIN {_N(0, 0)} USING (gi, gj) LEFT JOIN {_N(0, 1)} USING (gi, gj) LEFT JOIN {_N(1, 0)} USING (gi, gj) LEFT JOIN {_N(1, 1)} USING (gi, gj))"
        + octree_sql(100, 8, "SELECT * FROM lifted")
        + " SELECT pid, CAST(level AS BIGINT) AS level, tx, ty, tz, round(l.z, 6) AS z, coalesce(r, red) AS red FROM nodes3 JOIN lifted l USING (pid) JOIN (SELECT pid, red, CAST(floor(x / 2) AS BIGINT) AS r_col, CAST(floor((y - 200) / -2) AS BIGINT) AS r_row FROM cloud_points) c USING (pid) LEFT JOIN raster USING (r_col, r_row)",
        "cloud_points", "raster", "geoid",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def job_cloud_tiles_full(spark, d):
    """Thinned, lifted and coloured, in that order, before the tiles are made."""
    config = {"sample_radius": 2.0, "to_ellipsoidal_height": "true", "colorization_image": "image.tif"}
    out = jobs.cloud_tiles(points(spark, d), config, fixture(spark, d, "raster"), GEOTRANSFORM, (fixture(spark, d, "geoid"), (0.0, 0.0), 10.0), budget=100, max_level=8)
    return _tile(out["tiles"].join(out["points"].select("pid", F.round("z", 6).alias("height"), "red"), "pid"), F.col("height").alias("z"), "red")


@query("geom_error_scale", over(budget_sql("SELECT pid, x, y FROM cloud_points", "x y", 300, 8) + "SELECT CAST(level AS INTEGER) AS level, c_x >> (8 - level) AS tx, c_y >> (8 - level) AS ty, 2.5 / pow(2, level) AS geometric_error FROM leafs GROUP BY ALL", "cloud_points"))
def geom_error_scale(spark, d):
    tiles = tiling.tile_budget(points(spark, d), ["x", "y"], 300, 8).groupBy("level", "tile").agg((1.0 / F.pow(F.lit(2.0), F.first("level"))).alias("geometric_error"))
    return tiling.error_scale(tiles, 2.5).select(F.col("level").cast("int").alias("level"), F.col("tile")[0].alias("tx"), F.col("tile")[1].alias("ty"), "geometric_error")


#: Mean distances to the eight nearest of a part's kept points; their eighth neighbours are nearer than 30.
_PART_KNN = "SELECT part, pid, avg(d) AS m FROM (SELECT part, pid, d, row_number() OVER (PARTITION BY pid ORDER BY d) AS n FROM (SELECT a.part, a.pid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM kept_c a JOIN (SELECT c.*, o.range - 1 AS oi, q.range - 1 AS oj FROM kept_c c CROSS JOIN range(3) o CROSS JOIN range(3) q) b ON b.part = a.part AND a.i = b.i + b.oi AND a.j = b.j + b.oj AND a.pid <> b.pid) p WHERE d < 30) q WHERE n <= 8 GROUP BY part, pid"


@query(
    "job_denoise",
    over(
        ", sizes AS (SELECT count(*) AS n FROM cloud_points)"
        + greedy_sql("kept", 1.0, "SELECT CAST(floor(rank / each) AS BIGINT) AS part, pid, x, y, z FROM (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS rank, ceil(n / ceil(n / 4000.0)) AS each FROM cloud_points CROSS JOIN sizes) q")
        + f", kept_c AS MATERIALIZED (SELECT *, CAST(floor(x / 30) AS BIGINT) AS i, CAST(floor(y / 30) AS BIGINT) AS j FROM kept), k AS MATERIALIZED ({_PART_KNN}), limits AS (SELECT part, avg(m) + 2.2 * stddev_samp(m) AS most FROM k GROUP BY part)"
        + " SELECT pid, part, 0 AS classification FROM k JOIN limits USING (part) WHERE NOT m > most",
        "cloud_points",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def job_denoise(spark, d):
    return jobs.denoise(points(spark, d), radius=1.0, k=8, capacity=4000).select("pid", "part", "classification")
