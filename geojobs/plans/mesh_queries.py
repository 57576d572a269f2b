"""Queries over meshes and surveys."""

from __future__ import annotations

from pyspark.sql import functions as F

from geojobs.operators import cloud, mesh, survey, tiling
from geojobs.plans import jobs
from geojobs.plans.fixtures import fixture, over
from geojobs.plans.registry import query

DEPTH, MARGIN = 3, 4.0


def both(spark, d):
    return fixture(spark, d, "mesh_vertices"), fixture(spark, d, "mesh_faces")


_BOX = "SELECT min(x) AS l, max(y) AS t, max(x) - min(x) AS w, max(y) - min(y) AS h FROM mesh_vertices"
_WIDE = "SELECT f.fid, f.a, f.b, f.c, " + ", ".join(f"least(p.{c}, q.{c}, r.{c}) AS lo_{c}, greatest(p.{c}, q.{c}, r.{c}) AS hi_{c}" for c in "xyz") + " FROM mesh_faces f JOIN mesh_vertices p ON p.vid = f.a JOIN mesh_vertices q ON q.vid = f.b JOIN mesh_vertices r ON r.vid = f.c"
_TILES = f"SELECT CAST(l.range AS INTEGER) AS level, CAST(i.range AS INTEGER) AS tx, CAST(j.range AS INTEGER) AS ty, b.l + i.range * (b.w / (1 << l.range)) - {MARGIN} AS x0, b.l + (i.range + 1) * (b.w / (1 << l.range)) + {MARGIN} AS x1, b.t - (j.range + 1) * (b.h / (1 << l.range)) - {MARGIN} AS y0, b.t - j.range * (b.h / (1 << l.range)) + {MARGIN} AS y1 FROM ({_BOX}) b CROSS JOIN range({DEPTH + 1}) l CROSS JOIN range({1 << DEPTH}) i CROSS JOIN range({1 << DEPTH}) j WHERE i.range < (1 << l.range) AND j.range < (1 << l.range)"
_PLACED = f"SELECT w.*, t.level, t.ty AS y, t.tx AS x FROM ({_WIDE}) w JOIN ({_TILES}) t ON w.lo_x >= t.x0 AND w.hi_x <= t.x1 AND w.lo_y >= t.y0 AND w.hi_y <= t.y1"
_STATS = f"SELECT level, y, x, count(*) AS faces, min(lo_x) AS x0, max(hi_x) AS x1, min(lo_y) AS y0, max(hi_y) AS y1, min(lo_z) AS z0, max(hi_z) AS z1 FROM ({_PLACED}) p GROUP BY ALL"


@query("mesh_info", over("SELECT max(x) - min(x) AS size_x, max(y) - min(y) AS size_y, max(z) - min(z) AS size_z, min(x) AS left, max(y) AS top FROM mesh_vertices".replace("AS left", 'AS "left"'), "mesh_vertices"))
def mesh_info(spark, d):
    return mesh.mesh_info(fixture(spark, d, "mesh_vertices"))


@query("tile_points_range", over(f"SELECT v.vid, t.level, t.ty, t.tx FROM mesh_vertices v JOIN ({_TILES}) t ON v.x BETWEEN t.x0 AND t.x1 AND v.y BETWEEN t.y0 AND t.y1", "mesh_vertices"))
def tile_points_range(spark, d):
    return mesh.tile_points_range(fixture(spark, d, "mesh_vertices"), DEPTH, MARGIN).select("vid", "level", F.col("tile_y").alias("ty"), F.col("tile_x").alias("tx"))


@query("face_tiles", over(f"SELECT fid, level, y, x FROM ({_PLACED}) p", "mesh_vertices", "mesh_faces"))
def face_tiles(spark, d):
    return mesh.face_tiles(*both(spark, d), DEPTH, MARGIN).select("fid", "level", "y", "x")


@query("tile_stats", over(f"SELECT s.level, s.y, s.x, s.faces, u.vertices, (x0 + x1) / 2 AS center_x, (y0 + y1) / 2 AS center_y, x1 - x0 AS size_x, z1 - z0 AS size_z FROM ({_STATS}) s JOIN (SELECT level, y, x, count(DISTINCT vid) AS vertices FROM (SELECT level, y, x, unnest([a, b, c]) AS vid FROM ({_PLACED}) p) q GROUP BY ALL) u USING (level, y, x)", "mesh_vertices", "mesh_faces"))
def tile_stats(spark, d):
    v, f = both(spark, d)
    out = mesh.tile_stats(mesh.face_tiles(v, f, DEPTH, MARGIN), mesh.tasks_for(v))
    return out.select("level", "y", "x", "faces", "vertices", F.col("center")[0].alias("center_x"), F.col("center")[1].alias("center_y"), F.col("size")[0].alias("size_x"), F.col("size")[2].alias("size_z"))


_CHILDREN = f"SELECT s.level, s.y, s.x, count(c.level) AS children FROM ({_STATS}) s LEFT JOIN ({_STATS}) c ON c.level = s.level + 1 AND c.y >> 1 = s.y AND c.x >> 1 = s.x GROUP BY ALL"


@query("tile_children", over(_CHILDREN, "mesh_vertices", "mesh_faces"))
def tile_children(spark, d):
    v, f = both(spark, d)
    return tiling.tile_children(mesh.settle(mesh.tile_boxes(mesh.face_tiles(v, f, DEPTH, MARGIN))), DEPTH).select("level", "y", "x", F.col("children").cast("long").alias("children"))


@query("tileset_flat", over(f"SELECT s.level, s.y, s.x, CASE WHEN s.level > 0 THEN s.y >> 1 END AS parent_y, CASE WHEN s.level > 0 THEN s.x >> 1 END AS parent_x, CASE WHEN s.level < {DEPTH} THEN 256.0 / pow(2, s.level + 2) ELSE 0.0 END AS geometric_error, 'tiles/' || s.level || '_' || s.y || '_' || s.x || '.glb' AS uri, (x0 + x1) / 2 AS cx, (x1 - x0) / 2 AS hx FROM ({_STATS}) s", "mesh_vertices", "mesh_faces"))
def tileset_flat(spark, d):
    v, f = both(spark, d)
    stats = mesh.settle(mesh.tile_boxes(mesh.face_tiles(v, f, DEPTH, MARGIN)))
    out = tiling.tileset_flat(stats, [1.0, 1.0, 1.0], DEPTH, 256.0)
    return out.select("level", "y", "x", "parent_y", "parent_x", "geometric_error", "uri", F.col("box")[0].alias("cx"), F.col("box")[3].alias("hx"))


@query("tileset_json")
def tileset_json(spark, d):
    v, f = both(spark, d)
    stats = mesh.settle(mesh.tile_boxes(mesh.face_tiles(v, f, DEPTH, MARGIN)))
    return tiling.tileset_json(tiling.tileset_flat(stats, [1.0, 1.0, 1.0], DEPTH, 256.0), DEPTH, 256.0)


@query("snk_tile_info", over(f"SELECT level, y, x, (x0 + x1) / 2 AS cx, x1 - x0 AS sx FROM ({_STATS}) s", "mesh_vertices", "mesh_faces"))
def snk_tile_info(spark, d):
    from geojobs.sources import sinks

    v, f = both(spark, d)
    info = sinks.tile_info(mesh.tile_boxes(mesh.face_tiles(v, f, DEPTH, MARGIN)))
    back = F.from_json("info", "center array<double>, size array<double>")
    return info.select("level", "y", "x", back["center"][0].alias("cx"), back["size"][0].alias("sx"))


@query("geom_error_ladder", over(f"SELECT level, y, x, CASE WHEN level < {DEPTH} THEN round(sqrt(w * w + h * h) / 3 / pow(2, level + 2), 9) ELSE 0.0 END AS geometric_error FROM ({_STATS}) s CROSS JOIN ({_BOX}) b", "mesh_vertices", "mesh_faces"))
def geom_error_ladder(spark, d):
    v, f = both(spark, d)
    box = mesh.mesh_info(v).select(F.array("size_x", "size_y", F.lit(0.0)).alias("s"))
    rows = mesh.tile_boxes(mesh.face_tiles(v, f, DEPTH, MARGIN)).crossJoin(F.broadcast(box))  # one row
    return rows.select("level", "y", "x", F.round(tiling.geometric_error(F.col("level"), DEPTH, tiling.default_max_error(F.col("s"))), 9).alias("geometric_error"))


#: Tile lines run along the grid's sides, so that no face is cut here (tests/test_operators.py cuts); a heavy tile's clusters become
#: their first corner.
TARGET = 300
_CORNER = lambda n: f"[{n}.x, {n}.y, {n}.z]"
_MADE = f"""
, wide AS MATERIALIZED (SELECT w.*, {_CORNER('p')} AS pa, {_CORNER('q')} AS pb, {_CORNER('r')} AS pc FROM ({_WIDE}) w JOIN mesh_vertices p ON p.vid = w.a JOIN mesh_vertices q ON q.vid = w.b JOIN mesh_vertices r ON r.vid = w.c),
placed AS MATERIALIZED (SELECT w.fid, w.pa, w.pb, w.pc, t.level, t.ty AS y, t.tx AS x FROM wide w JOIN ({_TILES}) t ON w.lo_x >= t.x0 AND w.hi_x <= t.x1 AND w.lo_y >= t.y0 AND w.hi_y <= t.y1),
heavy AS MATERIALIZED (SELECT level, y, x FROM placed WHERE level < {DEPTH} GROUP BY ALL HAVING count(*) > {TARGET}),
spots AS (SELECT level, y, x, fid, k, p, [floor(p[i] / (5.0 / pow(2, level))) for i in [1, 2, 3]] AS cell FROM (SELECT level, y, x, fid, unnest([0, 1, 2]) AS k, unnest([pa, pb, pc]) AS p FROM placed JOIN heavy USING (level, y, x)) e),
firsts AS MATERIALIZED (SELECT level, y, x, cell, min(p) AS first FROM spots GROUP BY ALL),
coarse AS (SELECT level, y, x, fid, max(first) FILTER (k = 0) AS pa, max(first) FILTER (k = 1) AS pb, max(first) FILTER (k = 2) AS pc FROM spots JOIN firsts USING (level, y, x, cell) GROUP BY ALL),
made AS (SELECT level, y, x, pa, pb, pc FROM coarse WHERE pa <> pb AND pb <> pc AND pa <> pc UNION ALL SELECT level, y, x, pa, pb, pc FROM placed ANTI JOIN heavy USING (level, y, x))
SELECT level, y, x, count(*) AS faces, (min(least(pa[1], pb[1], pc[1])) + max(greatest(pa[1], pb[1], pc[1]))) / 2 AS cx, (min(least(pa[2], pb[2], pc[2])) + max(greatest(pa[2], pb[2], pc[2]))) / 2 AS cy, max(greatest(pa[3], pb[3], pc[3])) - min(least(pa[3], pb[3], pc[3])) AS sz FROM made GROUP BY ALL
"""


@query("job_mesh_tiles", over(_MADE, "mesh_vertices", "mesh_faces"))
def job_mesh_tiles(spark, d):
    out = jobs.mesh_tiles(*both(spark, d), {"depth": DEPTH, "tile_faces_target": str(TARGET)}, MARGIN)["tiles"]
    return out.select("level", "y", "x", "faces", F.col("center")[0].alias("cx"), F.col("center")[1].alias("cy"), F.col("size")[2].alias("sz"))


_WELD = "SELECT vid, x, y, z, min(vid) OVER (PARTITION BY floor(x / 2), floor(y / 2), floor(z / 2)) AS to_vid FROM mesh_vertices"


@query("weld", over(f"SELECT f.fid, p.to_vid AS a, q.to_vid AS b, r.to_vid AS c FROM mesh_faces f JOIN ({_WELD}) p ON p.vid = f.a JOIN ({_WELD}) q ON q.vid = f.b JOIN ({_WELD}) r ON r.vid = f.c WHERE p.to_vid <> q.to_vid AND q.to_vid <> r.to_vid AND p.to_vid <> r.to_vid", "mesh_vertices", "mesh_faces"))
def weld(spark, d):
    return mesh.weld(*both(spark, d), t=2.0)[1].select("fid", "a", "b", "c")


_CLUSTER = f"""
, placed AS MATERIALIZED ({_PLACED}), heavy AS MATERIALIZED (SELECT level, y, x FROM placed WHERE level < {DEPTH} GROUP BY ALL HAVING count(*) > {TARGET}),
spots AS MATERIALIZED (SELECT s.*, [floor(v.x / (5.0 / pow(2, level))), floor(v.y / (5.0 / pow(2, level))), floor(v.z / (5.0 / pow(2, level)))] AS cell FROM (SELECT level, y, x, fid, unnest([0, 1, 2]) AS k, unnest([a, b, c]) AS vid FROM placed JOIN heavy USING (level, y, x)) s JOIN mesh_vertices v USING (vid)),
firsts AS MATERIALIZED (SELECT level, y, x, cell, min(vid) AS first FROM spots GROUP BY ALL),
coarse AS (SELECT level, y, x, fid, max(first) FILTER (k = 0) AS a, max(first) FILTER (k = 1) AS b, max(first) FILTER (k = 2) AS c FROM spots JOIN firsts USING (level, y, x, cell) GROUP BY ALL)
SELECT level, y, x, fid, a, b, c FROM coarse WHERE a <> b AND b <> c AND a <> c UNION ALL SELECT level, y, x, fid, a, b, c FROM placed ANTI JOIN heavy USING (level, y, x)
"""


_TWINS = "SELECT vid, x, y, z FROM mesh_vertices UNION ALL SELECT vid + 1000000000, x + 0.00004 * (vid % 5), y, z FROM mesh_vertices WHERE vid % 7 = 0"
_ASKED = "SELECT fid, CASE WHEN a % 7 = 0 AND fid % 2 = 0 THEN a + 1000000000 ELSE a END AS a, b, c FROM mesh_faces"


@query("weld_near", over(f", t AS (SELECT fid, CASE WHEN a >= 1000000000 AND (a - 1000000000) % 5 <= 2 THEN a - 1000000000 ELSE a END AS a, b, c FROM ({_ASKED}) f) SELECT * FROM t WHERE a <> b AND b <> c AND a <> c", "mesh_vertices", "mesh_faces"))
def weld_near(spark, d):
    """Every seventh vertex has a twin up to 0.00016 beside it, which half of its faces use: those within 0.0001 are merged."""
    v, f = both(spark, d)
    twins = v.where("vid % 7 = 0").select((F.col("vid") + 1000000000).alias("vid"), (F.col("x") + 0.00004 * (F.col("vid") % 5)).alias("x"), "y", "z")
    asked = f.withColumn("a", F.when((F.col("a") % 7 == 0) & (F.col("fid") % 2 == 0), F.col("a") + 1000000000).otherwise(F.col("a")))
    return mesh.weld(v.select("vid", "x", "y", "z").unionByName(twins), asked, near=True)[1].select("fid", "a", "b", "c")


@query("cluster_decimate", over(_CLUSTER, "mesh_vertices", "mesh_faces"))
def cluster_decimate(spark, d):
    return mesh.cluster_decimate(*both(spark, d), DEPTH, MARGIN, target=TARGET).select("level", "y", "x", "fid", "a", "b", "c")


_CROSS = "((by_ - ay) * (cz - az) - (bz - az) * (cy - ay)) AS nx, ((bz - az) * (cx - ax) - (bx - ax) * (cz - az)) AS ny, ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) AS nz"
_FLAT = "SELECT f.fid, f.a, f.b, f.c, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM mesh_faces f JOIN mesh_vertices p ON p.vid = f.a JOIN mesh_vertices q ON q.vid = f.b JOIN mesh_vertices r ON r.vid = f.c"


@query("vertex_normals", over(f"SELECT vid, round(sx / n, 6) AS nx, round(sy / n, 6) AS ny, round(sz / n, 6) AS nz FROM (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS n FROM (SELECT vid, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM (SELECT unnest([a, b, c]) AS vid, {_CROSS} FROM ({_FLAT}) w) e GROUP BY vid) s) t", "mesh_vertices", "mesh_faces"))
def vertex_normals(spark, d):
    return mesh.vertex_normals(*both(spark, d)).select("vid", *[F.round("n" + c, 6).alias("n" + c) for c in "xyz"])


_SIDES = "SELECT DISTINCT u, v FROM (SELECT unnest([a, b, c, b, c, a]) AS u, unnest([b, c, a, a, b, c]) AS v FROM mesh_faces) s"


@query("taubin_smooth", over(f"SELECT m.vid, round(m.x + 0.5 * coalesce(n.x - m.x, 0), 6) AS x, round(m.y + 0.5 * coalesce(n.y - m.y, 0), 6) AS y, round(m.z + 0.5 * coalesce(n.z - m.z, 0), 6) AS z FROM mesh_vertices m LEFT JOIN (SELECT u, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ({_SIDES}) e JOIN mesh_vertices w ON w.vid = e.v GROUP BY u) n ON n.u = m.vid", "mesh_vertices", "mesh_faces"))
def taubin_smooth(spark, d):
    v, f = both(spark, d)
    return mesh.smooth_step(v, mesh.edges(f), 0.5).select("vid", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("taubin_smooth_full")
def taubin_smooth_full(spark, d):
    return mesh.taubin(*both(spark, d))


@query("quantile_trim", over("SELECT fid, a, b, c FROM mesh_faces WHERE a IN (SELECT vid FROM k) AND b IN (SELECT vid FROM k) AND c IN (SELECT vid FROM k)".replace("FROM k", "FROM (SELECT vid FROM mesh_vertices WHERE z >= (SELECT quantile_cont(z, 0.02) FROM mesh_vertices)) k"), "mesh_vertices", "mesh_faces"))
def quantile_trim(spark, d):
    return mesh.quantile_trim(*both(spark, d), "z", 0.02)[1]


_IN = "(SELECT vid FROM mesh_vertices, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM cloud_points WHERE x BETWEEN 0 AND 100 AND y BETWEEN 0 AND 80) b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1)"


@query("crop_to_bbox", over(f"SELECT fid, a, b, c FROM mesh_faces WHERE a IN {_IN} AND b IN {_IN} AND c IN {_IN}", "mesh_vertices", "mesh_faces", "cloud_points"))
def crop_to_bbox(spark, d):
    return mesh.crop_to_bbox(*both(spark, d), cloud.crop_xy(fixture(spark, d, "cloud_points"), [0, 0, 100, 80]))[1]


_AREA = f"SELECT fid, sqrt(nx * nx + ny * ny + nz * nz) / 2 AS area FROM (SELECT fid, {_CROSS} FROM ({_FLAT}) w) n"


def _areas(pieces):
    d = {k + c: F.col(k + c) - F.col("a" + c) for k in "bc" for c in "xyz"}
    cross = [d["by"] * d["cz"] - d["bz"] * d["cy"], d["bz"] * d["cx"] - d["bx"] * d["cz"], d["bx"] * d["cy"] - d["by"] * d["cx"]]
    return F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2


@query("split_grid", over(f"SELECT fid, round(area, 6) AS area FROM ({_AREA}) a", "mesh_vertices", "mesh_faces"))
def split_grid(spark, d):
    v, f = both(spark, d)
    info = mesh.mesh_info(v).first()
    pieces = mesh.split_grid(v, f, info["left"], info["top"], info["size_x"] / 7, info["size_y"] / 7, 7)
    return pieces.groupBy("fid").agg(F.round(F.sum(_areas(pieces)), 6).alias("area"))


#: The box cuts faces. Its part of a face under, or over, the diagonal of a grid cell is an integral over x of what two ramps leave.
CROP = (15.4, 3.7, 60.2, 21.9)
_RAMPS = "((greatest(s1 - b, 0) * greatest(s1 - b, 0) - greatest(s1 - t, 0) * greatest(s1 - t, 0)) - (greatest(s0 - b, 0) * greatest(s0 - b, 0) - greatest(s0 - t, 0) * greatest(s0 - t, 0))) / 2"
_CROPPED = f"""
SELECT fid, round(area * flat / (1.5 * 1.5 / 2), 6) AS area FROM (SELECT fid, area, CASE WHEN fid % 2 = 0 THEN {_RAMPS} ELSE (t - b) * (s1 - s0) - {_RAMPS} END AS flat
  FROM (SELECT w.fid, a.area, greatest({CROP[0]}, lo_x) - lo_x AS s0, least({CROP[2]}, hi_x) - lo_x AS s1, greatest({CROP[1]}, lo_y) - lo_y AS b, least({CROP[3]}, hi_y) - lo_y AS t FROM ({_WIDE}) w JOIN ({_AREA}) a USING (fid)) q
  WHERE s1 > s0 AND t > b) r WHERE flat > 0.000001
"""


@query("crop_mesh", over(_CROPPED, "mesh_vertices", "mesh_faces"))
def crop_mesh(spark, d):
    pieces = mesh.crop(*both(spark, d), list(CROP))
    return pieces.groupBy("fid").agg(F.sum(_areas(pieces)).alias("area")).where("area > 0.000002").select("fid", F.round("area", 6).alias("area"))


AXES = ["X", "-X", "Y", "-Y", "Z", "-Z"]
_AXIS = lambda c: f"(CASE {c} " + " ".join(f"WHEN {i} THEN [{', '.join(str(float((-1 if a[0] == '-' else 1) * (a[-1] == x))) for x in 'XYZ')}]" for i, a in enumerate(AXES)) + " END)"


@query(
    "mesh_reorient",
    over(
        "SELECT vid, CASE WHEN p THEN x ELSE abs(r[1]) * x + abs(r[2]) * y + abs(r[3]) * z END AS size_x, CASE WHEN p THEN y ELSE abs(f[1]) * x + abs(f[2]) * y + abs(f[3]) * z END AS size_y, CASE WHEN p THEN z ELSE u[1] * x + u[2] * y + u[3] * z END AS offset_z FROM (SELECT *, f[1] * u[1] + f[2] * u[2] + f[3] * u[3] <> 0 AS p, [f[2] * u[3] - f[3] * u[2], f[3] * u[1] - f[1] * u[3], f[1] * u[2] - f[2] * u[1]] AS r FROM (SELECT *, "
        + _AXIS("vid % 6") + " AS f, " + _AXIS("CAST(floor(vid / 6) AS BIGINT) % 6") + " AS u FROM mesh_vertices) q) w",
        "mesh_vertices",
    ),
)
def mesh_reorient(spark, d):
    axis = lambda c: F.element_at(F.array(*map(F.lit, AXES)), (c + 1).cast("int"))
    rows = fixture(spark, d, "mesh_vertices").withColumns({"size": F.array("x", "y", "z"), "offset": F.array("x", "y", "z")})
    out = mesh.mesh_reorient(rows, axis(F.col("vid") % 6), axis(F.floor(F.col("vid") / 6) % 6))
    return out.select("vid", F.col("size")[0].alias("size_x"), F.col("size")[1].alias("size_y"), F.col("offset")[2].alias("offset_z"))


@query("first_valid_vec3", over("SELECT vid, CASE WHEN vid % 3 = 0 THEN x WHEN vid % 3 = 1 THEN 7.5 END AS first FROM mesh_vertices", "mesh_vertices"))
def first_valid_vec3(spark, d):
    good = F.to_json(F.array("x", "y", "z"))
    a = F.when(F.col("vid") % 3 == 0, good).when(F.col("vid") % 3 == 1, F.lit('[1, "wide", 3]'))
    b = F.when(F.col("vid") % 3 == 2, F.lit("[1, 2]")).otherwise(F.lit("[7.5, 8, 9]"))
    return fixture(spark, d, "mesh_vertices").select("vid", mesh.first_valid_vec3(a, b)[0].alias("first"))


@query("survey_kind", over("SELECT survey_id, CASE WHEN bool_or(coalesce(json_extract(CASE WHEN json_valid(exif) THEN exif END, '$.opk') IS NOT NULL, false)) THEN 'AERIAL' ELSE 'HANDHELD' END AS kind FROM survey_images GROUP BY survey_id", "survey_images"))
def survey_kind(spark, d):
    return survey.survey_kind(fixture(spark, d, "survey_images")).select("survey_id", "kind")


@query("image_max_res", over("SELECT survey_id, coalesce(max(width) FILTER (ok), 1920) AS width, coalesce(max(height) FILTER (ok), 1080) AS height FROM (SELECT *, lower(regexp_extract(name, '\\.([^.]*)$', 1)) IN ('jpg', 'jpeg', 'png', 'tif', 'tiff') AS ok FROM survey_images) q GROUP BY survey_id", "survey_images"))
def image_max_res(spark, d):
    return survey.image_max_res(fixture(spark, d, "survey_images"))


@query("shot_camera", over("SELECT shot_id, camera_id, focal_x, coalesce(k1, 0.0) AS k1, k2, 0.0::DOUBLE AS c_x FROM shots JOIN cameras USING (camera_id)", "shots", "cameras"))
def shot_camera(spark, d):
    return survey.shot_camera(fixture(spark, d, "shots"), fixture(spark, d, "cameras")).select("shot_id", "camera_id", "focal_x", "k1", "k2", "c_x")


CORNERS = [(x, y, z) for x in (-10.0, 10.0) for y in (-8.0, 8.0) for z in (0.0, 5.0)]
_CORNERS = "(VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for i, (x, y, z) in enumerate(CORNERS)) + ") c(corner, x, y, z)"
_ROTATED = f"SELECT *, kx * x + ky * y + kz * z AS dot, ky * z - kz * y AS c0, kz * x - kx * z AS c1, kx * y - ky * x AS c2 FROM (SELECT *, CASE WHEN th = 0 THEN 0 ELSE rx / th END AS kx, CASE WHEN th = 0 THEN 0 ELSE ry / th END AS ky, CASE WHEN th = 0 THEN 0 ELSE rz / th END AS kz FROM (SELECT s.*, m.focal_x, m.focal_y, coalesce(m.k1, 0.0) AS k1, m.k2, c.*, sqrt(rx * rx + ry * ry + rz * rz) AS th FROM shots s JOIN cameras m USING (camera_id) CROSS JOIN {_CORNERS}) q) r"
_PROJECTED = f"SELECT shot_id, corner, focal_x * a * (1 + q * (k1 + q * k2)) * 1600 + 800 AS u, focal_y * b * (1 + q * (k1 + q * k2)) * 1600 + 600 AS v FROM (SELECT *, a * a + b * b AS q FROM (SELECT *, px / pz AS a, py / pz AS b FROM (SELECT *, x * cos(th) + c0 * sin(th) + kx * dot * (1 - cos(th)) + tx AS px, y * cos(th) + c1 * sin(th) + ky * dot * (1 - cos(th)) + ty AS py, z * cos(th) + c2 * sin(th) + kz * dot * (1 - cos(th)) + tz AS pz FROM ({_ROTATED}) t) w) o) p"


def _projected(spark, d):
    return survey.project_corners(survey.shot_camera(fixture(spark, d, "shots"), fixture(spark, d, "cameras")), CORNERS)


@query("project_corners", over(f"SELECT shot_id, corner, round(u, 5) AS u, round(v, 5) AS v FROM ({_PROJECTED}) p", "shots", "cameras"))
def project_corners(spark, d):
    return _projected(spark, d).select("shot_id", "corner", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


#: A side of the hull has all other corners on its left.
_HULL = f"WITH pr AS ({_PROJECTED}) SELECT p.shot_id, count(*) AS corners, round(sum(p.u * q.v - q.u * p.v) / 2, 3) AS area FROM pr p JOIN pr q USING (shot_id) WHERE p.corner <> q.corner AND NOT EXISTS (SELECT 1 FROM pr r WHERE r.shot_id = p.shot_id AND r.corner <> p.corner AND r.corner <> q.corner AND (q.u - p.u) * (r.v - p.v) - (q.v - p.v) * (r.u - p.u) < 0) GROUP BY p.shot_id"


@query("mask_hull", over(_HULL.replace("WITH pr AS", ", pr AS", 1), "shots", "cameras"))
def mask_hull(spark, d):
    return survey.mask_hull(_projected(spark, d)).select("shot_id", F.size("hull").cast("long").alias("corners"), F.round("area", 3).alias("area"))
