"""Queries over sources, sinks and streams: derived tables are written to the shared folder and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from geojobs.operators import mesh
from geojobs.operators.storage import open_store, settle, shared_dir as folder
from geojobs.plans.fixtures import fixture, over
from geojobs.plans.registry import query
from geojobs.plans.shapes import POSITIONS, polygons
from geojobs.sources import files, las, shapefile, sinks
from geojobs.streaming import jobs as streams


@query("src_geojson", over(POSITIONS + "SELECT p.gid, p.p_name, CAST(p.p_size AS BIGINT) AS p_size, count(*) AS positions, round(sum(q.z), 6) AS z FROM poly_params p JOIN positions q USING (gid) GROUP BY ALL", "poly_params"))
def src_geojson(spark, d):
    df = polygons(spark, d)
    path = folder(spark)
    geometry = F.struct(F.col("geom.type").alias("type"), F.col("geom.rings").alias("coordinates"))
    names = ["gid", "p_name", "p_size"]
    sinks.write_geojson(df.where("gid % 2 = 0"), names, geometry, path)
    # The others as collections of five hundred features, a file each, read by ranges of 32 kB.
    odd = sinks.geojson_features(df.where("gid % 2 = 1"), names, geometry)
    odd = odd.groupBy(F.floor(F.get_json_object("value", "$.properties.gid").cast("long") / 1000)).agg(F.array_join(F.collect_list("value"), ",\n").alias("all"))
    odd.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "all", F.lit("]}")).alias("value")).write.mode("append").option("maxRecordsPerFile", 1).text(path)
    back = files.read_geojson(spark, path, "gid long, p_name string, p_size int", range_bytes=1 << 15).toDF("feature", "gid", "p_name", "p_size", "geom")
    z = F.aggregate(F.flatten("geom.rings"), F.lit(0.0), lambda s, p: s + p[2])
    return back.select("gid", "p_name", F.col("p_size").cast("long").alias("p_size"), F.size(F.flatten("geom.rings")).cast("long").alias("positions"), F.round(z, 6).alias("z"))


@query("snk_geojson", over("SELECT gid, 'Feature' AS kind, c_name, 'Point' AS type, x FROM feat_point", "feat_point"))
def snk_geojson(spark, d):
    lines = sinks.geojson_features(fixture(spark, d, "feat_point"), ["gid", "c_name"], F.struct(F.lit("Point").alias("type"), F.array("x", "y", "z").alias("coordinates")))
    read = lambda p: F.get_json_object("value", p)
    return lines.select(read("$.properties.gid").cast("long").alias("gid"), read("$.type").alias("kind"), read("$.properties.c_name").alias("c_name"), read("$.geometry.type").alias("type"), read("$.geometry.coordinates[0]").cast("double").alias("x"))


@query("src_xyz", over("SELECT x, y, z, 0.0::DOUBLE AS nx, 1.0::DOUBLE AS nz FROM cloud_points", "cloud_points"))
def src_xyz(spark, d):
    path = folder(spark)
    rows = fixture(spark, d, "cloud_points").select("x", "y", "z", F.lit(0.0).alias("NormalX"), F.lit(0.0).alias("NormalY"), F.lit(1.0).alias("NormalZ"))
    rows.write.option("header", True).csv(path)
    return files.read_xyz(spark, path).select("x", "y", "z", "nx", "nz")


@query("snk_csv_points", over("SELECT x AS X, y AS Y, z AS Z, red AS Red, green AS Green, blue AS Blue FROM cloud_points", "cloud_points"))
def snk_csv_points(spark, d):
    path = folder(spark)
    sinks.write_csv_points(fixture(spark, d, "cloud_points"), path)
    return spark.read.csv(path, header=True, schema="X double, Y double, Z double, Red bigint, Green bigint, Blue bigint")


_OBJ = "SELECT line_no, TRY_CAST(string_split(value, ' ')[2] AS DOUBLE) AS x, TRY_CAST(string_split(value, ' ')[3] AS DOUBLE) AS y, TRY_CAST(string_split(value, ' ')[4] AS DOUBLE) AS z FROM obj_lines WHERE value LIKE 'v %' AND len(string_split(value, ' ')) >= 4"


@query("src_obj", over(f"SELECT row_number() OVER (ORDER BY line_no) AS vid, x, y, z FROM ({_OBJ}) o WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL", "obj_lines"))
def src_obj(spark, d):
    """The lines as the parts of a file, written in their order and read back by path."""
    path = folder(spark)
    fixture(spark, d, "obj_lines").repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return files.read_obj(spark, path)[0]


@query("obj_bbox", over(f"SELECT max(x) - min(x) AS size_x, max(y) - min(y) AS size_y, max(z) - min(z) AS size_z, (max(x) + min(x)) / 2 AS offset_x, (max(y) + min(y)) / 2 AS offset_y, (max(z) + min(z)) / 2 AS offset_z FROM ({_OBJ}) o WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL", "obj_lines"))
def obj_bbox(spark, d):
    return mesh.obj_bbox(files.obj_vertices(fixture(spark, d, "obj_lines")))


@query("src_ply", over("SELECT pid, x, y, z FROM cloud_points", "cloud_points"))
def src_ply(spark, d):
    path = folder(spark)
    rows = fixture(spark, d, "cloud_points").select("pid", "x", "y", "z")
    head = ["ply", "format ascii 1.0", f"element vertex {rows.count()}", "property double x", "property double y", "property double z", "end_header"]
    lines = spark.createDataFrame([(-len(head) + i, h) for i, h in enumerate(head)], "n long, value string").unionByName(rows.select(F.col("pid").alias("n"), F.concat_ws(" ", "x", "y", "z").alias("value")))
    lines.repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(path)  # parts of one file, in order
    return files.read_ply(spark, path)


@query("src_survey_json", over("SELECT 'cam' || camera_id AS camera_id, focal_x, k2, count(*) AS shots, round(sum(rx), 9) AS rx FROM shots JOIN cameras USING (camera_id) GROUP BY ALL", "shots", "cameras"))
def src_survey_json(spark, d):
    """A document for every hundred shots, with the cameras that took them, each a file of its own."""
    path = folder(spark)
    cameras = fixture(spark, d, "cameras")
    shots = fixture(spark, d, "shots").withColumn("doc", F.floor(F.col("shot_id") / 100)).join(cameras.select("camera_id", F.struct("focal_x", "focal_y", "k1", "k2").alias("c")), "camera_id")
    name = lambda kind, c: F.concat(F.lit(kind), c)
    camera = F.map_from_entries(F.collect_set(F.struct(name("cam", F.col("camera_id")), "c"))).alias("cameras")
    shot = F.struct(name("cam", F.col("camera_id")).alias("camera"), F.array("rx", "ry", "rz").alias("rotation"), F.array("tx", "ty", "tz").alias("translation"))
    docs = shots.groupBy("doc").agg(camera, F.map_from_entries(F.collect_list(F.struct(name("s", F.col("shot_id")), shot))).alias("shots"))
    docs.select(F.to_json(F.array(F.struct("cameras", "shots"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    cameras, shots = files.read_survey(spark, path)
    return shots.join(cameras, ["file", "camera_id"]).groupBy("camera_id", "focal_x", "k2").agg(F.count(F.lit(1)).alias("shots"), F.round(F.sum(F.col("rotation")[0]), 9).alias("rx"))


@query("src_las", over("SELECT pid, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, red, green, blue, intensity FROM cloud_points", "cloud_points"))
def src_las(spark, d):
    """Each task writes its points as LAS files; the folder is read back by ranges of records, in the order of pid."""
    path = folder(spark)

    def write(batches):
        from pyspark import TaskContext

        for k, pdf in enumerate(batches):
            if len(pdf):
                # Names sort as the partitions do; a task that runs again replaces its files.
                las.write(f"{path}/{TaskContext.get().partitionId():06d}-{k:06d}.las", pdf)
                yield pd.DataFrame({"n": [len(pdf)]})

    rows = fixture(spark, d, "cloud_points")
    settle(rows.repartitionByRange("pid").sortWithinPartitions("pid").mapInPandas(write, "n long"))
    out = files.read_las(spark, path, 1000)
    return out.select("pid", *[F.round(c, 3).alias(c) for c in "xyz"], *[F.col(c).cast("long").alias(c) for c in ("red", "green", "blue", "intensity")])


@query("snk_tiles", over("SELECT pid, CAST(pid % 4 AS INTEGER) AS level, CAST(floor(x / 50) AS BIGINT) AS tx FROM cloud_points", "cloud_points"))
def snk_tiles(spark, d):
    path = folder(spark)
    rows = fixture(spark, d, "cloud_points").select("pid", (F.col("pid") % 4).cast("int").alias("level"), F.array(F.floor(F.col("x") / 50)).alias("tile"))
    for _ in range(2):  # a second run replaces the first
        sinks.write_tiles(rows, spark.createDataFrame([("{}",)], "value string"), path)
    return sinks.read_tiles(spark, path).select("pid", "level", F.col("tile")[0].alias("tx"))


@query(
    "stream_status",
    over(
        """
SELECT s.task_id, s.status, s.ts, r.result
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS n FROM task_events) s
LEFT JOIN (SELECT task_id, result, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS n FROM task_events WHERE status = 'SUCCESS') r ON r.task_id IS NOT DISTINCT FROM s.task_id AND r.n = 1
WHERE s.n = 1
""",
        "task_events",
    ),
)
def stream_status(spark, d):
    """The event table as three arrivals, late ones among them, merged batch by batch."""
    source, checkpoint, target = folder(spark), folder(spark), folder(spark)
    events = fixture(spark, d, "task_events").select("task_id", "status", "ts", "event_id", "result")
    kinds = dict(c.split() for c in streams.STATUS.split(", "))
    events = events.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    for part in (2, 0, 1):
        events.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(source)
        streams.status(spark, source, checkpoint, target).awaitTermination()
    return streams.current(spark, checkpoint)


_ARRIVED = """
SELECT 'o' || (gid // 500) || '.obj' AS name, '.obj' AS extension, 'inspect_mesh' AS job, count(*) + 2 AS lines, count(*) AS points, min(lon0) AS min_x, max(lat0) AS max_y, max(z0) AS max_z FROM poly_params GROUP BY ALL
UNION ALL SELECT 'l' || (pid // 4000) || '.las', '.las', 'inspect_pointcloud', NULL, count(*), min(x), max(y), max(z) FROM cloud_points GROUP BY ALL
UNION ALL SELECT 't' || (gid // 500) || '.dat', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM poly_params GROUP BY ALL
"""


def _deliver(folder_: str):
    """Writes a group's rows as a file of the group's kind: OBJ, LAS, or of a kind that nothing reads."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["name"].iloc[0]
        if name.endswith(".las"):
            las.write(f"{folder_}/{name}", pdf.assign(intensity=0, classification=0, red=0, green=0, blue=0))
        else:
            lines = ["# vertices", *(f"v {x!r} {y!r}  {z!r}" for x, y, z in zip(*(pdf[c].tolist() for c in "xyz"))), "v 1 2"]
            system, place = open_store(f"{folder_}/{name}")
            system.create_dir(place.rpartition("/")[0], recursive=True)
            with system.open_output_stream(place) as out:
                out.write("\n".join(lines).encode())
        return pd.DataFrame({"n": [len(pdf)]})

    return run


@query("stream_ingest", over(_ARRIVED, "poly_params", "cloud_points"))
def stream_ingest(spark, d):
    """Files of bounded runs of rows, which arrive in two lots: OBJ files, LAS files, and ones of an unknown kind."""
    source, checkpoint, sink = folder(spark), folder(spark), folder(spark)
    name = lambda kind, key, each, suffix: F.concat(F.lit(kind), F.floor(F.col(key) / each).cast("string"), F.lit(suffix)).alias("name")
    place = [F.col(o).alias(c) for o, c in zip(("lon0", "lat0", "z0"), "xyz")]
    shapes = fixture(spark, d, "poly_params")
    rows = shapes.select(name("o", "gid", 500, ".obj"), *place).unionByName(shapes.select(name("t", "gid", 500, ".dat"), *place))
    rows = settle(rows.unionByName(fixture(spark, d, "cloud_points").select(name("l", "pid", 4000, ".las"), "x", "y", "z")))
    for lot in (0, 1):
        settle(rows.where(F.crc32(F.col("name").cast("binary")) % 2 == lot).groupBy("name").applyInPandas(_deliver(source), "n long"))
        streams.ingest(spark, source, checkpoint, sink).awaitTermination()
    out = spark.read.parquet(sink)
    return out.select(F.element_at(F.split("path", "/"), -1).alias("name"), "extension", "job", "lines", "points", "min_x", "max_y", "max_z")


@query("src_shapefile", over(POSITIONS + "SELECT p.p_name AS name, 'Polygon' AS type, count(DISTINCT q.ring) AS rings, count(*) AS positions, round(sum(q.z), 6) AS z FROM poly_params p JOIN positions q USING (gid) GROUP BY p.gid, p.p_name", "poly_params"))
def src_shapefile(spark, d):
    """Each task writes its features as layers of an Arrow batch each; the layers are read back by ranges of records."""
    path = folder(spark)

    def write(batches):
        from pyspark import TaskContext

        for k, pdf in enumerate(batches):
            if len(pdf):
                name = f"{path}/{TaskContext.get().partitionId():06d}-{k:06d}"
                shapefile.write(name, [({"name": n}, "Polygon", r) for n, r in zip(pdf["name"], pdf["rings"])], ["name"])
                yield pd.DataFrame({"n": [len(pdf)]})

    rows = polygons(spark, d).select("gid", F.col("p_name").alias("name"), F.col("geom.rings").alias("rings"))
    settle(rows.repartitionByRange("gid").mapInPandas(write, "n long"))
    back = files.read_shapefiles(spark, path, ["name"], records=100)
    z = F.aggregate(F.flatten("geom.rings"), F.lit(0.0), lambda s, p: s + p[2])
    return back.select("name", "geom.type", F.size("geom.rings").cast("long").alias("rings"), F.size(F.flatten("geom.rings")).cast("long").alias("positions"), F.round(z, 6).alias("z"))
