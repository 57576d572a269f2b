"""Queries over the catalog: listings, joins, statuses, routing, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from geojobs.operators import catalog
from geojobs.plans.fixtures import fixture, over
from geojobs.plans.registry import query

_EXT = "CASE WHEN extension IN ({}) THEN extension END".format(", ".join(f"'{e}'" for e in catalog.EXTENSION_JOBS))
_MODELS = "SELECT gid, concat(lower(c_mktsegment), '.glb') AS model FROM feat_point"


def _models(spark, d):
    return fixture(spark, d, "feat_point").select("gid", F.concat(F.lower("c_mktsegment"), F.lit(".glb")).alias("model"))


def _members(spark, d):
    """Archives of the fixture as uploads: a file name and the names inside."""
    rows = fixture(spark, d, "archive_members").groupBy("archive_id").agg(F.array_sort(F.collect_list("path")).alias("members"))
    return rows.withColumn("filename", F.when(F.col("archive_id") % 7 == 0, "cloud.LAS").when(F.col("archive_id") % 7 == 1, "a.v1.las").when(F.col("archive_id") % 7 == 2, "scan.las").otherwise("upload.zip"))


@query("list_assets", over("SELECT id, owner_id, filename, extension, upload_status FROM assets WHERE owner_id = 2 AND extension IN ('.shp.zip', '.las', '.glb') AND upload_status IN ('PENDING', 'SUCCESS') ORDER BY filename, id LIMIT 100 OFFSET 2", "assets"))
def list_assets(spark, d):
    found = catalog.list_assets(fixture(spark, d, "assets"), owner=2, extensions=[".shp.zip", ".las", ".glb"], statuses=["PENDING", "SUCCESS"], skip=2, limit=100)
    return found.select("id", "owner_id", "filename", "extension", "upload_status")


@query("catalog_count", over("SELECT count(*) AS count FROM assets WHERE owner_id = 3 AND extension IN ('.shp.zip', '.las')", "assets"))
def catalog_count(spark, d):
    return catalog.count_assets(fixture(spark, d, "assets"), owner=3, extensions=[".shp.zip", ".las"])


@query("list_pipelines", over("SELECT id, title, owner_id, task_status FROM pipelines WHERE owner_id = 4 ORDER BY title, id LIMIT 100 OFFSET 5", "pipelines"))
def list_pipelines(spark, d):
    return catalog.list_pipelines(fixture(spark, d, "pipelines"), owner=4, skip=5).select("id", "title", "owner_id", "task_status")


@query("pipeline_asset", over("SELECT p.id, p.asset_id, p.owner_id, a.filename, a.asset_type, a.geometry_type FROM pipelines p JOIN assets a ON p.asset_id = a.id WHERE p.owner_id = 2 AND a.owner_id = 2", "pipelines", "assets"))
def pipeline_asset(spark, d):
    return catalog.pipeline_asset(fixture(spark, d, "pipelines"), fixture(spark, d, "assets"), owner=2).select("id", "asset_id", "owner_id", "filename", "asset_type", "geometry_type")


@query("pipeline_asset_missing", over("SELECT id, asset_id FROM pipelines p WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.id = p.asset_id)", "pipelines", "assets"))
def pipeline_asset_missing(spark, d):
    return catalog.without_asset(fixture(spark, d, "pipelines"), fixture(spark, d, "assets")).select("id", "asset_id")


@query("model_assets", over(f"SELECT m.model, min(a.id) AS asset_id FROM (SELECT DISTINCT model FROM ({_MODELS}) x) m LEFT JOIN assets a ON a.filename = m.model GROUP BY m.model", "feat_point", "assets"))
def model_assets(spark, d):
    return catalog.model_assets(_models(spark, d), fixture(spark, d, "assets"))


@query("models_distinct", over(f"SELECT model, min(gid) AS first_gid FROM ({_MODELS}) x GROUP BY model", "feat_point"))
def models_distinct(spark, d):
    return catalog.models_distinct(_models(spark, d))


@query("color_image_lookup", over("SELECT p.id, p.image, a.asset_id FROM (SELECT id, json_extract_string(data, '$.colorization_image') AS image FROM pipelines) p LEFT JOIN (SELECT filename, min(id) AS asset_id FROM assets GROUP BY filename) a ON a.filename = p.image WHERE p.image IS NOT NULL", "pipelines", "assets"))
def color_image_lookup(spark, d):
    return catalog.color_image_lookup(fixture(spark, d, "pipelines"), fixture(spark, d, "assets"))


@query("upload_dedupe", over("SELECT id, owner_id, filename FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, filename ORDER BY id) AS n FROM assets WHERE id % 3 = 0) u WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM assets a WHERE a.id % 3 <> 0 AND a.owner_id = u.owner_id AND a.filename = u.filename)", "assets"))
def upload_dedupe(spark, d):
    a = fixture(spark, d, "assets")
    return catalog.upload_dedupe(a.where("id % 3 = 0"), a.where("id % 3 != 0")).select("id", "owner_id", "filename")


@query("asset_delete", over("SELECT id, title, CASE WHEN asset_id IN (SELECT id FROM assets WHERE owner_id = 6) THEN NULL ELSE asset_id END AS asset_id FROM pipelines", "pipelines", "assets"))
def asset_delete(spark, d):
    return catalog.asset_delete(fixture(spark, d, "pipelines"), fixture(spark, d, "assets").where("owner_id = 6").select("id")).select("id", "title", "asset_id")


@query("pick_obj", over("SELECT archive_id, arg_min(path, (len(string_split(path, '/')), path)) AS path FROM archive_members WHERE lower(path) LIKE '%.obj' AND path NOT LIKE '%__MACOSX%' AND string_split(path, '/')[-1] NOT LIKE '.%' GROUP BY archive_id", "archive_members"))
def pick_obj(spark, d):
    return catalog.pick_obj(fixture(spark, d, "archive_members"))


@query(
    "ext_classify",
    over(
        r"""
SELECT archive_id, CASE WHEN archive_id % 7 = 2 THEN '.las' WHEN archive_id % 7 < 2 THEN NULL
  WHEN bool_or(s = '.shp') THEN '.shp.zip' WHEN bool_or(s = '.obj') THEN '.obj.zip' WHEN bool_and(s IN ('.jpg', '.json', '.jpg.png', '.png', '')) THEN '.phg.zip' END AS extension
FROM (SELECT archive_id, lower(regexp_extract(regexp_replace(string_split(regexp_replace(path, '/+$', ''), '/')[-1], '^\.+', ''), '^[^.]*(\..*)$', 1)) AS s FROM archive_members) x GROUP BY archive_id
""",
        "archive_members",
    ),
)
def ext_classify(spark, d):
    return _members(spark, d).select("archive_id", catalog.ext_classify(F.col("filename"), F.col("members")).alias("extension"))


_JOBS = " ".join(f"WHEN '{e}' THEN '{j}'" for e, j in catalog.EXTENSION_JOBS.items())
_QUEUES = " ".join(f"WHEN '{e}' THEN '{catalog.JOB_QUEUES[j]}'" for e, j in catalog.EXTENSION_JOBS.items())


@query("route_inspect", over(f"SELECT id, extension, CASE extension {_JOBS} END AS job, CASE extension {_QUEUES} END AS queue FROM assets", "assets"))
def route_inspect(spark, d):
    return catalog.route_inspect(fixture(spark, d, "assets")).select("id", "extension", "job", "queue")


@query("route_pipeline", over("SELECT id, CASE WHEN asset_type = 'Mesh' THEN 'obj' WHEN geometry_type = 'Polygon' THEN 'polygon' WHEN geometry_type = 'Point' THEN 'point' WHEN geometry_type = 'PointCloud' THEN 'pointcloud' WHEN asset_type = 'Photogrammetry' THEN 'photogrammetry' END AS job FROM assets", "assets"))
def route_pipeline(spark, d):
    return fixture(spark, d, "assets").select("id", catalog.route_pipeline(F.col("asset_type"), F.col("geometry_type")).alias("job"))


@query(
    "status_label",
    over("SELECT id, CASE WHEN upload_status IN ('PENDING', 'STARTED') THEN 'PENDING' ELSE coalesce(upload_status, 'READY') END AS label, CASE WHEN upload_status IN ('PENDING', 'STARTED') THEN 'yellow' WHEN upload_status = 'SUCCESS' THEN 'green' WHEN upload_status IS NULL THEN 'blue' ELSE 'red' END AS color FROM assets", "assets"),
)
def status_label(spark, d):
    label, color = catalog.status_label(F.col("upload_status"))
    return fixture(spark, d, "assets").select("id", label.alias("label"), color.alias("color"))


_DEFAULTS = ", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in catalog.DEFAULTS["Point"].items())


@query(
    "cfg_defaults",
    over(
        f"""
SELECT p.id, d.key, CASE WHEN json_exists(p.data, '$.' || d.key) THEN json_extract_string(p.data, '$.' || d.key) ELSE d.value END AS value
FROM pipelines p CROSS JOIN (VALUES {_DEFAULTS}) d(key, value)
UNION ALL
SELECT p.id, k.key, json_extract_string(p.data, '$.' || k.key) FROM pipelines p CROSS JOIN (VALUES ('colorization_image'), ('sample_radius')) k(key) WHERE json_exists(p.data, '$.' || k.key)
""",
        "pipelines",
    ),
)
def cfg_defaults(spark, d):
    return catalog.cfg_defaults(fixture(spark, d, "pipelines"), "Point")


@query(
    "latest_status",
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
def latest_status(spark, d):
    return catalog.latest_status(fixture(spark, d, "task_events"))


@query("tileset_catalog", over("SELECT id, title, 'https://host' || json_extract_string(task_result, '$.tileset') AS url, '3dtiles' AS type, false AS autoload FROM pipelines WHERE task_status = 'SUCCESS' AND json_extract_string(task_result, '$.tileset') IS NOT NULL", "pipelines"))
def tileset_catalog(spark, d):
    return catalog.tileset_catalog(fixture(spark, d, "pipelines"), "https://host")


@query(
    "layer_validate",
    over(
        """
SELECT asset_id, CASE WHEN reason IS NULL THEN word END AS geometry_type, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, reason
FROM (SELECT *, CASE WHEN layer_count > 1 THEN 'multiple layers' WHEN geom_fields > 1 THEN 'multiple geometry fields' WHEN geometry_type LIKE '%Multi%' THEN 'multi geometry' WHEN NOT has_srs THEN 'missing reference system' WHEN word IS NULL THEN 'unsupported geometry' END AS reason
  FROM (SELECT *, CASE WHEN geometry_type LIKE '%Point%' THEN 'Point' WHEN geometry_type LIKE '%Polygon%' THEN 'Polygon' END AS word FROM layers) x) y
""",
        "layers",
    ),
)
def layer_validate(spark, d):
    return catalog.layer_validate(fixture(spark, d, "layers"))


@query(
    "crs_codes",
    over(
        r"""
, codes AS (SELECT asset_id,
  coalesce(TRY_CAST(regexp_extract_all(horizontal, '(?i)AUTHORITY\["EPSG","(\d+)"\]', 1)[-1] AS INTEGER), CASE WHEN srs_json IS NOT NULL THEN 32633 END) AS h,
  coalesce(TRY_CAST(regexp_extract_all(vertical, '(?i)AUTHORITY\["EPSG","(\d+)"\]', 1)[-1] AS INTEGER), CASE WHEN srs_json IS NOT NULL THEN 5773 END) AS v,
  TRY_CAST(regexp_extract_all(comp, '(?i)AUTHORITY\["EPSG","(\d+)"\]', 1)[-1] AS INTEGER) AS c FROM crs_meta)
SELECT asset_id, h AS horizontal, v AS vertical, CASE WHEN c IS NULL OR c = v THEN h ELSE c END AS epsg FROM codes
""",
        "crs_meta",
    ),
)
def crs_codes(spark, d):
    return catalog.crs_codes(fixture(spark, d, "crs_meta"))


@query("lim_sample", over("SELECT gid, c_name, x, y, z FROM feat_point ORDER BY gid LIMIT (SELECT CAST(round_even(count(*) * 1000.0 / 1750.0, 0) AS BIGINT) FROM feat_point)", "feat_point"))
def lim_sample(spark, d):
    points = fixture(spark, d, "feat_point")
    return catalog.lim_sample(points, "gid", 1750.0, points.count()).select("gid", "c_name", "x", "y", "z")


@query("table_name", over("SELECT id, 'pipeline_' || replace('0000-' || id || '-ab', '-', '_') AS name FROM pipelines", "pipelines"))
def table_name(spark, d):
    uuid = F.concat(F.lit("0000-"), F.col("id").cast("string"), F.lit("-ab"))
    return fixture(spark, d, "pipelines").select("id", catalog.table_name("pipeline", uuid).alias("name"))


@query("src_catalog", over("SELECT id, title, json_extract_string(data, '$.colorization_image') AS colorization_image, CAST(json_extract_string(data, '$.sample_radius') AS DOUBLE) AS sample_radius, json_extract_string(task_result, '$.tileset') AS tileset FROM pipelines", "pipelines"))
def src_catalog(spark, d):
    from geojobs.sources.catalog import parse_pipelines

    return parse_pipelines(fixture(spark, d, "pipelines")).select("id", "title", "colorization_image", "sample_radius", "tileset")
