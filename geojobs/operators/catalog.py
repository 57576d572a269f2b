"""Assets, pipelines, task statuses and uploads as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Supported extensions by the job that inspects them.
EXTENSION_JOBS = {
    ".shp.zip": "inspect_vector",
    ".tiff": "inspect_raster",
    ".tif": "inspect_raster",
    ".laz": "inspect_pointcloud",
    ".las": "inspect_pointcloud",
    ".obj": "inspect_mesh",
    ".obj.zip": "inspect_mesh",
    ".phg.zip": "inspect_photogrammetry",
    ".glb": "inspect_glb",
}
#: The queue of every inspection job.
JOB_QUEUES = {
    "inspect_vector": "vector",
    "inspect_pointcloud": "point-cloud",
    "inspect_raster": "vector",
    "inspect_photogrammetry": "photogrammetry",
    "inspect_glb": "common",
    "inspect_mesh": "mesh",
}
#: Suffixes that a photo archive may hold.
PHOTO_TYPES = [".jpg", ".json", ".jpg.png", ".png", ""]
#: What a pipeline starts from unless its own configuration says otherwise (None: unset).
DEFAULTS = {
    "Polygon": {
        "lower_limit_height": None, "upper_limit_height": None, "translate_z": "0", "max_features_per_tile": "1000", "double_sided": "false", "geometric_error_factor": "1",
        "max_geometric_error": "500", "remove_bottom_surface": "true", "add_lod": "false", "lod_max_simplify_tolerance": "5", "add_outline": "false",
    },
    "Point": {"model": "model.glb", "rotation": "0", "scale": "1", "translate_z": "0", "max_features_per_tile": "5000", "max_geometric_error": "1000"},
    "PointCloud": {"colorization_image": "", "sample_radius": None, "to_ellipsoidal_height": "false", "ground_classification": "false", "geometric_error_scale_factor": "1"},
    "Mesh": {
        "latitude": "0", "longitude": "0", "altitude": "0", "depth": "4", "tile_faces_target": "10000", "texture_image_size": "512", "max_geometric_error": "256",
        "decimate_last_depth_level": "false", "forward_axis": "Y", "up_axis": "Z",
    },
}


def _listed(df: DataFrame, sort: str, skip: int, limit: int) -> DataFrame:
    return df.orderBy(F.col(sort).asc(), F.col("id").asc()).offset(skip).limit(limit)


def _assets(assets: DataFrame, owner: int | None, extensions: list[str] | None) -> DataFrame:
    if owner is not None:
        assets = assets.where(F.col("owner_id") == owner)
    return assets.where(F.col("extension").isin(extensions)) if extensions else assets


def list_assets(assets: DataFrame, owner: int | None = None, extensions: list[str] | None = None, statuses: list[str] | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of a listing by file name. Ties are broken by id."""
    found = _assets(assets, owner, extensions)
    return _listed(found.where(F.col("upload_status").isin(statuses)) if statuses else found, "filename", skip, limit)


def count_assets(assets: DataFrame, owner: int | None = None, extensions: list[str] | None = None) -> DataFrame:
    """The total beside a listing; the upload status doesn't narrow it."""
    return _assets(assets, owner, extensions).agg(F.count(F.lit(1)).alias("count"))


def list_pipelines(pipelines: DataFrame, owner: int | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    return _listed(pipelines.where(F.col("owner_id") == owner) if owner is not None else pipelines, "title", skip, limit)


def pipeline_asset(pipelines: DataFrame, assets: DataFrame, owner: int | None = None) -> DataFrame:
    """Pipelines with their assets; for an owner, only where both are theirs."""
    a = assets.select(F.col("id").alias("asset_id"), F.col("owner_id").alias("asset_owner_id"), "filename", "extension", "asset_type", "geometry_type")
    joined = pipelines.join(a, "asset_id", "inner")
    return joined if owner is None else joined.where((F.col("owner_id") == owner) & (F.col("asset_owner_id") == owner))


def without_asset(pipelines: DataFrame, assets: DataFrame) -> DataFrame:
    """Pipelines whose asset isn't there."""
    return pipelines.join(assets.select(F.col("id").alias("asset_id")), "asset_id", "left_anti")


def _first_by_filename(assets: DataFrame) -> DataFrame:
    return assets.groupBy("filename").agg(F.min("id").alias("asset_id"))


def model_assets(instances: DataFrame, assets: DataFrame) -> DataFrame:
    """Every model that occurs with the first asset of that file name, null if there is none."""
    models = instances.select("model").distinct()
    first = _first_by_filename(assets).withColumnRenamed("filename", "model")
    return models.join(first, "model", "left")


def models_distinct(instances: DataFrame) -> DataFrame:
    """Models in the order in which they are first seen."""
    return instances.groupBy("model").agg(F.min("gid").alias("first_gid")).orderBy("first_gid")


def color_image_lookup(pipelines: DataFrame, assets: DataFrame) -> DataFrame:
    image = F.get_json_object("data", "$.colorization_image")
    rows = pipelines.select("id", image.alias("filename")).where(F.col("filename").isNotNull())
    return rows.join(_first_by_filename(assets), "filename", "left").select("id", F.col("filename").alias("image"), "asset_id")


def upload_dedupe(uploads: DataFrame, assets: DataFrame) -> DataFrame:
    """New uploads whose (owner, file name) is neither stored nor earlier in the batch."""
    first = Window.partitionBy("owner_id", "filename").orderBy("id")
    fresh = uploads.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return fresh.join(assets.select("owner_id", "filename"), ["owner_id", "filename"], "left_anti")


def asset_delete(pipelines: DataFrame, deleted: DataFrame) -> DataFrame:
    """Pipelines after assets are deleted: their asset_id becomes null."""
    gone = deleted.select(F.col("id").alias("asset_id"), F.lit(True).alias("_gone")).distinct()
    return pipelines.join(gone, "asset_id", "left").withColumn("asset_id", F.when(F.col("_gone").isNull(), F.col("asset_id"))).drop("_gone")


def pick_obj(members: DataFrame) -> DataFrame:
    """The OBJ file of each archive: fewest directories, then path; no resource forks or hidden files."""
    name = F.element_at(F.split("path", "/"), -1)
    usable = F.lower("path").endswith(".obj") & ~F.col("path").contains("__MACOSX") & ~name.startswith(".")
    depth = F.size(F.split("path", "/"))
    return members.where(usable).groupBy("archive_id").agg(F.min_by("path", F.struct(depth, F.col("path"))).alias("path"))


def suffixes(name: Column) -> Column:
    """All suffixes of a file name, joined; a leading full stop begins none."""
    base = F.element_at(F.split(F.regexp_replace(name, "/+$", ""), "/"), -1)
    return F.lower(F.regexp_extract(F.regexp_replace(base, r"^\.+", ""), r"^[^.]*(\..*)$", 1))


def ext_classify(filename: Column, members: Column | None = None) -> Column:
    """Extension under which an upload is handled; null if it is rejected.

    A ``.zip`` is told by its members: a shapefile, else an OBJ, else nothing but photo files.
    """
    ext = F.regexp_extract(F.regexp_replace(filename, r"^\.+", ""), r"^[^.]*(\..*)$", 1)
    if members is not None:
        kinds = F.transform(members, suffixes)
        has = lambda s: F.exists(kinds, lambda k: k == s)
        photo = F.forall(kinds, lambda k: k.isin(PHOTO_TYPES))
        inside = F.when(F.size(kinds) == 0, None).when(has(".shp"), ".shp.zip").when(has(".obj"), ".obj.zip").when(photo, ".phg.zip")
        ext = F.when(ext == ".zip", inside).otherwise(ext)
    return F.when(ext.isin(list(EXTENSION_JOBS)), ext)


def route_inspect(assets: DataFrame) -> DataFrame:
    """The inspection job and queue of each asset's extension, null if it has none."""
    spark = assets.sparkSession
    routes = spark.createDataFrame([(e, j, JOB_QUEUES[j]) for e, j in EXTENSION_JOBS.items()], "extension string, job string, queue string")
    return assets.join(F.broadcast(routes), "extension", "left")  # a row per extension


def route_pipeline(asset_type: Column, geometry_type: Column) -> Column:
    """The job of an asset, in this order; null if none fits."""
    jobs = F.when(asset_type == "Mesh", "obj")
    for kind, job in (("Polygon", "polygon"), ("Point", "point"), ("PointCloud", "pointcloud")):
        jobs = jobs.when(geometry_type == kind, job)
    return jobs.when(asset_type == "Photogrammetry", "photogrammetry")


def status_label(status: Column) -> tuple[Column, Column]:
    """Label and colour of a status."""
    label = F.when(status.isin("PENDING", "STARTED"), "PENDING").otherwise(F.coalesce(status, F.lit("READY")))
    color = F.when(label == "PENDING", "yellow").when(label == "SUCCESS", "green").when(F.coalesce(status, F.lit("")) == "", "blue").otherwise("red")
    return label, color


def cfg_defaults(pipelines: DataFrame, kind: str) -> DataFrame:
    """(id, key, value): a pipeline's configuration over the defaults of its kind."""
    base = F.create_map(*[F.lit(x) for kv in DEFAULTS[kind].items() for x in kv])
    own = F.coalesce(F.from_json("data", "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
    return pipelines.select("id", F.explode(merged).alias("key", "value"))


def latest_status(events: DataFrame) -> DataFrame:
    """The last event of each task, and the result of its last success (null before one)."""
    order = F.struct("ts", "event_id")
    success = F.when(F.col("status") == "SUCCESS", order)
    return events.groupBy("task_id").agg(F.max_by("status", order).alias("status"), F.max("ts").alias("ts"), F.max_by(F.when(F.col("status") == "SUCCESS", F.col("result")), success).alias("result"))


def tileset_catalog(pipelines: DataFrame, host: str = "") -> DataFrame:
    path = F.get_json_object("task_result", "$.tileset")
    rows = pipelines.where((F.col("task_status") == "SUCCESS") & path.isNotNull())
    return rows.select("id", "title", F.concat(F.lit(host), path).alias("url"), F.lit("3dtiles").alias("type"), F.lit(False).alias("autoload")).orderBy("title", "id")


def layer_validate(layers: DataFrame) -> DataFrame:
    """(..., geometry_type normalised, status, reason)."""
    kind = F.col("geometry_type")
    word = F.when(kind.contains("Point"), "Point").when(kind.contains("Polygon"), "Polygon")
    reason = (
        F.when(F.col("layer_count") > 1, "multiple layers")
        .when(F.col("geom_fields") > 1, "multiple geometry fields")
        .when(kind.contains("Multi"), "multi geometry")
        .when(~F.col("has_srs"), "missing reference system")
        .when(word.isNull(), "unsupported geometry")
    )
    return layers.select("asset_id", F.when(reason.isNull(), word).alias("geometry_type"), F.when(reason.isNull(), "ok").otherwise("rejected").alias("status"), reason.alias("reason"))


def lim_sample(features: DataFrame, key: str, size_kb: float, count: int, cap_kb: float = 1000) -> DataFrame:
    """All features, or as many by ``key`` as make about ``cap_kb``."""
    return features if size_kb <= cap_kb else features.orderBy(key).limit(round(count * cap_kb / size_kb))


def table_name(prefix: str, uuid: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.translate(uuid, "-", "_"))


def crs_codes(df: DataFrame) -> DataFrame:
    """(asset_id, horizontal, vertical, epsg) from WKT or JSON descriptions.

    The last authority code of each text counts; JSON components fill what is missing: vertical from a component whose type has
    ``vert``, horizontal from the first other. The compound's code gives way to the horizontal one if it is null or the vertical one.
    """
    last = lambda c: F.try_element_at(F.regexp_extract_all(F.col(c), F.lit(r'(?i)AUTHORITY\["EPSG",\s*"?(\d+)"?\]'), F.lit(1)), F.lit(-1)).try_cast("int")
    parts = F.from_json("srs_json", "components array<struct<type:string,id:struct<authority:string,code:int>>>")["components"]
    code = lambda vertical: F.try_element_at(F.filter(parts, lambda p: (F.lower(p["type"]).contains("vert") == vertical) & p["id"]["code"].isNotNull()), F.lit(1))["id"]["code"]
    horizontal = F.coalesce(last("horizontal"), code(False))
    vertical = F.coalesce(last("vertical"), code(True))
    out = df.select("asset_id", horizontal.alias("horizontal"), vertical.alias("vertical"), last("comp").alias("comp"))
    epsg = F.when(F.col("comp").isNull() | (F.col("comp") == F.col("vertical")), F.col("horizontal")).otherwise(F.col("comp"))
    return out.select("asset_id", "horizontal", "vertical", epsg.alias("epsg"))
