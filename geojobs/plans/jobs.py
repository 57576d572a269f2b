"""End-to-end jobs: DataFrames and a configuration in, named DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geojobs.functions import expr, geodesy
from geojobs.operators import catalog, cloud, mesh, surfaces, tiling
from geojobs.operators.storage import settle


def settings(kind: str, config: dict) -> dict:
    """A configuration over the defaults of its kind."""
    return catalog.DEFAULTS[kind] | config


def number(conf: dict, key: str, kind: str) -> float | None:
    """A number that is the same for all features; its default where it is none."""
    for value in (conf[key], catalog.DEFAULTS[kind][key]):
        try:
            return float(value)
        except (TypeError, ValueError):
            continue
    return None


def truth(value) -> bool:
    return value is True or str(value).lower() == "true"


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` on all cores where its source has fewer splits than there are: geometry costs more than its bytes tell."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def polygon_tiles(features: DataFrame, config: dict, max_level: int = 20) -> dict[str, DataFrame]:
    """Footprints ``(gid, properties.., geom)`` -> features with triangles and tiles, rejected ones with the reason, attributes, tiles with
    counts and regions, the nodes of the tileset and its documents. Every level of detail has a tree of its own by the same budget; the finer
    ones refine the coarser ones."""
    conf = settings("Polygon", config)
    schema = T.StructType([f for f in features.schema.fields if f.name not in ("gid", "geom")])
    value = lambda key, default=None: expr.to_number(expr.compile_expression("number", conf[key], schema, F.col("geom"), default))
    levels = surfaces.lod_explode(spread(features, "gid"), truth(conf["add_lod"]), number(conf, "lod_max_simplify_tolerance", "Polygon"))
    solids = surfaces.solids(levels, value("lower_limit_height"), value("upper_limit_height"), value("translate_z", 0), truth(conf["remove_bottom_surface"]))
    # Triangulated once, read by the budget, its extent and the result; only the features themselves ask for the triangles.
    solids = settle(solids.select("*", *[F.col("_center")[i].alias(f"_{c}") for i, c in enumerate("xy")], *[F.col("_box")[i].alias(f"_b{i}") for i in range(6)]).drop("_center", "_box"))
    rejected, kept = solids.where(F.col(surfaces.BECAUSE).isNotNull()), solids.where(F.col(surfaces.BECAUSE).isNull()).drop(surfaces.BECAUSE)
    tiled = tiling.tile_budget(kept, ["_x", "_y"], int(number(conf, "max_features_per_tile", "Polygon")), max_level, by=("lod",)).drop("_x", "_y")
    region = F.array(*[f(f"_b{i}") for i, f in ((0, F.min), (1, F.min), (3, F.max), (4, F.max), (2, F.min), (5, F.max))])
    counts = settle(tiled.groupBy("lod", "level", "tile").agg(F.count(F.lit(1)).alias("features"), F.sum("_count").alias("triangles"), region.alias("region")))
    tiled = tiled.drop("_count", *[f"_b{i}" for i in range(6)])
    top = number(conf, "max_geometric_error", "Polygon")
    nodes = tiling.adaptive_nodes(counts, top, max(1.0, number(conf, "geometric_error_factor", "Polygon")), "REPLACE" if truth(conf["add_lod"]) else "ADD")
    return {
        "features": tiled, "rejected": rejected.select("gid", "lod", surfaces.BECAUSE), "attributes": tiling.attr_schema(features), "tiles": counts,
        "nodes": nodes, "tileset": tiling.adaptive_documents(nodes, top),
    }


def point_tiles(points: DataFrame, config: dict, assets: DataFrame, properties: list[str], max_level: int = 20) -> dict[str, DataFrame]:
    """Points ``(gid, x, y, z, properties..)`` -> instances with tiles, their models' assets, attributes."""
    conf = settings("Point", config)
    instances = surfaces.point_instances(points, conf, properties)
    tiled = tiling.tile_budget(instances, ["x", "y"], int(number(conf, "max_features_per_tile", "Point")), max_level)
    return {"instances": tiled, "models": catalog.model_assets(instances, assets), "attributes": tiling.attr_schema(points.select(*properties))}


def cloud_inspect(points: DataFrame, crs: DataFrame | None = None, cap: int = 500_000) -> dict[str, DataFrame]:
    """A cloud -> metadata, statistics per dimension, a centred and thinned preview, codes of its reference system."""
    meta = cloud.metadata(points)
    out = {"metadata": meta, "stats": cloud.stats(points), "preview": cloud.centred(cloud.decimate(points, cap), meta)}
    return out | ({"crs": catalog.crs_codes(crs)} if crs is not None else {})


def cloud_tiles(points: DataFrame, config: dict, raster: DataFrame | None = None, geotransform: tuple | None = None, geoid: tuple | None = None, budget: int = 5000, max_level: int = 12, to_ecef: bool = False) -> dict[str, DataFrame]:
    """Sample, height, colour and ground in that order, each if asked for, then octree tiles with scaled errors."""
    conf = settings("PointCloud", config)
    if conf["sample_radius"] not in (None, ""):
        points = cloud.poisson_sample(points, float(conf["sample_radius"]))
    if truth(conf["to_ellipsoidal_height"]):
        points = cloud.height_datum(points, *geoid)
    if conf["colorization_image"]:
        points = cloud.colorize(points, raster, geotransform)
    if truth(conf["ground_classification"]):
        points = cloud.ground(points)
    if to_ecef:
        points = points.withColumn("_e", geodesy.ecef_lonlat(F.col("x"), F.col("y"), F.col("z"))).withColumns({c: F.col(f"_e.{c}") for c in "xyz"}).drop("_e")
    points = settle(points)  # read by each round of the tree and by the result
    tiles = settle(tiling.octree_tiles(points, budget, max_level))
    errors = tiles.groupBy("level", "tile").agg(F.count(F.lit(1)).alias("points")).withColumn("geometric_error", F.lit(1.0) / F.pow(F.lit(2.0), "level"))
    return {"points": points, "tiles": tiles, "nodes": tiling.error_scale(errors, float(conf["geometric_error_scale_factor"]))}


def denoise(points: DataFrame, radius: float = 0.1, k: int = 32, multiplier: float = 2.2, capacity: int = 5_000_000, scope: str = "part") -> DataFrame:
    """Divide; thin, clear classes, mark outliers as 7 and drop them within each part; the parts are one table.

    With ``scope`` cloud the parts see each other, as if the cloud had not been divided.
    """
    divided = settle(cloud.divide(points, capacity))
    sampled = settle(cloud.poisson_sample(divided, radius, scope=scope).withColumn("classification", F.lit(0)))
    return cloud.class_range(cloud.outlier(sampled, k, multiplier, scope), "classification", 7, 7, keep=False)


def mesh_tiles(vertices: DataFrame, faces: DataFrame, config: dict, margin: float = 4.0) -> dict[str, DataFrame]:
    """A mesh -> its faces by tile, cut along the tile lines of every level and coarsened above ``tile_faces_target`` (the deepest level
    only with ``decimate_last_depth_level``), the tiles with boxes, the flat tileset and its document."""
    conf = settings("Mesh", config)
    depth = int(number(conf, "depth", "Mesh"))
    info = mesh.mesh_info(vertices).first()
    size = [info["size_x"], info["size_y"], info["size_z"]]
    pieces = settle(mesh.cut_tiles(vertices, faces, depth, margin))
    placed = settle(mesh.coarsen(pieces, depth, int(number(conf, "tile_faces_target", "Mesh")), last=truth(conf["decimate_last_depth_level"])))
    stats = settle(mesh.tile_stats(placed, mesh.tasks_for(vertices)))  # a row for each tile, read once per level
    top = number(conf, "max_geometric_error", "Mesh")
    flat = tiling.tileset_flat(stats, size, depth, top)
    return {"faces": placed, "tiles": stats, "flat": flat, "tileset": tiling.tileset_json(flat, depth, top)}
