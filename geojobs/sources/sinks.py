"""Writers."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geojobs.operators.storage import open_store, qualified


def geojson_features(df: DataFrame, properties: list[str], geometry: Column) -> DataFrame:
    """One column, ``value``: a GeoJSON feature per row. ``geometry`` is a struct of type and coordinates."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, properties: list[str], geometry: Column, path: str) -> None:
    """JSON lines, one feature each."""
    geojson_features(df, properties, geometry).write.mode("overwrite").text(path)


def csv_points(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """X, Y, Z and, where there is colour, Red, Green, Blue without decimals; or the dimensions of ``order``. Others are dropped."""
    if order is None:
        order = ["x", "y", "z"] + (["red", "green", "blue"] if "red" in df.columns else [])
    whole = {"red", "green", "blue", "classification", "intensity"}
    return df.select(*[(F.round(F.col(c)).cast("int") if c in whole else F.col(c)).alias(c.capitalize()) for c in order])


def write_csv_points(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    csv_points(df, order).write.mode("overwrite").option("header", True).csv(path)


def tile_info(stats: DataFrame) -> DataFrame:
    """(level, y, x, info): a tile's centre, transform and size as JSON."""
    identity = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    return stats.select("level", "y", "x", F.to_json(F.struct("center", identity.alias("transform"), "size")).alias("info"))


#: The file that names the run which readers see, and what begins the folders of a run.
CURRENT, RUN = "_current", "run-"


def _current(spark: SparkSession, path: str) -> str | None:
    """The name of the run that readers see; None before the first one."""
    system, place = open_store(qualified(spark, path))
    try:
        with system.open_input_stream(f"{place}/{CURRENT}") as f:
            return f.read().decode().strip()
    except FileNotFoundError:
        return None


def write_tiles(tiles: DataFrame, tileset: DataFrame | None, path: str, keys: tuple[str, ...] = ("level",), max_records: int = 1_000_000) -> None:
    """Tile contents by level and, beside them, ``tileset``, as one new run in ``path``, which takes an earlier one's place at once.

    All of a run is written in a folder of its own; then one small file that names it is put in the place of the old one, by a rename,
    and the runs before are deleted, but for the one that was current, which readers may still have open. A run that fails leaves what
    readers see as it was. Other folders stay.
    """
    spark, run = tiles.sparkSession, RUN + uuid.uuid4().hex
    before = _current(spark, path)
    tiles.repartition(*keys, "tile").write.option("maxRecordsPerFile", max_records).partitionBy(keys[0]).parquet(f"{path}/{run}/tiles")
    if tileset is not None:
        tileset.coalesce(1).write.text(f"{path}/{run}/tileset")
    system, place = open_store(qualified(spark, path))
    with system.open_output_stream(f"{place}/{run}/{CURRENT}") as out:
        out.write(run.encode())
    system.move(f"{place}/{run}/{CURRENT}", f"{place}/{CURRENT}")
    for old in system.get_file_info(fs.FileSelector(place)):
        if old.base_name.startswith(RUN) and old.base_name not in (run, before):
            system.delete_dir(old.path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The tile contents of the current run."""
    return spark.read.parquet(f"{path}/{_named(spark, path)}/tiles")


def read_tileset(spark: SparkSession, path: str) -> DataFrame:
    """The tileset of the current run, as lines."""
    return spark.read.text(f"{path}/{_named(spark, path)}/tileset")


def _named(spark: SparkSession, path: str) -> str:
    run = _current(spark, path)
    if run is None:
        raise FileNotFoundError(f"no run of tiles has been finished in {path}")
    return run
