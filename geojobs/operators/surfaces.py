"""Solids from footprints, levels of detail, model instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geojobs.functions import expr, geometry
from geojobs.operators.tiling import lod_tolerance
from geojobs.operators.simplify import simplify
from geojobs.operators.triangulate import solid

BECAUSE = "rejected_because"


def extrude(df: DataFrame, lower: Column, upper: Column, translate: Column, remove_bottom: bool = True, multi: bool = False) -> DataFrame:
    """``df(.., geom)`` with ``triangles``: roof, walls and, unless removed, the bottom with its faces turned.

    Without limits (null or zero) the solid is a flat roof at its own heights. Lower and upper change places where the lower outer
    ring stands higher on average. Other types than polygons have none; with ``multi``, ``geom.parts`` are exploded first. Where there
    are none, ``rejected_because`` tells why: what is no polygon, one without area, one whose rings cross and can't be triangulated.
    """
    return solids(df, lower, upper, translate, remove_bottom, multi).drop("_count", "_center", "_box")


def solids(df: DataFrame, lower: Column, upper: Column, translate: Column, remove_bottom: bool = True, multi: bool = False) -> DataFrame:
    """``extrude`` with ``_count``, the number of triangles, ``_center``, the middle of the footprint's box, and ``_box``, the ends of the
    triangles (lowest x, y, z, highest x, y, z): what tiles ask for without the triangles."""
    if multi:
        df = df.withColumn("geom", F.explode("geom.parts"))
    rings = F.when(F.col("geom.type") == "Polygon", F.col("geom.rings"))
    df = df.withColumn("_solid", solid(rings, lower, upper, translate, not remove_bottom))
    why = F.when(F.coalesce(F.col("geom.type") != "Polygon", F.lit(True)), "no polygon").when(F.col("_solid.roof").isNull(), "not triangulated").when(F.col("_solid.roof") == 0, "no area")
    each = {"triangles": F.col("_solid.triangles"), BECAUSE: why, "_count": F.col("_solid.count"), "_center": F.col("_solid.center"), "_box": F.col("_solid.box")}
    return df.withColumns(each).drop("_solid")


def drop_empty(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with triangles, rows without, with the reason in ``rejected_because``)."""
    return df.where(F.size("triangles") > 0).drop(BECAUSE), df.where(F.size("triangles") == 0)


def lod_explode(df: DataFrame, add_lod: bool, max_tolerance: float = 5) -> DataFrame:
    """A row per level of detail: with ``add_lod`` 0 (simplified) and 1 (as it is), else 0 as it is."""
    lods = 2 if add_lod else 1
    rows = df.withColumn("lod", F.explode(F.sequence(F.lit(0), F.lit(lods - 1))))
    if not add_lod:
        return rows
    rings = simplify(F.col("geom.rings"), lod_tolerance(F.col("lod"), lods, F.lit(float(max_tolerance))))
    return rows.withColumn("_rings", rings).withColumn("geom", F.col("geom").withField("rings", F.col("_rings"))).drop("_rings")


def json_text(column: Column, kind: T.DataType) -> Column:
    """A value as JSON: decimals as numbers, dates and times as ISO texts, nulls kept."""
    if isinstance(kind, T.DecimalType):
        column = column.cast("double")
    elif isinstance(kind, T.DateType):
        column = F.date_format(column, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    # The JSON of a one-element array without its brackets keeps nulls and quotes texts.
    text = F.to_json(F.array(column), {"ignoreNullFields": "false"})
    return F.substr(text, F.lit(2), F.length(text) - 2)


def tags_json(df: DataFrame, columns: list[str]) -> Column:
    """``[{"a": 1}, {"b": "x"}]`` of columns in their order, as text."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.concat(F.lit('{"' + c + '":'), json_text(F.col(f"`{c}`"), kinds[c]), F.lit("}")) for c in columns]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def point_instances(points: DataFrame, config: dict, properties: list[str]) -> DataFrame:
    """``points(gid, x, y, z, properties...)`` -> gid, x, y, z, scale, scale_non_uniform, rotation, model, tags.

    z is lifted first; the other expressions see the lifted feature. Where one fails or is null its default holds.
    """
    schema = T.StructType([f for f in points.schema.fields if f.name in properties])
    defaults = {"translate_z": 0.0, "scale": 1.0, "rotation": 0.0, "model": "model.glb"}

    def value(key: str, kind: str, geom: Column | None = None) -> Column:
        made = expr.compile_expression(kind, config.get(key, defaults[key]), schema, geom, defaults[key])
        return F.coalesce(expr.to_number(made) if kind == "number" else made.cast("string"), F.lit(defaults[key]))

    lifted = points.withColumn("z", F.coalesce("z", F.lit(0.0)) + value("translate_z", "number"))
    geom = F.struct(F.lit("Point").alias("type"), F.array(F.array(F.array("x", "y", "z"))).alias("rings"))
    scale = value("scale", "number", geom)
    return lifted.select("gid", "x", "y", "z", scale.alias("scale"), F.array(scale, scale, scale).alias("scale_non_uniform"), value("rotation", "number", geom).alias("rotation"), value("model", "string", geom).alias("model"), tags_json(points, properties).alias("tags"))
