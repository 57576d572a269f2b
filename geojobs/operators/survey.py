"""Photo surveys: presets, image sizes, cameras, projected corners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What differs between the presets of aerial and handheld surveys.
PRESETS = {
    "AERIAL": {"reconstruct_algorithm": "triangulation", "feature_min_frames": 30000, "matching_graph_rounds": 50, "use_altitude_tag": "yes", "align_orientation_prior": "vertical", "depthmap_min_consistent_views": 3},
    "HANDHELD": {"reconstruct_algorithm": "incremental", "feature_min_frames": 8000, "matching_graph_rounds": 0, "use_altitude_tag": "no", "align_orientation_prior": "horizontal", "depthmap_min_consistent_views": 2},
}
#: Image types, and the size that is taken where a survey has none.
IMAGE_TYPES = ["jpg", "jpeg", "png", "tif", "tiff"]
DEFAULT_SIZE = (1920, 1080)


def survey_kind(images: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(survey_id, kind, preset columns): aerial if any readable document has an orientation (``opk``); an override wins."""
    opk = F.get_json_object(F.when(F.try_parse_json("exif").isNotNull(), F.col("exif")), "$.opk").isNotNull()
    kinds = images.groupBy("survey_id").agg(F.bool_or(opk).alias("aerial"))
    if overrides is not None:
        kinds = kinds.join(overrides.select("survey_id", F.col("aerial").alias("_o")), "survey_id", "left").withColumn("aerial", F.coalesce("_o", "aerial")).drop("_o")
    kind = F.when(F.col("aerial"), "AERIAL").otherwise("HANDHELD")
    presets = images.sparkSession.createDataFrame([(k, *p.values()) for k, p in PRESETS.items()], "kind string, reconstruct_algorithm string, feature_min_frames int, matching_graph_rounds int, use_altitude_tag string, align_orientation_prior string, depthmap_min_consistent_views int")
    return kinds.select("survey_id", kind.alias("kind")).join(F.broadcast(presets), "kind")  # two rows


def image_max_res(images: DataFrame) -> DataFrame:
    """(survey_id, width, height): the greatest of each over the images, independently."""
    usable = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(IMAGE_TYPES)
    size = lambda c, d: F.coalesce(F.max(F.when(usable, F.col(c))), F.lit(d)).alias(c)
    return images.groupBy("survey_id").agg(size("width", DEFAULT_SIZE[0]), size("height", DEFAULT_SIZE[1]))


def shot_camera(shots: DataFrame, cameras: DataFrame) -> DataFrame:
    """Shots with their cameras; what a camera doesn't say is 0."""
    known = [c for c in ("k1", "k2", "k3", "p1", "p2", "c_x", "c_y") if c in cameras.columns]
    full = cameras.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in known} | {c: F.lit(0.0) for c in ("k1", "k2", "k3", "p1", "p2", "c_x", "c_y") if c not in known})
    return shots.join(full, "camera_id")


def project_corners(shots: DataFrame, corners: list[tuple[float, float, float]]) -> DataFrame:
    """(shot_id, corner, u, v): corners in each shot's image, turned by its rotation vector, moved, distorted and scaled.

    ``shots`` has rx, ry, rz, tx, ty, tz, focal_x, focal_y, k1, k2, k3, p1, p2, c_x, c_y, width, height.
    """
    points = F.array(*[F.struct(F.lit(i).alias("corner"), *[F.lit(float(v)).alias(n) for v, n in zip(c, "xyz")]) for i, c in enumerate(corners)])
    rows = shots.select("*", F.explode(points).alias("p")).select("*", "p.*").drop("p")
    r, p = [F.col(c) for c in ("rx", "ry", "rz")], [F.col(c) for c in "xyz"]
    angle = F.sqrt(r[0] * r[0] + r[1] * r[1] + r[2] * r[2])
    k = [F.coalesce(F.try_divide(c, angle), F.lit(0.0)) for c in r]
    dot = k[0] * p[0] + k[1] * p[1] + k[2] * p[2]
    cross = [k[1] * p[2] - k[2] * p[1], k[2] * p[0] - k[0] * p[2], k[0] * p[1] - k[1] * p[0]]
    t = [p[i] * F.cos(angle) + cross[i] * F.sin(angle) + k[i] * dot * (1 - F.cos(angle)) + F.col(c) for i, c in enumerate(("tx", "ty", "tz"))]
    rows = rows.withColumns({"_a": F.try_divide(t[0], t[2]), "_b": F.try_divide(t[1], t[2])}).withColumn("_r", F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b"))
    a, b, q = F.col("_a"), F.col("_b"), F.col("_r")
    radial = 1 + q * (F.col("k1") + q * (F.col("k2") + q * F.col("k3")))
    u = a * radial + 2 * F.col("p1") * a * b + F.col("p2") * (q + 2 * a * a)
    v = b * radial + F.col("p1") * (q + 2 * b * b) + 2 * F.col("p2") * a * b
    size = F.greatest("width", "height")
    return rows.select("shot_id", "corner", ((F.col("focal_x") * u + F.col("c_x")) * size + F.col("width") / 2).alias("u"), ((F.col("focal_y") * v + F.col("c_y")) * size + F.col("height") / 2).alias("v"))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without points on its sides."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(ps) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def mask_hull(projected: DataFrame) -> DataFrame:
    """(shot_id, hull, area) of each shot's projected corners."""
    grouped = projected.groupBy("shot_id").agg(F.array_sort(F.collect_list(F.array("u", "v"))).alias("points"))

    @F.pandas_udf("hull array<array<double>>, area double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            made = [hull(np.array([list(p) for p in ps], float)) for ps in s]
            area = [0.5 * abs(float((h[:, 0] * np.roll(h[:, 1], -1) - np.roll(h[:, 0], -1) * h[:, 1]).sum())) if len(h) > 2 else 0.0 for h in made]
            yield pd.DataFrame({"hull": [h.tolist() for h in made], "area": area})

    return grouped.select("shot_id", run("points").alias("h")).select("shot_id", "h.hull", "h.area")

