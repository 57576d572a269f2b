"""Invariants of the helpers, golden values, independence from the partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geojobs.functions import geodesy
from geojobs.operators import cloud, storage, surfaces, survey, tiling
from geojobs.operators.sides import within
from geojobs.operators.simplify import crosses, simplify_ring, simplify_rings
from geojobs.operators.triangulate import both_sides, triangles
from geojobs.plans import vector_queries
from geojobs.plans.shapes import polygons
from geojobs.sources import files, las, shapefile, sinks
from geojobs.streaming import jobs as streams


def test_ecef_round_trip(spark):
    p = geodesy.ecef_from_lla(F.lit(10.0), F.lit(20.0), F.lit(30.0))
    row = spark.range(1).select(p.alias("p")).select(geodesy.lla_from_ecef(F.col("p.x"), F.col("p.y"), F.col("p.z")).alias("q")).first()["q"]
    assert (round(row.lat, 7), round(row.lon, 7), round(row.alt, 4)) == (10, 20, 30)


def test_topocentric_zero_and_distance(spark):
    ref = (F.lit(40.0), F.lit(30.0), F.lit(1000.0))
    row = spark.range(1).select(geodesy.enu_from_lla(*ref, ref).alias("p"), geodesy.gps_distance(F.lit(42.1), F.lit(-11.1), F.lit(42.2), F.lit(-11.3)).alias("d")).first()
    assert max(map(abs, row["p"])) < 1e-6
    assert 19_000 < row["d"] < 20_000


def test_utm_and_extent():
    x, y = geodesy.project(43.75, 11.25, 32632)
    assert abs(x - 681_152) < 1000 and abs(y - 4_846_500) < 2000
    box = geodesy.extent_to_local((43.75, 11.25, 0.0), [x - 50, y - 20, x + 50, y + 20], 32632)
    assert abs(box[0] + box[2]) < 1 and abs(box[2] - box[0] - 100) < 5
    assert geodesy.extent_to_local(None, [0, 0, 1, 1], 4326) is None


def area(tris):
    return sum(((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[2][0] - t[0][0]) * (t[1][1] - t[0][1])) / 2 for t in tris)


def test_triangulation_of_random_stars():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(3, 40))
        angle = np.sort(rng.uniform(0, 2 * math.pi, n)) + np.arange(n) * 1e-6
        r = rng.uniform(1, 5, n)
        ring = [[float(a * math.cos(t)), float(a * math.sin(t)), 1.0] for a, t in zip(r, angle)]
        if max(np.diff(np.append(angle, angle[0] + 2 * math.pi))) >= 2:
            continue
        ring.append(ring[0])
        x = np.array(ring)
        shoelace = 0.5 * float((x[:-1, 0] * x[1:, 1] - x[1:, 0] * x[:-1, 1]).sum())
        hole = [[0.3 * math.cos(t), 0.3 * math.sin(t), 1.0] for t in (0, 2, 4, 0)]
        assert len(triangles([ring])) == n - 2
        assert abs(area(triangles([ring])) - shoelace) < 1e-9
        inner = abs(area(triangles([hole])))
        with_hole = triangles([ring, hole])
        assert len(with_hole) == n + 3 - 2 + 2 and abs(area(with_hole) - (shoelace - inner)) < 1e-9
        assert abs(area(triangles([ring], reverse=True)) + shoelace) < 1e-9
    assert triangles([]) == [] and triangles(None) == [] and triangles([[[0, 0], [1, 0], [0, 0]]]) == []


def test_large_rings_are_clipped_in_time():
    import time

    seconds = []
    for n in (4_000, 16_000):
        t = np.linspace(0, 2 * math.pi, n, endpoint=False)
        r = 5 + np.where(np.arange(n) % 2, 0.0, 1.0) + 0.3 * np.sin(40 * t)  # teeth: half of the corners are reflex
        ring = np.column_stack((r * np.cos(t), r * np.sin(t), np.ones(n))).tolist()
        hole = [[math.cos(t), math.sin(t), 1.0] for t in np.linspace(0, 6, 50)]
        began = time.perf_counter()
        found = triangles([ring + ring[:1], hole + hole[:1]])
        seconds.append(time.perf_counter() - began)
        x = np.array(ring)
        shoelace = 0.5 * float((x[:, 0] * np.roll(x[:, 1], -1) - np.roll(x[:, 0], -1) * x[:, 1]).sum())
        assert len(found) == n + 50 and abs(area(found) - (shoelace - abs(area(triangles([hole]))))) < 1e-6
    assert seconds[1] < 10 * seconds[0] + 1  # four times the corners


def test_both_sides_are_one_footprint():
    ring = [[0, 0, 5], [4, 0, 5], [4, 3, 6], [1, 1, 5], [0, 3, 5], [0, 0, 5]]
    low = [[x, y, 1.0] for x, y, _ in ring]
    roof, bottom = both_sides([ring], [low])
    assert roof == triangles([ring]) and bottom == triangles([low], reverse=True) and both_sides(None, None) == ([], [])


def test_collinear_and_doubled_corners():
    ring = [[0, 0], [1, 0], [2, 0], [2, 0], [3, 0], [3, 1], [3, 2], [0, 2], [0, 1], [0, 0]]
    assert abs(area(triangles([ring])) - 6) < 1e-12


def test_self_crossing_against_all_pairs():
    rng = np.random.default_rng(8)
    for _ in range(200):
        r = rng.uniform(size=(int(rng.integers(4, 30)), 2))
        if rng.random() < 0.5:
            r = r[np.argsort(np.arctan2(*(r - 0.5).T))]
        n = len(r)
        cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
        want = any(cross(r[i], r[(i + 1) % n], r[j]) * cross(r[i], r[(i + 1) % n], r[(j + 1) % n]) < 0 and cross(r[j], r[(j + 1) % n], r[i]) * cross(r[j], r[(j + 1) % n], r[(i + 1) % n]) < 0 for i in range(n) for j in range(i + 2, n))
        assert crosses([[*r.tolist(), r[0].tolist()]]) == want


def star(rng, n, cx, cy, low, high, gap=2.5):
    """A closed ring of random corners about a centre, which it goes round once, with no wider angle between two than ``gap``."""
    angle = np.sort(rng.uniform(0, 2 * math.pi, n))
    while max(np.diff(np.append(angle, angle[0] + 2 * math.pi))) >= gap:
        angle = np.sort(rng.uniform(0, 2 * math.pi, n))
    ring = [[cx + float(q * math.cos(t)), cy + float(q * math.sin(t)), float(t)] for q, t in zip(rng.uniform(low, high, n), angle)]
    return ring + ring[:1]


def courts(rng, outer, holes):
    """A random ring with so many random holes, one in a cell each."""
    k = max(1, math.ceil(math.sqrt(holes)))
    g = 5.6 / k
    cells = rng.permutation([(i, j) for i in range(k) for j in range(k)])[:holes]
    return [star(rng, outer, 0, 0, 6, 10, 1.5), *[star(rng, int(rng.integers(4, 20)), -2.8 + (i + 0.5) * g, -2.8 + (j + 0.5) * g, g * 0.1, g * 0.49) for i, j in cells]]


def shoelace(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


@pytest.mark.parametrize("holes", [1, 3, 5, 20, 50])
def test_polygons_with_many_holes_keep_their_area(holes):
    rng = np.random.default_rng(holes)
    for _ in range(60):
        rings = courts(rng, int(rng.integers(10, 60)), holes)
        found = triangles(rings)
        assert len(found) == sum(len(r) - 1 for r in rings) + 2 * holes - 2
        assert abs(area(found) - shoelace(rings[0]) + sum(map(shoelace, rings[1:]))) < 1e-9


def square(x, y, w):
    return [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]


def test_holes_that_touch():
    """A side, a corner, each other, in a row, and on one line."""
    outer = square(0.0, 0.0, 10.0)
    for holes in (
        [[[0, 5], [2, 4], [2, 6], [0, 5]]], [[[10, 5], [8, 4], [8, 6], [10, 5]]], [[[0, 0], [3, 1], [1, 3], [0, 0]]], [[[10, 10], [7, 9], [9, 7], [10, 10]]],
        [square(2, 2, 2), square(4, 4, 2)], [square(2, 2, 2), [[4, 3], [6, 2], [6, 4], [4, 3]]], [square(1 + i, 1 + i, 1) for i in range(8)], [square(1, 1 + 2 * i, 1) for i in range(4)],
    ):
        assert abs(area(triangles([outer, *holes])) - 100 + sum(map(shoelace, holes))) < 1e-9, holes


def test_many_holes_take_no_square_of_time():
    import time

    seconds = []
    for k in (20, 60):
        began = time.perf_counter()
        found = triangles([square(0.0, 0.0, float(k)), *[square(i + 0.25, j + 0.25, 0.5) for i in range(k) for j in range(k)]])
        seconds.append(time.perf_counter() - began)
        assert abs(area(found) - 0.75 * k * k) < 1e-6 and len(found) == 6 * k * k + 2
    assert seconds[1] < 30 * max(seconds[0], 0.1)


def test_what_is_no_surface_has_a_reason(spark):
    """A polygon with area is kept or rejected with a reason, never dropped as empty."""
    shapes = {1: [square(0.0, 0.0, 4.0), square(1.0, 1.0, 1.0)], 2: [square(0.0, 0.0, 4.0), square(3.0, 3.0, 2.0)], 3: [[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]], 4: [[[0.0, 0.0], [4.0, 4.0], [4.0, 0.0], [0.0, 3.0], [0.0, 0.0]]], 5: []}
    df = spark.createDataFrame([(i, ("Polygon", r)) for i, r in shapes.items()] + [(6, ("Point", [[[1.0, 2.0]]])), (7, None)], "gid long, geom struct<type string, rings array<array<array<double>>>>")
    for bottom in (True, False):
        kept, rejected = surfaces.drop_empty(surfaces.extrude(df, F.lit(1.0), F.lit(2.0), F.lit(0.0), remove_bottom=bottom))
        assert [r.gid for r in kept.collect()] == [1] and "rejected_because" not in kept.columns
        assert {r.gid: r.rejected_because for r in rejected.collect()} == {2: "not triangulated", 3: "no area", 4: "not triangulated", 5: "no area", 6: "no polygon", 7: "no polygon"}


def test_simplified_polygons_stay_valid():
    rng = np.random.default_rng(1)
    fewer = 0
    for holes in (0, 1, 3, 8, 20):
        for _ in range(40):
            rings = [np.array(r) for r in courts(rng, int(rng.integers(10, 120)), holes)]
            out = simplify_rings(rings, float(rng.choice([0.1, 0.5, 1, 3])))
            flat = [[tuple(p[:2]) for p in r[:-1].tolist()] for r in out]
            assert not crosses([r.tolist() for r in out]) and all(len(r) >= 4 for r in out) and len(out) == len(rings)
            assert all(within(h[0], flat[0]) for h in flat[1:]) and not any(within(a[0], b) for a in flat[1:] for b in flat[1:] if a is not b)
            assert all({tuple(p) for p in n.tolist()} <= {tuple(p) for p in o.tolist()} for o, n in zip(rings, out))
            fewer += sum(map(len, rings)) - sum(map(len, out))
    assert fewer > 5000


def test_a_corner_stays_where_a_hole_reaches_behind_it():
    outer, hole = [[0, 0, 0], [10, 0, 0], [10, 10, 0], [5, 10.9, 0], [0, 10, 0], [0, 0, 0.0]], [[5, 10.6, 0], [4, 5, 0], [6, 5, 0], [5, 10.6, 0.0]]
    assert [len(r) for r in simplify_rings([np.array(outer), np.array(hole)], 1.0)] == [6, 4]
    assert [len(r) for r in simplify_rings([np.array(outer)], 1.0)] == [5]


def test_simplify_keeps_a_ring():
    ring = [[0, 0], [1, 0.001], [2, 0], [2, 2], [1, 2.001], [0, 2], [0, 0]]
    assert len(simplify_ring(ring, 0.01)) == 5
    assert len(simplify_ring(ring, 100)) >= 4
    assert len(simplify_ring(ring, 0)) == 7


def test_the_first_level_of_detail_is_simplified(spark, small):
    """The query takes the reference's five metres: corners of ells and courtyards go in level 0 and stay in level 1."""
    rows = {(r["gid"], r["lod"]): r.asDict() for r in vector_queries.lod_explode(spark, small).collect()}
    shapes = polygons(spark, small).select("gid", "kind", "geom.rings").collect()
    assert len(rows) == 2 * len(shapes)
    assert {s["kind"] for s in shapes if rows[s["gid"], 0]["positions"] < rows[s["gid"], 1]["positions"]} == {1}
    assert {s["kind"] for s in shapes if rows[s["gid"], 0]["others"] < rows[s["gid"], 1]["others"]} == {4}
    for s in shapes:
        for lod, metres in enumerate((5, 0)):
            n = [len(r) for r in simplify_rings([np.array(r) for r in s["rings"]], metres / 111194.87428468118)]
            assert [rows[s["gid"], lod][c] for c in ("positions", "others")] == [n[0], sum(n[1:])]


def points(spark, n=700, seed=1, span=30.0):
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, [span, span, 3], (n, 3))
    return spark.createDataFrame([(i, *map(float, p), 0) for i, p in enumerate(xyz)], "pid long, x double, y double, z double, classification int"), xyz


@pytest.mark.parametrize("block", [6.0, 100.0])
def test_poisson_sample_is_the_greedy_pass(spark, block):
    df, xyz = points(spark)
    kept: list[int] = []
    for i, p in enumerate(xyz):
        if all(((xyz[j] - p) ** 2).sum() >= 1.5**2 for j in kept):
            kept.append(i)
    for n in (1, 17):
        found = cloud.poisson_sample(df.repartition(n), 1.5, block=block)
        assert sorted(r.pid for r in found.collect()) == kept


@pytest.mark.parametrize("block", [40, 10_000])
def test_knn_mean(spark, block):
    df, xyz = points(spark, 400)
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :5].mean(axis=1)
    got = {r.pid: r.mean_distance for r in cloud.knn_mean(df, 5, block).collect()}
    assert len(got) == 400 and max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-9
    few = cloud.knn_mean(df.where("pid < 3"), 5, block).collect()
    assert len(few) == 3 and all(r.mean_distance > 0 for r in few)


def clustered(spark, n, share, seed=4):
    """Points of which a share stands in a hundredth of the side, some of them at one place."""
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, [100, 100, 2], (n, 3))
    dense = rng.random(n) < share
    xyz[dense] = rng.uniform([40, 40, 0], [41, 41, 2], (int(dense.sum()), 3))
    xyz[: n // 20] = xyz[0] if share else xyz[: n // 20]
    return spark.createDataFrame([(i, *map(float, p), 0) for i, p in enumerate(xyz)], "pid long, x double, y double, z double, classification int").repartition(8), xyz


def test_dense_spots_give_the_same_sample_and_neighbours(spark):
    df, xyz = clustered(spark, 3000, 0.9)
    kept: list[int] = []
    for i, p in enumerate(xyz):
        if not kept or ((xyz[kept] - p) ** 2).sum(axis=1).min() >= 0.5**2:
            kept.append(i)
    assert sorted(r.pid for r in cloud.poisson_sample(df, 0.5).collect()) == kept
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :6].mean(axis=1)
    got = {r.pid: r.mean_distance for r in cloud.knn_mean(df, 6, 100).collect()}
    assert len(got) == 3000 and max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-9


@pytest.mark.parametrize("job", [lambda df: cloud.poisson_sample(df, 0.5), lambda df: cloud.knn_mean(df, 8)])
def test_ninety_percent_in_one_cell_take_no_longer(spark, job):
    import time

    seconds = {}
    for share in (0.0, 0.0, 0.9):  # the first to warm up
        df = clustered(spark, 40_000, share)[0]
        began = time.perf_counter()
        job(df).write.format("noop").mode("overwrite").save()
        seconds[share] = time.perf_counter() - began
    assert seconds[0.9] < 2 * seconds[0.0] + 8  # rounds cost the same however few points are left for them


def test_parts_do_not_see_each_other(spark):
    df, xyz = points(spark, 400)
    parts = df.withColumn("part", F.col("pid") % 2)
    for i in (0, 1):
        alone = df.where(F.col("pid") % 2 == i)
        mine = lambda out: sorted(map(tuple, out.where(F.col("pid") % 2 == i).collect()))
        assert mine(cloud.poisson_sample(parts, 1.5, scope="part").select("pid")) == mine(cloud.poisson_sample(alone, 1.5).select("pid"))
        assert mine(cloud.knn_mean(parts, 4, 50, scope="part")) == mine(cloud.knn_mean(alone, 4, 50))
    none = df.limit(0)
    assert cloud.knn_mean(none, 3).count() == 0 and cloud.poisson_sample(none, 1.0).count() == 0
    odd = df.limit(1).unionByName(df.limit(1).select((F.col("pid") + 1000).alias("pid"), F.lit(None).cast("double").alias("x"), "y", "z", "classification"))
    assert [(r.pid, r.mean_distance) for r in cloud.knn_mean(odd, 3).collect()] == [(df.first().pid, None)] and cloud.poisson_sample(odd, 1.0).count() == 1


def test_denoise_by_parts(spark):
    from geojobs.plans import jobs

    df = points(spark, 600)[0]
    out = jobs.denoise(df, radius=0.8, k=4, multiplier=1.5, capacity=250).select("pid", "part").collect()
    want = set()
    for part in range(3):
        one = jobs.denoise(df.where(F.floor(F.col("pid") / 200) == part), radius=0.8, k=4, multiplier=1.5, capacity=10**6)
        want |= {(r.pid, part) for r in one.collect()}
    assert {(r.pid, r.part) for r in out} == want and len(want) < 600


def test_smrf_tells_ground_from_blocks(spark):
    rows = [(i, float(i % 40) + 0.5, float(i // 40) + 0.5, 6.0 if 15 <= i % 40 < 22 and 15 <= i // 40 < 22 else 0.02 * (i % 40), 0) for i in range(1600)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, classification int")
    for block in (16, 256):
        out = cloud.smrf(df, block=block).toPandas()
        block_points = out.z > 5
        assert (out.classification[block_points] != 2).all() and (out.classification[~block_points] == 2).mean() > 0.95


def test_smrf_against_loops(spark):
    """The filter told cell by cell: lowest heights, openings by disks, terrain without objects, distance from it."""
    block, rim, slope, scalar, threshold = 16, 7, 0.15, 1.25, 0.5
    rng = np.random.default_rng(9)
    cells = [(i, j) for i in range(block) for j in range(block) if rng.random() < 0.93]
    rows = [(k, i + 0.5, j + 0.5, 0.05 * i + 0.1 * float(rng.random()) + (4.0 if 5 <= i < 8 and 4 <= j < 8 else 0.0), 0) for k, (i, j) in enumerate(cells * 2)]
    n = block + 2 * rim

    def filled(z):
        while any(v is None for v in z.values()):
            known = {}
            for (i, j), v in z.items():
                near = [z[i + a, j + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if z.get((i + a, j + b)) is not None]
                known[i, j] = v if v is not None else sum(near) / len(near) if near else None
            z = known
        return z

    def extreme(z, r, fn):
        return {(i, j): fn(z[i + a, j + b] for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r and (i + a, j + b) in z) for i, j in z}

    low = {(i, j): None for i in range(-rim, n - rim) for j in range(-rim, n - rim)}
    for _, x, y, z, _ in rows:
        low[int(x), int(y)] = z if low[int(x), int(y)] is None else min(z, low[int(x), int(y)])
    last, objects = filled(low), set()
    for r in (1, 2, 3):
        opened = extreme(extreme(last, r, min), r, max)
        objects |= {c for c in low if last[c] - opened[c] > slope * r}
        last = opened
    ground = filled({c: None if c in objects else v for c, v in low.items()})
    steep = {(i, j): math.hypot((ground[i + 1, j] - ground[i - 1, j]) / 2, (ground[i, j + 1] - ground[i, j - 1]) / 2) for i, j in cells}
    want = {k: abs(z - ground[int(x), int(y)]) <= threshold + scalar * steep[int(x), int(y)] for k, x, y, z, _ in rows}
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, classification int")
    got = {r.pid: r.classification == 2 for r in cloud.smrf(df, window=3.0, block=block).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_divide_and_rank_with_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("pid")).repartition(5)
    parts = cloud.divide(df, 300).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in parts] == [250] * 4


def test_tile_budget_one_spot_and_nulls(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0) for i in range(20)] + [(99, None, 2.0)], "gid long, x double, y double")
    out = tiling.tile_budget(df, ["x", "y"], 5, 3).collect()
    assert len(out) == 21 and {r.level for r in out if r.gid != 99} == {3} and [r.tile for r in out if r.gid == 99] == [None]


def test_tileset_needs_a_size(spark):
    with pytest.raises(ValueError):
        tiling.tileset_flat(spark.createDataFrame([], "level int, y int, x int, center array<double>, size array<double>"), None, 2)


def test_hull():
    pts = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]], float)
    assert len(survey.hull(pts)) == 4


def test_las_and_shapefile(spark, tmp_path):
    import struct

    pdf = points(spark, 50)[0].toPandas().assign(intensity=5, red=1, green=2, blue=3)
    las.write(f"file://{tmp_path}/a.las", pdf)
    back = files.read_las(spark, f"{tmp_path}/a.las", 7).toPandas().sort_values("pid")
    assert len(back) == 50 and np.allclose(back[["x", "y", "z"]], pdf[["x", "y", "z"]], atol=1e-3) and set(back.blue) == {3}
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    poly = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    point = struct.pack("<i2d", 1, 3.0, 4.0)
    folder = tmp_path / "layers"
    folder.mkdir()
    shp = bytes(100) + b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate((poly, point)))
    head = bytearray(32)
    struct.pack_into("<IHH", head, 4, 2, 32 + 32 + 1, 1 + 5)
    field = bytearray(32)
    field[:4], field[11:12], field[16] = b"name", b"C", 5
    (folder / "l.shp").write_bytes(shp)
    (folder / "l.dbf").write_bytes(bytes(head) + bytes(field) + b"\r" + b" aa   " + b" bb   ")
    rows = files.read_shapefiles(spark, str(folder), ["name"]).orderBy("gid").collect()
    assert [(r.gid, r.name, r.geom.type, len(r.geom.rings[0])) for r in rows] == [(1, "aa", "Polygon", 4), (2, "bb", "Point", 1)]
    made = [({"name": f"n{i}", "kind": "k"}, "Point" if i % 2 else "Polygon", [[[float(i), 1.0, 0.0]]] if i % 2 else [[[0.0, 0.0, 1.0], [i + 1.0, 0.0, 1.0], [0.0, 0.0, 1.0]]]) for i in range(25)]
    shapefile.write(f"file://{folder}/sub/m", made, ["name", "kind"])
    back = files.read_shapefiles(spark, str(folder), ["kind", "name", "none"], records=4).where("layer like '%/sub/m'")
    assert back.rdd.getNumPartitions() == 1 + 7
    assert [(r.gid, r.name, r.kind, r.none, r.geom.type, r.geom.rings) for r in back.orderBy("gid").collect()] == [(i + 1, v["name"], "k", None, t, [list(map(list, ring)) for ring in g]) for i, (v, t, g) in enumerate(made)]


def shp(records):
    """A .shp without index of polygon records, each a list of rings."""
    import struct

    bodies = []
    for rings in records:
        flat = [p for r in rings for p in r]
        starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
        bodies.append(struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(rings), len(flat)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p[:2]) for p in flat))
    return bytes(100) + b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate(bodies))


def dbf(n):
    import struct

    head, field = bytearray(32), bytearray(32)
    struct.pack_into("<IHH", head, 4, n, 65, 9)
    field[:4], field[11:12], field[16] = b"name", b"C", 8
    return bytes(head) + bytes(field) + b"\r" + b"".join(b" " + f"n{i}".encode().ljust(8) for i in range(n))


def test_parts_of_shapefile_records(spark, tmp_path):
    """Outer rings in any order and turn, holes of several, islands in holes, rings that touch; layers without index by ranges."""
    a, b = square(0.0, 0.0, 10.0), square(20.0, 0.0, 10.0)
    hole, island, other, corner, back = square(2.0, 2.0, 6.0), square(4.0, 4.0, 2.0), square(22.0, 2.0, 3.0), [[0.0, 0.0], [3.0, 1.0], [1.0, 3.0], [0.0, 0.0]], square(10.0, 10.0, 5.0)
    cases = [
        ([a], [[a]]), ([a, hole], [[a, hole]]), ([hole[::-1], a], [[a, hole[::-1]]]), ([a, b], [[a], [b]]), ([hole, b, other, a], [[b, other], [a, hole]]), ([island, hole, a], [[island], [a, hole]]),
        ([a, corner], [[a, corner]]), ([a, back], [[a], [back]]), ([square(0.0, 0.0, 1.0), square(2.0, 0.0, 1.0)], [[square(0.0, 0.0, 1.0)], [square(2.0, 0.0, 1.0)]]), ([[[0.0, 0.0], [5.0, 5.0], [0.0, 0.0]], a], [[a, [[0.0, 0.0], [5.0, 5.0], [0.0, 0.0]]]]),
    ]
    rng = np.random.default_rng(3)
    for holes in (2, 7, 20):
        rings = [[[float(x), float(y)] for x, y, _ in r] for r in courts(rng, 30, holes)]
        order = rng.permutation(len(rings)).tolist()
        cases.append(([rings[i] for i in order], [[rings[0], *[rings[i] for i in order if i]]]))
    (tmp_path / "l.shp").write_bytes(shp([c[0] for c in cases] * 10))
    (tmp_path / "l.dbf").write_bytes(dbf(len(cases) * 10))
    (tmp_path / "m.shp").write_bytes(shp([[a], [a, hole]]))
    (tmp_path / "m.dbf").write_bytes(dbf(2))
    back = files.read_shapefiles(spark, str(tmp_path), ["name"], records=17)
    assert back.rdd.getNumPartitions() == -(-len(cases) * 10 // 17) + 1
    rows = back.where("layer like '%/l'").orderBy("gid").collect()
    assert [(r.gid, r.name) for r in rows] == [(i + 1, f"n{i}") for i in range(len(cases) * 10)]
    flat = lambda parts: [[[[*p, 0.0] for p in r] for r in rings] for rings in parts]
    for r, (_, want) in zip(rows, cases * 10):
        assert r.geom.type == ("MultiPolygon" if len(want) > 1 else "Polygon") and [p.rings for p in r.geom.parts] == flat(want)
        assert r.geom.rings == (flat(want)[0] if len(want) == 1 else None) and {p.type for p in r.geom.parts} == {"Polygon"}
    kinds = {r.layer[-1]: r.geometry_type for r in files.layer_types(back).collect()}
    assert kinds == {"l": "MultiPolygon", "m": "Polygon"}
    solids = surfaces.extrude(back.where("layer like '%/l' and gid <= 9"), F.lit(None).cast("double"), F.lit(2.0), F.lit(0.0), multi=True)
    assert abs(sum(area(r.triangles) for r in solids.where("gid = 9").collect()) - 2) < 1e-9 or solids.where("gid = 9").count() == 2


def test_many_parts_take_no_square_of_time():
    import time

    from geojobs.operators.rings import nest

    rings = [np.array(square(3.0 * i, 3.0 * j, w)) + o for i in range(50) for j in range(50) for w, o in ((2.0, 0.0), (1.0, 0.5))]
    began = time.perf_counter()
    assert nest(rings) == [[2 * k, 2 * k + 1] for k in range(2500)] and time.perf_counter() - began < 20


def test_geojson_collection(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"k":"x"},"geometry":{"type":"Point","coordinates":[1,2]}},\n{"type":"Feature","properties":{"k":null},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0,5],[0,0]]]}}]}')
    rows = files.read_geojson(spark, str(tmp_path), "k string").orderBy("gid").collect()
    assert [(r.gid, r.k, r.geom.type) for r in rows] == [(1, "x", "Point"), (2, None, "Polygon")]
    assert rows[0].geom.rings == [[[1, 2, 0]]] and rows[1].geom.rings[0][1] == [1, 0, 5]
    line = '{"type":"Feature","properties":{"k":"%d"},"geometry":{"type":"Point","coordinates":[%d,2]}}'
    (tmp_path / "b.json").write_text("\n" + "\n".join(line % (i, i) for i in range(50)) + "\n")  # lines, after a collection
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = files.read_geojson(spark, str(tmp_path), "k string").orderBy("gid").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.k for r in rows] == ["x", None, *map(str, range(50))]


@pytest.mark.parametrize("range_bytes", [37, 64, 1000, 1 << 20])
def test_collections_by_ranges(spark, tmp_path, range_bytes):
    """Features across the ends of ranges, brackets, quotes and backslashes in strings, other arrays of the root, keys in any order."""
    import json

    rng = np.random.default_rng(range_bytes)
    odd = ["]}", '"features":[{', "\\", '\\"', "{[", "é\u2028", "x" * 90, "", "a\\\\b", '"']
    want = []
    for name, order in (("a", ("type", "bbox", "crs", "features", "name")), ("b", ("features", "other", "type")), ("c", ("name", "type", "features")), ("d", ("type", "features", "features2"))):
        made = [{"type": "Feature", "properties": {"k": str(rng.choice(odd)) + str(i), "n": {"deep": [1, [2]]}}, "geometry": {"type": "Point", "coordinates": [i, 2.5]}} for i in range(int(rng.integers(0, 25)) if name != "c" else 0)]
        root = {"type": "FeatureCollection", "bbox": [1, 2, [3]], "crs": {"features": [{"a": 1}]}, "name": "]" + odd[1], "other": [{"type": "Feature", "x": 1}], "features2": [{"y": 1}], "features": made}
        text = json.dumps({k: root[k] for k in order}, indent=int(rng.integers(0, 3)) or None, ensure_ascii=bool(rng.integers(0, 2)))
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
        want += [(f["properties"]["k"], f["geometry"]["coordinates"][0]) for f in made]
    (tmp_path / "e.json").write_text("")
    (tmp_path / "f.json").write_text('{"properties":{"k":"last","features":[1]},"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}}\n')
    rows = files.read_geojson(spark, str(tmp_path), "k string", range_bytes).orderBy("gid").collect()
    assert [r.gid for r in rows] == list(range(1, len(want) + 2))
    assert [(r.k, r.geom.rings[0][0][0]) for r in rows] == [*want, ("last", 1.0)]


def test_obj_faces(spark):
    lines = spark.createDataFrame([(0, "v 0 0 0"), (1, "f 1/2 2//3 3 4"), (2, "f 1 2"), (3, "v 1 2 x"), (4, "v  5   6 7")], "line_no long, value string")
    assert [tuple(r)[1:] for r in files.obj_faces(lines).orderBy("fid").collect()] == [(1, 2, 3), (1, 3, 4)]
    assert [tuple(r) for r in files.obj_vertices(lines).orderBy("vid").collect()] == [(1, 0, 0, 0), (2, 5, 6, 7)]


def test_obj_by_path_counts_backwards_and_on(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv bad\nv 1 1 0\nf -3 -2 -1\nv 9 9 9\nv 8 8 8\nv 7 7 7\nf -1/1 2 -3\nf 1 2 3\n" + "f " + " ".join(["1", "2", "3"] * 500) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20")
    try:
        v, f = files.read_obj(spark, str(tmp_path / "m.obj"))
        assert [(r.vid, r.x) for r in v.orderBy("vid").collect()] == [(1, 0), (2, 1), (3, 1), (4, 9), (5, 8), (6, 7)]
        rows = f.orderBy("fid").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r)[1:] for r in rows[:3]] == [(1, 2, 3), (6, 2, 4), (1, 2, 3)] and len({r.fid for r in rows}) == 3 + 1498


def test_status_writes_what_a_batch_changes(spark, tmp_path):
    """Late, repeated and null events over eight arrivals: the store has one row a task, a batch's output only the tasks that it changes."""
    source, checkpoint, target = (str(tmp_path / n) for n in ("in", "cp", "out"))
    want, changed = {}, []
    for n in range(8):
        at = 3 if n == 5 else n  # the sixth arrival is late, the seventh the same as the fifth
        rows = [(t if t else None, "SUCCESS" if (at + t) % 3 == 0 else "STARTED", 100 * at + t, at * 10 + t, f"r{at}") for t in range(at % 4, 5)] if n != 6 else rows_before
        rows_before = rows
        touched = set()
        for t, s, when, number, result in rows:
            old = want.get(t, ((-1, -1), None, (-1, -1), None))
            new = ((when, number), s, *old[2:]) if (when, number) > old[0] else old
            new = (*new[:2], (when, number), result) if s == "SUCCESS" and (when, number) > new[2] else new
            touched |= {t} if new != old else set()
            want[t] = new
        changed.append(touched)
        df = spark.createDataFrame(rows, "task_id long, status string, ts long, event_id long, result string").withColumn("ts", F.timestamp_seconds("ts"))
        df.write.mode("append").parquet(source)
        streams.status(spark, source, checkpoint, target).awaitTermination()
    assert {r.task_id: (r.status, r.result) for r in streams.current(spark, checkpoint).collect()} == {t: (v[1], v[3]) for t, v in want.items()}
    out = spark.read.parquet(target).select("batch", "task_id").collect()
    assert [{r.task_id for r in out if r.batch == n} for n in range(8)] == changed and not changed[6]


def test_streams_take_each_file_once(spark, tmp_path):
    source, checkpoint, sink = (str(tmp_path / n) for n in ("in", "cp", "out"))
    spark.range(3).select(F.col("id").cast("string")).coalesce(1).write.text(source)
    for _ in range(2):
        streams.ingest(spark, source, checkpoint, sink).awaitTermination()
    assert spark.read.parquet(sink).count() == 1


def test_shared_folder_and_qualified_paths(spark, tmp_path):
    from types import SimpleNamespace as Some

    unset = Some(get=lambda *a: None)
    away = Some(conf=unset, sparkContext=Some(master="spark://host:7077", getConf=lambda: unset))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(away)
    assert storage.shared_dir(spark).startswith("file:/")
    assert storage.qualified(spark, "/some/place") == "file:/some/place" and storage.qualified(spark, "s3a://b/k") == "s3a://b/k"
    assert storage.open_store("file:/some/place")[1] == storage.open_store("file:///some/place")[1] == "/some/place"
    with pytest.raises(ValueError, match="scheme"):
        storage.open_store("/some/place")
    store = storage.settle(spark.range(3))
    assert store.count() == 3 and all(f.startswith("file:/") for f in store.inputFiles())


def test_a_run_of_tiles_replaces_the_last_at_once(spark, tmp_path):
    """A run that fails between tiles and tileset leaves both as they were; one that is done replaces both."""
    path = str(tmp_path / "out")
    made = lambda n: spark.range(n).select(F.col("id").alias("gid"), (F.col("id") % 3).cast("int").alias("level"), F.array("id").alias("tile"))
    with pytest.raises(FileNotFoundError):
        sinks.read_tiles(spark, path)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "textures").mkdir()
    sinks.write_tiles(made(10), spark.createDataFrame([("one",)], "value string"), path)
    bad = spark.createDataFrame([("x",)], "value string").select(F.raise_error(F.lit("stopped")).cast("string").alias("value"))
    with pytest.raises(Exception, match="stopped"):
        sinks.write_tiles(made(20), bad, path)
    assert sinks.read_tiles(spark, path).count() == 10 and sinks.read_tileset(spark, path).first().value == "one"
    for n in (30, 40):
        sinks.write_tiles(made(n), spark.createDataFrame([(str(n),)], "value string"), path)
        assert sinks.read_tiles(spark, path).count() == n and sinks.read_tileset(spark, path).first().value == str(n)
    assert (tmp_path / "out" / "textures").exists() and len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("run-")]) == 2


def test_csv_points_order(spark):
    df = spark.createDataFrame([(1.5, 2.5, 3.5, 254.6)], "x double, y double, z double, red double").withColumns({"green": F.lit(1), "blue": F.lit(2)})
    assert sinks.csv_points(df).columns == ["X", "Y", "Z", "Red", "Green", "Blue"]
    assert tuple(sinks.csv_points(df).first()) == (1.5, 2.5, 3.5, 255, 1, 2)
    assert sinks.csv_points(df, ["z", "x"]).columns == ["Z", "X"]
