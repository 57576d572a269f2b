"""What larger tables brought up: how work is dealt, and the order of parts."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from geojobs.operators import cloud, mesh, simplify, storage, surfaces, triangulate
from geojobs.plans import fixtures, mesh_queries
from geojobs.plans.shapes import polygons
from geojobs.sources import collections, files, shapefile


def test_ply_header_is_that_of_the_first_part(spark, tmp_path):
    """The part that holds the header is the smallest one; Spark reads large files first."""
    (tmp_path / "part-00000.txt").write_text("ply\nformat ascii 1.0\nelement vertex 401\n")
    (tmp_path / "part-00001.txt").write_text("property double x\nend_header\n0.5\n")
    (tmp_path / "part-00002.txt").write_text("".join(f"{k}\n" for k in range(400)))
    rows = files.read_ply(spark, str(tmp_path)).orderBy("pid").collect()
    assert [(r["pid"], r["x"]) for r in rows] == [(0, 0.5)] + [(k + 1, float(k)) for k in range(400)]


def test_polygons_are_dealt_by_their_number(spark, small):
    """The parts' file is one small split: without dealing, one task makes all shapes."""
    n = polygons(spark, small).count()
    tasks = storage.spread(spark.range(12_001, numPartitions=1), 1_000).select(F.spark_partition_id().alias("t")).groupBy("t").count().collect()
    assert len(tasks) == 13 and max(r["count"] for r in tasks) < 1_500
    assert n == spark.read.parquet(f"{small}/part.parquet").count()
    assert polygons(spark, small).rdd.getNumPartitions() == -(-n // 5_000)
    assert polygons(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 4


def mesh_rows(spark, points, triangles):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "vid long, x double, y double, z double"), spark.createDataFrame(triangles, "fid long, a long, b long, c long")


def linked(pairs, n):
    to = list(range(n))

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        to[b] = a
    return [root(i) for i in range(n)]


def test_near_pairs_link_like_all_pairs(spark):
    """Sparse places, a crowd, a chain over cells' borders, copies, places below zero."""
    rng, t = np.random.default_rng(7), 0.01
    points = np.concatenate([rng.uniform(-1, 1, (150, 3)), rng.uniform(-0.04, 0.04, (150, 3)), [[0.009 * k - 0.2, 0.08, -0.08] for k in range(45)], [[0.5, 0.5, 0.5]] * 3])
    pairs = mesh.near_pairs(mesh_rows(spark, points, [])[0], t).collect()
    apart = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    assert all(apart[r["a"], r["b"]] <= t * t for r in pairs)
    assert linked([(r["a"], r["b"]) for r in pairs], len(points)) == linked(np.argwhere(apart <= t * t).tolist(), len(points))


def test_lonely_vertices_ask_no_cells(spark, monkeypatch):
    """Only the places of crowded cells ask the cells about them."""
    asked, plain = [], mesh._crowded_pairs
    monkeypatch.setattr(mesh, "_crowded_pairs", lambda spots, t: asked.append(spots.count()) or plain(spots, t))
    v, _ = mesh_rows(spark, [(1.5 * k, 0, 0) for k in range(100)] + [(1.5 * k + 0.00005, 0, 0) for k in range(0, 100, 7)], [])
    assert mesh.near_pairs(v, 0.0001).distinct().count() == 15 and asked == [0]


def test_wide_faces_keeps_faces_of_one_number(spark):
    """Two files' faces may have the same number; a face with an unknown corner goes."""
    v, f = mesh_rows(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], [(1, 0, 1, 2), (1, 1, 3, 2), (2, 0, 1, 9)])
    rows = mesh.wide_faces(v, f).collect()
    assert sorted((r["a"], r["b"], r["c"], r["bx"], r["cy"]) for r in rows) == [(0, 1, 2, 1.0, 1.0), (1, 3, 2, 1.0, 1.0)]
    assert "Aggregate" not in mesh.wide_faces(v, f)._jdf.queryExecution().toString()


def smoothed(points, triangles, iterations=10):
    """Taubin smoothing of a few vertices in plain Python."""
    near = {k: set() for k in points}
    for _, *abc in triangles:
        for u in abc:
            if u in points:
                near[u] |= {v for v in abc if v != u and v in points}
    for factor in (0.5, -0.53) * iterations:
        points = {u: np.array(p) + factor * (np.mean([points[v] for v in sorted(near[u])], axis=0) - p) if near[u] else np.array(p) for u, p in points.items()}
    return points


def test_taubin_in_blocks(spark, monkeypatch):
    """Blocks with rims take all steps; beside a long side, and in crowded blocks, joins do. No result differs."""
    n, rng = 24, np.random.default_rng(3)
    points = [(i, j, rng.uniform(0, 1)) for j in range(n) for i in range(n)] + [(900.0, 900.0, 1.0)]
    cells = [j * n + i for j in range(n - 1) for i in range(n - 1)]
    triangles = [(2 * k + t, v, *((v + 1, v + n + 1) if t == 0 else (v + n + 1, v + n))) for k, v in enumerate(cells) for t in (0, 1)]
    asked, plain = [], mesh._smooth_by_joins
    monkeypatch.setattr(mesh, "_smooth_by_joins", lambda v, f, s, todo: asked.append(todo.count()) or plain(v, f, s, todo))
    for more, iterations, crowd in (([], 1, 10**6), ([(9999, 5, 6, 77_777)], 2, 10**6), ([(9998, 0, 1, n * n)], 1, 10**6), ([], 1, 200)):
        shapes, factors = triangles + more, [0.5, -0.53] * iterations
        v, f = mesh_rows(spark, points, shapes)
        got = {r["vid"]: (r["x"], r["y"], r["z"]) for r in mesh._smooth(v, f, factors, crowd).collect()}
        want = smoothed(dict(enumerate(points)), shapes, iterations)
        assert sorted(got) == sorted(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert len(asked) == 2 and 0 < asked[0] < 40 and asked[1] > 40


def test_taubin_takes_no_join_a_step(spark, monkeypatch):
    """Twenty half-steps of a plain mesh cost no join of all sides each."""
    steps = []
    monkeypatch.setattr(mesh, "smooth_step", lambda *a: steps.append(a))
    v, f = mesh_rows(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 1)], [(0, 0, 1, 2), (1, 1, 3, 2)])
    got = np.array([[r.x, r.y, r.z] for r in mesh.taubin(v, f).orderBy("vid").collect()])
    want = smoothed(dict(enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 1)])), [(0, 0, 1, 2), (1, 1, 3, 2)])
    assert np.allclose(got, [want[k] for k in range(4)]) and not steps


def test_faces_meet_corners_in_tasks_by_their_number(spark, monkeypatch):
    """More vertices, more tasks: no task's share of the sort grows with the mesh."""
    monkeypatch.setattr(mesh, "SHARE", 10)
    v, f = mesh_rows(spark, [(k, 0, 0) for k in range(101)], [(k, k, k + 1, k + 2) for k in range(99)])
    wide = mesh.wide_faces(v, f)
    assert wide.rdd.getNumPartitions() == 11 and wide.count() == 99


def test_small_ranges_of_a_collection_share_a_task(spark, tmp_path, monkeypatch):
    """A task for each range of some bytes costs more in starts than in reading."""
    place = tmp_path / "a.json"
    place.write_text('{"type":"FeatureCollection","features":[' + ",".join(f'{{"type":"Feature","properties":{{"k":{k}}},"geometry":null}}' for k in range(300)) + "]}")
    tasks, plain = [], collections.settle
    monkeypatch.setattr(collections, "settle", lambda df: tasks.append(df.rdd.getNumPartitions()) or plain(df))
    listed = spark.createDataFrame([(f"file:{place}", place.stat().st_size)], "file string, length long")
    assert collections.features(listed, 64).count() == 300 and tasks[0] <= spark.sparkContext.defaultParallelism


def test_small_ranges_of_a_layer_share_a_task(spark, tmp_path):
    square = [[[0.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0]]]
    for name in "ab":
        shapefile.write(f"file:{tmp_path}/{name}", [({"name": f"{name}{k}"}, "Polygon", square) for k in range(250)], ["name"])
    rows = files.read_shapefiles(spark, str(tmp_path), ["name"], records=10)
    assert rows.rdd.getNumPartitions() == 1
    assert sorted((r["name"], r["gid"]) for r in rows.collect()) == sorted((f"{n}{k}", k + 1) for n in "ab" for k in range(250))
    assert files.read_shapefiles(spark, str(tmp_path), ["name"], records=10_000).rdd.getNumPartitions() == 2


def test_only_faces_across_tile_lines_go_to_python(spark, monkeypatch):
    """Faces within a tile stay columns; pieces are those of ``_cut`` at every level, at lines, for flat and for large faces."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(0, 9, (60, 3)).astype(float), rng.uniform(0, 8, (60, 3)), [[0, 0, 0], [8, 8, 8]]])
    shapes = [(k, *rng.integers(0, len(points), 3).tolist()) for k in range(80)] + [(80 + k, k, 60 + k, k) for k in range(5)]
    v, f = mesh_rows(spark, points, shapes)
    got = {(r["level"], r["fid"], r["part"], r["y"], r["x"], *(r[c] for c in mesh._CORNERS)) for r in mesh.cut_tiles(v, f, 2, 0.0).where("home").collect()}
    want = set()
    for level in range(3):
        made = mesh._cut(np.array([s[0] for s in shapes]), points[np.array([s[1:] for s in shapes])], 0.0, 8.0, 8 / 2**level, 8 / 2**level, 2**level)
        want |= {(level, r.fid, r.part, r.y, r.x, *(getattr(r, c) for c in mesh._CORNERS)) for r in made.itertuples()}
    assert got == want
    small, one = mesh_rows(spark, [(0, 0, 0), (0.5, 0, 0), (0, 0.5, 0), (8, 8, 0)], [(0, 0, 1, 2)])
    monkeypatch.setattr(mesh, "_cut", None)  # nothing to cut: Python isn't asked
    assert mesh.cut_tiles(small, one, 3, 0.0).where("home").count() == 4


def test_nearest_asks_the_cells_about_a_place(monkeypatch):
    """Distances are those of all pairs, for crowds, lonely places and places of several points; few pairs are compared."""
    rng, k = np.random.default_rng(2), 8
    xyz = np.concatenate([rng.uniform(0, 100, (3_000, 3)), rng.normal(50, 0.5, (900, 3)), rng.uniform(300, 400, (5, 3))])
    times = rng.choice([1, 1, 1, 2, 12], len(xyz))
    rows = pd.DataFrame({"spot": np.arange(len(xyz)), **dict(zip("xyz", xyz.T)), "n": times, "ask": False})
    pairs, plain = [], np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda d, *a, **b: pairs.append(d.size) or plain(d, *a, **b))
    got = cloud._nearest(k)((0,), pd.concat([rows[::3].assign(ask=True), rows]))
    for spot, near in zip(got["spot"], got["near"]):
        d = np.sqrt(((xyz - xyz[spot]) ** 2).sum(axis=1))
        d[spot] = np.inf
        assert np.allclose(near, np.sort(np.repeat(d, times))[:k])
    assert got["spot"].tolist() == rows["spot"][::3].tolist()
    pairs.clear()
    flat = rows.assign(z=rows["z"] / 100, n=1)[:3_000]
    cloud._nearest(k)((0,), pd.concat([flat.assign(ask=True), flat]))
    assert sum(pairs) < 0.3 * len(flat) ** 2


def star(rng, n, middle=(0.0, 0.0), size=1.0):
    turn, far = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.3, 1, n) * size
    xyz = np.stack([middle[0] + far * np.cos(turn), middle[1] + far * np.sin(turn), rng.uniform(0, 1, n)], axis=1).round(2)
    return np.concatenate((xyz, xyz[:1]))


def test_rings_of_one_size_are_clipped_together(monkeypatch):
    """The ears of many rings are those of each, and a polygon like the one before is bridged once."""
    rng = np.random.default_rng(5)
    shapes = [[star(rng, n)] + ([star(rng, 4, size=0.15)] if k % 2 else []) for n in (5, 9, 14) for k in range(60)]
    together = triangulate._meshes(shapes)
    one_by_one = [triangulate._meshes([s])[0] for s in shapes]
    monkeypatch.setattr(triangulate, "FEW", 0)  # each ring by itself, in a grid
    alone = triangulate._meshes(shapes)
    for a, b, c in zip(together, one_by_one, alone):
        assert (a is None) == (b is None) == (c is None)
        assert a is None or all(np.array_equal(x, y) and np.array_equal(x, z) for x, y, z in zip(a, b, c))
    assert sum(a is not None and len(a[1]) > 2 for a in together) > 120
    bridged, plain = [], triangulate._bridged
    monkeypatch.setattr(triangulate, "_bridged", lambda *a: bridged.append(1) or plain(*a))
    hole = [np.array([[x, y, 0.0] for x, y in r]) for r in ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)])]
    made = triangulate._meshes([hole, [r.copy() for r in hole], None, hole])
    assert len(bridged) == 2 and made[1] is made[0] and len(made[3][1]) == 8 and not len(made[2][1])
    assert triangulate._meshes([[np.array([[0, 0, 0], [1, np.nan, 0], [1, 1, 0], [0.2, 0.1, 0], [0, 0, 0]], float)]]) == [None]


def test_rings_that_keep_their_corners_need_no_grid(monkeypatch):
    rng = np.random.default_rng(6)
    shapes = [[star(rng, int(n))] for n in rng.integers(4, 9, 300)]
    want = [simplify.simplify_rings(s, 0.2) for s in shapes]
    kept = simplify._keeps(shapes, [0.2] * len(shapes))
    assert 5 < sum(kept) < 200 and all(len(w[0]) == len(s[0]) for s, w, k in zip(shapes, want, kept) if k)
    assert simplify._keeps([None, shapes[0], [star(rng, 30)]], [0.2, None, 1e-9]) == [True, True, False]
    monkeypatch.setattr(simplify, "Grid", None)
    round_ = [[np.cos(k % 30 / 30 * 2 * np.pi), np.sin(k % 30 / 30 * 2 * np.pi), 0.0] for k in range(31)]
    assert len(simplify.simplify_rings([np.array(round_)], 1e-9)[0]) == 31


def test_solids_tell_the_ends_of_their_triangles(spark):
    """Tiles ask for numbers beside the triangles; heights that are null are none."""
    square = [[0.0, 0.0, None], [3.0, 0.0, 1.0], [3.0, 2.0, 1.0], [0.0, 2.0, 1.0], [0.0, 0.0, None]]
    rows = spark.createDataFrame([(0, "Polygon", [square], 2.0), (1, "Polygon", None, 2.0), (2, "Point", [[[1.0, 2.0, 3.0]]], 2.0), (3, "Polygon", [square], None)], "gid int, t string, r array<array<array<double>>>, u double")
    rows = rows.select("gid", F.struct(F.col("t").alias("type"), F.col("r").alias("rings")).alias("geom"), "u").repartition(1)
    for removed, n in ((True, 10), (False, 12)):
        made = surfaces.solids(rows, F.lit(None), F.col("u"), F.lit(1), removed).orderBy("gid").collect()
        assert [(r["_count"], r["_center"], r["_box"]) for r in made] == [(n, [1.5, 1.0], [0.0, 0.0, 1.0, 3.0, 2.0, 3.0]), (0, None, None), (0, None, None), (2, [1.5, 1.0], [0.0, 0.0, 1.0, 3.0, 2.0, 2.0])]
        assert [len(r["triangles"]) for r in made] == [n, 0, 0, 2] and [r[surfaces.BECAUSE] for r in made] == [None, "no area", "no polygon", None]


def test_tiles_without_vertex_counts_join_faces_once(spark, small):
    """A tile's centre and size don't ask for its vertices: the faces are joined with their corners once, not once more for counting."""
    plan = mesh_queries.snk_tile_info(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3


def test_lookups_of_a_fixture_are_dealt_by_rows(spark, small, monkeypatch):
    """The mesh's faces look their orders up in tasks by the number of orders, vertices are told apart in tasks by theirs."""
    rows = fixtures.fixture(spark, small, "mesh_faces").count()
    monkeypatch.setattr(fixtures, "SHARE", 100)
    faces = fixtures.fixture(spark, small, "mesh_faces")
    plan = faces._jdf.queryExecution().executedPlan().toString()
    assert ", 15), REPARTITION_BY_NUM" in plan and faces.count() == rows
    v, f = mesh_rows(spark, [(k, 0, 0) for k in range(101)], [(k, k, k + 1, k + 2) for k in range(99)])
    placed = mesh.face_tiles(v, f, 1, 0.0)
    few, many = mesh.tile_stats(placed), mesh.tile_stats(placed, 11)
    assert sorted(few.collect()) == sorted(many.collect()) and {r["vertices"] for r in few.where("level = 0").collect()} == {101}
    assert ", 11), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
