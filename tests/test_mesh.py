"""Meshes: cutting, tiles and coarsening against plain geometry."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from geojobs.operators import mesh, tiling
from geojobs.plans import jobs


def area(pieces):
    p = {k: pieces[[k + c for c in "xyz"]].to_numpy(float) for k in "abc"}
    return float(np.linalg.norm(np.cross(p["b"] - p["a"], p["c"] - p["a"]), axis=1).sum() / 2)


def soup(spark, n, size, span=64.0, seed=2):
    """Random triangles, many larger than a tile and its margin."""
    rng = np.random.default_rng(seed)
    at = rng.uniform(0, span, (n, 1, 3)) + rng.uniform(-size, size, (n, 3, 3))
    at[0, 0] = at[0, 1] = at[0, 2]  # without area
    corners = at.reshape(-1, 3)
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(corners)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(n)] + [(n, 0, 1, 10**9)], "fid long, a long, b long, c long")
    total = float(np.linalg.norm(np.cross(at[:, 1] - at[:, 0], at[:, 2] - at[:, 0]), axis=1).sum() / 2)
    return v, f, total, corners


@pytest.mark.parametrize("size", [0.5, 30.0])
def test_cut_tiles_hold_the_whole_mesh_at_every_level(spark, size):
    v, f, total, corners = soup(spark, 60, size)
    pieces = mesh.cut_tiles(v, f, 4, 1.0).toPandas()
    (left, low), (right, top) = corners[:, :2].min(axis=0), corners[:, :2].max(axis=0)
    for level in range(5):
        at = pieces[pieces.level == level]
        assert area(at[at.home]) == pytest.approx(total)
        w, h = (right - left) / 2**level, (top - low) / 2**level
        for k in "abc":
            assert (at[k + "x"] >= left + at.x * w - 1 - 1e-9).all() and (at[k + "x"] <= left + (at.x + 1) * w + 1 + 1e-9).all()
            assert (at[k + "y"] <= top - at.y * h + 1 + 1e-9).all() and (at[k + "y"] >= top - (at.y + 1) * h - 1 - 1e-9).all()


def test_coarsen_heavy_tiles_only(spark):
    v, f, _, _ = soup(spark, 300, 2.0)
    pieces = mesh.cut_tiles(v, f, 2, 0.0)
    out = mesh.coarsen(pieces, 2, target=150, size=16.0).toPandas()
    before = pieces.toPandas()
    n = before.groupby(["level", "y", "x"]).size()
    m = out.groupby(["level", "y", "x"]).size()
    assert n[(0, 0, 0)] > 150 and m[(0, 0, 0)] < n[(0, 0, 0)]
    light = n[(n <= 150) | (n.index.get_level_values(0) == 2)]
    assert (m[light.index] == light).all()
    rows = before[before.level == 0]
    cells: dict = {}
    for k in "abc":
        for p in rows[[k + c for c in "xyz"]].to_numpy():
            cell = tuple(np.floor(p / 16.0))
            cells[cell] = min(cells.get(cell, tuple(p)), tuple(p))
    want = []
    for p in rows[[k + c for k in "abc" for c in "xyz"]].to_numpy().reshape(-1, 3, 3):
        to = [cells[tuple(np.floor(q / 16.0))] for q in p]
        if len(set(to)) == 3:
            want.append(tuple(x for q in to for x in q))
    got = out[out.level == 0][[k + c for k in "abc" for c in "xyz"]]
    assert sorted(want) == sorted(map(tuple, got.to_numpy()))


def test_mesh_job_honours_its_settings(spark):
    v, f, _, _ = soup(spark, 300, 2.0)
    rows = {last: jobs.mesh_tiles(v, f, {"depth": "1", "tile_faces_target": "20", "decimate_last_depth_level": last}, 0.0) for last in ("false", "true")}
    deepest = {k: r["tiles"].where("level = 1").agg(F.sum("faces")).first()[0] for k, r in rows.items()}
    assert deepest["true"] < deepest["false"]
    assert rows["true"]["tileset"].count() == 1
    empty = jobs.mesh_tiles(v.limit(0), f.limit(0), {"depth": "1"})
    assert empty["faces"].count() == empty["tiles"].count() == 0


@pytest.mark.parametrize("split", [1, 2, 4])
def test_tileset_documents_hold_every_tile_once(spark, split):
    v, f, _, _ = soup(spark, 200, 2.0)
    flat = tiling.tileset_flat(mesh.tile_stats(mesh.cut_tiles(v, f, 3, 0.0)), [64.0, 64.0, 64.0], 3, 256.0)
    docs = {r.path: json.loads(r.tileset) for r in tiling.tileset_json(flat, 3, 256.0, split).collect()}
    rows = {r.uri: r for r in flat.collect()}
    seen = []

    def walk(node, error):
        uri = node.get("content", {}).get("uri")
        assert node["geometricError"] <= error and len(node["boundingVolume"]["box"]) == 12
        if uri and uri.endswith(".json"):
            assert "children" not in node
            return walk(docs[uri]["root"], error)
        if uri:
            seen.append(uri)
            assert node["boundingVolume"]["box"] == pytest.approx(list(rows[uri].box)) and len(node.get("children", [])) == rows[uri].children
        for child in node.get("children", []):
            walk(child, node["geometricError"])

    walk(docs["tileset.json"]["root"], docs["tileset.json"]["geometricError"])
    assert sorted(seen) == sorted(rows) and (len(docs) > 1) == (split < 4)


@pytest.mark.parametrize("split", [1, 2, 4])
def test_adaptive_tilesets_hold_every_leaf_once(spark, split):
    """Leaves of mixed depth in two levels of detail, the second coarser here and finer there: one tree, boxes within boxes, errors that fall."""
    leaves = [(0, 1, (0, 0)), (0, 1, (1, 0)), (0, 2, (0, 2)), (0, 2, (1, 3)), (0, 3, (6, 6)), (0, 3, (7, 7)), (1, 2, (0, 0)), (1, 3, (3, 3)), (1, 1, (1, 0)), (1, 2, (0, 2)), (1, 1, (1, 1))]
    rows = [(lod, level, list(t), [t[0] / 2**level, t[1] / 2**level, (t[0] + 1) / 2**level, (t[1] + 1) / 2**level, float(lod), float(level)], 5) for lod, level, t in leaves]
    df = spark.createDataFrame(rows, "lod int, level int, tile array<long>, region array<double>, features long")
    nodes = tiling.adaptive_nodes(df, 100.0, 2.0)
    found = {r.id: r for r in nodes.collect()}
    assert {i for i, r in found.items() if r.features} == {f"{lod}_{level}_{t[1]}_{t[0]}" for lod, level, t in leaves}
    assert {i: r.parent for i, r in found.items() if i[0] == "1"} == {"1_2_0_0": "0_1_0_0", "1_3_3_3": "1_2_1_1", "1_2_1_1": "0_1_0_0", "1_1_0_1": "0_1_0_1", "1_2_2_0": "0_2_2_0", "1_1_1_1": "0_1_1_1"}
    assert [i for i, r in found.items() if r.parent is None] == ["0_0_0_0"] and all(r.parent in found for r in found.values() if r.parent)
    docs = {r.path: json.loads(r.tileset) for r in tiling.adaptive_documents(nodes, 100.0, split).collect()}
    seen = []

    def walk(node, error, outer):
        box, uri = node["boundingVolume"]["region"], node.get("content", {}).get("uri")
        assert node["geometricError"] <= error and all(outer[i] <= box[i] + 1e-12 if i in (0, 1, 4) else box[i] <= outer[i] + 1e-12 for i in range(6))
        if uri and uri.endswith(".json"):
            assert "children" not in node
            return walk(docs[uri]["root"], error, outer)
        if uri:
            seen.append(uri)
        for child in node.get("children", []):
            walk(child, node["geometricError"], box)

    root = docs["tileset.json"]
    walk(root["root"], root["geometricError"], [-9, -9, 9, 9, -9, 9])
    assert sorted(seen) == sorted(f"tiles/{i}.glb" for i, r in found.items() if r.features) and (len(docs) > 1) == (split < 4)
    assert tiling.adaptive_documents(tiling.adaptive_nodes(df.limit(0), 100.0), 100.0).count() == 0


def test_polygon_jobs_keep_a_budget_for_each_level_of_detail(spark, small):
    from geojobs.plans import jobs
    from geojobs.plans.shapes import polygons

    config = {"upper_limit_height": 9, "max_features_per_tile": 50}
    one = jobs.polygon_tiles(polygons(spark, small), config)["tiles"].collect()
    out = jobs.polygon_tiles(polygons(spark, small), config | {"add_lod": "true", "lod_max_simplify_tolerance": 0.001})
    both = out["tiles"].collect()
    key = lambda r: (r.level, *r.tile, r.features)
    assert sorted(map(key, one)) == sorted(key(r) for r in both if r.lod == 0) == sorted(key(r) for r in both if r.lod == 1)
    assert max(r.features for r in both) <= 50 and json.loads(out["tileset"].where("path = 'tileset.json'").first().tileset)["root"]["children"]


def test_weld_by_distance_against_all_pairs(spark):
    """Chains of near vertices, twins at one place, neighbours over the borders of cells, null coordinates."""
    rng = np.random.default_rng(2)
    t = 0.1
    xyz = np.concatenate((rng.uniform(-1, 1, (250, 3)), np.repeat(rng.uniform(-1, 1, (5, 3)), 6, axis=0), [[3 + 0.09 * i, 0, 0] for i in range(12)], [[5, 0, 0], [5.1000001, 0, 0], [6, 0, 0], [6.0999999, 0, 0]]))
    n = len(xyz)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ((xyz[i] - xyz[j]) ** 2).sum() <= t * t:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    faces = [tuple(map(int, rng.choice(n, 3, replace=False))) for _ in range(300)]
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)] + [(n, None, 0.0, 0.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i, *c) for i, c in enumerate(faces)], "fid long, a long, b long, c long")
    kept, out = mesh.weld(v, f, t, near=True)
    assert {r.vid for r in kept.collect()} == {find(i) for i in range(n)} | {n}
    want = {(i, *map(find, c)) for i, c in enumerate(faces) if len(set(map(find, c))) == 3}
    assert {tuple(r) for r in out.select("fid", "a", "b", "c").collect()} == want and len({find(i) for i in range(n)}) < n - 40


def test_taubin_against_numpy(spark):
    rng = np.random.default_rng(5)
    n, xyz = 40, rng.uniform(size=(40, 3))
    faces = [tuple(map(int, rng.choice(n, 3, replace=False))) for _ in range(60)]
    near = np.zeros((n, n), bool)
    for a, b, c in faces:
        for p, q in ((a, b), (b, c), (c, a)):
            near[p, q] = near[q, p] = True
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i, *t) for i, t in enumerate(faces)], "fid long, a long, b long, c long")
    want = xyz.copy()
    for _ in range(10):
        for factor in (0.5, -0.53):
            mean = np.where(near.any(1)[:, None], near @ want / np.maximum(near.sum(1), 1)[:, None], want)
            want = want + factor * (mean - want)
    got = np.array([[r.x, r.y, r.z] for r in mesh.taubin(v, f).orderBy("vid").collect()])
    assert np.allclose(got, want)
