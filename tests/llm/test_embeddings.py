import numpy as np
import pytest

from geojobs.llm import embeddings


def brute(ids, vectors, dims):
    ok = np.array([v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors])
    x = np.array([v if o else [0.0] * dims for v, o in zip(vectors, ok)], float)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    link = (x @ x.T >= 0.9) & ok[:, None] & ok[None, :]
    np.fill_diagonal(link, False)
    comp = list(range(len(ids)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in zip(*np.nonzero(link)):
        a, b = sorted((root(i), root(j)))
        comp[b] = a
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return link.sum(1), [low.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("leaf,block", [(1200, 4096), (60, 4096), (60, 25)])
def test_against_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(2)
    dims, vectors = 16, []
    for c in rng.normal(size=(40, dims)):
        vectors += [(c + s * rng.normal(size=dims)).tolist() for s in rng.choice([0.05, 0.15, 0.25], int(rng.integers(1, 12)))]
    hot = rng.normal(size=dims)
    vectors += [(hot + 0.02 * rng.normal(size=dims)).tolist() for _ in range(150)] + [hot.tolist()] * 3
    vectors += [None, [], [0.0] * dims, [float("nan")] * dims, [1.0, None] * 8, [1.0] * 3, [float("inf")] + [1.0] * 15, [1e300] * dims, [1e-300] * dims]
    ids = [int(i) * 3 for i in rng.permutation(len(vectors))]
    ids[0] = None
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, label int, row int").repartition(3)
    out = {r.vec_id: r for r in embeddings.near_duplicates(df, leaf=leaf, sample=200).collect()}
    links, comps = brute(ids, vectors, dims)
    assert len(out) == len(ids)
    found = sum(out[i].n_links for i in ids)
    assert all(out[i].n_links <= n for i, n in zip(ids, links))
    assert found >= 0.93 * links.sum() and sum(out[i].component_id == c for i, c in zip(ids, comps)) >= 0.97 * len(ids)
    assert all(r.kept == (r.vec_id == r.component_id and r.vec_id is not None) for r in out.values())
    if leaf > len(ids):
        assert found == links.sum()


def test_empty_and_all_odd(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0])], schema)).where("kept and n_links = 0").count() == 2


def forest(x, leaf, task_rows, spark, sample):
    """Leaves of each row after the top on a sample and all refinement."""
    splits = {(t, n): s for t in range(embeddings.TREES) for n, s in embeddings.fit_tree(x[:sample], t, max(1, leaf * sample / len(x))).items()}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, vector array<double>").repartition(4)
    routed = df.mapInArrow(embeddings._router(splits, embeddings.TREES), "row long, vector array<double>, leaves array<bigint>")
    return embeddings.refine(embeddings.stash(routed), leaf, task_rows)


@pytest.mark.parametrize("task_rows", [100_000, 150])
def test_recall_of_deep_trees(spark, task_rows):
    """Pairs of cosine 0.90 to 0.93 in trees of many levels, split by tasks alone or by all tasks together first."""
    rng = np.random.default_rng(7)
    n, dims, leaf = 2000, 64, 12
    a = rng.normal(size=(n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, dims))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.93, (n, 1))
    x = np.concatenate((a, c * a + np.sqrt(1 - c * c) * b))
    rows = forest(x, leaf, task_rows, spark, 300).collect()
    leaves = {r.row: set(r.leaves) for r in rows}
    assert len(rows) == len(x) and {v >> 48 for v in leaves[0]} == set(range(embeddings.TREES))
    sizes: dict = {}
    for own in leaves.values():
        for v in own:
            sizes[v] = sizes.get(v, 0) + 1
    assert max(sizes.values()) <= 2 * leaf and max(v & embeddings.NODE for v in sizes) >= 1 << 8
    assert sum(bool(leaves[i] & leaves[n + i]) for i in range(n)) >= 0.97 * n
