import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from geojobs.llm import components, simhash
from geojobs.llm.components import connected_components


def brute(texts):
    out = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for s in "\t\n\x0b\x0c\r":
            words = words.replace(s, " ")
        words = [w for w in words.split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        out.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    return out


def closure(ids, fps):
    comp = list(range(len(fps)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    known = {}
    for i, d in enumerate(ids):
        if d is not None:
            known[root(i)] = min(d, known.get(root(i), d))
    return [known.get(root(i)) for i in range(len(ids))]


def test_brute_force(make, odd):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    rows = list(odd)
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 400))]
        for v in range(5):
            copy = list(base)
            for _ in range(v):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((100 + 10 * g + v, " ".join(copy)))
    fps = brute([t for _, t in rows])
    want = sorted(zip([-1 if i is None else i for i, _ in rows], [f"{f:016x}" for f in fps], closure([i for i, _ in rows], fps)), key=str)
    got = simhash.near_duplicates(make(rows)).collect()
    assert sorted([(-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == want


def test_links_find_every_near_fingerprint(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 5) for _ in range(8)}
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    want = closure(fps.view(np.int64).tolist(), fps.tolist())
    for most in (simhash.MAX_POSTING, 4):  # with and without finer postings
        found = {r.node: r.component for r in connected_components(simhash.links(df, most)).collect()}
        got = [found.get(int(f), int(f)) for f in fps.view(np.int64)]
        groups = lambda labels: {frozenset(np.flatnonzero(np.array(labels) == x).tolist()) for x in set(labels)}
        assert groups(got) == groups(want)


def test_blocks_cover_every_five_positions():
    from itertools import combinations

    blocks = simhash._blocks()
    assert len(blocks) == 14 and all(any(set(b) <= set(c) for b in blocks) for c in combinations(range(8), 5))


def shared(a, b):
    return sum(int(x) >> 8 * p & 255 == int(y) >> 8 * p & 255 for p in range(8) for x, y in [(a, b)])


@pytest.mark.parametrize("size", [3, 60, 400])
def test_only_pairs_with_enough_shared_bytes_are_verified(monkeypatch, size):
    """The tally gates the verification: pairs below five shared positional bytes never reach it, and no link is lost."""
    rng = np.random.default_rng(size)
    fps = rng.integers(0, 4, (size, 8), dtype=np.uint8) * 17  # few values, so that tallies of all sizes occur
    fps = np.unique(fps.view("<u8").ravel())
    near = fps[: size // 3] ^ np.uint64(1 << 13)
    fps = np.unique(np.concatenate((fps, near)))
    seen = []
    plain = simhash._verified

    def record(a, b):
        a, b = np.broadcast_arrays(a, b)
        seen.extend(zip(a.tolist(), b.tolist()))
        return plain(a, b)

    monkeypatch.setattr(simhash, "_verified", record)
    linked = [(int(x), int(y)) for i, x in enumerate(fps) for y in fps[:i] if (int(x) ^ int(y)).bit_count() <= 3]
    for find in (simhash._small, simhash._forest):
        seen.clear()
        a, b = find(fps)
        assert seen and all(shared(x, y) >= simhash.MIN_BYTES for x, y in seen)
        assert any((x ^ y).bit_count() > 3 for x, y in seen) or size < 60
        groups = lambda pairs: {frozenset(g) for g in _groups(fps.tolist(), pairs)}
        assert groups(zip(a.tolist(), b.tolist())) == groups(linked)
    keys = pa.array(np.zeros(fps.size, np.int64))
    (batch,) = simhash._pairs(iter([pa.RecordBatch.from_arrays([keys, pa.array(fps.view(np.int64))], names=["key", "fp"])]))
    assert groups(zip(batch.column(0).to_numpy().view(np.uint64).tolist(), batch.column(1).to_numpy().view(np.uint64).tolist())) == groups(linked)


def _groups(nodes, pairs):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for x, y in pairs:
        top[root(x)] = root(y)
    found = {}
    for n in nodes:
        found.setdefault(root(n), set()).add(n)
    return found.values()


def test_keep_one(make, odd):
    kept = simhash.keep_one(make(odd)).collect()
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept)
    assert ids == [-1, 1, 2, 5, 6] and len(kept[0]) == 7


def test_empty(make):
    assert simhash.near_duplicates(make([])).count() == 0 and simhash.keep_one(make([])).count() == 0


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 3), (900, 901), (900, 901)], "a long, b long")
    out = {r.node: r.component for r in connected_components(edges).collect()}
    assert len(out) == 303 and {out[i] for i in range(301)} == {0} and out[901] == 900


def test_a_component_around_one_node_is_dealt_over_tasks(spark):
    """A star of 20,000 edges: its centre's rows go to several places, and the components are right."""
    star = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    least = star.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    plan = components.with_least(star, least, 1000)
    assert plan.count() == 20_000 and plan.where("m != 1").count() == 0
    salts = star.groupBy(F.pmod(F.xxhash64("b"), F.lit(20))).count().agg(F.max("count")).first()[0]
    assert salts < 1300
    found = components.connected_components(star.unionByName(spark.createDataFrame([(20_000, 20_001), (30_000, 30_001), (None, 1), (5, 5)], "a long, b long")))
    assert found.where("component = 0").count() == 20_002 and found.where("component = 30000").count() == 2
