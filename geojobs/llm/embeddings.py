"""Embedding near-duplicates by a forest of random-projection trees.

A tree splits its rows by a random direction at a middle value, again and again; rows near a split go down both sides (spill). The
top of every tree is fitted on a bounded sample of vectors and has a bounded number of splits, whatever the corpus; that alone is held by
the driver. A leaf that all rows together overfill is split further: by a task that holds its rows, or, where it has too many for one,
by middle values counted over all its rows and a join. Within leaves all pairs are compared in double precision. A pair that meets in
several leaves counts in the first of them alone, so that link counts add up. What can't be split, such as a group of near copies, is
compared in square blocks by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geojobs.llm.common import at_most, spread_join, stash
from geojobs.llm.components import connected_components

COSINE = 0.9
TREES, LEAF, SPILL, SEED = 10, 1200, 0.1, 7
#: Vectors that the trees' tops are fitted on: those of the smallest id hashes.
SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
#: Sample vectors of a top's leaf at least: some 4,000 splits a tree at most.
SAMPLE_LEAF = 16
#: Rows of a leaf that one task splits to the end (25 MB at 64 dimensions); larger ones are split by all tasks together first.
TASK_ROWS = 50_000
#: Leaves of which every task may hold the sizes or splits; of more, the rows are shuffled to them.
FEW = 500_000
#: Rows of a leaf that one task holds; larger ones are compared in blocks.
BLOCK = 4096
MAX_DEPTH = 40


def _direction(tree: int, node: int, dims: int) -> np.ndarray:
    d = np.random.default_rng([SEED, tree, node]).normal(size=dims)
    return d / np.linalg.norm(d)


def _children(values: np.ndarray, split: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Left and right of a split ``(middle, low, high)``: rows between low and high go both ways."""
    return values <= split[2], values >= split[1]


def _split(values: np.ndarray) -> tuple[float, float, float] | None:
    low, middle, high = np.quantile(values, [0.5 - SPILL / 2, 0.5, 0.5 + SPILL / 2])
    left, right = _children(values, (middle, low, high))
    return (float(middle), float(low), float(high)) if max(left.sum(), right.sum()) <= 0.8 * values.size else None


def fit_tree(sample: np.ndarray, tree: int, leaf: float) -> dict[int, tuple[float, float, float] | None]:
    """Splits by node (the root is 1, children 2n and 2n+1) until a node has ``leaf`` sample rows; None: can't be split."""
    nodes, splits = [(1, np.arange(len(sample)))], {}
    while nodes:
        node, rows = nodes.pop()
        if rows.size <= leaf or node >= 1 << MAX_DEPTH:
            continue
        values = sample[rows] @ _direction(tree, node, sample.shape[1])
        splits[node] = _split(values)
        if splits[node]:
            nodes += [(2 * node + side, rows[mask]) for side, mask in enumerate(_children(values, splits[node]))]
    return splits


def _router(splits: dict[tuple[int, int], tuple | None], trees: int) -> Callable:
    """(vec_id, vector) -> one row with the leaves of all trees: ``tree << 48 | node`` each, in order."""

    def route(x: np.ndarray) -> list[list[int]]:
        leaves: list[list[int]] = [[] for _ in range(len(x))]
        for tree in range(trees):
            nodes = [(1, np.arange(len(x)))]
            while nodes:
                node, rows = nodes.pop()
                split = splits.get((tree, node))
                if split is None or not rows.size:
                    for r in rows.tolist():
                        leaves[r].append(tree << 48 | node)
                    continue
                values = x[rows] @ _direction(tree, node, x.shape[1])
                nodes += [(2 * node + side, rows[mask]) for side, mask in enumerate(_children(values, split))]
        return [sorted(v) for v in leaves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(route(x), pa.list_(pa.int64()))], names=["row", "vector", "leaves"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(1)).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["row", "vector"])


def _compare(cosine: float) -> Callable:
    """Units of work (a leaf, or two blocks of one) -> per row its new links, and edges that connect what is linked."""

    def first_leaf(a: list, b: list, rows: np.ndarray, cols: np.ndarray, leaf: int) -> np.ndarray:
        """Whether ``leaf`` is the first that the pairs share."""
        ok = np.ones(rows.size, bool)
        width = max(max(map(len, a)), max(map(len, b)))
        pad = lambda ls, fill: np.array([[*v[:width], *[fill - i for i in range(width - len(v))]] for v in ls], np.int64)
        pa_, pb = pad(a, -1), pad(b, -100_000)
        for at in range(0, rows.size, 1 << 16):
            x, y = pa_[rows[at : at + (1 << 16)]], pb[cols[at : at + (1 << 16)]]
            x = np.where(x < leaf, x, -1)
            part = np.ones(len(x), bool)
            for j in range(width):
                part &= ~((x == y[:, j : j + 1]) & (x >= 0)).any(axis=1)
            ok[at : at + (1 << 16)] = part
        return ok

    def unit(leaf: int, ids: np.ndarray, x: np.ndarray, leaves: list, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts, parent = np.zeros(ids.size, np.int64), np.arange(ids.size)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        left = np.flatnonzero(side != 2)
        right = np.flatnonzero(side != 1)
        same = not (side > 0).any()
        for at in range(0, left.size, 512):
            part = left[at : at + 512]
            r, c = np.nonzero(x[part] @ x[right].T >= cosine)
            r, c = part[r], right[c]
            keep = r < c if same else np.ones(r.size, bool)
            r, c = r[keep], c[keep]
            if r.size:
                new = first_leaf(leaves, leaves, r, c, leaf)
                r, c = r[new], c[new]
                np.add.at(counts, r, 1)
                np.add.at(counts, c, 1)
                for i, j in zip(r.tolist(), c.tolist()):
                    i, j = root(i), root(j)
                    if i != j:
                        parent[max(i, j)] = min(i, j)
        tops = np.array([root(i) for i in range(ids.size)])
        return counts, ids[tops], ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["row", "links", "top"]

        def flush() -> pa.RecordBatch:
            ids = np.array([h[2] for h in held], np.int64)
            counts, tops, _ = unit(held[0][0], ids, np.array([h[3] for h in held]), [h[4] for h in held], np.array([h[5] for h in held]))
            some = (counts > 0) | (tops != ids)
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(counts[some]), pa.array(tops[some])], names=names)

        for batch in batches:
            vectors = _matrix(batch.column(3))
            rest = [batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)]
            for leaf, part, row, leaves, side, vector in zip(*rest, vectors):
                if held and held[0][:2] != (leaf, part):
                    if len(held) > 1:
                        yield flush()
                    held = []
                held.append((leaf, part, row, vector, leaves, side))
        if len(held) > 1:
            yield flush()

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> vec_id, n_links, component_id, kept; one row per row.

    Vectors that are null, empty, zero, or hold null or non-finite components, or have another dimension than most, link with nothing
    and are components of their own. Repeated ids count as vectors of their own; a null vec_id takes part, its component_id is the
    smallest id it reaches or null. Other columns are left out.
    """
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    raw = stash(raw.withColumn("row", F.monotonically_increasing_id()))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    usual = raw.where(finite).groupBy(F.size("vector").alias("dims")).count().orderBy(F.col("count").desc(), "dims").first()
    alone = raw.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if usual is None:
        return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    unit = stash(raw.where(finite & (F.size("vector") == usual["dims"])).select("row", "vector").mapInArrow(_unit, "row long, vector array<double>"))
    n = unit.count()
    # The driver holds the sample: at most SAMPLE_BYTES, however many dimensions there are.
    held = unit.orderBy(F.xxhash64("row"), "row").limit(max(1, min(sample, SAMPLE_BYTES // (8 * max(1, usual["dims"]))))).select("vector").toArrow()
    some = held.column(0).combine_chunks().flatten().to_numpy().reshape(-1, usual["dims"])
    top = max(min(SAMPLE_LEAF, leaf), leaf * len(some) / max(n, len(some)))
    splits = {(t, node): s for t in range(trees) for node, s in fit_tree(some, t, top).items()}
    routed = stash(unit.mapInArrow(_router(splits, trees), "row long, vector array<double>, leaves array<bigint>"))
    routed = refine(routed, leaf)
    work = _units(routed)
    found = stash(work.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "row").mapInArrow(_compare(cosine), "row long, links long, top long"))
    joined = connected_components(found.select(F.col("row").alias("a"), F.col("top").alias("b")))
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    placed = stash(raw.select("row", "vec_id").join(links, "row", "left").join(joined.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row")))
    lowest = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = spread_join(placed, lowest, "component", "row").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


NODE = (1 << 48) - 1


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, vector, leaf) -> the same and the vector's value along the direction of its leaf."""
    for batch in batches:
        x, leaves = _matrix(batch.column(1)), batch.column(2).to_numpy()
        values = np.zeros(len(x))
        for leaf in np.unique(leaves).tolist():
            values[leaves == leaf] = x[leaves == leaf] @ _direction(leaf >> 48, leaf & NODE, x.shape[1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=["row", "vector", "leaf", "value"])


def _split_here(leaf_rows: int) -> Callable:
    """(row, vector, leaf), a leaf's rows together -> row, leaf: split until no leaf has over ``leaf_rows`` rows or can be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None

        def flush() -> pa.RecordBatch:
            ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            nodes, rows, leaves = [(own & NODE, np.arange(ids.size))], [], []
            while nodes:
                node, some = nodes.pop()
                split = None
                if some.size > leaf_rows and node < 1 << MAX_DEPTH:
                    values = x[some] @ _direction(own >> 48, node, x.shape[1])
                    split = _split(values)
                if split is None:
                    rows.append(ids[some])
                    leaves.append(np.full(some.size, own >> 48 << 48 | node))
                else:
                    nodes += [(2 * node + side, some[mask]) for side, mask in enumerate(_children(values, split))]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(leaves))], names=["row", "leaf"])

        for batch in batches:
            ids, x, leaves = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(leaves[1:] != leaves[:-1]) + 1).tolist(), leaves.size] if leaves.size else []
            for a, b in zip(cuts, cuts[1:]):
                if held and own != leaves[a]:
                    yield flush()
                    held = []
                own = int(leaves[a])
                held.append((ids[a:b], x[a:b]))
        if held:
            yield flush()

    return run


def refine(routed: DataFrame, leaf: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``routed(row, vector, leaves)`` with leaves of over 2 ``leaf`` rows split further; only rows of such leaves are moved."""
    full = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 2 * leaf)
    full = stash(full)
    if full.isEmpty():
        return routed
    sizes = at_most(full, FEW)
    rows = routed.select("row", "vector", F.explode("leaves").alias("leaf")).join(sizes, "leaf")
    done = [routed.select("row", F.explode("leaves").alias("leaf")).join(sizes, "leaf", "left_anti").select("row", "leaf")]
    node = F.col("leaf").bitwiseAND(F.lit(NODE))
    while True:
        here = rows.where(F.col("size") <= task_rows).select("row", "vector", "leaf")
        done.append(here.repartition("leaf").sortWithinPartitions("leaf", "row").mapInArrow(_split_here(2 * leaf), "row long, leaf long"))
        large = rows.where(F.col("size") > task_rows).select("row", "vector", "leaf")
        valued = stash(large.mapInArrow(_project, "row long, vector array<double>, leaf long, value double"))
        if valued.isEmpty():
            break
        cuts = at_most(stash(valued.groupBy("leaf").agg(F.percentile_approx("value", [0.5 - SPILL / 2, 0.5, 0.5 + SPILL / 2], 1000).alias("q"))), FEW)
        left, right = F.col("value") <= F.col("q")[2], F.col("value") >= F.col("q")[0]
        counted = valued.select("leaf", "value").join(cuts, "leaf").groupBy("leaf").agg(F.first("q").alias("q"), F.count(F.lit(1)).alias("n"), F.count_if(left).alias("left"), F.count_if(right).alias("right"))
        splits = stash(counted.withColumn("ok", (F.greatest("left", "right") <= 0.8 * F.col("n")) & (node < 1 << MAX_DEPTH)))
        placed = valued.join(at_most(splits, FEW), "leaf")
        done.append(placed.where("not ok").select("row", "leaf"))
        sides = F.array_compact(F.array(F.when(left, F.lit(0)), F.when(right, F.lit(1))))
        below = placed.where("ok").select("row", "vector", "leaf", "left", "right", F.explode(sides).alias("side"))
        below = below.select("row", "vector", (F.col("leaf") + node + F.col("side")).alias("leaf"), F.when(F.col("side") == 0, F.col("left")).otherwise(F.col("right")).alias("size"))
        done.append(below.where(F.col("size") <= 2 * leaf).select("row", "leaf"))
        rows = below.where(F.col("size") > 2 * leaf)
    leaves = reduce(DataFrame.unionByName, done).groupBy("row").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    return stash(routed.select("row", "vector").join(leaves, "row"))


def _units(routed: DataFrame) -> DataFrame:
    """A row for each leaf of a vector; in a leaf of b blocks, one for each of the b block pairs that hold the vector's block.

    ``side``: 0 for a whole leaf or a block with itself, 1 and 2 for the blocks of a pair.
    """
    sizes = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    large = stash(sizes.where(F.col("size") > BLOCK).select("leaf", F.ceil(F.col("size") / BLOCK).cast("long").alias("b")))
    rows = routed.select("row", "vector", "leaves", F.explode("leaves").alias("leaf")).join(at_most(large, FEW), "leaf", "left")
    rows = rows.withColumn("b", F.coalesce("b", F.lit(1).cast("long"))).withColumn("mine", F.pmod(F.xxhash64("row"), F.col("b")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)))
    part = F.least("mine", "other") * F.col("b") + F.greatest("mine", "other")
    side = F.when(F.col("other") == F.col("mine"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return rows.select("leaf", part.alias("part"), "row", "vector", "leaves", side.cast("int").alias("side"))
