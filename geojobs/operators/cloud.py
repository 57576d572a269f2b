"""Point clouds: profile, thin, cut, classify, colour.

A cloud is ``DataFrame[pid, x, y, z, intensity, classification, red, green, blue, ...]``; ``pid`` is the record's place in its source.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geojobs.operators.storage import settle

NOISE, GROUND = 7, 2


def metadata(points: DataFrame) -> DataFrame:
    """One row: count, minimum, maximum, size and centre (minimum + size / 2) per axis."""
    box = points.agg(F.count(F.lit(1)).alias("count"), *[f(c).alias(n + c) for c in "xyz" for n, f in (("min_", F.min), ("max_", F.max))])
    size = box.withColumns({f"size_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"})
    return size.withColumns({f"center_{c}": F.col(f"min_{c}") + F.col(f"size_{c}") / 2 for c in "xyz"})


def stats(points: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """Per dimension: position, name, count, minimum, maximum, average, stddev, variance (sample)."""
    dims = dims or [c for c, kind in points.dtypes if c != "pid" and kind in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    rows = points.select(*[F.col(c).cast("double").alias(c) for c in dims])
    make = (("count", F.count), ("minimum", F.min), ("maximum", F.max), ("average", F.avg), ("stddev", F.stddev_samp), ("variance", F.var_samp))
    wide = rows.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(dims) for n, f in make])
    each = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), *[F.col(f"{n}_{i}").alias(n) for n, _ in make]) for i, c in enumerate(dims)])
    return wide.select(F.inline(each))


def decimate(points: DataFrame, cap: int = 500_000) -> DataFrame:
    """Every step-th record where there are more than ``cap``: step = ceil(count / cap), by ``pid``, or by rank where pids have gaps.

    One pass tells whether they do: as many as from 0 to the last, none twice (unique pids are the cloud's).
    """
    n, low, high = points.agg(F.count(F.lit(1)), F.min("pid"), F.max("pid")).first()
    if n <= cap:
        return points
    step = F.lit(-(-n // cap))
    if low == 0 and high == n - 1:
        return points.where(F.pmod("pid", step) == 0)
    return ranked(points).where(F.pmod("rank", step) == 0).drop("rank")


def ranked(points: DataFrame, key: str = "pid") -> DataFrame:
    """``rank``: the row's place by ``key`` from 0, without sorting all rows in one task."""
    ordered = settle(points.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("_part", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ordered.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_at") - F.col("_from") + F.col("_before")).drop("_part", "_at", "_from", "_before")


def divide(points: DataFrame, capacity: int, dense: bool = False) -> DataFrame:
    """``part``: contiguous runs of records, of sizes as alike as can be and at most ``capacity``."""
    n = points.count()
    parts = max(1, -(-n // capacity))
    each = max(1, -(-n // parts))
    rows = points.withColumn("rank", F.col("pid")) if dense else ranked(points)
    return rows.withColumn("part", F.floor(F.col("rank") / each)).drop("rank")


def affine(points: DataFrame, m: list[float]) -> DataFrame:
    """x, y, z under a row-major 4x4."""
    x, y, z = (F.col(c) for c in "xyz")
    moved = {c: x * float(m[4 * i]) + y * float(m[4 * i + 1]) + z * float(m[4 * i + 2]) + float(m[4 * i + 3]) for i, c in enumerate("xyz")}
    return points.withColumns(moved)


def centred(points: DataFrame, meta: DataFrame) -> DataFrame:
    """The cloud about its box's centre."""
    at = meta.select(*[F.col(f"center_{c}").alias(f"_{c}") for c in "xyz"])
    return points.crossJoin(F.broadcast(at)).withColumns({c: F.col(c) - F.col(f"_{c}") for c in "xyz"}).drop("_x", "_y", "_z")  # one row


def crop_xy(points: DataFrame, box: list[float]) -> DataFrame:
    """Points within [min x, min y, max x, max y], edges included."""
    return points.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def class_range(points: DataFrame, dim: str, low: float, high: float, keep: bool = True) -> DataFrame:
    """Points whose dimension is in a range, or those for which it isn't (nulls count as outside)."""
    inside = F.coalesce(F.col(dim).between(low, high), F.lit(False))
    return points.where(inside if keep else ~inside)


def class_assign(points: DataFrame, dim: str = "classification", value: int = 0) -> DataFrame:
    return points.withColumn(dim, F.lit(value))


def height_ramp(points: DataFrame) -> DataFrame:
    """``hue`` 0.5 to 0.9 by height for clouds without colour; ``r``, ``g``, ``b`` as shares of 255 for others."""
    if {"red", "green", "blue"} <= set(points.columns):
        return points.withColumns({c[0]: F.col(c) / 255 for c in ("red", "green", "blue")})
    span = points.agg(F.min("z").alias("_a"), F.max("z").alias("_b"))
    return points.crossJoin(F.broadcast(span)).withColumn("hue", 0.5 + F.try_divide(0.4 * (F.col("z") - F.col("_a")), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def class_color(classification: Column) -> Column:
    """Display colour of a class."""
    return (
        F.when(classification.isin(1, 2), "#FFDEAD").when(classification.isin(3, 4), "#63FF7E").when(classification == 5, "#22B33A").when(classification == 6, "#ff0000").otherwise("#808080")
    )


def merge(parts: list[DataFrame]) -> DataFrame:
    """Parts one after another; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def colorize(points: DataFrame, raster: DataFrame, geotransform: tuple[float, float, float, float]) -> DataFrame:
    """Colours of the raster's pixels: ``raster(r_row, r_col, r, g, b)``, geotransform (x0, dx, y0, dy). Points outside keep theirs."""
    x0, dx, y0, dy = geotransform
    at = points.withColumns({"r_col": F.floor((F.col("x") - x0) / dx), "r_row": F.floor((F.col("y") - y0) / dy)})
    joined = at.join(raster.select("r_row", "r_col", "r", "g", "b"), ["r_row", "r_col"], "left")
    return joined.withColumns({c: F.coalesce(F.col(c[0]), F.col(c)) for c in ("red", "green", "blue")}).drop("r_row", "r_col", "r", "g", "b")


def height_datum(points: DataFrame, grid: DataFrame, origin: tuple[float, float], step: float) -> DataFrame:
    """z + N: orthometric to ellipsoidal heights, N bilinear in ``grid(gi, gj, n)`` (rows by latitude). Null z outside the grid."""
    u, v = (F.col("y") - origin[1]) / step, (F.col("x") - origin[0]) / step
    at = points.withColumns({"_u": u, "_v": v}).withColumns({"_i": F.floor("_u"), "_j": F.floor("_v")})
    corners = [(0, 0), (0, 1), (1, 0), (1, 1)]
    # One look-up per point: every cell knows its four corners.
    cells = grid.select("gi", "gj", "n")
    for k, (a, b) in enumerate(corners):
        c = grid.select((F.col("gi") - a).alias("gi"), (F.col("gj") - b).alias("gj"), F.col("n").alias(f"_n{k}"))
        cells = cells.join(c, ["gi", "gj"], "left") if k else cells.withColumn("_n0", F.col("n"))
    cells = cells.drop("n").withColumnRenamed("gi", "_i").withColumnRenamed("gj", "_j")
    f, g = F.col("_u") - F.col("_i"), F.col("_v") - F.col("_j")
    n = F.col("_n0") * (1 - f) * (1 - g) + F.col("_n1") * (1 - f) * g + F.col("_n2") * f * (1 - g) + F.col("_n3") * f * g
    return at.join(cells, ["_i", "_j"], "left").withColumn("z", F.col("z") + n).drop("_u", "_v", "_i", "_j", "_n0", "_n1", "_n2", "_n3")


def elm(points: DataFrame, cell: float = 10.0, threshold: float = 1.0) -> DataFrame:
    """Extended local minimum: of a cell's points by height, the lowest are noise (7) while the next is ``threshold`` or more above."""
    rows = points.withColumns({"_i": F.floor(F.col("x") / cell), "_j": F.floor(F.col("y") / cell)})
    order = Window.partitionBy("_i", "_j").orderBy("z", "pid")
    gap = F.lead("z").over(order) - F.col("z")
    lowest = F.min(F.coalesce(F.col("_gap"), F.lit(-1.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("_gap", gap).withColumn("classification", F.when(lowest >= threshold, NOISE).otherwise(F.col("classification")))
    return marked.drop("_i", "_j", "_gap")


def _blocks(points: DataFrame, side: float, halo: float) -> DataFrame:
    """Points dealt to square blocks and to those within ``halo`` of them; ``_own`` tells the block that a point lies in."""
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side))
    rows = points.withColumns({"_oi": F.floor(F.col("x") / side), "_oj": F.floor(F.col("y") / side)})
    rows = rows.withColumn("_i", F.explode(near("x"))).withColumn("_j", F.explode(near("y")))
    return rows.withColumn("_own", (F.col("_i") == F.col("_oi")) & (F.col("_j") == F.col("_oj"))).drop("_oi", "_oj")


def _keyed(points: DataFrame, scope: str) -> DataFrame:
    """(pid, x, y, z, _p): points with their part where only those of a part see each other. Points without a place are left out."""
    part = F.col("part").cast("long") if scope == "part" else F.lit(0).cast("long")
    placed = points.where("x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z)")
    return placed.select("pid", *[F.col(c).cast("double").alias(c) for c in "xyz"], F.coalesce(part, F.lit(-1).cast("long")).alias("_p"))


#: Points in a cell that only one of them can stay in, from which on the cell is hot.
HOT = 64


def _thin_hot(points: DataFrame, radius: float) -> DataFrame:
    """``points`` with ``state``: 1 for the first point of a hot cell if no cell about it has an earlier one, 2 for those near such points.

    Two points of a cell of side radius / 2 are nearer than the radius. Cells are counted before anything is shuffled; of a spot that
    holds a share of all points, nothing but its first point goes on.
    """
    side = radius / 2
    cell = ["_p", "_a", "_b", "_c"]
    placed = points.withColumns({n: F.floor(F.col(c) / side) for n, c in zip(("_a", "_b", "_c"), "xyz")})
    cells = settle(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pid", "x", "y", "z")).alias("first")))
    hot = cells.where(F.col("n") > HOT)
    if hot.isEmpty():
        return points.withColumn("state", F.lit(0))
    steps = F.sequence(F.lit(-2), F.lit(2))
    about = lambda df: df.withColumn("_da", F.explode(steps)).withColumn("_db", F.explode(steps)).withColumn("_dc", F.explode(steps))
    to = [F.col("_p"), *[(F.col(n) + F.col("_d" + n[1])).alias(n) for n in ("_a", "_b", "_c")]]
    asked = about(hot.select(*cell, F.col("first.pid").alias("mine"))).select(*to, "mine").join(cells.select(*cell, F.col("first.pid").alias("pid")), cell)
    early = asked.where("pid < mine").select(F.col("mine").alias("pid")).distinct()
    kept = settle(hot.select("_p", "_a", "_b", "_c", "first.*").join(early, "pid", "left_anti"))
    near = about(kept).select(*to, F.struct("pid", "x", "y", "z").alias("_k")).groupBy(*cell).agg(F.collect_list("_k").alias("_ks"))  # 125 at most
    apart = lambda k: (k["x"] - F.col("x")) * (k["x"] - F.col("x")) + (k["y"] - F.col("y")) * (k["y"] - F.col("y")) + (k["z"] - F.col("z")) * (k["z"] - F.col("z"))
    state = F.when(F.exists("_ks", lambda k: k["pid"] == F.col("pid")), 1).when(F.exists("_ks", lambda k: (k["pid"] < F.col("pid")) & (apart(k) < radius * radius)), 2).otherwise(0)
    return placed.join(near, cell, "left").withColumn("state", F.when(F.col("_ks").isNull(), 0).otherwise(state)).drop("_a", "_b", "_c", "_ks")


def _sample_pass(radius: float):
    """Blocks' points in order of pid -> pid, new: one pass that holds the kept points and the cells with undecided ones, nothing else.

    Of a cell of side radius / 2 one point can stay, so what is held depends on a block's extent, not on its points. A point waits for
    cells with earlier undecided ones within reach, and at the block's rim.
    """
    from itertools import product

    import pyarrow as pa

    half, square = radius / 2, radius * radius
    reach = [(a, b, c) for a, b, c in product(range(-2, 3), repeat=3) if sum(max(0, abs(d) - 1) ** 2 for d in (a, b, c)) < 4]

    def run(batches):
        block, kept, waiting = None, {}, set()
        for batch in batches:
            p, i, j, pid = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(4))
            xyz = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in (4, 5, 6)])
            state, own, edge = (batch.column(n).to_numpy(zero_copy_only=False) for n in (7, 8, 9))
            cells, new = np.floor(xyz / half).astype(np.int64).tolist(), state.tolist()
            places, rim = xyz.tolist(), edge.tolist()
            for at, key in enumerate(zip(p.tolist(), i.tolist(), j.tolist())):
                if key != block:
                    block, kept, waiting = key, {}, set()
                cell = tuple(cells[at])
                if new[at] == 1:
                    kept[cell] = places[at]
                    continue
                if cell in kept:
                    new[at] = 2
                    continue
                (x, y, z), (a, b, c) = places[at], cell
                wait = rim[at] or cell in waiting
                for da, db, dc in reach:
                    other = (a + da, b + db, c + dc)
                    q = kept.get(other)
                    if q is not None and (q[0] - x) ** 2 + (q[1] - y) ** 2 + (q[2] - z) ** 2 < square:
                        new[at] = 2
                        break
                    if not wait and other in waiting:
                        wait = True
                else:
                    if wait:
                        waiting.add(cell)
                    else:
                        new[at] = 1
                        kept[cell] = places[at]
            mine = np.flatnonzero(own & (state == 0))
            yield pa.RecordBatch.from_arrays([pa.array(pid[mine]), pa.array(np.array(new, np.int32)[mine])], names=["pid", "new"])

    return run


def poisson_sample(points: DataFrame, radius: float, max_rounds: int = 200, block: float | None = None, scope: str = "cloud") -> DataFrame:
    """Points of which no two are nearer than ``radius``: a point stays unless a kept one of smaller pid is nearer.

    Blocks with a rim of twice the radius decide what they can; what depends on points beyond the rim waits for the next round. The
    result is that of one pass by pid, however the cloud is dealt. With ``scope`` part only points of one ``part`` see each other.
    Points without a place (null or NaN) stay out of the result; pids are unique.
    """
    side = block or 32 * radius
    state = settle(_thin_hot(_keyed(points, scope), radius))
    for _ in range(max_rounds):
        todo = state.where("state = 0").select("_p", F.floor(F.col("x") / side).alias("_i"), F.floor(F.col("y") / side).alias("_j")).distinct()
        rows = _blocks(state.where("state != 2"), side, 2 * radius).join(todo, ["_p", "_i", "_j"], "left_semi")
        beyond = lambda c, b: (F.col(c) < F.col(b) * side - radius) | (F.col(c) >= (F.col(b) + 1) * side + radius)
        rows = rows.select("_p", "_i", "_j", "pid", "x", "y", "z", "state", "_own", (beyond("x", "_i") | beyond("y", "_j")).alias("_edge"))
        made = rows.repartition("_p", "_i", "_j").sortWithinPartitions("_p", "_i", "_j", "pid").mapInArrow(_sample_pass(radius), "pid long, new int")
        state = settle(state.join(made, "pid", "left").withColumn("state", F.coalesce("new", "state")).drop("new"))
        if state.where("state = 0").isEmpty():
            return points.join(state.where("state = 1").select("pid"), "pid", "left_semi")
    raise RuntimeError(f"sampling did not settle in {max_rounds} rounds")


#: Places in a cell of a chunk, whose asking places are compared with those of the nine cells about them.
CELL = 48


def _nearest(k: int):
    """A block's chunk -> for each asking place its distances to the k nearest others of the chunk, as often as points stand there.

    Nine cells of a grid answer where the k-th place is nearer than their border; the whole chunk answers the rest.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asks, rest = pdf[pdf["ask"]], pdf[~pdf["ask"]]
        ask, xyz = asks[["x", "y", "z"]].to_numpy(float), rest[["x", "y", "z"]].to_numpy(float)
        ids, others, weight = asks["spot"].to_numpy(), rest["spot"].to_numpy(), rest["n"].to_numpy()
        near: list[np.ndarray] = [np.empty(0)] * len(ask)

        def compare(rows: np.ndarray, cols: np.ndarray, safe: np.ndarray) -> np.ndarray:
            """Settles the ``rows`` whose k-th place among ``cols`` is nearer than ``safe``; the others are returned."""
            n = min(k + 1, len(cols))
            if not n:
                return rows[safe < np.inf]
            d, (ox, oy, oz) = np.zeros((len(rows), len(cols))), xyz[cols].T
            for c, o in enumerate((ox, oy, oz)):
                d += (ask[rows, c][:, None] - o[None, :]) ** 2
            d[ids[rows, None] == others[None, cols]] = np.inf
            first = np.argpartition(d, n - 1, axis=1)[:, :n]
            d = np.take_along_axis(d, first, axis=1)
            order = np.argsort(d, axis=1)
            d, w = np.sqrt(np.take_along_axis(d, order, axis=1)), weight[cols[np.take_along_axis(first, order, axis=1)]]
            ok = safe == np.inf
            if n >= k:
                ok |= d[:, k - 1] < safe
            plain = n >= k and (w[:, :k] == 1).all()
            for at in np.flatnonzero(ok).tolist():
                if plain and d[at, k - 1] < np.inf:  # a point at each place
                    near[rows[at]] = d[at, :k]
                    continue
                some = np.isfinite(d[at])
                row, times = d[at][some], w[at][some]
                near[rows[at]] = (row if (times == 1).all() else np.repeat(row, np.minimum(times, k)))[:k]
            return rows[~ok]

        left = np.arange(len(ask))
        m = int((len(xyz) / CELL) ** 0.5)
        low, width = (xyz[:, :2].min(axis=0), (np.ptp(xyz[:, :2], axis=0) / max(m, 1))) if len(xyz) else (None, np.zeros(2))
        if m > 3 and (width > 0).all():
            cell = lambda p: np.clip(np.floor((p[:, :2] - low) / width), 0, m - 1).astype(np.int64)
            held = cell(xyz) @ [m, 1]
            order = np.argsort(held, kind="stable")
            held, asked = held[order], cell(ask)
            sides, late = np.argsort(asked @ [m, 1], kind="stable"), []
            cuts = np.flatnonzero(np.diff((asked @ [m, 1])[sides])) + 1
            for rows in np.split(sides, cuts):
                if not len(rows):
                    continue
                i, j = asked[rows[0]].tolist()
                spans = [np.searchsorted(held, (r * m + max(j - 1, 0), r * m + min(j + 1, m - 1) + 1)) for r in range(max(i - 1, 0), min(i + 1, m - 1) + 1)]
                cols = np.concatenate([order[p:q] for p, q in spans])
                safe = np.full(len(rows), 1e300)  # nothing stands beyond the grid
                for c, at in enumerate((i, j)):
                    if at > 1:
                        safe = np.minimum(safe, ask[rows, c] - (low[c] + (at - 1) * width[c]))
                    if at + 2 < m:
                        safe = np.minimum(safe, low[c] + (at + 2) * width[c] - ask[rows, c])
                step = max(1, 4_000_000 // max(1, len(cols)))
                late += [compare(rows[at : at + step], cols, safe[at : at + step] * (1 - 1e-9)) for at in range(0, len(rows), step)]
            left = np.concatenate([np.empty(0, np.int64), *late])
        every, step = np.arange(len(xyz)), max(1, 4_000_000 // max(1, len(xyz)))
        for at in range(0, len(left), step):
            compare(left[at : at + step], every, np.full(len(left[at : at + step]), np.inf))
        return pd.DataFrame({"spot": ids, "near": near})

    return run


def _search(asks: DataFrame, spots: DataFrame, side: float, halo: float, k: int, limit: int) -> DataFrame:
    """(asks.., near, safe): distances to the k nearest points within the rim of the asking place's block, and how far that reaches.

    Blocks with over ``limit`` places are searched chunk by chunk, and so are asking places, so that no task holds a dense block.
    """
    own = [F.floor(F.col(c) / side).alias(n) for c, n in (("x", "_i"), ("y", "_j"))]
    block = ["_p", "_i", "_j"]
    asks = asks.select("*", *own)
    many = lambda c: F.greatest(F.lit(1).cast("long"), F.ceil(F.col(c) / limit).cast("long"))
    live = asks.groupBy(*block).agg(F.count(F.lit(1)).alias("asks"))
    near = _blocks(spots, side, halo).drop("_own").join(live.select(*block), block, "left_semi")
    counts = near.groupBy(*block).agg(F.count(F.lit(1)).alias("places"))
    sizes = settle(live.join(counts, block, "left").select(*block, many("asks").alias("_a"), many("places").alias("_c")))
    deal = lambda c: F.pmod(F.xxhash64("spot"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    cols = ["spot", "x", "y", "z", "n"]
    right = near.join(sizes, block).select(*block, deal("_c").alias("_k"), every("_a").alias("_l"), *cols, F.lit(False).alias("ask"))
    left = asks.join(sizes, block).select(*block, every("_c").alias("_k"), deal("_a").alias("_l"), *cols, F.lit(True).alias("ask"))
    found = left.unionByName(right).groupBy(*block, "_k", "_l").applyInPandas(_nearest(k), "spot long, near array<double>")
    found = found.groupBy("spot").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    safe = F.least(*[f for c, n in (("x", "_i"), ("y", "_j")) for f in (F.col(c) - (F.col(n) * side - halo), (F.col(n) + 1) * side + halo - F.col(c))])
    return asks.join(found, "spot").withColumn("safe", safe).drop("_i", "_j")


def knn_mean(points: DataFrame, k: int, block_points: int = 4_000, scope: str = "cloud") -> DataFrame:
    """``(pid, mean_distance)``: mean distance of each point to its k nearest others (to all others, if there are fewer).

    Points at one place are one asking place. A quadtree splits blocks until they hold ``block_points`` places; the smallest blocks ask
    first, with a rim of a quarter of their side. Places whose k-th neighbour may lie beyond the rim ask again with the blocks of a
    higher level, and at last with ever wider rims, until these take in the whole cloud. With ``scope`` part only points of one ``part``
    are neighbours. Points without a place are left out; one alone has a null distance.
    """
    from geojobs.operators.tiling import tile_budget

    rows = _keyed(points, scope)
    spots = rows.groupBy("_p", "x", "y", "z").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("spot"))
    # Every other level will do, the finer of two: half the rounds.
    spots = settle(tile_budget(spots, ["x", "y"], block_points, 20, by=("_p",)).drop("tile").withColumn("level", F.col("level") + F.col("level") % 2))
    box = spots.agg(F.max("level").alias("deepest"), *[f(c).alias(n + c) for c in "xy" for n, f in (("a", F.min), ("b", F.max))]).first()
    if box["deepest"] is None:
        return points.select("pid", F.lit(None).cast("double").alias("mean_distance")).limit(0)
    span = max(box["bx"] - box["ax"], box["by"] - box["ay"]) or 1.0
    levels = sorted((r["level"] for r in spots.select("level").distinct().collect()), reverse=True)  # 21 at most
    plain = spots.drop("level")
    # Points of the place itself come first, at distance 0.
    zeros = F.array_repeat(F.lit(0.0), F.least(F.col("n") - 1, F.lit(k)).cast("int"))
    done, todo, level, side = [], [], levels[0], span / 2 ** levels[0]
    halo = side / 4
    while True:
        asks = todo + ([spots.where(F.col("level") == level).drop("level")] if level in levels else [])
        if asks:
            found = _search(reduce(DataFrame.unionByName, asks), plain, side, halo, k, block_points)
            found = settle(found.withColumn("near", F.slice(F.array_sort(F.concat(zeros, "near")), 1, k)))
            whole = halo >= 2 * span
            ok = F.lit(True) if whole else F.coalesce((F.size("near") == k) & (F.try_element_at("near", F.lit(-1)) <= F.col("safe")), F.lit(False))
            mean = F.aggregate("near", F.lit(0.0), lambda s, v: s + v, lambda s: F.try_divide(s, F.size("near")))
            done.append(found.where(ok).select("_p", "x", "y", "z", mean.alias("mean_distance")))
            rest = found.where(~ok).drop("near", "safe")
            todo = [] if whole or rest.isEmpty() else [rest]
        if level <= 0 and not todo:
            break
        level -= 2
        side, halo = (4 * side, 4 * halo) if level >= 0 else (side, 2 * halo)
    return rows.join(reduce(DataFrame.unionByName, done), ["_p", "x", "y", "z"]).select("pid", "mean_distance")


def outlier(points: DataFrame, k: int = 8, multiplier: float = 2.0, scope: str = "cloud") -> DataFrame:
    """Class 7 where the mean distance to k neighbours is over mean + multiplier x stddev (sample) of the cloud, or, with ``scope`` part,
    of the ``part``, whose points then know no neighbours but their own."""
    near = settle(knn_mean(points, k, scope=scope))
    rows = points.join(near, "pid", "left")
    keys = ["part"] if scope == "part" else []
    limit = rows.groupBy(*keys).agg((F.avg("mean_distance") + multiplier * F.coalesce(F.stddev_samp("mean_distance"), F.lit(0.0))).alias("_limit"))
    joined = rows.join(limit, keys) if keys else rows.crossJoin(F.broadcast(limit))  # one row
    return joined.withColumn("classification", F.when(F.col("mean_distance") > F.col("_limit"), NOISE).otherwise(F.col("classification"))).drop("_limit", "mean_distance")


def _open_disk(z: np.ndarray, radius: int) -> np.ndarray:
    """Grey opening of a grid by a disk: least, then greatest heights about each cell."""
    near = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]

    def extreme(grid: np.ndarray, fn, fill: float) -> np.ndarray:
        wide = np.pad(grid, radius, constant_values=fill)
        out = np.full(grid.shape, fill)
        for a, b in near:
            out = fn(out, wide[radius + a : radius + a + grid.shape[0], radius + b : radius + b + grid.shape[1]])
        return out

    return extreme(extreme(z, np.minimum, np.inf), np.maximum, -np.inf)


def _fill(z: np.ndarray) -> np.ndarray:
    """Cells without points take the height of the nearest with some (rings outward)."""
    z = z.copy()
    while np.isnan(z).any() and not np.isnan(z).all():
        wide = np.pad(z, 1, constant_values=np.nan)
        sides = np.stack([wide[1 + a : 1 + a + z.shape[0], 1 + b : 1 + b + z.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)])
        count = (~np.isnan(sides)).sum(axis=0)
        mean = np.where(count, np.nansum(sides, axis=0) / np.maximum(count, 1), np.nan)
        z = np.where(np.isnan(z), mean, z)
    return z


def _terrain(cell: float, slope: float, window: float, block: int, rim: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = key
        n = block + 2 * rim
        z = np.full((n, n), np.nan)
        z[pdf["ci"].to_numpy() - bi * block + rim, pdf["cj"].to_numpy() - bj * block + rim] = pdf["low"].to_numpy()
        dem = _fill(z)
        objects, last = np.zeros(z.shape, bool), dem
        for radius in range(1, int(np.ceil(window / cell)) + 1):
            opened = _open_disk(last, radius)
            objects |= last - opened > slope * radius * cell
            last = opened
        dem = _fill(np.where(objects, np.nan, z))
        di, dj = np.gradient(dem, cell) if n > 1 else (np.zeros_like(dem), np.zeros_like(dem))
        i, j = np.meshgrid(np.arange(rim, rim + block), np.arange(rim, rim + block), indexing="ij")
        return pd.DataFrame({"ci": (i + bi * block - rim).ravel(), "cj": (j + bj * block - rim).ravel(), "ground": dem[i, j].ravel(), "steep": np.hypot(di, dj)[i, j].ravel()})

    return run


def smrf(points: DataFrame, cell: float = 1.0, slope: float = 0.15, window: float = 18.0, scalar: float = 1.25, threshold: float = 0.5, block: int = 256) -> DataFrame:
    """Ground (class 2) by a simple morphological filter; points of class 7 take no part.

    Lowest heights per cell, openings by growing disks that mark what rises more than the slope allows, a terrain without the marked
    cells, and points within threshold + scalar x slope of it. Only the grid of lowest heights goes to grouped tasks.
    """
    live = F.coalesce(F.col("classification") != NOISE, F.lit(True))
    rows = points.withColumns({"ci": F.floor(F.col("x") / cell).cast("long"), "cj": F.floor(F.col("y") / cell).cast("long")})
    grid = rows.where(live).groupBy("ci", "cj").agg(F.min("z").alias("low"))
    rim = int(np.ceil(window / cell)) * 2 + 1
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - rim) / block), F.floor((F.col(c) + rim) / block)))
    dealt = grid.withColumn("_bi", near("ci")).withColumn("_bj", near("cj"))
    home = grid.select(F.floor(F.col("ci") / block).alias("_bi"), F.floor(F.col("cj") / block).alias("_bj")).distinct()
    dem = dealt.join(home, ["_bi", "_bj"], "left_semi").groupBy("_bi", "_bj").applyInPandas(_terrain(cell, slope, window, block, rim), "ci long, cj long, ground double, steep double")
    joined = rows.join(dem, ["ci", "cj"], "left")
    ground = live & (F.abs(F.col("z") - F.col("ground")) <= threshold + scalar * F.col("steep"))
    return joined.withColumn("classification", F.when(ground, GROUND).otherwise(F.col("classification"))).drop("ci", "cj", "ground", "steep")


def ground(points: DataFrame) -> DataFrame:
    """Classes cleared, low noise and outliers marked, ground found."""
    return smrf(outlier(elm(class_assign(points)), 8, 2.0))

