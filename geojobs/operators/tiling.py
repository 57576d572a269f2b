"""Adaptive tile trees and tilesets.

Trees grow from the top: a round counts cells a few levels down, rolls them up in a small table, and opens only those over the budget for
the next one, so that no task sees a whole tile's rows and rows are shuffled once at most, to meet their leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geojobs.functions import geodesy
from geojobs.operators.storage import settle


def _cell(value: Column, low: Column, span: Column, level: int) -> Column:
    """Cell number along one axis at the finest level; the upper edge belongs to the last cell."""
    n = 1 << level
    at = F.floor(F.coalesce(F.try_divide(value - low, span), F.lit(0.0)) * n).cast("long")
    return F.when(value.isNotNull(), F.least(F.greatest(at, F.lit(0).cast("long")), F.lit(n - 1).cast("long")))


def _up(keys: list[str], levels: Column | int) -> list[Column]:
    """Tile numbers that many levels above cell numbers."""
    return [F.call_function("shiftright", F.col(k), levels if isinstance(levels, Column) else F.lit(levels)) for k in keys]


def _budgeted(df: DataFrame, axes: list[str], max_features: int, max_level: int, extent: DataFrame | None, by: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """``tile_budget`` with the finest cell numbers of the rows, and the names of these columns."""
    if extent is None:
        extent = settle(df.agg(*[f(F.col(a)).alias(f"{n}_{i}") for i, a in enumerate(axes) for n, f in (("low", F.min), ("high", F.max))]))  # read in each round
    span = F.greatest(*[F.col(f"high_{i}") - F.col(f"low_{i}") for i in range(len(axes))], F.lit(0.0))
    cells = df.crossJoin(F.broadcast(extent))  # one row
    for i, a in enumerate(axes):
        cells = cells.withColumn(f"_c{i}", _cell(F.col(a), F.col(f"low_{i}"), span, max_level))
    cells = cells.drop(*[f"{n}_{i}" for i in range(len(axes)) for n in ("low", "high")])
    keys, tile = [f"_c{i}" for i in range(len(axes))], [f"_t{i}" for i in range(len(axes))]
    known = reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in keys])

    def at(level: Column | int) -> list[Column]:
        up = max_level - level if isinstance(level, int) else (F.lit(max_level) - level).cast("int")
        return [c.alias(t) for c, t in zip(_up(keys, up), tile)]

    # From the top: a few levels a round are counted, and only cells over the budget are counted finer in the next one.
    ends, opens, leaves, low = [], [], [], 0
    step = max(1, 8 // len(axes))
    rows = cells.where(known).select(*by, *keys)
    while True:
        high = min(max_level, low + step - (low > 0))
        inside = rows
        if opens:
            inside = rows.withColumns(dict(zip(tile, at(ends[-1])))).join(_small(opens[-1]), [*by, *tile], "left_semi").select(*by, *keys)
        counts = settle(inside.groupBy(*by, *at(high)).agg(F.count(F.lit(1)).alias("_n")))
        each = counts.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_level"))
        above = [c.alias(f"_u{i}") for i, c in enumerate(_up(tile, (F.lit(high) - F.col("_level")).cast("int")))]
        each = each.select(*by, *tile, "_n", "_level", *above)
        nodes = each.groupBy(*by, "_level", *[f"_u{i}" for i in range(len(axes))]).agg(F.sum("_n").alias("_n"))
        small = nodes.where((F.col("_n") <= int(max_features)) | (F.col("_level") == max_level)).drop("_n")
        leaf = each.drop("_n").join(small, [*by, "_level", *[f"_u{i}" for i in range(len(axes))]]).groupBy(*by, *tile).agg(F.min("_level").alias("level"))
        leaves.append(leaf.withColumn("_round", F.lit(len(ends))))
        ends.append(high)
        if high == max_level:
            break
        opens.append(settle(counts.where(F.col("_n") > int(max_features)).select(*by, *tile)))
        if opens[-1].isEmpty():
            break
        low = high + 1
    # A row's leaf is told by the round in which its cell was no more over the budget; then it takes one look-up.
    placed, which = cells, F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        opened = _small(opens[i].withColumn(f"_o{i}", F.lit(True)))
        placed = placed.withColumns(dict(zip(tile, at(ends[i])))).join(opened, [*by, *tile], "left").drop(*tile)
        which = F.when(F.col(f"_o{i}").isNull(), F.lit(i)).otherwise(which)
    placed = placed.withColumn("_round", which).drop(*[f"_o{i}" for i in range(len(ends) - 1)])
    end = F.element_at(F.array(*map(F.lit, ends)), F.col("_round") + 1)
    found = reduce(DataFrame.unionByName, leaves)
    placed = placed.withColumns(dict(zip(tile, at(end)))).join(found, [*by, "_round", *tile], "left").drop("_round", *tile)
    number = F.when(F.col("level").isNotNull(), F.array(*_up(keys, (F.lit(max_level) - F.col("level")).cast("int"))))
    return placed.withColumn("tile", number), keys


#: Cells over the budget that are broadcast; there are fewer than rows through budget.
SMALL = 500_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def tile_budget(df: DataFrame, axes: list[str], max_features: int, max_level: int = 20, extent: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``level`` and ``tile`` (one number per axis): leaves of the adaptive tree of quadrants (or octants).

    A node with at most ``max_features`` rows is a leaf, as is one at ``max_level``, however many rows stand at one place. Rows with
    a null coordinate have null tiles. The extent is that of all rows unless given (one row of low_i and high_i). Rows with different
    ``by`` (not null) have trees of their own over the same extent.
    """
    placed, keys = _budgeted(df, axes, max_features, max_level, extent, by)
    return placed.drop(*keys)


def octree_tiles(points: DataFrame, budget: int, max_level: int = 12) -> DataFrame:
    """Points in ECEF with their octree node: every inner node holds one representative (smallest pid) per cell ``thin`` levels down.

    -> pid, level, tile, x, y, z: a point stands in the shallowest node for which it is the representative of its cell, else in its leaf.
    Representatives go up from level to level: those of a cell are the least of its parts' and of the points whose leaves begin below it.
    """
    thin = 3
    placed, keys = _budgeted(points, ["x", "y", "z"], budget, max_level, None, ())
    placed = settle(placed)
    deepest = placed.agg(F.max("level")).first()[0] or 0
    fine = lambda level: min(max_level, level + thin)
    found, below = [], None
    for level in range(deepest - 1, -1, -1):
        new = placed.where(F.col("level") == level + 1).select("pid", *[c.alias(k) for c, k in zip(_up(keys, max_level - fine(level)), keys)])
        if below is not None:
            new = new.unionByName(below.select("pid", *[c.alias(k) for c, k in zip(_up(keys, fine(level + 1) - fine(level)), keys)]))
        below = settle(new.groupBy(*keys).agg(F.min("pid").alias("pid")))
        found.append(below.select("pid", F.lit(level).alias("_at")))
    if not found:
        return placed.select("pid", "level", "tile", "x", "y", "z")
    first = reduce(DataFrame.unionByName, found).groupBy("pid").agg(F.min("_at").alias("_at"))
    out = placed.join(first, "pid", "left")
    level = F.coalesce("_at", "level")
    moved = F.transform("tile", lambda c: F.call_function("shiftright", c, (F.col("level") - level).cast("int")))
    return out.select("pid", level.alias("node_level"), moved.alias("tile"), "x", "y", "z").withColumnRenamed("node_level", "level")


def tile_children(tiles: DataFrame, depth: int) -> DataFrame:
    """``tiles(level, y, x, ...)`` that hang together from level 0: (level, y, x, parent_y, parent_x, children).

    A tile whose parent is missing goes with all below it.
    """
    kept = [tiles.where("level = 0")]
    for level in range(1, depth + 1):
        up = kept[-1].select(F.col("y").alias("_py"), F.col("x").alias("_px"))
        kept.append(tiles.where(F.col("level") == level).join(up, (F.shiftright("y", 1) == F.col("_py")) & (F.shiftright("x", 1) == F.col("_px")), "left_semi"))
    rows = reduce(DataFrame.unionByName, kept)
    children = rows.where("level > 0").groupBy((F.col("level") - 1).alias("level"), F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x")).agg(F.count(F.lit(1)).alias("children"))
    out = rows.join(children, ["level", "y", "x"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    parent = lambda c: F.when(F.col("level") > 0, F.shiftright(c, 1))
    return out.withColumns({"parent_y": parent("y"), "parent_x": parent("x")})


def geometric_error(level: Column, depth: int, max_error: Column) -> Column:
    """max / 2^(level + 2), and 0 at the deepest level."""
    return F.when(level < depth, max_error / F.pow(F.lit(2.0), level + 2)).otherwise(F.lit(0.0))


def default_max_error(size: Column) -> Column:
    """A third of the box's diagonal."""
    return F.sqrt(size[0] * size[0] + size[1] * size[1] + size[2] * size[2]) / 3


def tileset_flat(tiles: DataFrame, size: list[float] | None, depth: int, max_error: float | None = None, transform: Column | None = None) -> DataFrame:
    """``tiles(level, y, x, center, size)`` -> level, y, x, parent_y, parent_x, children, box, geometric_error, uri, refine.

    Raises without a size. ``transform`` (column-major 4x4) turns the boxes.
    """
    if not size:
        raise ValueError("a tileset needs the size of its mesh")
    top = F.lit(float(max_error)) if max_error is not None else default_max_error(F.array(*map(F.lit, map(float, size))))
    box = geodesy.box_from_size(F.col("center"), F.col("size"))
    box = box if transform is None else geodesy.box_transform(box, transform)
    name = F.concat_ws("_", "level", "y", "x")
    return tile_children(tiles, depth).select(
        "level", "y", "x", "parent_y", "parent_x", "children", box.alias("box"), geometric_error(F.col("level"), depth, top).alias("geometric_error"),
        F.concat(F.lit("tiles/"), name, F.lit(".glb")).alias("uri"), F.lit("REPLACE").alias("refine"),
    )


def tileset_json(flat: DataFrame, depth: int, max_error: float, split: int = 4) -> DataFrame:
    """(path, tileset): nested documents of ``split`` levels each, made level by level from below. Without tiles, no row.

    ``tileset.json`` is the root; a tile whose level is a multiple of ``split`` begins a document of its own, to which the tile above
    refers, so that no row holds more than 4^split tiles. A tileset of depth 0 has its tile as root, others a wrapper with half the
    greatest error.
    """
    start = lambda error: F.concat(F.lit('{"asset":{"version":"1.1"},"geometricError":'), error, F.lit(',"root":'))
    documents, below = [], None
    for level in range(depth, -1, -1):
        rows = flat.where(F.col("level") == level)
        path = F.concat(F.lit("tileset_"), F.concat_ws("_", "level", "y", "x"), F.lit(".json"))
        node = lambda uri: F.to_json(F.struct(F.col("geometric_error").alias("geometricError"), F.col("refine"), F.struct("box").alias("boundingVolume"), F.struct(uri.alias("uri")).alias("content")))
        head, reference = node(F.col("uri")), node(path)
        if below is not None:
            rows = rows.join(below, (rows["y"] == below["_y"]) & (rows["x"] == below["_x"]), "left")
            kids = F.coalesce(F.col("_kids"), F.lit(""))
            head = F.when(kids == "", head).otherwise(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"children":['), kids, F.lit("]}")))
        made = rows.select("y", "x", path.alias("path"), F.col("geometric_error").cast("string").alias("error"), head.alias("_node"), reference.alias("_reference"))
        if level and level % split == 0:
            documents.append(made.select("path", F.concat(start(F.col("error")), "_node", F.lit("}")).alias("tileset")))
            made = made.withColumn("_node", F.col("_reference"))
        grouped = made.groupBy(F.shiftright("y", 1).alias("_y"), F.shiftright("x", 1).alias("_x"))
        below = grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "_node"))), lambda s: s["_node"]), ",").alias("_kids"))
    box = flat.where("level = 0").agg(F.to_json(F.struct(F.first("box").alias("box"))).alias("_box"))
    root = below.crossJoin(F.broadcast(box))  # a row each
    wrapped = F.col("_kids") if depth == 0 else F.concat(F.lit(f'{{"geometricError":{max_error / 2},"refine":"REPLACE","boundingVolume":'), "_box", F.lit(',"children":['), "_kids", F.lit("]}"))
    top = root.select(F.lit("tileset.json").alias("path"), F.concat(start(F.lit(str(float(max_error)))), wrapped, F.lit("}")).alias("tileset"))
    return reduce(DataFrame.unionByName, documents, top)


def adaptive_nodes(leaves: DataFrame, max_error: float, factor: float = 2.0, refine: str = "REPLACE") -> DataFrame:
    """``leaves(lod, level, tile, region, features)`` of adaptive trees -> all nodes of one tree: id, parent, lod, level, y, x, depth,
    parent_depth, children, features, region, geometric_error, uri, refine.

    ``region`` is west, south, east, north, lowest, highest; a node's is the union of those below it. Inner nodes have no content. A level
    of detail refines the one before: its node hangs below the node of the same place there, else below that of the next larger place, its
    own only where there is no other, so that it has inner nodes only where it is finer. Errors fall by ``factor`` with each step down and are 0 where nothing is below.
    """
    at = lambda c: F.call_function("shiftright", c, (F.col("leaf_level") - F.col("level")).cast("int"))
    rows = leaves.select("lod", F.col("level").alias("leaf_level"), F.col("tile")[1].alias("_y"), F.col("tile")[0].alias("_x"), "region", F.col("features").alias("_f"))
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("leaf_level").cast("int")))).withColumn("y", at(F.col("_y"))).withColumn("x", at(F.col("_x")))
    # Below a node stand its own leaves and those of all later levels of detail.
    rows = rows.withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("lod").cast("int"))))
    ends = [F.min(F.col("region")[i]) if i in (0, 1, 4) else F.max(F.col("region")[i]) for i in range(6)]
    mine = F.col("lod") == F.col("_l")
    content = F.max(F.when(mine & (F.col("level") == F.col("leaf_level")), F.col("_f")))
    nodes = rows.groupBy(F.col("_l").alias("lod"), "level", "y", "x").agg(F.array(*ends).alias("region"), F.max(mine).alias("_own"), content.alias("features")).where("_own").drop("_own")
    nodes = settle(nodes)
    # An inner node is dropped where the level of detail before has a node.
    there = nodes.select((F.col("lod") + 1).alias("lod"), "level", "y", "x", F.lit(True).alias("_there"))
    nodes = nodes.join(there, ["lod", "level", "y", "x"], "left").where("features is not null or _there is null")
    larger = there.select("lod", F.col("level").alias("_pl"), F.col("y").alias("_py"), F.col("x").alias("_px"), F.col("_there").alias("_over"))
    nodes = nodes.withColumns({"_pl": F.col("level") - 1, "_py": F.shiftright("y", 1), "_px": F.shiftright("x", 1)}).join(larger, ["lod", "_pl", "_py", "_px"], "left")
    name = lambda lod, level, y, x: F.concat_ws("_", lod, level, y, x)
    beyond = F.when(F.col("_over"), F.col("lod") - 1).otherwise(F.col("lod"))
    above = F.when(F.col("_there"), name(F.col("lod") - 1, F.col("level"), F.col("y"), F.col("x"))).when(F.col("level") > 0, name(beyond, F.col("_pl"), F.col("_py"), F.col("_px")))
    depth = (F.col("lod") + F.col("level")).cast("int")
    up = depth - F.when(F.coalesce("_over", F.lit(False)) & F.col("_there").isNull(), 2).otherwise(1)
    nodes = settle(nodes.select(name(*map(F.col, ("lod", "level", "y", "x"))).alias("id"), above.alias("parent"), "lod", "level", "y", "x", depth.alias("depth"), up.alias("parent_depth"), "features", "region"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    nodes = nodes.join(children, "id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    error = F.when(F.col("children") > 0, F.lit(float(max_error)) / F.pow(F.lit(float(factor)), "depth")).otherwise(0.0)
    uri = F.when(F.col("features").isNotNull(), F.concat(F.lit("tiles/"), "id", F.lit(".glb")))
    return nodes.select("*", error.alias("geometric_error"), uri.alias("uri"), F.lit(refine).alias("refine"))


def adaptive_documents(nodes: DataFrame, max_error: float, split: int = 4) -> DataFrame:
    """(path, tileset): the nested documents of ``adaptive_nodes``. ``tileset.json`` is the root; a node with children whose depth is a
    multiple of ``split`` begins a document of its own, to which the one above refers, so that no row holds more than a subtree. Regions are in
    degrees and written in radians. Without nodes, no row."""
    nodes = settle(nodes)
    deepest = nodes.agg(F.max("depth")).first()[0]
    start = lambda error: F.concat(F.lit('{"asset":{"version":"1.1"},"geometricError":'), error.cast("string"), F.lit(',"root":'))
    radians = F.array(*[F.radians(F.col("region")[i]) for i in range(4)], F.col("region")[4], F.col("region")[5])
    documents: list[DataFrame] = []
    waiting: dict[int, list[DataFrame]] = {}  # made nodes by the depth of their parents, which is one or two less
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        rows = nodes.where(F.col("depth") == depth)
        path = F.concat(F.lit("tileset_"), "id", F.lit(".json"))
        node = lambda uri: F.to_json(F.struct(F.col("geometric_error").alias("geometricError"), "refine", F.struct(radians.alias("region")).alias("boundingVolume"), F.when(uri.isNotNull(), F.struct(uri.alias("uri"))).alias("content")))
        rows = rows.withColumns({"_head": node(F.col("uri")), "_reference": node(path)})
        if depth in waiting:
            below = reduce(DataFrame.unionByName, waiting.pop(depth)).groupBy(F.col("parent").alias("id"))
            rows = rows.join(below.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_child"), F.col("_node")))), lambda n: n["_node"]), ",").alias("_kids")), "id", "left")
        else:
            rows = rows.withColumn("_kids", F.lit(None).cast("string"))
        whole = F.when(F.col("_kids").isNull(), F.col("_head")).otherwise(F.concat(F.substr("_head", F.lit(1), F.length("_head") - 1), F.lit(',"children":['), "_kids", F.lit("]}")))
        made = rows.select("id", "parent", "parent_depth", "children", path.alias("path"), "geometric_error", whole.alias("_node"), "_reference")
        made = settle(made)  # read by the documents and by the nodes above
        if depth and depth % split == 0:
            documents.append(made.where("children > 0").select("path", F.concat(start(F.col("geometric_error")), "_node", F.lit("}")).alias("tileset")))
            made = made.withColumn("_node", F.when(F.col("children") > 0, F.col("_reference")).otherwise(F.col("_node")))
        if depth == 0:
            documents.append(made.select(F.lit("tileset.json").alias("path"), F.concat(start(F.lit(float(max_error))), "_node", F.lit("}")).alias("tileset")))
        for step in (1, 2):
            waiting.setdefault(depth - step, []).append(made.where(F.col("parent_depth") == depth - step).select("parent", F.col("id").alias("_child"), "_node"))
    return reduce(DataFrame.unionByName, documents) if documents else nodes.select(F.col("id").alias("path"), F.col("id").alias("tileset"))


def error_scale(flat: DataFrame, factor: float) -> DataFrame:
    """Every node's geometric error times a factor; what is no number raises."""
    return flat.withColumn("geometric_error", F.col("geometric_error").cast("double") * float(factor))


def attr_schema(df: DataFrame, exclude: tuple[str, ...] = ("geom", "gid", "lod"), real_stats: bool = False) -> DataFrame:
    """(position, name, kind, minimum, maximum) of the attributes: texts have no range, others 1 to 1, or with ``real_stats`` their own."""
    fields = [f for f in df.schema.fields if f.name not in exclude]
    text = lambda f: isinstance(f.dataType, (T.StringType, T.VarcharType))
    ranges = {}
    numbers = [f for f in fields if isinstance(f.dataType, T.NumericType)]
    if real_stats and numbers:
        row = df.agg(*[g(F.col(f"`{f.name}`").cast("double")).alias(f"{n}{i}") for i, f in enumerate(numbers) for n, g in (("a", F.min), ("b", F.max))]).first()
        ranges = {f.name: (row[f"a{i}"], row[f"b{i}"]) for i, f in enumerate(numbers)}
    rows = [(i, f.name, f.dataType.simpleString(), *((None, None) if text(f) else ranges.get(f.name, (1.0, 1.0)))) for i, f in enumerate(fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, kind string, minimum double, maximum double")


def lod_tolerance(level: Column, lods: int, max_tolerance: Column) -> Column:
    """Degrees by which all levels but the last are simplified; null for the last."""
    return F.when(level < lods - 1, max_tolerance / F.pow(F.lit(2.0), level) / F.lit(111194.87428468118))
