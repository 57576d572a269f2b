"""A Merkle manifest of a dataset: leaves in runs of 16 under subroots by source, subroots under one root.

Each aligned block of 256 nodes keeps its levels as one hex string each: fixed-width substrings of a level are hashed to its parents,
and what flanks a node in its run is its siblings' segment. The roots of blocks are nodes of the next round, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geojobs.llm.common import at_most, stash

RUN = 16
#: Nodes of a block, two levels of runs.
BLOCK = RUN * RUN
HEX = 64
#: Rows of a task where leaves are put in order, and of the table of a task's sources that is broadcast.
TASK_ROWS, SMALL = 1_000_000, 200_000
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another; digests go in as their hex text."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column] | None = None) -> Column:
    """A document's digest; ``columns`` stand in for columns of the same name."""
    return digest(*[framed((columns or {}).get(c, F.col(c))) for c in LEAF])


def fold(start: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(siblings, start, lambda node, s: digest(s["left"], node, s["right"]))


def segments(siblings: Column) -> Column:
    """All siblings' digests, level by level and left to right."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")


def _in_order(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with pos (from 0 within ``group`` by ``order``) and n (of the group). Rows are dealt by ranges, so a group of any size is
    numbered by many tasks: a row's place in its task's share of the group plus what earlier tasks hold."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    dealt = rows.repartitionByRange(tasks, group, *order).sortWithinPartitions(group, *order)
    dealt = stash(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.spark_partition_id()))
    whole, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shares = dealt.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    shares = stash(shares.select(group, "_task", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_c").over(whole).alias("n")))
    return dealt.join(at_most(shares, SMALL), [group, "_task"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def _parents(level: Column) -> Column:
    """The next level of a block: each run of 16 digests is a substring of fixed width, the last one perhaps shorter."""
    wide = RUN * HEX
    last = ((F.length(level) - 1) / wide).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(level, i * wide + 1, F.lit(wide)).cast("binary"), 256)), "")


def _flanks(level: Column, place: Column) -> Column:
    """What stands left and right of a node in its run."""
    at, run = place * HEX + 1, F.floor(place / RUN).cast("int") * (RUN * HEX) + 1
    return F.struct(F.substring(level, run, at - run).alias("left"), F.substring(level, at + HEX, run + RUN * HEX - at - HEX).alias("right"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """``nodes(key, pos, n, node, …)`` -> key, block, n, rows, low, high, top: a block's two levels and its root."""
    kept = F.struct((F.col("pos") % BLOCK).cast("int").alias("pos"), *[c for c in nodes.columns if c not in ("key", "pos", "n")])
    rows = nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block"), "n").agg(F.sort_array(F.collect_list(kept)).alias("rows"))
    rows = rows.withColumn("low", F.array_join("rows.node", "")).withColumn("high", F.when(F.col("n") > 1, _parents(F.col("low"))))
    top = F.when(F.col("n") == 1, F.col("low")).when(F.col("n") <= RUN, F.col("high")).otherwise(_parents(F.col("high")))
    return rows.withColumn("top", top)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of each round, up to the one in which every key has a single block."""
    found = [stash(_blocks(nodes))]
    while (found[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        upper = found[-1].where(F.col("n") > BLOCK).select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("node"))
        found.append(stash(_blocks(upper)))
    return found


def _paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Every node of the blocks with its siblings up to the root; ``above(key, block, last, above, subroot)`` has those of the blocks' roots."""
    joined = blocks.withColumn("last", F.col("n") <= BLOCK).join(above, ["key", "block", "last"])

    def row(r: Column) -> Column:
        own = F.when(F.col("n") == 1, F.array().cast(PATH)).when(F.col("n") <= RUN, F.array(_flanks(F.col("low"), r["pos"])))
        own = own.otherwise(F.array(_flanks(F.col("low"), r["pos"]), _flanks(F.col("high"), F.floor(r["pos"] / RUN).cast("int"))))
        return F.struct(r.alias("r"), F.concat(own, F.col("above")).alias("siblings"))

    return joined.select("key", "block", "subroot", F.inline(F.transform("rows", row)))


def _proved(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(key, subroot, r, siblings) of the first round's nodes; ``above(key, above, subroot)`` has the siblings of the keys' roots."""
    tops = above.select("key", F.lit(0).cast("long").alias("block"), F.lit(True).alias("last"), "above", "subroot")
    paths = None
    for blocks in reversed(rounds):
        known = tops if paths is None else tops.unionByName(paths)
        found = _paths(blocks, known)
        paths = found.select("key", (F.col("block") * BLOCK + F.col("r.pos")).alias("block"), F.lit(False).alias("last"), F.col("siblings").alias("above"), "subroot")
    return found.select("key", "subroot", "r", "siblings")


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` (doc_id, source, lang, n_chars, text) -> doc_id, source, leaf, subroot, root, siblings, and the columns of ``carry``.

    Siblings are the digests left and right of the node in its run, from the leaf's level up to the root. Leaves of a source ascend by
    doc_id, null first, ties by their digest: repeated rows are leaves each, and alike. A null source is a source, the first; the
    empty string is another. Nulls in any column are told from every value; a long text is hashed whole. An empty table gives no row.
    """
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    extra = [c.alias("_" + name) for name, c in (carry or {}).items()]
    leaves = stash(docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("node"), *extra))
    trees = _rounds(_in_order(leaves, "key", "doc_id", "node"))
    done = trees[0].where(F.col("n") <= BLOCK).select("key", "top")
    for blocks in trees[1:]:
        done = done.unionByName(blocks.where(F.col("n") <= BLOCK).select("key", "top"))
    subroots = stash(done.select(F.lit(0).alias("all"), F.col("key").alias("name"), F.col("top").alias("node")))
    over = _rounds(_in_order(subroots, "all", "name").withColumnRenamed("all", "key"))
    first = over[-1].select("top").first()
    root = F.lit(first[0] if first else None).cast("string")
    nothing = over[-1].select("key", F.array().cast(PATH).alias("above"), F.col("top").alias("subroot")).limit(1)
    tops = stash(_proved(over, nothing).select(F.col("r.name").alias("key"), F.col("siblings").alias("above"), F.col("r.node").alias("subroot")))
    source = F.when(F.col("key") != "", F.expr("substring(key, 2)"))
    return _proved(trees, tops).select("r.doc_id", source.alias("source"), F.col("r.node").alias("leaf"), "subroot", root.alias("root"), "siblings", *[F.col(f"r._{name}").alias(name) for name in carry or {}])
