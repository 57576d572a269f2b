import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from geojobs.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, key long, pos long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """(root, siblings of each node by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            run = at[k] // 16 * 16
            path.append(("".join(nodes[run : at[k]]), "".join(nodes[at[k] + 1 : run + 16])))
            at[k] //= 16
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append((r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s])]) for s in names}
    root, over = tree([trees[s][0] for s in names])
    return [(x[1] if x[0] else None, s, x[2], trees[s][0], root, path + over[k]) for k, s in enumerate(names) for x, path in zip(sorted(sources[s]), trees[s][1])]


def ours(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(3)
    return [(r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(s) for s in r.siblings]) for r in merkle.manifest(df, **more).collect()]


def test_against_the_definition(spark, odd):
    """Sources of 1, 2, 16, 17, 256, 257 and some 4,400 leaves, null, empty and many names, repeated rows, null ids."""
    rng = random.Random(1)
    sizes = {None: 3, "": 2, "a": 1, "b": 16, "c": 17, "d": 256, "e": 257, "hot": 4400, "é": 2, "\U0001f600": 1} | {f"s{i}": 1 for i in range(300)}
    rows = [(rng.randrange(10**6), s, rng.choice(["en", None, ""]), rng.choice([None, 5]), f"Text {i}") for s, n in sizes.items() for i in range(n)]
    rows += [rows[0], rows[40], (None, "b", None, None, None), (None, "b", None, None, "x")] + [(i, "odd", None, None, t) for i, t in odd]
    assert sorted(ours(spark, rows), key=str) == sorted(plain(rows), key=str)


def test_folding_tells_tampered_leaves(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(900)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA)
    other = F.when(F.col("doc_id") % 7 == 0, merkle.leaf({"text": F.lower("text")}))
    out = merkle.manifest(df, {"other": other}).withColumn("ok", merkle.fold(F.coalesce("other", "leaf"), F.col("siblings")) == F.col("root"))
    assert {r.doc_id for r in out.where("not ok").collect()} == {i for i in range(900) if i % 7 == 0}


def test_one_and_none(spark):
    (row,) = ours(spark, [(1, "a", None, None, None)])
    assert row[2] == row[3] == row[4] == leaf((1, "a", None, None, None)) and row[5] == []
    assert ours(spark, []) == []


def test_fields_are_framed(spark):
    """Values that run together alike are told apart."""
    rows = [(1, "a", "b", 1, "c"), (1, "a", "b1", None, "c"), (1, "a", None, None, "-"), (1, "a", None, None, None), (1, "a", "-", None, None)]
    assert len({r[2] for r in ours(spark, rows)}) == 5


def test_a_hot_source_is_dealt_over_tasks(spark):
    rows = spark.range(20_000).select(F.lit("=hot").alias("key"), "id", F.sha2(F.col("id").cast("string"), 256).alias("node"))
    placed = merkle._in_order(rows, "key", "id", "node")
    assert placed.where("pos <> id or n <> 20000").count() == 0
    blocks = merkle._blocks(placed)
    assert blocks.select(F.max(F.size("rows"))).first()[0] == merkle.BLOCK and blocks.count() == -(-20_000 // merkle.BLOCK)
