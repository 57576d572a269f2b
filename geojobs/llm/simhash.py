"""SimHash near-duplicates: byte-position inverted index, count filter, verification, components.

A fingerprint has 64 bits in 8 bytes. Three differing bits touch at most three bytes, so linked fingerprints share at least five
positional bytes. Single bytes are too common to be posted alone at scale: the index posts every distinct fingerprint under 14 sets of
four byte positions, the blocks of the Steiner system S(3, 4, 8). Whichever five positions two fingerprints share, one block lies
within them. Inside a posting the other positions are indexed byte by byte; each pair that meets there has its shared positional bytes
tallied, pairs with fewer than five are dropped, and only the rest is verified by its differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geojobs.llm.common import at_most, small_batches, spread_join, stash
from geojobs.llm.components import connected_components

MAX_BITS = 3
#: 8 - MAX_BITS: what two linked fingerprints share at least.
MIN_BYTES = 5
#: Larger postings are posted again under finer keys, so that no task holds an unbounded one.
MAX_POSTING = 32_768
#: Postings of which all pairs are tallied at once.
SMALL = 64
#: Rows that go of which every task may hold the numbers (8 MB); of more, the rows are shuffled to them.
FEW = 1_000_000


def _blocks() -> list[tuple[int, ...]]:
    """The 14 blocks: four positions whose 3-bit numbers add up (exclusive or) to zero."""
    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """SimHash of one text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends)], "<u8", n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, text, ...)`` -> ``(doc_id, ..., fp)``."""
    for batch in small_batches(batches, "text"):
        fps = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows).view(np.int64)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(fps)], names=[*kept, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; ``fp`` is the fingerprint's 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


def _small(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of one small posting: all tallies at once."""
    rows = fps.view(np.uint8).reshape(-1, 8)
    shared = (rows[:, None] == rows[None]).sum(axis=2, dtype=np.uint8)
    a, b = np.nonzero(np.triu(shared >= MIN_BYTES, 1))
    linked = _verified(fps[a], fps[b])
    return fps[b[linked]], fps[a[linked]]


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all linked members of one posting, a spanning forest, in memory linear in its members.

    Positions at which all members agree count for each pair; the others are an inverted index, whose postings a member looks up.
    """
    rows, todo = fps.view(np.uint8).reshape(-1, 8).astype(np.int32), np.ones(fps.size, bool)
    index = []
    for p in range(8):
        order = np.argsort(rows[:, p], kind="stable")
        starts = np.searchsorted(rows[order, p], np.arange(257))
        if starts[rows[0, p] + 1] - starts[rows[0, p]] < fps.size:
            index.append((p, order, starts.tolist()))
    alike, a, b = 8 - len(index), [], []
    for seed in range(fps.size):
        if not todo[seed]:
            continue
        todo[seed], front = False, [seed]
        while front:
            at = front.pop()
            if alike >= MIN_BYTES:
                kept = np.flatnonzero(todo)
            else:
                met = np.concatenate([order[starts[rows[at, p]] : starts[rows[at, p] + 1]] for p, order, starts in index])
                ids, tally = np.unique(met[todo[met]], return_counts=True)
                kept = ids[alike + tally >= MIN_BYTES]
            linked = kept[_verified(fps[kept], fps[at])]
            if linked.size:
                todo[linked] = False
                a.append(fps[linked])
                b.append(np.full(linked.size, fps[at]))
                front += linked.tolist()
    none = np.empty(0, np.uint64)
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(key, fp)`` rows -> edges. A posting may go across batches; those of one member are passed over at once."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((starts, [keys.size])))
        two = starts[sizes == 2]
        x, y = fps[two], fps[two + 1]
        kept = (x.view(np.uint8).reshape(-1, 8) == y.view(np.uint8).reshape(-1, 8)).sum(axis=1) >= MIN_BYTES
        x, y = x[kept], y[kept]
        near = _verified(x, y)
        a, b = [x[near]], [y[near]]
        for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            x, y = (_small if size <= SMALL else _forest)(fps[at : at + size])
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
        if keys.size and (cut := int(np.searchsorted(keys, keys[-1]))):
            yield edges(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if keys.size:
        yield edges(keys, fps)


def _post(fps: DataFrame) -> DataFrame:
    """Every fingerprint under each of its 14 four-byte keys: block number and bytes in one long."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    key = lambda k, c: F.lit(k << 32).bitwiseOR(sum((F.shiftleft(byte(p), 8 * i) for i, p in enumerate(c[1:], 1)), byte(c[0])))
    return fps.select(F.explode(F.array(*[key(k, c) for k, c in enumerate(_blocks())])).alias("key"), "fp")


def _finer(rows: DataFrame) -> DataFrame:
    """Post the members of a large posting under 20 keys each: its own and three of six runs of the other 32 bits.

    Three differing bits leave three of six runs as they are. A finer posting has at most 18 free bits, which bounds its members (2 ** 18)
    whatever the corpus; each looks up about a 64th of them.
    """
    blocks = _blocks()
    others = [[p for p in range(8) if p not in c] for c in blocks]
    rest = F.lit(0).cast("long")
    for k, ps in enumerate(others):
        packed = sum((F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)), 8 * i) for i, p in enumerate(ps)), F.lit(0).cast("long"))
        rest = F.when(F.shiftright("key", 32) == k, packed).otherwise(rest)
    cuts = [(0, 6), (6, 6), (12, 5), (17, 5), (22, 5), (27, 5)]
    run = [F.shiftright("_rest", at).bitwiseAND(F.lit((1 << bits) - 1)) for at, bits in cuts]
    keys = [F.xxhash64(F.col("key"), F.lit(n), *[run[i] for i in c]) for n, c in enumerate(combinations(range(6), 3))]
    return rows.withColumn("_rest", rest).select(F.explode(F.array(*keys)).alias("key"), "fp")


def links(fps: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """``(a, b)``: edges that connect just those of the distinct ``fp`` that chains of links connect."""
    posted = _post(fps)
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_posting).select("key")
    large = stash(sizes)
    if large.isEmpty():
        rows = posted
    else:
        hot = posted.join(large, "key", "left_semi")
        rows = posted.join(large, "key", "left_anti").unionByName(_finer(hot))
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_pairs, "a long, b long")


def components(hashed: DataFrame) -> DataFrame:
    """``(fp, root, component_id)`` for each distinct fingerprint of ``hashed(doc_id, fp)``.

    ``root`` is the component's smallest fingerprint, ``component_id`` its smallest doc_id, null if it has none.
    """
    groups = stash(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = connected_components(links(groups.select("fp"))).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    placed = stash(groups.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(roots, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fingerprint, component_id)``, one row per row.

    Null and empty texts have fingerprint 0 and link like others; repeated rows are rows of their own in one component; a null
    doc_id takes part and is the component's id only if it has no other. Other columns of ``docs`` are left out.
    """
    hashed = stash(fingerprints(docs))
    found = spread_join(hashed, components(hashed), "fp", "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest doc_id (null last), ties by the order of the rows.

    Keeps all columns, whatever their names. Of rows that are alike in every column one stays. The rows are written down once with
    numbers; only numbers and fingerprints are shuffled, unless more than FEW rows go.
    """
    number = "row"
    while number in docs.columns:
        number += "_"
    rows = stash(docs.withColumn(number, F.monotonically_increasing_id()))
    small = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(number).alias("row"))
    hashed = stash(small.mapInArrow(_fingerprints, "doc_id long, row long, fp long"))
    first = hashed.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    kept = first.join(components(hashed), "fp").groupBy("root").agg(F.min("first").alias("first"))
    gone = stash(hashed.select("row").join(kept.select(F.col("first.row").alias("row")), "row", "left_anti"))
    return rows.join(at_most(gone, FEW).withColumnRenamed("row", number), number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
