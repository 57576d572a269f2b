"""Packing along a space-filling curve: documents that are alike become neighbours, neighbours share sequences.

A document's hashed vector of damped token counts is projected to a few dimensions; its cell there has a place on the Hilbert curve.
Documents are range-sorted by that place and laid end to end, and the stream is cut every ``capacity`` ids. What a task's stream leaves
over at its end goes on to fewer tasks, still in order, until one cuts the last rest into powers of two.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geojobs.llm.common import small_batches, stash, worker_kept

CAPACITY = 2048
END_ID = 1
#: Dimensions of the curve, bits of a cell's side, buckets of the hashed vector, seed of the projection.
DIMS, BITS, BUCKETS, SEED = 4, 8, 1 << 14, 20
#: Ids of a row: longer documents travel as several rows. Ids of a task where the stream is cut, and how many tasks at most do so.
ROW_IDS, TASK_IDS, MAX_TASKS = 1 << 12, 2 << 20, 20_000
#: Tasks whose rests meet in one task of the next round.
FAN_IN = 64
#: Signs that are tokenized at a time.
SLICE = 1 << 20

DOC = "doc_id long, start long, ids binary, doc_tokens long, crc long, " + ", ".join(f"x{i} double" for i in range(DIMS))
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, place long, ids binary"
#: A space between two words: no token of a byte-level tokenizer goes across its left side.
SAFE = re.compile(r"(?<=[a-z0-9.,]) (?=[A-Za-z])")


def _signs() -> dict[str, int]:
    """Byte-level tokenizers write bytes that don't print as the signs from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text under the tokenizer of ``path``, as the file's own library gives them.

    A byte-level BPE whose merges are numbered in the order of its ids, with no normalizer and no template, runs as ranks, which is some
    four times as fast; all others run as they are.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, split = told["model"], told.get("pre_tokenizer") or {}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", ())]
    vocab, added = model.get("vocab", {}), {a["content"]: a["id"] for a in told.get("added_tokens", ())}
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer")
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain = plain and not any(a[k] for a in told.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip"))
    if plain and [vocab.get(m) for m in merges] == list(range(256, 256 + len(merges))):
        import tiktoken
        import public_tokenizers

        signs = _signs()
        ranks = {bytes(signs[c] for c in token): i for token, i in vocab.items() if token not in added}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        return lambda text: np.array(fast.encode(text, allowed_special="all"), "<u4")

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A text in parts of about ``size`` signs, cut before single spaces between words; parts' ids are the text's ids."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def project(ids: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """One row per document: its hashed vector of damped counts, of length 1, times ``matrix``."""
    sizes = np.array([i.size for i in ids])
    bucket = (np.concatenate(ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(len(matrix))
    cell, n = np.unique(np.repeat(np.arange(sizes.size), sizes) * len(matrix) + bucket.astype(np.int64), return_counts=True)
    weight, doc = np.log1p(n), cell // len(matrix)
    rows = matrix[cell % len(matrix)] * weight[:, None]
    norm = np.sqrt(np.bincount(doc, weight**2, sizes.size))
    return np.stack([np.bincount(doc, rows[:, i], sizes.size) for i in range(matrix.shape[1])], 1) / np.maximum(norm, 1e-300)[:, None]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of ``cells`` (rows of whole numbers under 2 ** bits), by Skilling's transpose."""
    x = [c.astype(np.int64) for c in cells.T]
    for at in range(bits - 1, 0, -1):
        side, low = 1 << at, (1 << at) - 1
        for i in range(len(x)):
            high = (x[i] & side) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for at in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & (1 << at)) != 0, turn ^ ((1 << at) - 1), turn)
    key = np.zeros_like(x[0])
    for at in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | (((v ^ turn) >> at) & 1)
    return key


def _reader(path: str, end_id: int, kind: str) -> Callable:
    matrix = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_kept(("encoder", path), lambda: encoder(path))
        for batch in small_batches(batches, "text", SLICE):
            ids = [np.concatenate([*map(encode, slices(t or "")), np.array([end_id], "<u4")]) for t in batch.column(1).to_pylist()]
            at = project(ids, matrix)
            rows: list[list] = [[] for _ in range(5 + DIMS)]
            for doc, own, x in zip(batch.column(0).to_pylist(), ids, at.tolist()):
                for start in range(0, own.size, ROW_IDS):
                    part = own[start : start + ROW_IDS]
                    for column, value in zip(rows, (doc, start, part.astype(kind).tobytes(), own.size, zlib.crc32(own.tobytes()), *x)):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.float64()] * DIMS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["doc_id", "start", "ids", "doc_tokens", "crc", *[f"x{i}" for i in range(DIMS)]])

    return run


def along_curve(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Documents' ids with ``key``, their place on the curve. Each dimension is cut into cells by mean and deviation over all documents."""
    kind = "<u4" if _large(tokenizer_path, end_id) else "<u2"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = stash(rows.mapInArrow(_reader(tokenizer_path, end_id, kind), DOC))
    names = [f"x{i}" for i in range(DIMS)]
    told = made.where("start = 0").agg(*[F.avg(x) for x in names], *[F.stddev_pop(x) for x in names]).first()
    mean, wide = (np.array([v or 0.0 for v in told[i : i + DIMS]]) for i in (0, DIMS))

    @F.pandas_udf("long")
    def key(*columns: pd.Series) -> pd.Series:
        z = (np.stack([c.to_numpy() for c in columns], 1) - mean) / np.maximum(wide, 1e-12)
        return pd.Series(hilbert(np.minimum((1 << BITS) / (1 + np.exp(np.clip(-1.702 * z, -50, 50))), (1 << BITS) - 1).astype(np.int64)))

    return made.withColumn("key", key(*names)).drop(*names)


def _large(path: str, end_id: int) -> bool:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    vocab = told["model"].get("vocab", {})
    largest = max(vocab.values()) if isinstance(vocab, dict) and vocab else len(vocab)
    return max([largest, end_id, *[a["id"] for a in told.get("added_tokens", ())]]) >= 1 << 16


def _cutter(kind: str, capacity: int, round_: int, last: bool, keep_ids: bool) -> Callable:
    """Rows in order (doc_id, start, ids, doc_tokens) -> pieces. Whole sequences are final; the rest at the end keeps its ids and has no
    sequence yet, unless ``last``: then it becomes sequences of a power of two each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        base, made, fill = (round_ << 56) + (task << 32), 0, 0
        out: list[tuple] = []
        open_: list[tuple] = []

        def piece(doc, start, ids, total, sequence, offset, place=None):
            part = None if place is None else task
            return doc, start, ids.size, zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, part, place, ids.tobytes() if keep_ids or place is not None else None

        def handed() -> pa.RecordBatch:
            nonlocal out
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in PIECE.split(", ")])
            out = []
            return batch

        def closed(parts: list[tuple]) -> None:
            nonlocal made
            at = 0
            for doc, start, ids, total in parts:
                out.append(piece(doc, start, ids, total, base + made, at))
                at += ids.size
            made += 1

        def cut(parts: Iterator[tuple], size: int) -> Iterator[tuple]:
            """The first ``size`` ids of the parts."""
            for doc, start, ids, total in parts:
                yield doc, start, ids[:size], total
                size -= min(size, ids.size)
                if not size:
                    return

        for batch in small_batches(batches, "ids", 2 << 20):
            for doc, start, data, total in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                ids = np.frombuffer(data, kind)
                while ids.size:
                    part = ids[: capacity - fill]
                    open_.append((doc, start, part, total))
                    fill, start, ids = fill + part.size, start + part.size, ids[part.size :]
                    if fill == capacity:
                        closed(open_)
                        open_, fill = [], 0
                if len(out) >= 10_000:
                    yield handed()
        if last:
            while fill:
                size = 1 << (fill.bit_length() - 1)
                head = list(cut(iter(open_), size))
                closed(head)
                whole, split = open_[len(head) :], open_[len(head) - 1]
                taken = head[-1][2].size
                rest = [(split[0], split[1] + taken, split[2][taken:], split[3])] if taken < split[2].size else []
                open_, fill = rest + whole, fill - size
        else:
            out.extend(piece(*row, None, None, place) for place, row in enumerate(open_))
        if out:
            yield handed()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, with ``keep_ids``
    also ids (little-endian, two bytes each, four where the vocabulary needs them).

    Every sequence holds ``capacity`` ids, but for at most eleven of powers of two at the end of the curve, so none is padded. A null or
    empty text is the end id alone; a null doc_id stays null; repeated rows are packed each, side by side; documents of one place on the
    curve follow each other by doc_id (null first), then by their ids; very long texts go through many sequences. An empty table gives
    no row. Other columns of ``docs`` are left out.
    """
    spark, kind = docs.sparkSession, "<u4" if _large(tokenizer_path, end_id) else "<u2"
    rows = along_curve(docs, tokenizer_path, end_id)
    tasks = int(min(MAX_TASKS, max(1, -(-(rows.agg(F.sum(F.length("ids"))).first()[0] or 0) // (TASK_IDS * int(kind[-1]))))))
    order, done, round_ = ["key", "doc_id", "crc", "start"], [], 0
    while True:
        dealt = rows.repartitionByRange(tasks, *order) if tasks > 1 else rows.repartition(1)
        dealt = dealt.sortWithinPartitions(*order).select("doc_id", "start", "ids", "doc_tokens")
        cut = stash(dealt.mapInArrow(_cutter(kind, capacity, round_, tasks == 1, keep_ids), PIECE))
        done.append(cut.where("sequence_id is not null"))
        if tasks == 1:
            break
        rows, order, tasks, round_ = cut.where("sequence_id is null"), ["part", "place"], -(-tasks // FAN_IN), round_ + 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return whole.select(*columns, *(["ids"] if keep_ids else []))
