"""Sum-of-squares packing of tokenized documents into sequences.

Every task packs its own pieces: a piece goes where the sum of the squared numbers of open bins per residual gap becomes
smallest. Bins that are left with much room are packed once more across tasks, as pieces of their fill.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geojobs.llm.common import small_batches, stash

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs: its lengths and open bins are all that it holds.
TASK_PIECES = 100_000
#: Words whose ids a worker remembers; beyond it starts anew.
CACHE_WORDS = 300_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters that the tokenizer's normalizer leaves alone but for case and white space, and an added token.
PLAIN = r"[\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*"
BREAK = "<|endoftext|>"


class WordIds:
    """Ids of texts through the ids of their words.

    The tokenizer turns white space into single spaces and drops them, so no token goes across a space: a text's ids are those of
    its space-separated words. Texts of plain characters are first lower-cased and get a space before a full stop or comma that ends a
    word, where it splits anyway unless signs stand side by side, so that fewer words differ. New words are encoded many at a time, joined by an added token that
    tells where each ends; words with ``<|``, perhaps added tokens themselves, are encoded alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        # The same model without its normalizer and splitter, for words that are lower-case letters throughout.
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.bare, self.letters = Tokenizer.from_str(json.dumps(bare)), re.compile(r"[a-z\u00e0-\u00f6\u00f8-\u00ff]+")
        self.stop = self.tokenizer.token_to_id(BREAK)
        self.plain, self.runs = re.compile(PLAIN), re.compile(r"[!-/:-@\[-`{-~][.,]")
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.start, self.ids = np.zeros(1, np.int64), np.empty(0, "<u4")

    def _encode(self, tokenizer: Tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        lines = [BREAK.join(words[i : i + 256]) for i in range(0, len(words), 256)]
        found = [np.array([*e.ids, self.stop], "<u4") for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.empty(0, "<u4")
        return ids[ids != self.stop], np.diff(np.flatnonzero(ids == self.stop), prepend=-1) - 1

    def _learn(self, words: list[str]) -> None:
        kinds: tuple = ([], [], [])
        for w in words:
            kinds[0 if self.letters.fullmatch(w) else 2 if "<|" in w else 1].append(w)
        found = [self._encode(self.bare, kinds[0]), self._encode(self.tokenizer, kinds[1])]
        for w in kinds[2]:
            ids = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4")
            found.append((ids, np.array([ids.size])))
        self.slot.update(zip([w for k in kinds for w in k], range(len(self.slot), len(self.slot) + len(words))))
        self.ids = np.concatenate((self.ids, *(x for x, _ in found)))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(np.concatenate([n for _, n in found]).astype(np.int64))))

    def _spaced(self, text: str) -> str:
        if not self.plain.fullmatch(text):
            return text
        text = text.lower().replace("\n", " ")
        return text if self.runs.search(text) else text.replace(". ", " . ").replace(", ", " , ")

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the texts' ends in them."""
        texts = [self._spaced(t) for t in texts]
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        known = words.dictionary.to_pylist()
        if len(self.slot) + len(known) > CACHE_WORDS:
            self.forget()
        self._learn([w for w in known if w not in self.slot])
        slots = np.fromiter(map(self.slot.__getitem__, known), np.int64, len(known))[words.indices.to_numpy()]
        starts, sizes = self.start[slots], self.start[slots + 1] - self.start[slots]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if ends.size else 0)]
        return ids, np.concatenate(([0], ends))[split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]]


def _word_ids(path: str) -> WordIds:
    """This worker's, kept over its tasks."""
    kept = sys.modules.setdefault("geojobs_worker", types.ModuleType("geojobs_worker"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.ids = path, WordIds(path)
    return kept.ids


def _piece_maker(tokenizer_path: str, capacity: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, size = _word_ids(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in small_batches(batches, "text", 4 << 20):
            rows: list[list] = [[], [], [], [], []]
            ids, ends = encode([t or "" for t in batch.column(1).to_pylist()])
            begin = 0
            for doc, stop in zip(batch.column(0).to_pylist(), ends.tolist()):
                data, begin = ids[begin:stop].tobytes() + end, stop
                for piece, at in enumerate(range(0, len(data), size)):
                    part = data[at : at + size]
                    for column, value in zip(rows, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_piece_maker(tokenizer_path, capacity, end_id), PIECE)


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each length, the longest first; ties keep their order.

    ``open_[g]`` counts open bins with gap g. Into gap g a piece of n changes the sum of squares by
    1 - 2 open_[g] for leaving g, plus 1 + 2 open_[g - n] for entering g - n unless that closes the bin.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(lengths.size, np.int64), np.empty(lengths.size, np.int64)
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in order.tolist():
        n = int(lengths[i])
        change = -2 * open_[n:] + 1
        change[1:] += 2 * open_[1 : capacity - n + 1] + 1
        change[open_[n:] == 0] = np.iinfo(np.int64).max
        at = int(change.argmin())
        gap = n + at
        if not open_[gap] or change[at] > (2 * open_[capacity - n] + 1 if n < capacity else 0):
            chosen, gap = made, capacity
            made += 1
        else:
            chosen = stacks[gap].pop()
            open_[gap] -= 1
        bins[i], offsets[i] = chosen, capacity - gap
        if gap > n:
            open_[gap - n] += 1
            stacks[gap - n].append(chosen)
    return bins, offsets


def _packer(size: str, task_pieces: int, capacity: int) -> Callable:
    """Rows -> the same rows with ``bin`` and ``offset``; bins are numbered by task and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, held, rows = TaskContext.get().partitionId() << 40, [], 0

        def packed() -> pa.RecordBatch:
            nonlocal base
            whole = pa.Table.from_batches(held).combine_chunks()
            bins, offsets = pack_lengths(whole.column(size).to_numpy(), capacity)
            out = whole.append_column("bin", pa.array(bins + base)).append_column("offset", pa.array(offsets))
            base += int(bins.max()) + 1
            return out

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= task_pieces:
                yield from packed().to_batches()
                held, rows = [], 0
        if rows:
            yield from packed().to_batches()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, task_pieces: int = TASK_PIECES) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; a null doc_id stays null and repeated rows are packed each; an empty table gives no
    row. Texts over ``capacity`` ids are cut, no other. Pieces of one length are packed in the order in which they come; of gaps that
    are equally good the narrowest is taken, and an open bin before a new one. Other columns of ``docs`` are left out.
    """
    made = stash(pieces(docs, tokenizer_path, capacity, end_id))
    tasks = max(1, -(-made.count() // task_pieces))
    schema = PIECE + ", bin long, offset long"
    first = stash(made.repartition(tasks).mapInArrow(_packer("length", 2 * task_pieces, capacity), schema))
    if tasks == 1:
        return first.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    # Bins that kept more than a fiftieth of their room meet those of other tasks.
    fills = first.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < capacity - capacity // 50)
    loose = stash(fills.select(F.col("bin").alias("old"), "fill"))
    again = loose.repartition(max(1, -(-loose.count() // task_pieces))).mapInArrow(_packer("fill", 2 * task_pieces, capacity), "old long, fill long, bin long, offset long")
    moved = again.select(F.col("old").alias("bin"), (-1 - F.col("bin")).alias("to"), F.col("offset").alias("shift"))
    return first.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
