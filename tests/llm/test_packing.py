import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from geojobs.llm import packing, queries


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


def check(out, rows, path, capacity):
    tokenizer = Tokenizer.from_file(path)
    want = []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out], key=str) == sorted(want, key=str)
    bins: dict = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("task_pieces", [100_000, 40])
def test_round_trip(make, odd, path, task_pieces):
    rng = np.random.default_rng(1)
    rows = odd + [(1000 + i, " ".join(f"Tok{int(x)}," for x in rng.integers(0, 5000, int(rng.integers(1, 120))))) for i in range(150)]
    out = packing.pack(make(rows), path, capacity=256, task_pieces=task_pieces).collect()
    total = sum(r.length for r in out)
    assert check(out, rows, path, 256) <= -(-total // 256) * 1.03 + 1


def test_empty(make, path):
    assert packing.pack(make([]), path).count() == 0


def test_sum_of_squares_choice():
    lengths = np.array([6, 6, 4, 3, 1])
    bins, offsets = packing.pack_lengths(lengths, 10)
    fills = {int(b): int(lengths[bins == b].sum()) for b in set(bins.tolist())}
    assert max(fills.values()) <= 10 and len(fills) == 2 and sorted(offsets.tolist())[0] == 0


def test_lengths_of_many_kinds():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    bins, offsets = packing.pack_lengths(lengths)
    order = np.lexsort((offsets, bins))
    b, o, n = bins[order], offsets[order], lengths[order]
    first = np.concatenate(([True], b[1:] != b[:-1]))
    assert (o[first] == 0).all() and (o[1:][~first[1:]] == (o + n)[:-1][~first[1:]]).all() and (o + n).max() <= 2048
    assert bins.max() + 1 <= -(-lengths.sum() // 2048) * 1.01


def test_each_place_has_the_least_sum_of_squares():
    """Every choice against all places tried: the squared counts of open bins by gap are nowhere smaller."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(rng.integers(5, 30))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 40)))
        bins, offsets = packing.pack_lengths(lengths, capacity)
        fill: dict[int, int] = {}
        squares = lambda f: sum(n * n for n in Counter(capacity - v for v in f.values() if v < capacity).values())
        for i in np.argsort(-lengths, kind="stable").tolist():
            n, mine = int(lengths[i]), int(bins[i])
            tried = [squares(fill | {b: v + n}) for b, v in fill.items() if v + n <= capacity] + [squares(fill | {-1: n})]
            assert offsets[i] == fill.get(mine, 0)
            fill[mine] = fill.get(mine, 0) + n
            assert fill[mine] <= capacity and squares(fill) == min(tried)
