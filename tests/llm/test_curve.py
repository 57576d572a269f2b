import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from geojobs.llm import curve, queries


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path(queries.CURVE_TOKENIZER)


def check(out, rows, path, capacity, kind="<u2"):
    """Each id in one piece, sequences gapless, all of ``capacity`` but for powers of two."""
    tokenizer, parts, places = Tokenizer.from_file(path), defaultdict(list), defaultdict(list)
    want = sorted((str(d), tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in rows)
    for r in out:
        ids = np.frombuffer(r.ids, kind)
        assert ids.size == r.length and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        parts[str(r.doc_id), r.doc_tokens].append((r.start, tuple(ids.tolist())))
        places[r.sequence_id].append((r.offset, r.length))
    got = defaultdict(list)
    for (doc, total), found in parts.items():
        found.sort()
        while found:  # documents of one id and size: pieces chain up
            at, ids, rest = 0, (), []
            texts = [w for d, w in want if d == doc and len(w) == total]
            goal = texts[len([g for g in got[doc] if len(g) == total])]
            for start, piece in found:
                if start == at and goal[at : at + len(piece)] == piece:
                    at, ids = at + len(piece), ids + piece
                else:
                    rest.append((start, piece))
            assert ids == goal
            got[doc].append(ids)
            found = rest
    assert sorted((d, g) for d, gs in got.items() for g in gs) == want
    sizes = []
    for parts_ in places.values():
        at = 0
        for offset, length in sorted(parts_):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(s == capacity or s < capacity and s & (s - 1) == 0 for s in sizes)
    assert sum(s < capacity for s in sizes) <= capacity.bit_length()


@pytest.mark.parametrize("task_ids,row_ids", [(curve.TASK_IDS, curve.ROW_IDS), (2000, 700)])
def test_each_id_once_and_no_padding(make, odd, path, monkeypatch, task_ids, row_ids):
    monkeypatch.setattr(curve, "TASK_IDS", task_ids)
    monkeypatch.setattr(curve, "ROW_IDS", row_ids)
    monkeypatch.setattr(curve, "FAN_IN", 4)
    rng = np.random.default_rng(1)
    rows = odd + [(1000 + i, " ".join(f"Tok{int(x)}," for x in rng.integers(0, 5000, int(rng.integers(1, 120))))) for i in range(150)]
    check(curve.pack(make(rows), path, capacity=256, keep_ids=True).collect(), rows, path, 256)


def test_empty_and_one(make, path):
    assert curve.pack(make([]), path).count() == 0
    (row,) = curve.pack(make([(3, None)]), path).collect()
    assert (row.doc_id, row.start, row.length, row.doc_tokens, row.offset) == (3, 0, 1, 1, 0)


def test_ids_are_the_tokenizers(path):
    fast, slow = curve.encoder(path), Tokenizer.from_file(path)
    rng, signs = np.random.default_rng(0), list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　'sdtlvrem.,!aB1é́中\U0001f600<|>") + ["<|endoftext|>", "'ll", "  ", "word", "­", "﻿"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 25)))) for _ in range(4000)]
    texts += ["x" * 5000, " " * 100_000, "\n " * 50_000, "é" * 3000]
    texts += ["".join(f"a{chr(c)}b {chr(c)} " for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x20000, 64)]
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t[:60])


def test_other_tokenizers_run_as_they_are():
    path = queries.tokenizer_path("word_bpe_49k.json")
    assert curve.encoder(path)("Some Words").tolist() == Tokenizer.from_file(path).encode("Some Words", add_special_tokens=False).ids


def test_long_texts_are_tokenized_in_slices(path):
    text = "Some words, and  more.\n\nIt's <|endoftext|> 12 é. " * 300
    parts = list(curve.slices(text, 500))
    encode = curve.encoder(path)
    assert len(parts) > 10 and "".join(parts) == text and np.concatenate([encode(p) for p in parts]).tolist() == encode(text).tolist()
    assert list(curve.slices("x" * 3000, 500)) == ["x" * 3000]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_each_cell_and_steps_to_a_neighbour(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = curve.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_neighbours_are_alike(make, path):
    """Documents of ten vocabularies: beside each other on the curve stand ones of the same far more often than by chance."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"q{chr(97 + i % 10)}{chr(97 + int(x))}zo" for x in rng.integers(0, 20, 60))) for i in range(400)]
    keys = {r.doc_id: r.key for r in curve.along_curve(make(rows), path).select("doc_id", "key").collect()}
    kinds = [i % 10 for i in sorted(keys, key=lambda i: (keys[i], i))]
    assert np.mean([a == b for a, b in zip(kinds, kinds[1:])]) > 0.5
