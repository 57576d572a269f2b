import random

import numpy as np

from geojobs.llm import decontam


def ids(words):
    return np.array([hash(w) & (2**63 - 1) for w in words], np.uint64)


def greedy(pattern, runs, k):
    """The definition: the longest match of unmarked tokens, the first by places, again and again."""
    p_free, r_free, made = [True] * len(pattern), [[True] * len(r) for r in runs], []
    while True:
        best = None
        for p in range(len(pattern)):
            for x, run in enumerate(runs):
                for t in range(len(run)):
                    n = 0
                    while p + n < len(pattern) and t + n < len(run) and pattern[p + n] == run[t + n] and p_free[p + n] and r_free[x][t + n]:
                        n += 1
                    if n >= k and (best is None or n > best[0]):
                        best = (n, p, x, t)
        if best is None:
            return made
        n, p, x, t = best
        for i in range(n):
            p_free[p + i] = r_free[x][t + i] = False
        made.append(best)


def test_tiles_against_the_definition():
    rng = random.Random(5)
    for case in range(150):
        vocab = [str(i) for i in range(rng.choice([3, 8, 60]))]
        pattern = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        runs = []
        for _ in range(rng.randint(0, 3)):
            cut = sorted(rng.randint(0, len(pattern)) for _ in range(2))
            runs.append([rng.choice(vocab) for _ in range(rng.randint(0, 6))] + pattern[cut[0] : cut[1]] + [rng.choice(vocab)])
        got = decontam.tiles(ids(pattern), [ids(r) for r in runs], 5)
        want = greedy(pattern, runs, 5)
        assert (got[0][0] if got else 0) == (want[0][0] if want else 0)
        assert sum(m[0] for m in got) == sum(m[0] for m in want)


def test_leaks(spark, make, odd):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 60)))) for i in range(30)] + [(100, None), (101, ""), (102, "too short"), (None, "x " * 20), (0, "")]
    items += [(7, " ".join(f"other{i}" for i in range(20))), (None, " ".join(f"nameless{i}" for i in range(20))), (7, " ".join(f"other{i}" for i in range(20)))]
    words = [i[1].split() for i in items[:30]]
    noise = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = list(odd)
    rows += [(1000 + i, " ".join(noise(50) + words[i] + noise(50)).upper()) for i in range(10)]
    rows += [(2000 + i, ", ".join(words[i][len(words[i]) // 2 :] + noise(20) + words[i][: len(words[i]) // 2])) for i in range(10, 20)]  # halves changed about
    rows += [(3000 + i, " ".join(noise(30) + words[i][:6] + noise(30))) for i in range(20, 30) if len(words[i]) > 15]  # a few words only
    rows += [(5000, " ".join(noise(9) + [f"other{i}" for i in range(20)])), (5001, " ".join(noise(9) + [f"Nameless{i}," for i in range(20)])), (5002, "Too short!"), (5003, "it is too short for that"), (5004, "too")]
    rows += [(4000, " ".join(words[3])), (4000, " ".join(words[3])), (None, " ".join(words[4]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make(rows), bench).collect()}
    assert got == {(1000 + i, i) for i in range(10)} | {(2000 + i, i) for i in range(10, 20)} | {(4000, 3), (None, 4), (5000, 7), (5001, None), (5002, 102)}
    kept = decontam.clean(make(rows), bench)
    assert kept.count() == len(rows) - 26 and len(kept.columns) == 7


def test_empty(spark, make, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert decontam.clean(make(odd), none).count() == len(odd) and decontam.contaminated(make([]), some).count() == 0


def test_windows():
    x = np.arange(20, dtype=np.uint64) * np.uint64(977)
    both = np.concatenate((x, x))
    h = decontam.window_hashes(both, 6)
    assert (h[:15] == h[20:35]).all() and len(set(h[:20].tolist())) == 20 and decontam.window_hashes(x, 21).size == 0


def test_a_line_that_many_share_makes_no_pairs(spark, make):
    """300 documents and 200 items have one line of a dozen words in common: no document meets an item through it."""
    line = "read the text below and choose the best of the four answers"
    items = [(i, " ".join([line] + [f"item{i}w{k}" for k in range(30)])) for i in range(200)]
    rows = [(i, " ".join([f"doc{i}w{k}" for k in range(20)] + [line])) for i in range(300)] + [(1000 + i, items[i][1]) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    seen = []
    keep = decontam._candidates

    def watched(*args):
        seen.append(keep(*args))
        return seen[-1]

    decontam._candidates = watched
    try:
        got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make(rows), bench).collect()}
    finally:
        decontam._candidates = keep
    assert got == {(1000 + i, i) for i in range(5)} and seen[0].count() == 5


def test_telling_seeds_miss_no_leak():
    """Against all windows: texts that avoid an item's telling seeds cover less than the share in demand."""
    import pyarrow as pa

    rng = random.Random(4)
    for _ in range(200):
        item = ids([str(rng.randint(0, 12)) for _ in range(rng.randint(1, 40))])
        size = min(5, item.size)
        windows = decontam.window_hashes(item, size).view(np.int64)
        df = [{"seed": int(s), "df": rng.randint(0, 9)} for s in set(windows.tolist()) if rng.random() < 0.8]
        share = rng.choice([0.3, 0.5, 1.0])
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([item.view(np.int64).tolist()]), pa.array([df], pa.list_(pa.struct([("seed", pa.int64()), ("df", pa.int64())])))], names=["key", "item", "df"])
        kept = {s for out in decontam._telling(5, share)(iter([batch])) for s in out.column(1).to_pylist()}
        covered = np.zeros(item.size, bool)
        for at, s in enumerate(windows.tolist()):
            if s not in kept:
                covered[at : at + size] = True
        assert kept and covered.sum() < share * item.size
