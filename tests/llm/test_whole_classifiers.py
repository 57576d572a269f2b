"""op1 and op7 from terms to scores against plain re-implementations over some 250 documents."""

import math
import re
import zlib
from collections import Counter, defaultdict
from statistics import median

import numpy as np
import pytest
import xxhash
from test_classifiers import corpus

from geojobs.llm import quality, toxicity


@pytest.fixture(scope="module")
def data(spark, make):
    docs, labels = corpus(260, 9)
    docs += [(1000, None), (1001, ""), (1002, "vilest " * 3 + "kadan " * 400)]
    return docs, labels, make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def learned_from(docs, labels, at):
    texts = dict(docs)
    return [(texts[row[0]] or "", row[at]) for row in labels if zlib.crc32(str(row[0]).encode()) % 3 != 1]


def stems(word):
    return {word} | {"^" + word[:n] for n in (4, 5, 6) if len(word) >= n}


def words_of(text):
    return toxicity.WORDS.findall((text or "").lower())


def plain_terms(sample):
    n = Counter(y > 0 for _, y in sample)
    hold = {True: Counter(), False: Counter()}
    for text, y in sample:
        hold[y > 0].update({t for w in words_of(text) for t in stems(w)})
    counts = {t: (hold[True][t], hold[False][t]) for t in hold[True] | hold[False] if hold[True][t] + hold[False][t] > 2}
    alike, base = Counter(y + x for y, x in counts.values()), min(0.5, 2.0 * n[True] / (n[True] + n[False]))

    def odds(y, x):
        own, all_ = 0.02 * (y + x), 0.02 * (n[True] + n[False])
        value = math.log((y + own) / (n[True] + all_ - y - own)) - math.log((x + own) / (n[False] + all_ - x - own))
        return value, value / math.sqrt(1 / (y + own) + 1 / (x + own))

    def one_sided(y, x):
        if not y or y / (y + x) <= base:
            return False
        p = y / (y + x)
        tail = (y + x) * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if x else 0))
        return math.log(alike.get(y + x, 1)) - tail <= math.log(0.3) and odds(y, x)[0] >= 2 and odds(y, x)[1] >= 2

    likely, terms = {t for t, c in counts.items() if one_sided(*c)}, {}
    for t in likely:
        around = set()
        for text, y in sample:
            w = ["", *words_of(text), ""]
            around |= {(y > 0, w[i - 1], w[i], w[i + 1]) for i in range(1, len(w) - 1) if t in stems(w[i])}
        y, x = min(n[True], sum(a[0] for a in around)), min(n[False], sum(not a[0] for a in around))
        if one_sided(y, x):
            terms[t] = odds(y, x)[0]
    cost = median(terms.values()) / 50
    clean = {t: odds(*c)[0] for t, c in counts.items() if t[0] != "^" and odds(*c)[1] <= -2}
    return clean | terms, cost


def best_first(s):
    """A best segment, then what is left of it and right of it."""
    at = np.concatenate(([0.0], np.cumsum(s)))
    gain = at[None, :] - at[:, None]
    gain[np.tril_indices(len(at))] = -1
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    return [] if gain[i, j] <= 0 else best_first(s[:i]) + [float(gain[i, j])] + best_first(s[j:])


def plain_segments(text, terms, cost):
    line = []
    for w in words_of(text):
        value = max((terms[t] for t in stems(w) if t in terms), default=0.0)
        line.append((value if value > 0 else terms.get(w, 0.0)) - cost)
    return best_first(np.array(line)) if line else []


def climb(f, low, high):
    """The place of a maximum of a function with one."""
    for _ in range(200):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if f(a) > f(b) else (a, high)
    return low


def test_toxicity_from_terms_to_scores(data):
    docs, labels, table, label_table = data
    sample = learned_from(docs, labels, 2)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    fold = [(t, y) for t, y in sample if signed(xxhash.xxh64_intdigest(t.encode(), 42)) % 3 == 0]
    seen = [r for r in sample if r not in fold]
    terms, cost = plain_terms(sample)
    apart = plain_terms(seen)
    clean = [(max(plain_segments(t, *apart), default=0.0), max(1, len(words_of(t)))) for t, y in fold if not y]
    clean.append((1.0, max(1.0, median(len(words_of(t)) for t, y in fold if not y))))
    best, n = (np.array(v, float) for v in zip(*clean))
    m = (best > 0).sum()
    size = lambda rate: m / (n * np.exp(-rate * best)).sum()
    rate = climb(lambda r: m * math.log(r * size(r)) - r * best.sum(), 0.02, 5.0)

    def evidence(text, terms, cost):
        location = math.log(size(rate) * max(1, len(words_of(text))))
        return sum(rate * s - location for s in plain_segments(text, terms, cost) if rate * s > location)

    e, y = np.array([evidence(t, *apart) for t, _ in fold]), np.array([float(v > 0) for _, v in fold])
    w = b = 0.0
    for _ in range(100):  # the least of the logistic loss and 0.005 (w^2 + b^2)
        p = 1 / (1 + np.exp(-(w * e + b)))
        h = p * (1 - p)
        step = np.linalg.solve([[(h * e * e).sum() + 0.01, (h * e).sum()], [(h * e).sum(), h.sum() + 0.01]], [((p - y) * e).sum() + 0.01 * w, (p - y).sum() + 0.01 * b])
        w, b = w - step[0], b - step[1]
    want = {i: 1 / (1 + math.exp(-min(50, max(-50, max(0, w) * evidence(t, terms, cost) + b)))) for i, t in docs}
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.toxicity(table, toxicity.fit(table, label_table)).collect()}
    assert len(terms) > 5 and max(want.values()) > 0.9
    assert max(abs(got[i][0] - s) for i, s in want.items()) < 2e-3
    assert all(got[i][1] == (s >= 0.7) for i, s in want.items() if abs(s - 0.7) > 2e-3)


def plain_features(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    values = [(zlib.crc32(w.encode()) % quality.BUCKETS, 1 + math.log(c)) for w, c in Counter(words).items()]
    length = math.sqrt(sum(v * v for _, v in values)) or 1e-9
    return [(b, v / length) for b, v in values], quality.statistics(text or "", words)


def test_quality_from_words_to_scores(data):
    """Plain loops over rows and features: pairs by their sum, AdaGrad term by term."""
    docs, labels, table, label_table = data
    rows = []
    for text, y in learned_from(docs, labels, 1):
        x, stats = plain_features(text)
        packed = np.array([b for b, _ in x], np.int16).tobytes(), np.array([v for _, v in x], np.float16).tobytes()
        rows.append((zlib.crc32(packed[0] + packed[1]), int(y > 0), [(b, float(np.float16(v))) for b, v in x], stats))
    rows.sort(key=lambda r: r[:2])
    k, rank, tail = quality.BUCKETS + len(quality.STATS), quality.RANK, quality.BUCKETS
    mean, spread = np.mean([r[3] for r in rows], 0), np.std([r[3] for r in rows], 0) + 1e-6
    mean[0], spread[0] = 0, 1
    scaled = lambda stats: [(tail + i, float(np.clip((s - m) / d, -4, 4))) for i, (s, m, d) in enumerate(zip(stats, mean, spread))]
    share = np.mean([r[1] for r in rows])
    rng = np.random.default_rng(0)
    w0, w, v = 0.0, np.zeros(k), rng.normal(0, 0.01, (k, rank))
    gw0, gw, gv = 1.0, np.ones(k), np.ones((k, rank))

    def logit(x):
        sums = sum((v[b] * value for b, value in x), np.zeros(rank))
        return w0 + sum(w[b] * value for b, value in x) + 0.5 * float((sums**2).sum() - sum(((v[b] * value) ** 2).sum() for b, value in x)), sums

    for _ in range(quality.EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), quality.BATCH):
            batch = order[at : at + quality.BATCH]
            dw, dv, g0 = defaultdict(float), defaultdict(lambda: np.zeros(rank)), 0.0
            for i in batch:
                _, y, words, stats = rows[i]
                x = words + scaled(stats)
                z, sums = logit(x)
                g = (1 / (1 + math.exp(-max(-30, min(30, z)))) - y) * (0.5 / share if y else 0.5 / (1 - share)) / len(batch)
                g0 += g
                for b, value in x:
                    dw[b] += g * value
                    dv[b] += g * value * (sums - v[b] * value)
            gw0 += g0**2
            w0 -= quality.RATE * 5 * g0 / math.sqrt(gw0)
            for b in dw:
                d, f = dw[b] + quality.RIDGE * w[b], dv[b] + quality.RIDGE * v[b]
                gw[b] += 100 * d**2
                gv[b] += 100 * f**2
                w[b] -= quality.RATE * 20 * d / math.sqrt(gw[b])
                v[b] -= quality.RATE * 5 * f / np.sqrt(gv[b])
    got = {r.doc_id: r.score for r in quality.quality(table, quality.fit(table, label_table)).collect()}
    for i, text in docs:
        x, stats = plain_features(text)
        assert abs(got[i] - 1 / (1 + math.exp(-logit(x + scaled(stats))[0]))) < 1e-6, i
