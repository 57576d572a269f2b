"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Of a document's metadata only its sizes (characters, words, lines) are features, told from the text: language, source and ids must not
tell its quality, so the model takes no other column.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise interactions at a cost linear in
the features that a text has.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geojobs.llm.common import labelled

WORDS = re.compile(r"[^\W\d_]+")
#: Hashed word features; behind them come the statistics.
BUCKETS = 1 << 14
RANK = 8
#: Fitted on at most so many labelled documents, which the driver holds as features.
FIT_ROWS = 12_000
EPOCHS, BATCH, RATE, RIDGE = 6, 256, 0.02, 1e-4
THRESHOLD = 0.5
STATS = (
    "bias", "log characters", "log words", "log lines", "distinct words", "repeated neighbours", "distinct lines", "most frequent word", "mean word length",
    "letters", "digits", "upper case", "white space", "signs", "bars", "stops", "words to a line", "lines that end in a stop", "short words", "distinct word pairs",
)


@dataclass(frozen=True)
class QualityModel:
    """Weights and factors of the factorisation machine, and the statistics' mean and spread."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def statistics(text: str, words: list[str]) -> list[float]:
    """The structure statistics of a text, in the order of STATS."""
    n, m = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    counts = Counter(words)
    letters = sum(map(len, words))
    pairs = len(set(zip(words, words[1:])))
    count = text.count
    digits = sum(count(d) for d in "0123456789")
    spaces = count(" ") + count("\n") + count("\t")
    upper = len(re.findall(r"[A-Z]", text))
    return [
        1.0, np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), len(counts) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        len(set(lines)) / len(lines), max(counts.values(), default=0) / m, letters / m, letters / n, digits / n, upper / n, spaces / n,
        max(0, len(text) - letters - digits - spaces) / n, count("|") / m, (count(".") + count("!") + count("?")) / m, np.log1p(m / len(lines)),
        sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines), sum(len(w) <= 3 for w in words) / m, pairs / m,
    ]


class Featurizer:
    """Texts -> hashed words with weights (unit length) and statistics. Remembers the buckets of words."""

    def __init__(self, cache: int = 150_000):
        self.cache, self.bucket = cache, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        text = text or ""
        words = WORDS.findall(text.lower())
        if len(self.bucket) > self.cache:
            self.bucket = {}
        counts = Counter(words)
        for w in counts:
            if w not in self.bucket:
                self.bucket[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        ids = np.fromiter(map(self.bucket.__getitem__, counts), np.int64, len(counts))
        x = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
        return ids, x / max(1e-9, float(np.sqrt((x * x).sum()))), statistics(text, words)


def _score(model: QualityModel, ids: np.ndarray, x: np.ndarray, stats: np.ndarray) -> float:
    """Logit of one text: the interactions by the sum-of-squares identity."""
    z = np.clip((stats - model.mean) / model.spread, -4, 4)
    wx = model.w0 + model.w[ids] @ x + model.w[BUCKETS:] @ z
    vx = model.v[ids] * x[:, None]
    vz = model.v[BUCKETS:] * z[:, None]
    total = vx.sum(0) + vz.sum(0)
    return float(wx + 0.5 * ((total * total).sum() - (vx * vx).sum() - (vz * vz).sum()))


def probability(model: QualityModel, features: tuple[np.ndarray, np.ndarray, list[float]]) -> float:
    ids, x, stats = features
    return float(1 / (1 + np.exp(-np.clip(_score(model, ids, x, np.array(stats)), -30, 30))))


def fit_features(features: list[tuple[np.ndarray, np.ndarray, list[float]]], label: np.ndarray, seed: int = 0) -> QualityModel:
    """AdaGrad on the logistic loss, both labels weighted alike; without rows of both labels the score is 0.5 throughout."""
    rng = np.random.default_rng(seed)
    k = BUCKETS + len(STATS)
    stats = np.array([f[2] for f in features]).reshape(-1, len(STATS))
    if len(set(label.tolist())) < 2:
        return QualityModel(0.0, np.zeros(k), np.zeros((k, RANK)), np.zeros(len(STATS)), np.ones(len(STATS)))
    mean, spread = stats.mean(0), stats.std(0) + 1e-6
    mean[0], spread[0] = 0, 1
    z = np.clip((stats - mean) / spread, -4, 4)
    weight = np.where(label > 0, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    w0, w, v = 0.0, np.zeros(k), rng.normal(0, 0.01, (k, RANK))
    gw0, gw, gv = 1.0, np.full(k, 1.0), np.full((k, RANK), 1.0)
    tail = np.arange(BUCKETS, k)
    for _ in range(EPOCHS):
        order = rng.permutation(len(features))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            ids = np.concatenate([np.concatenate((features[i][0], tail)) for i in rows])
            x = np.concatenate([np.concatenate((features[i][1], z[i])) for i in rows])
            starts = np.concatenate(([0], np.cumsum([features[i][0].size + tail.size for i in rows])[:-1]))
            vx = v[ids] * x[:, None]
            total = np.add.reduceat(vx, starts)
            logit = w0 + np.add.reduceat(w[ids] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - (label[rows] > 0)) * weight[rows] / len(rows)
            each = np.repeat(g, np.diff(np.concatenate((starts, [ids.size]))))
            uniq, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, each * x, uniq.size) + RIDGE * w[uniq]
            inner = (np.repeat(total, np.diff(np.concatenate((starts, [ids.size]))), axis=0) - vx) * (each * x)[:, None]
            dv = np.stack([np.bincount(back, inner[:, f], uniq.size) for f in range(RANK)], 1) + RIDGE * v[uniq]
            gw0 += g.sum() ** 2
            w0 -= RATE * 5 * g.sum() / np.sqrt(gw0)
            gw[uniq] += 100 * dw**2
            gv[uniq] += 100 * dv**2
            w[uniq] -= RATE * 20 * dw / np.sqrt(gw[uniq])
            v[uniq] -= RATE * 5 * dv / np.sqrt(gv[uniq])
    return QualityModel(float(w0), w, v, mean, spread)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on ``labels(doc_id, quality)`` of ``docs(doc_id, text)`` that aren't held out, at most ``max_rows`` of them.

    Features are made on executors; the driver gets those of the bounded sample in the order of their hash.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Featurizer()
        for pdf in batches:
            made = [make(t) for t in pdf["text"]]
            yield pd.DataFrame({"label": (pdf["label"] > 0).astype(int), "ids": [m[0].astype(np.int16).tobytes() for m in made], "x": [m[1].astype(np.float16).tobytes() for m in made], "stats": [m[2] for m in made]})

    rows = labelled(docs, labels, "quality", max_rows).mapInPandas(run, "label int, ids binary, x binary, stats array<double>").toPandas()
    rows["key"] = [zlib.crc32(i + x) for i, x in zip(rows["ids"], rows["x"])]
    rows = rows.sort_values(["key", "label"], kind="stable")
    features = [(np.frombuffer(i, np.int16).astype(np.int64), np.frombuffer(x, np.float16).astype(float), list(s)) for i, x, s in zip(rows["ids"], rows["x"], rows["stats"])]
    return fit_features(features, rows["label"].to_numpy())


def score(text: Column, model: QualityModel) -> Column:
    """Score from 0 to 1 of a whole text; null counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = Featurizer()
        for texts in batches:
            yield pd.Series([probability(model, make(t)) for t in texts], dtype="float64")

    return run(text.cast("string"))


def quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, score, predicted (score >= 0.5), one row per row.

    A null doc_id stays null; null and empty texts score as empty ones; very long ones are scored whole; repeated rows score alike;
    other columns of ``docs`` are left out, whatever their names. An empty table gives none.
    """
    scored = docs.select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
