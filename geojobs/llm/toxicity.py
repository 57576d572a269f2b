"""Toxicity by maximum-scoring segments of token log-odds.

Learned from labelled documents: for each word and its first letters, in how many toxic and other documents it occurs. The log-odds
between the two, under a Dirichlet prior whose pseudo-counts are in proportion to the corpus, are a token's score: positive for what is
significantly toxic, negative for what is significantly clean; every token costs a fixed amount besides. A linear-time scan (Ruzzo and
Tompa) finds all maximal segments of a text. A Gumbel law for the best segment of a clean text, its location growing with the text's
length, tells which segments are significant; those add up to the document's evidence, which a logistic curve turns into a score. Law
and curve are fitted on labelled documents that the terms behind them have not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geojobs.llm.common import labelled, small_batches, stash

WORDS = re.compile(r"[^\W\d_]+")
#: Fitted on at most so many labelled documents: a bound on the model's cost, not on what is scored.
FIT_ROWS = 20_000
#: A term counts as toxic from this z-score and log-odds on, if fewer than CHANCE terms as frequent as it are expected to be as
#: one-sided by chance, even where toxic documents are UNEVEN times as common as on the whole (in one language, say); the strongest
#: MAX_TERMS make up the model.
MIN_Z, MIN_ODDS, CHANCE, UNEVEN, MAX_TERMS = 2.0, 2.0, 0.3, 2.0, 20_000
#: The prior weighs this share of the labelled documents: a term that n of them hold has PRIOR * n pseudo-counts on both sides.
PRIOR = 0.02
#: A token costs what a median toxic term outweighs over so many tokens.
GAP = 50
#: One of so many labelled documents, by the hash of its text, is kept for calibration.
FOLDS = 3
#: How many first letters stand for a stem.
GRAMS = (4, 5, 6)
THRESHOLD = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    """Signed log-odds of terms, the cost of a token, Gumbel parameters of clean texts' best segments, logistic weights.

    The best of a clean text of n tokens exceeds s with probability 1 - exp(-size * n * exp(-rate * s)).
    """

    terms: dict[str, float] = field(default_factory=dict)
    cost: float = 1.0
    rate: float = 1.0
    size: float = 1.0
    weight: float = 1.0
    bias: float = -3.0


def word_terms(word: str) -> set[str]:
    """The word itself, and ``^`` with its first letters: inflected forms share a stem."""
    return {word} | {"^" + word[:n] for n in GRAMS if len(word) >= n}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(begin, end, score)``, end exclusive, of the tokens' scores.

    Ruzzo and Tompa's scan: linear, with one step for each positive token, since the others between two of them count as one.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    places = np.flatnonzero(scores > 0)
    kept: list[tuple[int, int, float, float, int]] = []  # begin, end, sum before, sum after, last one with a smaller sum before
    for begin, before, after in zip(places.tolist(), sums[places].tolist(), sums[places + 1].tolist()):
        last, j = begin + 1, len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= after:
                kept.append((begin, last, before, after, j))
                break
            begin, _, before, _, link = kept[j]
            del kept[j:]
            j = link
    return [(a, b, y - x) for a, b, x, y, _ in kept]


class Scorer:
    """Segments and evidence of texts under a model; remembers the scores of words."""

    def __init__(self, model: ToxicityModel, cache: int = 150_000):
        self.model, self.cache, self.known = model, cache, {}

    def _score(self, word: str) -> float:
        """The strongest toxic term of a word; without one, what the word itself says for a clean text; less the cost."""
        odds = max((self.model.terms[t] for t in word_terms(word) if t in self.model.terms), default=0.0)
        return (odds if odds > 0 else self.model.terms.get(word, 0.0)) - self.model.cost

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments of the text's tokens, and how many tokens it has."""
        words = WORDS.findall((text or "").lower())
        if len(self.known) > self.cache:
            self.known = {}
        known, different = self.known, set(words)
        for w in different.difference(known):
            known[w] = self._score(w)
        if not any(known[w] > 0 for w in different):
            return [], len(words)
        return segments(np.fromiter(map(known.__getitem__, words), np.float64, len(words))), len(words)

    def significant(self, text: str | None) -> list[tuple[int, int, float]]:
        """``(begin, end, evidence)`` of segments that are expected less than once by chance: the score over the law's location."""
        found, n = self.passages(text)
        location = math.log(self.model.size * max(1, n))
        return [(a, b, self.model.rate * s - location) for a, b, s in found if self.model.rate * s > location]

    def evidence(self, text: str | None) -> float:
        """Sum statistic of all significant segments; 0 without any."""
        return sum(x for _, _, x in self.significant(text))

    def probability(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.model.weight * self.evidence(text) + self.model.bias))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> word, documents that hold it: toxic and other. Words are expanded to terms after they are counted."""
    for batch in small_batches(batches, "text", 6 << 20):
        counts = (Counter(), Counter())
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for term in {t for w in set(WORDS.findall((text or "").lower())) for t in word_terms(w)}:
                counts[1 if y else 0][term] += 1
        # A term of clean documents alone can't be toxic.
        terms = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "other"])


def _calibrate(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic weight (not negative) and bias by Newton's method with a weak ridge."""
    w, b = 0.1, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w * evidence + b, -30, 30)))
        r, h = p - label, p * (1 - p) + 1e-6
        g = np.array([(r * evidence).sum() + 1e-2 * w, r.sum() + 1e-2 * b])
        m = np.array([[(h * evidence**2).sum() + 1e-2, (h * evidence).sum()], [(h * evidence).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(m, g)
        w, b = w - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(0.0, float(w)), float(b)


def gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Rate and size of the law of clean texts' best segments by maximum likelihood; texts without a segment (0) are censored.

    Given the rate, size = m / sum n exp(-rate s) for m texts with a segment; the rate's derivative falls, so halving finds its root. One
    more text of typical length with a segment of score 1 keeps both finite where next to nothing is positive by chance.
    """
    best, n = np.append(best, 1.0), np.append(np.maximum(n, 1), max(1.0, float(np.median(n)) if n.size else 1.0))
    m, total = int((best > 0).sum()), float(best.sum())

    def size(rate: float) -> float:
        return m / float((n * np.exp(-rate * best)).sum())

    low, high = 0.02, 5.0
    for _ in range(60):
        rate = (low + high) / 2
        slope = m / rate - total + size(rate) * float((n * best * np.exp(-rate * best)).sum())
        low, high = (rate, high) if slope > 0 else (low, rate)
    return low, size(low)


def _odds(y: Column, x: Column, n: dict[bool, int]) -> tuple[Column, Column]:
    """Log-odds of a term in toxic against other documents under the prior, and its standard error."""
    own, all_ = PRIOR * (y + x), PRIOR * (n[True] + n[False])
    odds = F.log((y + own) / (n[True] + all_ - y - own)) - F.log((x + own) / (n[False] + all_ - x - own))
    return odds, F.sqrt(1 / (y + own) + 1 / (x + own))


def _sizes(sample: DataFrame) -> dict[bool, int]:
    return {r["toxic"]: r["n"] for r in sample.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on ``labels(doc_id, toxic)`` of ``docs(doc_id, text)`` that aren't held out, at most ``max_rows`` of them.

    The law and the curve are fitted on one of FOLDS documents with the terms of the others; the terms that scores then use come from
    all. Term counts are made on executors; the driver gets the significant terms and two numbers of each calibration document. Without
    labelled rows of both kinds the model has no terms and scores all texts alike and low. Too few to keep some for calibration: all
    serve for both.
    """
    whole = stash(labelled(docs, labels, "toxic", max_rows))
    kept = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    seen, fold = whole.where(~kept), whole.where(kept)
    terms, cost = _terms(whole)
    if not terms:
        return ToxicityModel()
    apart = _terms(seen) if len(_sizes(fold)) == 2 else ({}, 1.0)
    if not apart[0]:
        apart, fold = (terms, cost), whole
    best = _evidence(fold, ToxicityModel(*apart), best=True)
    none = best[best["label"] == 0]
    rate, size = gumbel(none["value"].to_numpy(), none["n"].to_numpy(float))
    found = _evidence(fold, ToxicityModel(*apart, rate=rate, size=size), best=False)
    weight, bias = _calibrate(found["value"].to_numpy(), (found["label"] > 0).to_numpy().astype(float))
    return ToxicityModel(terms, cost, rate, size, weight, bias)


def _terms(sample: DataFrame) -> tuple[dict[str, float], float]:
    """Log-odds of the significant terms of ``sample(text, label)``, and what a token costs; none without rows of both kinds."""
    n = _sizes(sample)
    if len(n) < 2:
        return {}, 1.0
    counts = sample.mapInArrow(_count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("y"), F.sum("other").alias("x"))
    odds, error = _odds(F.col("y"), F.col("x"), n)
    counts = stash(counts.where("y + x > 2").withColumns({"n": F.col("y") + F.col("x"), "odds": odds, "z": odds / error}))
    alike = counts.groupBy("n").agg(F.count(F.lit(1)).alias("alike"))  # a row for each frequency, max_rows at most
    base = min(0.5, UNEVEN * n[True] / (n[True] + n[False]))
    share = F.col("y") / F.col("n")
    tail = F.col("n") * (share * F.log(share / base) + F.when(F.col("x") > 0, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
    strong = counts.where((F.col("y") > 0) & (share > base)).join(F.broadcast(alike), "n").where(F.log("alike") - tail <= math.log(CHANCE))
    strong = strong.where((F.col("odds") >= MIN_ODDS) & (F.col("z") >= MIN_Z))
    likely = {r["term"] for r in strong.orderBy(F.col("z").desc(), "term").limit(MAX_TERMS).collect()}
    terms = _in_many_contexts(sample, likely, {r["n"]: r["alike"] for r in alike.collect()}, n, base)
    if not terms:
        return {}, 1.0
    cost = float(np.median(list(terms.values()))) / GAP
    # What speaks for a clean text: whole words that toxic documents hold significantly less often.
    clean = counts.where(~F.col("term").startswith("^") & (F.col("z") <= -MIN_Z)).orderBy("z", "term").limit(MAX_TERMS)
    return terms | {r["term"]: r["odds"] for r in clean.select("term", "odds").collect() if r["term"] not in terms}, cost


def _in_many_contexts(sample: DataFrame, likely: set[str], alike: dict[int, int], n: dict[bool, int], base: float) -> dict[str, float]:
    """Log-odds of those likely terms that stay significant when a term between the same two words counts once.

    All words of a toxic document that has many copies look toxic; its copies are one context to each of them.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in small_batches(batches, "text", 6 << 20):
            seen = set()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = ["", *WORDS.findall((text or "").lower()), ""]
                for i in range(1, len(words) - 1):
                    found = known.get(words[i])
                    if found is None:
                        found = known[words[i]] = tuple(t for t in word_terms(words[i]) if t in likely)
                    for term in found:
                        seen.add((term, y > 0, f"{words[i - 1]} {words[i]} {words[i + 1]}"))
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.bool_(), pa.string()))], names=["term", "toxic", "context"])

    found = sample.mapInArrow(contexts, "term string, toxic boolean, context string").distinct().groupBy("term")
    counts = found.agg(F.count_if("toxic").alias("y"), F.count_if(~F.col("toxic")).alias("x")).collect()  # a row for each likely term
    terms = {}
    for r in counts:
        y, x = min(r["y"], n[True]), min(r["x"], n[False])
        share = y / (y + x)
        if share <= base:
            continue
        tail = (y + x) * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if x else 0))
        own, all_ = PRIOR * (y + x), PRIOR * (n[True] + n[False])
        odds = math.log((y + own) / (n[True] + all_ - y - own)) - math.log((x + own) / (n[False] + all_ - x - own))
        error = math.sqrt(1 / (y + own) + 1 / (x + own))
        if odds >= MIN_ODDS and odds / error >= MIN_Z and math.log(alike.get(y + x, 1)) - tail <= math.log(CHANCE):
            terms[r["term"]] = odds
    return terms


def _evidence(sample: DataFrame, model: ToxicityModel, best: bool) -> pd.DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in batches:
            found = [scorer.passages(t) for t in pdf["text"]] if best else [([], 0)] * len(pdf)
            value = [max((s for _, _, s in f), default=0.0) for f, _ in found] if best else [scorer.evidence(t) for t in pdf["text"]]
            yield pd.DataFrame({"label": (pdf["label"] > 0).astype(int), "value": value, "n": [k for _, k in found]})

    return sample.mapInPandas(run, "label int, value double, n long").toPandas()


def score(text: Column, model: ToxicityModel) -> Column:
    """Score from 0 to 1 of a whole text; null and empty texts have the score of no evidence."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.probability(t) for t in texts], dtype="float64")

    return run(text.cast("string"))


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every significant passage: doc_id, begin and end as token numbers, its evidence, its tokens.

    Null and empty texts have none; very long ones are scanned whole; repeated rows give theirs again; other columns of ``docs`` are
    left out, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                if found := scorer.significant(text):
                    words = WORDS.findall(text.lower())
                    rows += [(doc, a, b, x, " ".join(words[a:b])) for a, b, x in found]
            yield pd.DataFrame(rows, columns=["doc_id", "begin", "end", "evidence", "passage"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, begin long, end long, evidence double, passage string")


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, score, predicted (score >= 0.7), one row per row.

    A null doc_id stays null; null and empty texts have the score of no evidence; very long ones are scored whole; repeated rows score
    alike; other columns of ``docs`` are left out, whatever their names. An empty table gives none.
    """
    scored = docs.select("doc_id", score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
