import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geojobs.llm import quality, toxicity
from geojobs.llm.common import held_out, labelled


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "ka lo mi nu re so ti va".split() for b in "dan fel gor hin jas kel".split()]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        toxic, good = i % 6 == 0, i % 5 != 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "scumm", "loathen", "loathest", "loathish"]))
        text = " ".join(words) + "." if good else " | ".join([words[0]] * 20 + words[:8])
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def data(spark, make):
    docs, labels = corpus()
    return make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out_accuracy(docs, labels, scored, label):
    rows = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 200
    return sum((r.predicted == 1) == (r[label] == 1) for r in rows) / len(rows)


def test_toxicity_held_out(data):
    docs, labels = data
    model = toxicity.fit(docs, labels)
    assert held_out_accuracy(docs, labels, toxicity.toxicity(docs, model), "toxic") > 0.97
    found = toxicity.passages(docs, model).join(labels, "doc_id")
    assert found.where("toxic = 1").select("doc_id").distinct().count() > 120 and found.where("toxic = 0").count() < 15


def test_quality_held_out(data):
    docs, labels = data
    assert held_out_accuracy(docs, labels, quality.quality(docs, quality.fit(docs, labels)), "quality") > 0.97


def test_odd_rows(make, odd, data):
    for scored in (toxicity.toxicity(make(odd), toxicity.fit(*data)), quality.quality(make(odd), quality.fit(*data))):
        rows = scored.collect()
        assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)


def test_without_labels_or_documents(spark, make, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 0, 0), (7, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert toxicity.toxicity(make(odd), toxicity.fit(make(odd), labels)).where("predicted = 1").count() == 0
        assert quality.quality(make(odd), quality.fit(make(odd), labels)).count() == len(odd)
    assert toxicity.toxicity(make([]), toxicity.fit(make([]), none)).count() == 0
    assert quality.quality(make([]), quality.fit(make([]), none)).count() == 0


def all_maximal(s):
    """Ruzzo and Tompa's definition: take a best segment (the shortest, then first), go on on both sides."""
    best = max(((sum(s[i:j]), -(j - i), -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    return all_maximal(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in all_maximal(s[j:])]


def test_segments_against_the_definition():
    rng = random.Random(1)
    for _ in range(300):
        line = [rng.choice([1.5, 2.25, 4.125]) if rng.random() < 0.35 else -rng.choice([0.53125, 1.0, 2.03125]) for _ in range(rng.randint(0, 25))]
        got = toxicity.segments(np.array(line))
        assert [(a, b) for a, b, _ in got] == all_maximal(line)
        assert all(abs(x - sum(line[a:b])) < 1e-9 for a, b, x in got)


def test_gumbel_parameters_are_found_again():
    rng = np.random.default_rng(6)
    for rate, size in ((0.7, 0.02), (1.6, 0.5)):
        n = rng.integers(20, 400, 4000).astype(float)
        best = np.maximum(0.0, (np.log(size * n) - np.log(-np.log(rng.uniform(size=n.size)))) / rate)
        got = toxicity.gumbel(best, n)
        assert abs(got[0] / rate - 1) < 0.1 and abs(got[1] / size - 1) < 0.25
    assert all(np.isfinite(toxicity.gumbel(np.zeros(50), np.full(50, 30.0)))) and all(np.isfinite(toxicity.gumbel(np.empty(0), np.empty(0))))


def test_tokens_score_for_and_against(data):
    """Signed log-odds under corpus-proportional pseudo-counts, those of words of clean documents among them."""
    docs, labels = data
    model = toxicity.fit(docs, labels)
    assert any(v > 0 for v in model.terms.values()) and model.cost > 0 and model.rate > 0
    odds, error = toxicity._odds(F.lit(30), F.lit(10), {True: 100, False: 900})
    row = docs.limit(1).select(odds.alias("o"), error.alias("e")).first()
    own, all_ = toxicity.PRIOR * 40, toxicity.PRIOR * 1000
    assert abs(row.o - (np.log((30 + own) / (100 + all_ - 30 - own)) - np.log((10 + own) / (900 + all_ - 10 - own)))) < 1e-9
    assert abs(row.e - np.sqrt(1 / (30 + own) + 1 / (10 + own))) < 1e-9
    scorer = toxicity.Scorer(toxicity.ToxicityModel({"bad": 5.0, "fine": -2.0}, cost=0.5))
    assert [scorer._score(w) for w in ("bad", "fine", "other")] == [4.5, -2.5, -0.5]


def test_interactions_by_the_identity():
    rng = np.random.default_rng(0)
    k = quality.BUCKETS + len(quality.STATS)
    model = quality.QualityModel(0.3, rng.normal(size=k), rng.normal(size=(k, quality.RANK)), np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    ids, x, z = np.array([3, 70, 9000]), np.array([0.2, 1.0, -0.4]), rng.normal(size=len(quality.STATS))
    where, value = np.concatenate((ids, np.arange(quality.BUCKETS, k))), np.concatenate((x, z))
    pairs = sum(model.v[where[i]] @ model.v[where[j]] * value[i] * value[j] for i in range(value.size) for j in range(i))
    assert abs(quality._score(model, ids, x, z) - (0.3 + model.w[where] @ value + pairs)) < 1e-9


def test_the_bound_of_labels_holds_for_rows(spark):
    """A thousand rows of one id are one row to learn from, whichever order they come in."""
    docs = spark.range(20_000).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    free = labels.where(~held_out(F.col("doc_id"))).count()
    got = sorted(tuple(r) for r in labelled(docs, labels, "toxic", 100).collect())
    assert len(got) == free and got == sorted(tuple(r) for r in labelled(docs.orderBy(F.desc("text")), labels, "toxic", 100).collect())
    assert labelled(docs, labels, "toxic", 5).count() == 5
