import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from geojobs.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, n long"


def plain(rows, min_docs, top=10):
    """The definition, term by term."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
        groups[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def share(c):
            return {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}

        p, q = {s: share(c) for s, c in own.items()}, share(whole)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in own:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def ours(spark, rows, min_docs):
    full = [(i, *r, None, "clash", 3) for i, r in enumerate(rows)]
    out = divergence.audit(spark.createDataFrame(full, SCHEMA).repartition(3), min_docs)
    return sorted(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_the_definition(spark, odd):
    texts = [t for _, t in odd] + ["Ünïcode Wörter, straße STRASSE don't", "a b c d e f g h i j k l m n", "É é İ ı 𝔘 x1y2_z-w", "a a a b\x00c\x7fd"] * 2
    rows = [(t, lang, s) for i, t in enumerate(texts) for lang, s in (("en", f"s{i % 3}"), (None, "s1"), ("en", None if i % 5 else ""), ("fr", "only"))]
    rows += [("", "xx", "none"), (None, "xx", "other")]
    for min_docs in (1, 3):
        assert ours(spark, rows, min_docs) == plain(rows, min_docs)


def test_ties_and_a_hot_group(spark, monkeypatch):
    """Far more terms than ranks share a value; tasks hand their counts on early."""
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    rows = [(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(k, k + 60)), "en", "hot" if k % 3 else "cold") for k in range(0, 300, 2)]
    assert ours(spark, rows, 2) == plain(rows, 2)


def test_nothing_kept_and_nothing_at_all(spark):
    assert ours(spark, [("a b", "en", "s"), ("c", "en", "t")], 10) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert ours(spark, [], 10) == []


@pytest.mark.parametrize("count,total,kept", [(0, 1, 1), (7, 7, 1), (10**12, 3 * 10**12 + 1, 10**9), (8_999_999_999_999_990, 8_999_999_999_999_999, 0)])
def test_shares_are_exact(spark, count, total, kept):
    got = spark.range(1).select(divergence.share(*[F.lit(v).cast("long") for v in (count, total, kept)])).first()[0]
    assert got == 1 + 10**9 * (count + 2) // (total + 2 * kept)
