"""How far the sources of a language drift from it and from each other: term counts, smoothed shares, divergence in whole numbers.

A term's divergence depends on its counts alone, so terms are grouped into cells of (count in the group, count in the language), each
cell is evaluated once, cells rank by their cumulative multiplicity, and only the cells that reach a rank in demand become terms again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geojobs.llm.common import at_most, small_batches, stash

MIN_DOCS = 10
PRIOR = 2
TOP = 10
SCALE_STEPS = 3  # a share is in 1000 ** 3 parts
#: Distinct terms that a task counts before it hands them on.
HELD_TERMS = 200_000
#: Tables that are broadcast: rows of groups, or of chosen cells, of some 100 bytes.
SMALL = 200_000

#: In UTF-8, letters of ASCII in lower case and whatever is beyond ASCII make terms; all else is a space between them.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), pre-aggregated; the empty term stands for the group itself."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in groups.items():
            terms = list(counts)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
            columns += [pa.array([c[t] for t in terms], pa.int64()) for c in (counts, docs)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in small_batches(batches, "text"):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, source) not in groups:
                groups[lang, source] = Counter({b"": 0}), Counter()
            counts, docs = groups[lang, source]
            before, found = len(counts), text.translate(LETTERS).split()
            counts.update(found)
            docs.update(set(found))
            held += len(counts) - before
            if held >= HELD_TERMS:
                yield from handed()
                held = 0
    yield from handed()


def share(count: Column, total: Column, kept: Column, prior: int = PRIOR) -> Column:
    """1 + floor(10^9 (count + prior) / (total + prior kept)), by long division with digits of base 1000: exact up to 9 * 10^15 occurrences."""
    rest, parts, whole = count + F.lit(prior).cast("long"), F.lit(0).cast("long"), total + F.lit(prior).cast("long") * kept
    for _ in range(SCALE_STEPS):
        parts = parts * 1000 + _div(rest * 1000, whole)
        rest = (rest * 1000) % whole
    return parts + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so nothing overflows."""
    return _div((p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, prior: int = PRIOR, top: int = TOP) -> DataFrame:
    """``docs(text, lang, source)`` -> lang, source, part, item, value, rank: each group's distance from every other source of its
    language (``pair``) and the ``top`` terms that it uses more than its language does (``term``).

    Null texts, languages and sources are empty strings; an empty text counts for its group but has no terms. A repeated row is a
    document more. A language that keeps no term has pairs of value 0 and no terms; a group alone in its language has no pairs; an
    empty table gives no row. Equal values rank by UTF-8 bytes of the item. Other columns of ``docs`` are left out.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = stash(rows.mapInArrow(_count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    words = counts.where("term <> ''")
    vocabulary = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "lang_n")
    kept = stash(words.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]))
    groups = stash(_groups(counts.where("term = ''").select("lang", "source"), kept, stash(vocabulary), prior))
    return _pairs(kept, groups, prior).unionByName(_terms(kept, groups, prior, top))


def _groups(seen: DataFrame, kept: DataFrame, vocabulary: DataFrame, prior: int) -> DataFrame:
    """One row per (lang, source): what its shares need, and its share of a term that it hasn't got (null where no term is kept)."""
    langs = vocabulary.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    full = seen.join(totals, ["lang", "source"], "left").join(F.broadcast(langs), "lang", "left").fillna(0, ["total", "lang_total", "v"])
    return full.withColumn("absent", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v"), prior)))


def _pairs(kept: DataFrame, groups: DataFrame, prior: int) -> DataFrame:
    """Sums over all kept terms: as if neither source had any of them, corrected by the cells of the terms that one of them has, and by
    the terms that both have. No row stands for a term that a source lacks."""
    wide = at_most(groups, SMALL)
    shares = stash(kept.join(wide, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("v"), prior).alias("p"), "absent"))
    one, two = (groups.select("lang", F.col("source").alias(s), F.col("absent").alias(a), "v") for s, a in (("source", "mine"), ("item", "other")))
    base = one.join(at_most(two, SMALL).drop("v"), "lang").where("source <> item")
    start = base.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * divergence(F.col("mine"), F.col("other"))).otherwise(0).alias("value"))

    cells = shares.groupBy("lang", "source", "p", "absent").agg(F.count(F.lit(1)).alias("m"))
    others = at_most(groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("other")), SMALL)
    alone = cells.join(others, "lang").where("source <> item")
    alone = alone.select("lang", "source", "item", (F.col("m") * (divergence(F.col("p"), F.col("other")) - divergence(F.col("absent"), F.col("other")))).alias("value"))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    left = shares.select("lang", "term", "source", "p", F.col("absent").alias("mine"))
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("absent").alias("other"))
    p, q, mine, other = (F.col(c) for c in ("p", "q", "mine", "other"))
    both = left.join(right, ["lang", "term"]).where("source < item")
    both = both.select("lang", "source", "item", (divergence(p, q) - divergence(p, other) - divergence(mine, q) + divergence(mine, other)).alias("value"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def turned(df: DataFrame) -> DataFrame:
        return df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")

    parts = [start, alone, turned(alone), both, turned(both)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    sums = whole.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))


def _terms(kept: DataFrame, groups: DataFrame, prior: int, top: int) -> DataFrame:
    """Cells by value: at most ``top`` values a group can reach a rank in demand, and of those only the ones before which less than ``top`` terms stand."""
    p, q = share(F.col("n"), F.col("total"), F.col("v"), prior), share(F.col("lang_n"), F.col("lang_total"), F.col("v"), prior)
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("m"))
    cells = cells.join(at_most(groups, SMALL), ["lang", "source"]).select("lang", "source", "n", "lang_n", "m", p.alias("p"), q.alias("q")).where("p > q")
    cells = stash(cells.select("lang", "source", "n", "lang_n", "m", divergence(F.col("p"), F.col("q")).alias("value")))
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m")).withColumn("at", F.row_number().over(group)).where(F.col("at") <= top)
    before = F.coalesce(F.sum("m").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value")
    chosen = stash(cells.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value"))
    terms = kept.join(at_most(chosen, SMALL), ["lang", "source", "n", "lang_n"])
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return terms.withColumn("rank", place).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
