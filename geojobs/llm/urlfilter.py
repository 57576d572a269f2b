"""URL rules by Bloom filter cascades, in DataFrame functions alone.

A cascade's even levels encode listed keys, its odd levels those unlisted keys of the corpus's whole key universe that pass the level
before. Levels follow until nothing passes wrongly, so that membership is exact for every key of the corpus, by bit tests and without
a join. The first level's error rate is the list's share of the universe, which keeps all levels in proportion to the list.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geojobs.llm.common import stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A level's bits travel in the plan as one literal; a list that would need more is refused. That is 8 MB, or some 9 million listed keys
#: where they are a twentieth of the universe.
MAX_BITS = 1 << 26


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its words of 64 bits, how many bits and hashes, and the seed of its hashes."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        # One literal, not one for each word: a constant that the optimizer turns into an array once.
        words = F.split(F.lit(" ".join(map(str, self.words))), " ").cast("array<bigint>")
        tests = []
        for place in _places(key, self.bits, self.hashes, self.seed):
            word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
            tests.append(F.getbit(word, (place.bitwiseAND(F.lit(63))).cast("int")) == 1)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def _places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits).cast("long")) for i in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """Encode the ``n`` rows of ``keys(key)``; only words that aren't zero come to the driver."""
    hashes = max(1, math.ceil(math.log2(1 / rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)
    if bits > MAX_BITS:
        raise ValueError(f"{n} keys need {bits} bits; {MAX_BITS} are the most")
    places = keys.select(F.explode(F.array(*_places(F.col("key"), bits, hashes, seed))).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    rows = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("value")).collect()
    words = [0] * (bits // 64)
    for row in rows:
        words[row["word"]] = row["value"]
    return Level(tuple(words), bits, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether the list holds ``key``; exact for each key of the universe that the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for j in reversed(range(len(self.levels))):
            out = F.when(~self.levels[j].passes(key), F.lit(j % 2 == 1)).otherwise(out)
        return out


def build(listed: DataFrame, universe: DataFrame, salt: int = 0, max_levels: int = 64) -> Cascade:
    """Cascade of ``listed(key)`` over ``universe(key)``; null keys are none, repeated keys count once, either may be empty."""
    listed = stash(listed.where("key is not null").select("key").distinct())
    universe = universe.where("key is not null").select("key")
    n = listed.count()
    if not n:
        return Cascade(())
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    levels = [_level(listed, n, min(0.5, max(2.0**-40, 0.7 * n / max(size, n))), salt)]
    wrong = stash(universe.where(levels[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti"))  # the universe is read once for it
    right = listed
    while len(levels) < max_levels:
        n = wrong.count()
        if not n:
            return Cascade(tuple(levels))
        level = _level(wrong, n, 0.5, salt + len(levels))
        levels.append(level)
        # What this level should not hold but lets pass is what the next one encodes.
        wrong, right = stash(right.where(level.passes(F.col("key")))), wrong
    raise RuntimeError(f"{max_levels} levels don't tell the keys apart")


@dataclass(frozen=True)
class Rules:
    """Listed ``host/path`` keys of both kinds, and the numbers of labels and lengths of paths that occur in them."""

    allow: tuple[str, ...]
    block: tuple[str, ...]

    def keys(self, host: Column, path: Column) -> Column:
        """The keys under which a rule for this url can be listed: ends of the host with beginnings of the path."""
        split = [r.partition("/") for r in (*self.allow, *self.block)]
        labels = sorted({h.count(".") + 1 for h, _, _ in split})
        lengths = sorted({len(slash + p) for _, slash, p in split})
        ends = [F.when(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) >= n - 1, F.substring_index(host, ".", -n)) for n in labels]
        starts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
        return F.array_compact(F.array(*[F.concat(e, s) for e in ends for s in starts]))


def judge(pages: DataFrame, rules: Rules, default: str = "allow") -> DataFrame:
    """``pages(page_id, url)`` -> page_id, host, path, rule, verdict, one row per row.

    The longest rule whose host is the url's host or a parent domain of it and whose path begins the url's path wins; listed as both,
    block holds. Urls without a rule get ``default``, with a null rule; so do null urls and those without ``://``, whose host and path
    are empty. Repeated rows are judged each, null ids stay null, other columns are left out.
    """
    spark = pages.sparkSession
    url = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    split = url.select("page_id", host.alias("host"), path.alias("path"))
    if not rules.allow and not rules.block:
        return split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = split.withColumn("keys", rules.keys(F.col("host"), F.col("path")))
    universe = keyed.select(F.explode("keys").alias("key"))
    listed = lambda keys: spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("key"))
    blocked, allowed = build(listed(rules.block), universe), build(listed(rules.allow), universe, salt=1000)
    hits = F.filter("keys", lambda k: blocked.holds(k) | allowed.holds(k))
    best = F.array_max(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    ruled = keyed.select("page_id", "host", "path", best.alias("rule"))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.holds(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.withColumn("verdict", verdict)
