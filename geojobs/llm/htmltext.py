"""Main text of web pages: what the markup itself says, and nearest-URL page differencing wherever it is silent.

Elements whose name, role or class say that they are no text (menus, headers, footers, forms, adverts, notices, comments) are dropped.
Lines inside an article or main element are text: what two articles share is no template; only parts in it with a name that may or may
not mean text (share, related, discussion) stay in doubt. Every other line is kept unless the nearest page has it as well: pages of a
host are ordered by URL path, each is paired with the one of its two neighbours with which its path has more signs in common from the
start (of equals the one before), the lines of the two are aligned by longest common subsequence, and those that both have are deleted.
A page whose lines are all its partner's is a copy, which says nothing about the site's template; it keeps them.
"""

from __future__ import annotations

import html as entities
import os
import re
import struct
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geojobs.llm.urlfilter import host_and_path

#: Comments, elements whose content is no markup, tags (quotes count only after an equals sign), other declarations.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|(?P<comment>\Z)))"
    r"|<(?P<raw>script|style|textarea|title|iframe)(?=[\s/>])(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+>(?:.*?</(?P=raw)(?=[\s/>])[^>]*+>|.*(?P<rest>\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>|<[/!?][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHROME = frozenset("nav footer aside form button menu dialog fieldset search noscript template svg object canvas select audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words for elements that are no text, as a class or id, alone or together with words that say nothing (AROUND).
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer header masthead topbar toolbar share sharing social related recommended comment comments "
    "discussion disqus replies pagination pager skip login search widgets banners sponsors popups".split()
)
AROUND = frozenset("area bar block bottom box button buttons container global group icon icons inner item items left link links list main outer page panel primary right row secondary section site slot top unit wrap wrapper".split())
#: A header inside a text is part of it, and so is a heading that is called one.
HEADER = frozenset("header masthead banner".split())
#: A header or footer is the site's only with these words (section-header is a part's heading, page-header often a title).
ENDS, SITE = frozenset("header footer".split()), frozenset("area bar bottom container global inner main outer primary site top wrap wrapper".split())
#: First words that say enough whatever follows (comment-body), and last words that do after any other (post-comments),
#: unless the first tells a state (has-comments).
OPENERS = frozenset("advert advertisement breadcrumb breadcrumbs comment comments disqus newsletter".split())
REPLIES, STATES = frozenset("comments discussion disqus replies".split()), frozenset("has have is no not open show with without".split())
#: Within a text these names alone say that an element is none; the others of NAMES leave it to the nearest page.
SURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion cookie cookies consent gdpr newsletter subscribe signup nav navbar navigation "
    "breadcrumb breadcrumbs comment comments disqus notice notices pagination pager login".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = re.compile(r"\s+")

#: Fixed values of HTML: elements that an end tag doesn't reach beyond, what a start tag closes (its names, within its bounds), and the
#: parts of a table to which one goes back.
SCOPE = frozenset("table td th caption template object".split())
CELLS = frozenset("table caption thead tbody tfoot tr td th".split())
LISTS = SCOPE | {"ul", "ol", "menu", "dir"}
CLOSES = {t: (frozenset({"p"}), SCOPE | {"button"}) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre search section summary table ul".split()}
CLOSES |= {t: (frozenset({"p"}), SCOPE | {"button"}) for t in HEADINGS}
CLOSES |= {"li": (frozenset({"li"}), LISTS), "option": (frozenset({"option"}), SCOPE | {"select", "datalist"})} | {t: (frozenset({"dt", "dd"}), SCOPE | {"dl"}) for t in ("dt", "dd")}
_ROWS = frozenset("table thead tbody tfoot".split())
BACK_TO = {"td": _ROWS | {"tr"}, "th": _ROWS | {"tr"}, "tr": _ROWS} | {t: frozenset({"table"}) for t in ("thead", "tbody", "tfoot", "caption")}


#: What the markup says of an element.
TEXT, DOUBT, NO_TEXT = range(3)


def _named(tag: str, value: str, inside_main: bool) -> int:
    """What a class or id says: a whole name tells that an element is no text, a name that only mentions one (article-header) doesn't."""
    names = NAMES - HEADER if inside_main or tag in HEADINGS else NAMES
    says = TEXT
    for token in value.split():
        words = [w.lower() for w in WORD.findall(token)]
        found = [w for w in words if w in names]
        level = DOUBT if inside_main and not SURE.intersection(found) else NO_TEXT
        if found and len(found) + sum(w in AROUND for w in words if w not in names) == len(words):
            rest = [w for w in words if w not in names]
            if not ENDS.issuperset(found) or SITE.issuperset(rest) or found == ["footer"] and rest == ["page"]:
                says = max(says, level)
        if len(words) > 1 and (words[0] in OPENERS or words[-1] in REPLIES and words[0] not in STATES):
            says = max(says, DOUBT if inside_main and words[0] not in OPENERS and words[-1] != "comments" else NO_TEXT)
    return says


def _is_chrome(tag: str, attrs: str, inside_main: bool) -> int:
    """Within a text the names of headings and inline elements say nothing: class="menu" may tell what they are about."""
    if tag in CHROME or tag == "header" and not inside_main:
        return NO_TEXT
    if not attrs or tag == "main":
        return TEXT
    says, heard = TEXT, not inside_main or tag in BLOCKS and tag not in HEADINGS
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "style" and "display:none" in value.lower().replace(" ", "") or name == "role" and value.lower() in ROLES:
            return NO_TEXT
        if heard and name in ("class", "id"):
            says = max(says, _named(tag, value, inside_main))
    return says


def _is_main(tag: str, attrs: str) -> bool:
    if tag in ("article", "main"):
        return True
    return bool(attrs) and any(n.lower() == "role" and "main" in v or n.lower() == "itemprop" and "articleBody" in v for n, *v in ATTRIBUTE.findall(attrs))


def blocks(page: str | None) -> list[tuple[bool, str]]:
    """The text blocks of a page in order, without chrome: (inside an article or main element and not in doubt, text).

    Elements that authors may leave unclosed (paragraphs, list items, cells) end where HTML lets them end, and a chrome element ends at
    the latest with its parent. A form around an article hides nothing from there on.
    """
    out: list[tuple[bool, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, article or main, in doubt
    opened: Counter = Counter()
    page, at, mains, doubts = page or "", 0, 0, 0
    skip: int | None = None  # place in the stack of the chrome element that hides the text

    def close() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                out.append((mains > 0 and not doubts, text))

    def take(text: str) -> None:
        parts.append(entities.unescape(text) if "&" in text else text)

    def innermost(names: frozenset, bounds: frozenset) -> int | None:
        if any(opened[n] for n in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names:
                    return i
                if stack[i][0] in bounds:
                    break
        return None

    def end_from(place: int) -> None:
        nonlocal skip, mains, doubts
        if any(main or doubt for _, main, doubt in stack[place:]) and skip is None:
            close()
        while len(stack) > place:
            name, main, doubt = stack.pop()
            opened[name] -= 1
            mains -= main
            doubts -= doubt
        if skip is not None and len(stack) <= skip:
            skip = None

    last = page.rfind(">") + 1  # no tag ends after it
    for m in TOKEN.finditer(page, 0, last):
        if skip is None and m.start() > at:
            take(page[at : m.start()])
        at, tag = m.end(), m["tag"]
        if tag is None:
            if m["comment"] is not None or m["rest"] is not None:
                at = len(page)
            continue
        tag = tag.lower()
        if skip is None:
            if tag in BLOCKS:
                close()
            elif tag in ("br", "td", "th"):
                parts.append(" ")
        if m["end"]:
            names = HEADINGS if tag in HEADINGS else frozenset({tag})
            bounds = frozenset({"table"}) if tag in CELLS else CLOSES[tag][1] if tag in ("p", "li", "dt", "dd") else SCOPE if tag in BLOCKS or tag in CHROME else BLOCKS | SCOPE
            place = innermost(names, bounds)
            if place is not None:
                end_from(place)
            continue
        if tag in CLOSES and (place := innermost(*CLOSES[tag])) is not None:
            end_from(place)
        if tag in BACK_TO and (place := innermost(BACK_TO[tag], frozenset())) is not None:
            end_from(place + 1)
        if tag in VOID or tag in ("html", "head", "body"):
            continue
        attrs = m["attrs"]
        main = _is_main(tag, attrs)
        if skip is not None and main and stack[skip][0] == "form":
            skip = None
        says = _is_chrome(tag, attrs, mains > 0) if skip is None else TEXT
        if says == NO_TEXT:
            if attrs.endswith("/"):
                continue
            skip = len(stack)
        elif tag in ("svg", "math") and attrs.endswith("/"):
            continue
        stack.append((tag, main, says == DOUBT))
        opened[tag] += 1
        mains += main
        doubts += says == DOUBT
    if skip is None and at < len(page):
        take(page[at:])
    close()
    return out


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` with every beginning of ``y``."""
    row = np.zeros(y.size + 1, np.int64)
    for v in x:
        row[1:] = np.maximum.accumulate(np.where(y == v, row[:-1] + 1, row[1:]))
    return row


def _matched(x: np.ndarray, y: np.ndarray, at: int) -> list[int]:
    """Hirschberg's halving: places (from ``at``) of a longest common subsequence, in memory linear in the lines."""
    if not x.size or not y.size:
        return []
    if x.size == 1:
        return [at] if (y == x[0]).any() else []
    half = x.size // 2
    cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
    return _matched(x[:half], y[:cut], at) + _matched(x[half:], y[cut:], at + half)


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    common = set(x) & set(y)
    places = [i for i, v in enumerate(x) if v in common]
    found = _matched(np.array([x[i] for i in places], np.uint64), np.array([v for v in y if v in common], np.uint64), 0)
    return {*range(head), *range(len(a) - tail, len(a)), *(head + places[i] for i in found)}


def _hashes(lines: list[tuple[bool, str]]) -> list[int]:
    """Of the lines outside main elements, which differencing may delete."""
    return [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for inside, t in lines if not inside]


def main_text(lines: list[tuple[bool, str]], other: list[int] | None) -> tuple[str, int]:
    """Text of a page and how many lines differencing took from it; ``other`` are its partner's line hashes, None without a partner."""
    own = _hashes(lines)
    shared = common_lines(own, other) if other and own != other else set()
    kept, outside = [], 0
    for inside, text in lines:
        if inside or outside not in shared:
            kept.append(text)
        outside += not inside
    return "\n".join(kept), len(shared)


def _pack(lines: list[tuple[bool, str]]) -> bytes:
    data = b"".join(struct.pack("<?I", inside, len(x := t.encode("utf-8", "surrogatepass"))) + x for inside, t in lines)
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> list[tuple[bool, str]]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        inside, n = struct.unpack_from("<?I", data, at)
        out.append((inside, data[at + 5 : at + 5 + n].decode("utf-8", "surrogatepass")))
        at += 5 + n
    return out


PARSED = "bucket int, host string, path string, page_id long, url string, halo boolean, lines binary"
TEXTS = "page_id long, url string, text string, n_chars long, lines_deleted long"


def _key(host: str, path: str, page_id: int | None) -> tuple[str, str, int]:
    return host, path, -(1 << 63) if page_id is None else page_id


def _parser(bounds: list[tuple], edges: dict[int, tuple[tuple, tuple]]) -> Callable:
    """Parse pages and deal them to buckets of the url order; a bucket's first and last page go to its neighbours as well."""
    filled = sorted(edges)
    after = dict(zip(filled, filled[1:]))
    before = dict(zip(filled[1:], filled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for page_id, url, host, path, page in zip(*(c.to_pylist() for c in batch.columns)):
                key = _key(host, path, page_id)
                home = bisect_right(bounds, key)
                first, last = edges[home]
                lines = _pack(blocks(page))
                places = [(home, False)]
                if key == first and home in before:
                    places.append((before[home], True))
                if key == last and home in after:
                    places.append((after[home], True))
                for bucket, halo in places:
                    for column, value in zip(rows, (bucket, host, path, page_id, url, halo, lines)):
                        column.append(value)
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["bucket", "host", "path", "page_id", "url", "halo", "lines"])

    return run


def nearest(path: str, before: str | None, after: str | None) -> int:
    """Which neighbour in the order of paths is nearer: -1 the one before, 1 the one after, 0 without any. Of equals the one before."""
    same = lambda other: len(os.path.commonprefix((path, other)))
    if before is None or after is None:
        return -1 if before is not None else 1 if after is not None else 0
    return 1 if same(after) > same(before) else -1


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pages -> texts. A page waits for the one after it; of a host's pages in a bucket only two are held."""
    names, kinds = ["page_id", "url", "text", "n_chars", "lines_deleted"], (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    rows: list[tuple] = []
    before = now = None  # before: path and line hashes; now: bucket and host, path, line hashes, lines, page

    def settle(after: tuple | None) -> None:
        """The waiting page's row; ``after`` is the next page of its host in the bucket."""
        if now is None or now[4][2]:  # a neighbouring bucket's page
            return
        choice = nearest(now[1], before and before[0], after and after[1])
        text, taken = main_text(now[3], (None, after and after[2], before and before[1])[choice])
        rows.append((*now[4][:2], text, len(text), taken))

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        for bucket, host, path, page_id, url, halo, packed in zip(*(c.to_pylist() for c in batch.columns)):
            lines = _unpack(packed)
            page = ((bucket, host), path, _hashes(lines), lines, (page_id, url, halo))
            same = now is not None and now[0] == page[0]
            settle(page if same else None)
            before, now = (now[1:3] if same else None), page
        yield emit()
        rows.clear()
    settle(None)
    if rows:
        yield emit()


def extract(pages: DataFrame, buckets: int | None = None, sample: int = 25) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, url, text, n_chars, lines_deleted; one row per row.

    Null and empty pages have an empty text; null urls form a host of their own; repeated rows pair with each other; null ids sort
    first. Other columns are left out. A hot host spreads over buckets, whose bounds come from about ``sample`` urls a bucket (the
    bounds set the dealing, never the result).
    """
    spark = pages.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 8 * tasks  # several to a task even out how they fall
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"), "html")
    keys = rows.select("host", "path", "page_id")
    # About so many different keys by their hash: tasks send what falls in, not a full sample each.
    every = max(1, keys.count() // (buckets * sample))
    some = keys.where(F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(every)) == 0).distinct().collect()
    some = sorted(_key(*r) for r in some)
    bounds = [some[len(some) * i // buckets] for i in range(1, buckets)] if len(some) >= buckets else []
    bounds = sorted(set(bounds))

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                key = _key(*r)
                at = bisect_right(bounds, key)
                low, high = found.get(at, (key, key))
                found[at] = min(low, key), max(high, key)
        out = [(at, *k) for at, ks in found.items() for k in ks]
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["bucket", "host", "path", "id"])

    ends = keys.mapInArrow(edge, "bucket int, host string, path string, id long").groupBy("bucket")
    ends = ends.agg(F.min(F.struct("host", "path", "id")).alias("low"), F.max(F.struct("host", "path", "id")).alias("high")).collect()  # one row per bucket
    edges = {r["bucket"]: (tuple(r["low"]), tuple(r["high"])) for r in ends}
    parsed = rows.mapInArrow(_parser(bounds, edges), PARSED)
    dealt = parsed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "host", "path", F.col("page_id").asc_nulls_first())
    return dealt.mapInArrow(_difference, TEXTS)
