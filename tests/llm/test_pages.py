import base64
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from geojobs.llm import htmltext, queries, urlfilter, warc
from geojobs.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, host string, key string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA).repartition(3)


ODD = [(1, "http://a.Example.com/en/x", "<p>one</p>"), (2, None, None), (3, "", ""), (None, "no scheme", "<p>one</p>"), (5, "http://x.net/es/a?b#c", "é" * 100_000), (6, "ftp://x.net", "<p>one</p>"), (6, "ftp://x.net", "<p>one</p>"), (7, "http://b.com/100%\r\n ü", "<div>"), (8, "http://b.com/a%20b?q=%2525", "<a>"), (9, "http://b.com/one", "<b>"), (9, "http://b.com/two", "<b>")]


def test_warc_round_trip(spark):
    df = pages(spark, ODD)
    place = lambda i, u: (i, u) if i != 9 else (i, "either")  # noqa: E731  # two rows with one id and payload: either is the response
    got = sorted(((*place(r.page_id, r.url), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    want, done = [], set()
    for i, u, h in ODD:
        data = (h or "").encode()
        first = min(j for j, _, k in ODD if (k or "") == (h or "") and j is not None)
        same = i == first and (i, h) not in done  # of repeated rows one is the response
        done.add((i, h))
        want.append((*place(i, u), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if same else "revisit", None if same else first))
    assert got == sorted(want, key=str)
    nameless = warc.round_trip(pages(spark, [(None, None, "x"), (None, "u", "x"), (None, "u", "x")])).collect()
    assert sorted(r.record_type for r in nameless) == ["response", "revisit", "revisit"]
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_headers_for_other_readers(spark):
    index = warc.write(pages(spark, ODD), shared_dir(spark)).collect()
    assert len({r.record_id for r in index}) == len(ODD)
    heads = [(r.page_id, warc.read_record(r.bundle, r.frame_offset, r.record_offset)[0]) for r in index]
    uris = {i: h["WARC-Target-URI"] for i, h in heads if "WARC-Target-URI" in h}
    assert uris[8] == "http://b.com/a%20b?q=%2525" and uris[7] == "http://b.com/100%%0D%0A%20%C3%BC"
    ids = {h["WARC-Record-ID"] for _, h in heads}
    assert all(h["WARC-Refers-To"] in ids for _, h in heads if h["WARC-Type"] == "revisit")


def test_warc_index_reads_single_records(spark):
    rows = [(i, f"http://h/{i}", "x" * 40_000 + str(i)) for i in range(120)]
    index = warc.write(pages(spark, rows), shared_dir(spark)).collect()
    assert max(r.frame for r in index) > 0
    for r in random.Random(0).sample(index, 10):
        head, _, payload = warc.read_record(r.bundle, r.frame_offset, r.record_offset)
        assert head["WARC-Record-ID"] == f"<{r.record_id}>" and payload.decode() == "x" * 40_000 + str(r.page_id)


def test_bundle_is_plain_zstandard():
    import io

    import zstandard

    bundle = warc.Bundle()
    parts = [bytes([65 + i]) * 700_000 for i in range(5)]
    for p in parts:
        bundle.add(p)
    data = bundle.finish()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(parts)


def test_url_rules_against_sql(spark):
    rng = random.Random(4)
    hosts = ["example.com", "www.example.com", "a.www.Example.com", "net", "x.net", "com", "notexample.com", "example.com.org", "", "ex.ample.net:80"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/x', '/fr/', '/en/../fr/', '/ES/'])}{rng.choice(['', '?q=/en/', '#t'])}", None) for i in range(400)] + ODD[:1] + ODD[1:3] + ODD[4:5]
    got = sorted(map(str, urlfilter.judge(pages(spark, rows), queries.RULES).select("page_id", "host", "path", "rule", "verdict").toPandas().values.tolist()))
    pages_df = pages(spark, rows).select("page_id", "url", "html").toPandas()
    con = duckdb.connect()
    con.register("pages", pages_df)
    want = con.execute("select page_id, host, path, rule, verdict from (" + queries.ORACLES["op5_url_filter"] + ") q").fetchall()
    assert got == sorted(str(list(r)) for r in want)
    assert urlfilter.judge(pages(spark, []), queries.RULES).count() == 0
    assert urlfilter.judge(pages(spark, ODD), urlfilter.Rules((), ())).where("verdict = 'allow' and rule is null").count() == len(ODD)


def test_rules_plan_has_no_python(spark):
    plan = urlfilter.judge(pages(spark, ODD), queries.RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_large_list_is_one_literal(spark):
    import time

    universe = spark.range(120_000).select(F.concat(F.lit("k"), "id").alias("key"))
    began = time.perf_counter()
    cascade = urlfilter.build(universe.where("crc32(key) % 4 = 0"), universe)
    wrong = universe.where(cascade.holds(F.col("key")) != (F.crc32("key") % 4 == 0)).count()
    assert wrong == 0 and max(len(v.words) for v in cascade.levels) > 1000 and time.perf_counter() - began < 120


@pytest.mark.parametrize("n", [1, 60, 700])
def test_cascade_is_exact(spark, n):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.col("key").isin([f"k{7 * i % 3000}" for i in range(n)])).unionByName(spark.createDataFrame([(None,), ("k0",)], "key string"))
    cascade = urlfilter.build(listed, universe.unionByName(universe))
    want = {r.key for r in listed.collect() if r.key}
    assert {r.key for r in universe.where(cascade.holds(F.col("key"))).collect()} == want


def test_cascade_of_an_empty_universe_or_list(spark):
    """Keys beyond the universe aren't promised, the listed ones always are; without listed keys nothing is held."""
    none = spark.createDataFrame([], "key string")
    some = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "key string")
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert keys.where(urlfilter.build(some, none).holds(F.col("key"))).count() == 2
    assert keys.where(urlfilter.build(none, some).holds(F.col("key"))).count() == 0
    assert keys.where(urlfilter.build(none, none).holds(F.col("key"))).count() == 0


def test_warc_of_nothing_and_of_missing_bundles(spark):
    index = warc.write(pages(spark, [(1, "http://h.com/a", "x")]), shared_dir(spark))
    assert warc.read(index.limit(0)).count() == 0 and warc.read(index.unionByName(index)).count() == warc.read(index).count() == 1
    gone = index.withColumn("bundle", F.concat("bundle", F.lit(".gone")))
    with pytest.raises(Exception, match="gone"):
        warc.read(gone).count()


PAGE = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><!-- <p>no</p> --><nav><ul><li>menu</ul></nav><div class='x ad-box'>buy<div>now</div></div>{}<footer>foot</footer></body></html>"


def test_article_text(spark):
    body = "<article><h1>Title &amp; more</h1><p>one<b>two</b>\n  three<br>four<p>five &#x41;&nbsp;b<aside>side</aside></article><section id=comments>no</section>"
    rows = [(1, "http://h.com/a/1", PAGE.format(body)), (2, "http://h.com/a/2", PAGE.format(body)), (3, "http://h.com/b", "<p>unclosed <b>x"), (4, None, None), (5, "", "")]
    out = {r.page_id: r for r in htmltext.extract(pages(spark, rows)).collect()}
    text = "Title & more\nonetwo three four\nfive A b"
    assert out[1].text == out[2].text == text and out[1].n_chars == len(text)
    assert out[3].text == "unclosed x" and out[4].text == out[5].text == "" and len(out) == 5


@pytest.mark.parametrize("buckets", [1, 2, 7])
def test_differencing_without_article(spark, buckets):
    rows = [(i, f"http://h.com/p/{i:03d}", f"<div>Site menu</div><p>Own text {i}</p><p>More {i * i}</p><div>Imprint</div>") for i in range(60)] + [(100, "http://alone.com/", "<div>Site menu</div><p>only</p>")]
    out = {r.page_id: r for r in htmltext.extract(pages(spark, rows), buckets=buckets, sample=3).collect()}
    assert all(out[i].text == f"Own text {i}\nMore {i * i}" and out[i].lines_deleted == 2 for i in range(60))
    assert out[100].text == "Site menu\nonly"
    assert htmltext.extract(pages(spark, [])).count() == 0


def test_common_lines_are_longest():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found = sorted(htmltext.common_lines(a, b))
        assert len(found) == table[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in found)


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p class="notice">Cookies<p>Body text one<p>Body two</article>', ["Body text one", "Body two"]),
        ('<article><ul><li class="promo">Buy<li>Real item</ul><p>Rest</article>', ["Real item", "Rest"]),
        ("<table><tr><td class=ad>buy<td>cell<tr><td>two</table>after", ["cell", "two", "after"]),
        ("<dl><dt class=ad>a<dd>b</dl>c", ["b", "c"]),
        ('<p class="ad">buy<div>text</div>', ["text"]),
        ('<div><span class="ad">buy <span>now</span> more</span> text</div>', ["text"]),
        ("<div><aside>side</div>text", ["text"]),
        ('<div class="article-header"><h1>Title</h1></div>', ["Title"]),
        ('<div class="layout has-sidebar"><p>one</div><body class="has-comments">two', ["one", "two"]),
        ('<div class="siteHeader">x</div><div class="ad-box">x</div><div id="post-comments">x</div><div class="menu__item">x</div>text', ["text"]),
        ('<article class="comment">x</article><p>text', ["text"]),
        ('<div class="section-header">one</div><div class="page-header">two</div><div class="card-header">three</div><div class="site-header">x</div><div class="page-footer">x</div><div class="header">x</div>', ["one", "two", "three"]),
        ('<div class="comment-body">x</div><div id="disqus_thread">x</div><div class="newsletter-cta">x</div><div class="footer-widgets">x</div><div class="cookie-recipe">one', ["one"]),
        ("<article><header><h1>T</h1></header><h2 class=header>U</h2>v<footer>x</footer></article>", ["T", "U", "v"]),
        ("<article>A</article><p>Outside article text</p>", ["A", "Outside article text"]),
        ('<article><section class="discussion">A paper\'s part</section><p class="share">Share of the market rose</p></article>', ["A paper's part", "Share of the market rose"]),
        ('<article><h2 class="menu">Menu of the day</h2><p>a <span class="alert">watch</span> was out</p></article>', ["Menu of the day", "a watch was out"]),
        ('<article><div class="comments">x</div><div class="post-comments">x</div><div class="ad">x</div>text<p class="cookie-notice">x</article>', ["text"]),
        ("<p>let <math><mi>x</mi></math> be", ["let x be"]),
        ('<svg class=a/><p>a <svg viewBox="0"><title>x</title><text>x</text></svg>b</p>', ["a b"]),
        ("<head><title>x</title><p>body", ["body"]),
        ("<form>x<article><p>in a form</article></form><form>x<input></form>after", ["in a form", "after"]),
        ("<p title=it's>one</p><p>it's", ["one", "it's"]),
        ("<!--><p>one</p><!-- x --!><p>two</p><!-- <p>x</p>", ["one", "two"]),
        ('<div data-hidden="x" data-class="ad" title="class=ad hidden">a < b <4 <', ["a < b <4 <"]),
        ("one<script>x</script", ["one"]),
        ("a &amp;lt; &#x41;&nbsp;\n b", ["a &lt; A b"]),
    ],
)
def test_blocks_drop_chrome_alone(page, want):
    assert [t for _, t in htmltext.blocks(page)] == want


def _longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("article", [False, True])
def test_differencing_against_plain_alignment(spark, article):
    """On pages without an article, and beside one: the nearest neighbour in the order of urls, aligned by the plain table."""
    rng = random.Random(5)
    rows, lines = [], {}
    for i in range(90):
        beside = [f"own {i}"] * rng.randint(0, 2) + [f"line {rng.randint(0, 8)}" for _ in range(rng.randint(0, 7))]
        rng.shuffle(beside)
        lines[i] = beside
        inside = [f"line {rng.randint(0, 8)}" for _ in range(3)] if article else []
        at = rng.randint(0, len(beside))
        parts = [f"<p>{x}</p>" for x in beside]
        parts[at:at] = [f"<article>{''.join(f'<p>{x}</p>' for x in inside)}</article>"] if article else []
        rows.append((i, f"http://{rng.choice('abc')}.com/{rng.randint(0, 30)}", "".join(parts)))
        lines[i] = (beside, at, inside)
    out = {r.page_id: r for r in htmltext.extract(pages(spark, rows), buckets=5, sample=3).collect()}
    order = sorted(rows, key=lambda r: (r[1].split("/")[2], "/" + r[1].rsplit("/", 1)[1], r[0]))
    deleted = later = 0
    for k, (i, url, _) in enumerate(order):
        host = url.split("/")[2]
        same = [j for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][1].split("/")[2] == host]
        beside, at, inside = lines[i]
        path = lambda j: "/" + order[j][1].rsplit("/", 1)[1]
        near = max(same, key=lambda j: (next((n for n, (x, y) in enumerate(zip(path(k), path(j))) if x != y), min(len(path(k)), len(path(j)))), -j), default=None)
        later += near == k + 1 and len(same) == 2
        other = lines[order[near][0]][0] if same else []
        n = _longest(beside, other) if beside != other else 0
        got = out[i].text.split("\n") if out[i].text else []
        assert out[i].lines_deleted == n and len(got) == len(beside) - n + len(inside)
        it = iter(beside[:at] + inside + beside[at:])
        assert all(x in it for x in got)
        assert all(x in got for x in inside) and all(x in got for x in beside if x not in other)
        deleted += n
    assert deleted > 50 and later > 10


def test_parts_in_doubt_within_an_article(spark):
    """A part whose name may mean text stays unless the nearest page has the same lines; what two articles share without such a name stays."""
    page = "<article><p>Both have this</p><p>Own {0}</p><div class='share'><p>Share this page</p></div><section class='discussion'><p>Result {0}</p></section></article>"
    rows = [(i, f"http://h.com/{i}", page.format(i)) for i in range(5)]
    out = {r.page_id: r.text for r in htmltext.extract(pages(spark, rows)).collect()}
    assert all(out[i] == f"Both have this\nOwn {i}\nResult {i}" for i in range(5))


def test_the_nearer_neighbour_counts(spark):
    rows = [(1, "http://h.com/a/1", "<p>first</p><p>of a</p>"), (2, "http://h.com/b/1", "<p>of a</p><p>of b</p><p>second</p>"), (3, "http://h.com/b/2", "<p>of b</p><p>third</p>")]
    out = {r.page_id: r.text for r in htmltext.extract(pages(spark, rows), buckets=3, sample=1).collect()}
    assert out == {1: "first", 2: "of a\nsecond", 3: "third"}
    assert [htmltext.nearest("/x", *n) for n in ((None, None), ("/a", None), (None, "/a"), ("/a", "/b"), ("/", "/xy"))] == [0, -1, 1, -1, 1]
