"""The registered queries of this subpackage: thin calls of its operators, and oracle SQL where SQL can express them."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geojobs.llm import chat, curve, decontam, divergence, embeddings, htmltext, merkle, packing, quality, simhash, toxicity, urlfilter, warc
from geojobs.llm.common import held_out, table

#: Public tokenizers of the packing, the chat and the curve query.
TOKENIZER, CHAT_TOKENIZER, CURVE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.json"
RULES = urlfilter.Rules(allow=("com/", "www.example.com/en/"), block=("example.com/en/", "net/es/", "net/fr/"))
#: A conversation whose texts are control strings of other templates.
EXTRA_CHAT = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CHAT, "conv_id long, turn long, role string, text string")
    return chat.read_back(*chat.build(turns.unionByName(extra), tokenizer_path(CHAT_TOKENIZER)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    rows = merkle.manifest(table(spark, sf_dir, "documents"), {"other": F.when(tampered & (lowered != F.col("text")), merkle.leaf({"text": lowered}))})
    folded = merkle.fold(F.coalesce("other", "leaf"), F.col("siblings"))
    proof = merkle.digest(merkle.segments(F.col("siblings")))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.pack(table(spark, sf_dir, "documents"), tokenizer_path(CURVE_TOKENIZER))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_chat": op2_chat,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_html_text": op8_html_text,
    "op9_embeddings": op9_embeddings,
    "op10_decontamination": op10_decontamination,
    "op11_divergence": op11_divergence,
    "op12_merkle": op12_merkle,
    "op13_curve_packing": op13_curve_packing,
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: 160 bits as 32 signs: the SHA-1's hex digits, five at a time as 20 bits, four signs each.
_SIGNS = " || ".join(
    f"substr('{_BASE32}', CAST((CAST(('0x' || substr(sha, {5 * g + 1}, 5)) AS BIGINT) >> {shift}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0)
)

_FRAMED = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: Levels of a tree of at most 16^7 nodes: where one node is left it stays, else every 16 become one.
_TREE = "{t}0 AS MATERIALIZED (SELECT *, count(*) OVER ({partition}) AS n FROM ({first})),\n" + ",\n".join(
    f"{{t}}{k + 1} AS MATERIALIZED (SELECT key, pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node, (any_value(n) + 15) // 16 AS n FROM {{t}}{k} GROUP BY key, pos // 16)"
    for k in range(7)
)
#: Each leaf's siblings left and right by level, of its source's tree and then of the tree of subroots, and its digest folded through them.
_SIBLINGS = (
    "".join(
        f"s{t}{k} AS MATERIALIZED (SELECT key, pos, n, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{k} WINDOW w AS (PARTITION BY key, pos // 16 ORDER BY pos)),\n"
        for t in "ab" for k in range(7)
    )
    + "path AS (SELECT m.*, " + ", ".join(f"s{t}{k}.l AS l{i}, s{t}{k}.r AS r{i}, s{t}{k}.n AS n{i}" for i, (t, k) in enumerate((t, k) for t in "ab" for k in range(7))) + " FROM m "
    + " ".join(f"JOIN sa{k} ON sa{k}.key IS NOT DISTINCT FROM m.source AND sa{k}.pos = m.pos // {16**k}" for k in range(7))
    + " " + " ".join(f"JOIN sb{k} ON sb{k}.pos = m.spos // {16**k}" for k in range(7)) + "),\n"
    + "".join(f"fold{i} AS (SELECT *, CASE WHEN n{i} = 1 THEN {prev} ELSE sha256(l{i} || {prev} || r{i}) END AS f{i} FROM {'path' if not i else f'fold{i - 1}'}),\n" for i, prev in ((i, "other" if not i else f"f{i - 1}") for i in range(14)))
    + "fold AS (SELECT * FROM fold13)"
)

ORACLES: dict[str, str] = {
    "op2_chat": """
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS nameless, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CAST(length(text) + len(regexp_extract_all(text, '<\\\\*\\|(im_start|im_end|endoftext|startoftext|user|assistant|system|eot_id|start_header_id|end_header_id)\\|>|<\\\\*/?s>|\\[\\\\*/?INST\\]|<\\\\*</?SYS>>')) AS BIGINT) AS body FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + body + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, nameless
""",
    "op4_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, upper(sha1(coalesce(html, ''))) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_SIGNS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (sha)
""",
    "op5_url_filter": """
WITH r(kind, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT page_id, host, path, max_by(h || r.p, length(h || r.p)) AS rule, max_by(kind, length(h || r.p)) AS kind
  FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(kind, 'allow') AS verdict FROM m
""",
    "op9_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.e, q.e) >= 0.9),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(any_value(n_links), 0) AS BIGINT) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id
""",
    "op11_divergence": """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS ln FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
c AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(ln) AS total FROM k GROUP BY lang),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v) AS p,
  1 + CAST(1000000000 AS HUGEINT) * (k.ln + 2) // (l.total + 2 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
""",
    "op12_merkle": f"""
WITH d AS (SELECT doc_id, source, text, {_FRAMED.format(text="text")} AS leaf,
    list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)), lambda crc, b:
      list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1) + y))) AS crc FROM documents),
t AS (SELECT *, CASE WHEN xor(crc, 4294967295::UBIGINT) % 5 = 0 THEN {_FRAMED.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE leaf END AS other
  FROM documents JOIN d USING (doc_id, source, text)),
l0 AS MATERIALIZED (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM t d),
{_TREE.format(first="SELECT source AS key, pos, leaf AS node FROM l0", t="a", partition="PARTITION BY key")},
subs AS MATERIALIZED (SELECT key AS source, node AS subroot, row_number() OVER (ORDER BY key IS NOT NULL, key) - 1 AS spos FROM a7),
{_TREE.format(first="SELECT 0 AS key, spos AS pos, subroot AS node FROM subs", t="b", partition="PARTITION BY key")},
m AS (SELECT l0.*, subroot, spos, (SELECT node FROM b7) AS root FROM l0 JOIN subs ON subs.source IS NOT DISTINCT FROM l0.source),
{_SIBLINGS}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"l{k} || r{k}" for k in range(14))}) AS proof_sha256, f13 AS folded_root, f13 = root AS verified FROM fold
""",
}
