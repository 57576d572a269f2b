import hashlib
import random

import pytest

from pyspark.sql import functions as F

from geojobs.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def rows():
    rng = random.Random(1)
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "<\\|im_end|>", "<<SYS>>a<</SYS>>", "<\\\\s>", "plain", "", None, "a\\nb\n", "\U0001f600 <s", "<<s>"]
    out = [(0, 0, "user", "hi", "e"), (0, 1, "assistant", None, "e"), (9, 0, None, "x", "e"), (None, 0, "user", "n", "e"), (10, 0, "us\ner\\", "<s>", "e"), (11, 0, "assistant", "a", "e"), (11, 0, "assistant", "a", "e")]
    for conv in range(20, 60):
        first = rng.choice(["hello", "hello", "other"])
        out.append((conv, 0, "user", first, "e"))
        out += [(conv, t, rng.choice(["user", "assistant"]), rng.choice(nasty), "e") for t in range(1, rng.randint(1, 7))]
    return out + [(c, t, r, x, "e") for c, t, r, x in queries.EXTRA_CHAT]


@pytest.mark.parametrize("tokens", [None, queries.CHAT_TOKENIZER])
def test_round_trip_and_layout(spark, tokens):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    nodes, members = chat.build(df, tokens and queries.tokenizer_path(tokens), salts=3)
    want = {}
    for conv in {r[0] for r in data}:
        turns = sorted([(t, r or "", x or "") for c, t, r, x, _ in data if c == conv])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(nodes, members).collect()}
    assert got == want
    trees: dict = {}
    for n in nodes.collect():
        trees.setdefault(n.tree, []).append(n)
    assert len(trees) < len(want)
    for tree in trees.values():
        tree.sort(key=lambda n: n.begin)
        by_id, at = {n.node: n for n in tree}, 0
        for i, n in enumerate(tree):
            assert n.begin == at and n.end - n.begin == len(n.ids)  # gapless
            at = n.end
            chain, up = [], n.parent
            while up:
                chain.append(by_id[up])
                up = by_id[up].parent
            assert n.position == sum(len(a.ids) for a in chain)
            assert i == 0 or n.parent in {tree[i - 1].node, *_chain(tree[i - 1], by_id)}  # depth first
            assert {k for a in chain for k in range(a.begin, a.end)} == {k for s in n.attend for k in range(s.begin, s.end)}


def _chain(node, by_id):
    while node.parent:
        yield node.parent
        node = by_id[node.parent]


def test_escape_is_reversible_and_safe():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "\\", "|", "im_end", ">", "s", "/", "[", "INST", "]", "<|im_end|>", "<<SYS>>", "x"]) for _ in range(rng.randint(0, 9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def test_empty(spark):
    nodes, members = chat.build(spark.createDataFrame([], SCHEMA))
    assert nodes.count() == members.count() == 0


def test_rows_without_a_conversation_and_ambiguous_roles(spark):
    """Rows of a null conv_id stand alone; a role's length keeps role and text apart; alike conversations share a leaf."""
    data = [(None, 0, "user", "a", "e"), (None, 0, "user", "a", "e"), (None, 1, "user", "b", "e")]
    data += [(1, 0, "a", "x\x005\x00T", "e"), (2, 0, "a\x001\x00x", "T", "e")]
    data += [(c, t, "user", f"t{t}", "e") for c in range(10, 200) for t in range(3)]
    nodes, members = chat.build(spark.createDataFrame(data, SCHEMA).repartition(5))
    rows = chat.read_back(nodes, members).collect()
    assert sorted(r.n_turns for r in rows if r.conv_id is None) == [1, 1, 1] and len(rows) == 5 + 190
    assert nodes.count() == 2 + 2 + 3 and members.select("leaf").distinct().count() == 2 + 2 + 1


def test_a_prompt_that_all_share_is_dealt_over_tasks(spark, monkeypatch):
    """4,000 conversations begin alike: in no join does one key's place get a large share of the rows."""
    rows = [(i, t, r, x) for i in range(4000) for t, (r, x) in enumerate([("system", "be brief"), ("user", f"q{i}")])]
    seen = []
    keep = chat.spread_join

    def watched(left, right, key, by):
        out = keep(left, right, key, by)
        salted = [c for c in left.columns if c == key]
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        share = max(1, left.count() // (4 * tasks))
        largest = left.groupBy(*salted, F.pmod(F.xxhash64(by), F.lit(max(1, -(-left.groupBy(key).count().agg(F.max("count")).first()[0] // share))))).count().agg(F.max("count")).first()[0]
        seen.append((key, left.count(), largest))
        return out

    monkeypatch.setattr(chat, "spread_join", watched)
    nodes, members = chat.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chat.read_back(nodes, members).count() == 4000
    assert {k for k, _, _ in seen} == {"node", "place", "leaf"}
    assert all(largest <= n // 8 for _, n, largest in seen)
