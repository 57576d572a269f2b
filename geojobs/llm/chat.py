"""Chat formatting as prefix trees.

Conversations that share their first turns share nodes: a node is a turn with all that stands before it, a tree begins at a first turn.
Each node's formatted tokens are emitted once, trees depth-first, with position ids as in the conversation alone and the intervals of
ancestor tokens that the node may attend to. Offsets come from sums over ancestors and over siblings that are summed by salt first, so
that no task holds a whole tree however many conversations share its first turn.

The template: ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. In roles and texts every ``<`` or ``[`` that begins a control string (or an escaped one)
is followed by a backslash, which reading back takes out again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geojobs.llm.common import small_batches, spread_join, stash

#: Control strings of chat templates in use, so that no text can end a turn or open another.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|user|>", "<|assistant|>", "<|system|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
START, END = "<|im_start|>", "<|im_end|>\n"
_INNER = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL)
#: A control string, also with backslashes after its first sign: one more goes in, one comes out.
ESCAPE = re.compile(f"(?={_INNER})(.)")
UNESCAPE = re.compile(rf"(?={'|'.join(re.escape(c[0]) + r'\\+' + re.escape(c[1:]) for c in CONTROL)})(.)\\")
TURN = re.compile(r"<\|im_start\|>(?P<role>.*?)\n(?P<text>.*?)<\|im_end\|>\n", re.S)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1" + r"\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and begin and end of its text in code points (the loss span of an assistant turn)."""
    head = START + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """Roles and texts of a formatted conversation, with begin and end of each text in it."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn begins at {at}")
        role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], m["role"])
        out.append((unescape(role), unescape(m["text"]), m.start("text"), m.end("text")))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")
    return out


TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turns) -> the same and path: a node id for each turn, the hash of its parent's, its role's length, role and text."""
    for batch in small_batches(batches, "turns"):
        paths = []
        for turns in batch.column(1).to_pylist():
            node, path = "", []
            for t in turns:
                node = hashlib.md5(f"{node}{len(t['role'])}:{t['role']}{t['text']}".encode("utf-8", "surrogatepass")).hexdigest()
                path.append(node)
            paths.append(path)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.list_(pa.string()))], names=["conv_id", "turns", "path"])


def _paths(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, its turns in order, and the node ids along its path."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    grouped = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    single = rows.where("conv_id is null").select("conv_id", F.array("turn").alias("turns"))
    return grouped.unionByName(single).mapInArrow(_chain, f"conv_id long, turns {TURNS}, path array<string>")


FORMATTED = "node string, parent string, tree string, depth int, owner string, role string, formatted string, loss_begin long, loss_end long, ids array<int>, n long"


def _format(batches: Iterator[pa.RecordBatch], tokenizer_path: str | None) -> Iterator[pa.RecordBatch]:
    """(node, parent, tree, depth, owner, role, text) -> FORMATTED, about a megabyte of text at a time: token lists take many times its room."""
    encode = lambda texts: [np.array(list(map(ord, t)), np.int32) for t in texts]
    if tokenizer_path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True
        encode = lambda texts: [np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t in texts]
    for batch in small_batches(batches, "text", 1 << 20):
        roles = batch.column(5).to_pylist()
        made = [format_turn(r, t) for r, t in zip(roles, batch.column(6).to_pylist())]
        texts = [m[0] for m in made]
        ids = encode(texts)
        spans = [m[1:] if r == LOSS_ROLE else (0, 0) for m, r in zip(made, roles)]
        columns = [*(batch.column(i) for i in range(6)), pa.array(texts, pa.string()), *(pa.array([s[i] for s in spans], pa.int64()) for i in (0, 1)), pa.array(ids, pa.list_(pa.int32())), pa.array([i.size for i in ids], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FORMATTED.split(", ")])


ATTEND = "node string, begin long, end long, position long, attend array<struct<begin:bigint,end:bigint>>"


def _attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, its path as at, node, n, begin, owned) -> ATTEND of the nodes that the leaf owns; adjacent intervals are one."""
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), span]
    for batch in batches:
        rows = []
        for path in batch.column(1).to_pylist():
            merged: list[tuple[int, int]] = []
            position = 0
            for step in path:
                begin, end = step["begin"], step["begin"] + step["n"]
                if step["owned"]:
                    rows.append((step["node"], begin, end, position, [{"begin": x, "end": y} for x, y in merged]))
                if merged and merged[-1][1] == begin:
                    merged[-1] = (merged[-1][0], end)
                else:
                    merged.append((begin, end))
                position += step["n"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in ATTEND.split(", ")])


def build(conversations: DataFrame, tokenizer_path: str | None = None, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """``conversations(conv_id, turn, role, text)`` -> (nodes, members).

    nodes: node, tree, depth, parent, role, formatted, loss_begin, loss_end (code points of the formatted text under the loss mask), ids
    (token ids, or code points without a tokenizer), begin and end (place of its tokens in its tree's depth-first sequence), position
    (position id of its first token; they count up from there), attend (intervals of the sequence that its tokens see besides their
    own node's earlier ones: its ancestors, adjacent ones merged). members: conv_id, leaf, n_turns, tree, begins (its nodes' places).

    A null text or role is empty; turns with equal numbers come in order of role and text, null numbers first; repeated rows are
    turns of their own; a row of a null conv_id is a conversation of its own. An empty table gives empty tables. Work and rows are
    linear in the turns, however long a conversation; one conversation's turns are one row. Conversations that are alike throughout
    share a leaf; however many they are, no task has to hold them.
    """
    paths = stash(_paths(conversations))
    members = paths.select("conv_id", F.element_at("path", -1).alias("leaf"), F.size("path").alias("n_turns"))
    # Conversations that are alike throughout are one from here on.
    leaves = stash(paths.groupBy(F.element_at("path", -1).alias("leaf")).agg(F.first(F.struct("turns", "path")).alias("c")).select("leaf", "c.turns", "c.path"))
    steps = leaves.select("leaf", "path", F.posexplode("turns").alias("at", "turn")).select(
        "leaf", "at", F.get("path", F.col("at")).alias("node"), F.get("path", F.col("at") - 1).alias("parent"), F.get("path", F.lit(0)).alias("tree"), "turn"
    )
    # Each node belongs to one of the leaves below it.
    one = F.struct("parent", "tree", F.col("at").alias("depth"), F.col("turn.role").alias("role"), F.col("turn.text").alias("text"))
    alike = steps.groupBy("node").agg(F.min("leaf").alias("owner"), F.first(one).alias("s"))
    alike = alike.select("node", "s.parent", "s.tree", "s.depth", "owner", "s.role", "s.text")
    nodes = stash(alike.mapInArrow(lambda batches: _format(batches, tokenizer_path), FORMATTED))

    # Tokens in and below each node: every leaf tells the nodes on its path what it owns from there on.
    # A system prompt that all share is a node on every path: its rows are spread over tasks.
    along = spread_join(stash(leaves.select("leaf", F.posexplode("path").alias("at", "node"))), nodes.select("node", "n", "owner"), "node", "leaf")
    along = stash(along.select("leaf", "at", "node", "n", (F.col("owner") == F.col("leaf")).alias("owned")))
    onward = Window.partitionBy("leaf").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = along.select("node", F.sum(F.when(F.col("owned"), F.col("n")).otherwise(0)).over(onward).alias("n")).groupBy("node").agg(F.sum("n").alias("below"))
    # Siblings in order of (salt, node): sums of earlier salts, then of earlier siblings of the same salt.
    salt = (F.conv(F.substring("node", 1, 4), 16, 10).cast("long") * salts / 65536).cast("int")
    salted = stash(nodes.where("parent is not null").select("node", "parent", salt.alias("salt")).join(below, "node"))
    earlier = Window.partitionBy("parent").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    by_salt = salted.groupBy("parent", "salt").agg(F.sum("below").alias("all")).withColumn("salts_before", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
    inside = Window.partitionBy("parent", "salt").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.withColumn("before", F.coalesce(F.sum("below").over(inside), F.lit(0))).join(by_salt.drop("all"), ["parent", "salt"])
    shift = shift.select("node", (F.col("before") + F.col("salts_before")).alias("before"))
    shift = shift.unionByName(nodes.where("parent is null").select("node", F.lit(0).cast("long").alias("before")))
    # A node begins after its ancestors and what stands before each of them, and it, among its siblings.
    upto = Window.partitionBy("leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = spread_join(along, stash(shift), "node", "leaf").withColumn("begin", F.sum(F.col("before") + F.col("n")).over(upto) - F.col("n"))
    lines = stash(placed.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "node", "n", "begin", "owned"))).alias("path")))
    out = nodes.drop("owner", "n").join(lines.select("leaf", "path").mapInArrow(_attend, ATTEND), "node")
    where = lines.select("leaf", F.col("path")[0]["node"].alias("tree"), F.col("path.begin").alias("begins"))
    return stash(out), stash(spread_join(members, where, "leaf", "conv_id"))


DIGEST = "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, its path's nodes in order) -> DIGEST, from the formatted texts alone."""
    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, rows = batch.slice(at, 256), []
            for leaf, nodes in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                line = "".join(n["formatted"] for n in nodes)
                loss = "".join(unescape(n["formatted"][n["loss_begin"] : n["loss_end"]]) for n in nodes)
                turns, parsed = hashlib.sha256(), parse_turns(line)
                for role, text, _, _ in parsed:
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                rows.append((leaf, len(parsed), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(line)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Each conversation read from the trees: the nodes at its places in their order; parsed and digested.

    -> conv_id and DIGEST, one row for each of ``members``: a null conv_id stays null, a row of it is a conversation of its own; members
    that share a leaf are read once and digest alike; null and empty texts are empty. Empty tables give no row, other columns of
    ``nodes`` and ``members`` are left out. Very long conversations are one row.
    """
    wanted = members.groupBy("leaf").agg(F.first(F.struct("tree", "begins")).alias("m")).select("leaf", "m.tree", F.posexplode("m.begins").alias("at", "begin"))
    place = F.concat_ws(":", "tree", "begin").alias("place")
    wanted = stash(wanted.select("leaf", "at", place))
    found = spread_join(wanted, nodes.select(place, "formatted", "loss_begin", "loss_end"), "place", "leaf")
    lines = found.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "formatted", "loss_begin", "loss_end"))).alias("nodes"))
    return spread_join(members.select("conv_id", "leaf"), lines.mapInArrow(_digest, DIGEST), "leaf", "conv_id").drop("leaf")
