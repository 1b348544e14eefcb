"""Reply trees and chat formatting (operator 2)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare

START, END = "<|im_start|>", "<|im_end|>"
_INNER, _OUTER = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash more goes between ``<`` and ``|``, also where some stand already."""
    return _INNER.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OUTER.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(the conversation, the spans of the loss mask): the text of every assistant turn, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END + "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a conversation: the inverse of ``format_turns``."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, body = piece.split("\n", 1)
        turns.append((_unrole(role), unescape(body[: -len(END) - 1])))
    return turns


def masked_text(formatted: str, spans: list) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def _format(batches):
    for b in batches:
        texts, starts, ends = [], [], []
        for turns in b.column(2).to_pylist():
            text, spans = format_turns([(t["role"], t["text"]) for t in turns])
            texts.append(text)
            starts.append([s for s, _ in spans])
            ends.append([e for _, e in spans])
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(starts, longs), pa.array(ends, longs)], ["tree_id", "leaf", "formatted", "mask_from", "mask_to"])


def leaf_paths(messages: DataFrame) -> DataFrame:
    """(tree_id, leaf, node, up): every node of every root-to-leaf path, ``up`` steps above the leaf.

    ``messages``: (tree_id, node, parent). The tables of ancestors at distances 1, 2, 4, ... come from self-joins;
    going down these, each (leaf, node) found yields the one that far above it, so a path of n nodes takes about
    2 log n joins and as many rows as it has nodes. A parent that is null or missing makes a root. Nodes that lie on
    a cycle have no leaf, or stop at the first node that repeats.
    """
    nodes = messages.select("tree_id", "node", "parent")
    known = nodes.select("tree_id", F.col("node").alias("parent"))
    jump = materialize(nodes.join(known, ["tree_id", "parent"], "left_semi").select("tree_id", "node", F.col("parent").alias("up")), "jumps")
    inner = jump.select("tree_id", F.col("up").alias("node")).distinct()
    paths = nodes.join(inner, ["tree_id", "node"], "left_anti").select("tree_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    levels, limit = [jump], nodes.count()
    while 1 << len(levels) <= limit:
        far = levels[-1].join(levels[-1].select("tree_id", F.col("node").alias("up"), F.col("up").alias("top")), ["tree_id", "up"]).select("tree_id", "node", F.col("top").alias("up"))
        far = materialize(far, "jumps")
        if far.isEmpty():
            break
        levels.append(far)
    for k in reversed(range(len(levels))):
        above = paths.join(levels[k].withColumnRenamed("up", "top"), ["tree_id", "node"]).select("tree_id", "leaf", F.col("top").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = materialize(paths.union(above), "paths")
    return paths.groupBy("tree_id", "leaf", "node").agg(F.min("up").alias("up"))


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree_id, leaf, rank, score, n_turns, formatted, mask_from, mask_to): the ``best`` branches of each tree.

    ``messages``: (tree_id, node, parent, role, text, score), node unique in its tree. A branch's score is the mean
    of its messages' scores (null: 0); ties go to the smaller leaf. Each chosen path is one conversation in the
    template ``<|im_start|>role\\ntext<|im_end|>\\n``, control strings in texts escaped; the mask spans every
    assistant text. Null role and text: empty. A tree without rows does not exist; an empty table gives no rows.
    Branches are ranked before any text is gathered, so only the chosen paths' texts are.
    """
    prepare(messages.sparkSession)
    paths = materialize(leaf_paths(messages), "leaf_paths")
    scores = messages.select("tree_id", "node", F.coalesce("score", F.lit(0.0)).alias("score"))
    ranked = paths.join(scores, ["tree_id", "node"]).groupBy("tree_id", "leaf").agg(F.avg("score").alias("score"), F.count("*").alias("n_turns"))
    if best == 1:
        top = ranked.groupBy("tree_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "leaf", "n_turns")).alias("m"))
        chosen = top.select("tree_id", "m.leaf", F.lit(1).alias("rank"), (-F.col("m.s")).alias("score"), "m.n_turns")
    else:
        order = Window.partitionBy("tree_id").orderBy(F.col("score").desc(), "leaf")
        chosen = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("tree_id", "leaf", "rank", "score", "n_turns")
    chosen = materialize(chosen, "chosen")
    turn = F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = paths.join(chosen.select("tree_id", "leaf"), ["tree_id", "leaf"], "left_semi")
    turns = kept.join(messages.select("tree_id", "node", "role", "text"), ["tree_id", "node"]).groupBy("tree_id", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = turns.mapInArrow(_format, "tree_id long, leaf long, formatted string, mask_from array<long>, mask_to array<long>")
    return chosen.join(formatted, ["tree_id", "leaf"])


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees of one branch: each turn replies to the one before.

    Repeated turns are ordered by role and text. A null conv_id is a conversation of its own, number NO_CONV.
    """
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce("conv_id", F.lit(NO_CONV)).alias("tree_id"), "turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


NO_CONV = -(2**63)


def _digest(batches):
    import hashlib

    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for b in batches:
        out = []
        for conv, text, starts, ends in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            turns = parse_turns(text)
            loss = masked_text(text, list(zip(starts, ends, strict=True)))
            out.append((None if conv == NO_CONV else conv, len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), hexed(loss), len(text)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the written form."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree_id", "formatted", "mask_from", "mask_to").mapInArrow(_digest, schema)
