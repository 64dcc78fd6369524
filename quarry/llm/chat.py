"""Chat formatting of reply trees.

A forest of replies (tree, node, parent, role, text, score) becomes one conversation for each chosen root-to-leaf path:
1. Self-joins with doubled step give each node its ancestor 1, 2, 4, ... levels up, until no node has one.
2. From every leaf, the same tables in falling order enumerate all its ancestors: the rows of its path.
3. Paths of a tree are ranked by their summed score (ties: the smaller leaf id) and the best `top` are kept.
4. A path's turns are written with the template below; spans of assistant text are the loss mask.

Template: `<|im_start|>` role `<|im_sep|>` text `<|im_end|>`, turns joined by line breaks. Inside roles and texts a
backslash is doubled and every control string (listed in CONTROL) gets a backslash after its first character, so that no
marker can appear in a text; dropping each backslash that precedes a character restores it.

Defined cases: null text and null role are empty; a null score is 0; a node whose parent is absent is a root; a cycle
raises ValueError; an empty table gives an empty result; equal rows are turns of their own; paths of one score (ties) rank by
leaf id; texts of any length are written whole. Only the named columns are read, so further ones may carry any name.
In `linear_tree`, all rows without a conv_id are one conversation, whose conv_id is null.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common as C

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates in public use treat as control.
CONTROL = r"<\||</?s>|\[/?INST\]|<</?SYS>>"
_CONTROL = re.compile(rf"\\|{CONTROL}")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node of every root-to-leaf path; up counts from the leaf. nodes: tree, node, parent."""
    nodes = nodes.select("tree", "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = C.cut(nodes.where("parent is not null").join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("above")))
    leaves = nodes.join(jump.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti")
    jumps, most = [], max(1, jump.count()).bit_length()
    while jump.take(1):
        jumps.append(jump)
        if len(jumps) > most:
            raise ValueError("a reply tree holds a cycle")
        upper = jump.select("tree", F.col("above").alias("mid"), "node").join(jump.select("tree", F.col("node").alias("mid"), F.col("above")), ["tree", "mid"])
        jump = C.cut(upper.select("tree", "node", "above"))
    rows = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        here = F.struct(F.col("node"), F.col("up"))
        there = F.when(F.col("above").isNotNull(), F.array(here, F.struct(F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up")))).otherwise(F.array(here))
        rows = rows.join(jumps[k], ["tree", "node"], "left").select("tree", "leaf", F.explode(there).alias("n")).select("tree", "leaf", "n.node", "n.up")
    return rows


def best_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, turns): the `top` best paths of each tree (None: all), turns root first."""
    rows = paths(nodes).join(nodes.select("tree", "node", "role", "text", "score"), ["tree", "node"])
    turn = F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    path = rows.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    ranked = path.withColumn("rank", rank)
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def write(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) of assistant texts."""
    out, spans, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        head = ("\n" if k else "") + START + escape(role) + SEP
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted conversation."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


FORMATTED = "tree long, leaf long, rank int, score double, formatted string, loss array<struct<begin:long,end:long>>"


def format_paths(best: DataFrame) -> DataFrame:
    """One row per chosen path: the conversation and its loss mask."""

    def run(frames):
        for f in frames:
            done = [write([(t["role"], t["text"]) for t in turns]) for turns in f["turns"]]
            yield pd.DataFrame({"tree": f["tree"], "leaf": f["leaf"], "rank": f["rank"], "score": f["score"], "formatted": [d[0] for d in done], "loss": [[{"begin": a, "end": b} for a, b in d[1]] for d in done]})

    return best.select("tree", "leaf", "rank", "score", "turns").mapInPandas(run, FORMATTED)


def linear_tree(conversations: DataFrame) -> DataFrame:
    """Turns of linear conversations as nodes: each turn replies to the one before it (by turn, then role and text)."""
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select(F.col("tree").alias("conv"), F.coalesce("tree", F.lit(-(1 << 62))).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1; digests are taken from the formatted output, read back."""
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = C.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
    nodes = C.cut(linear_tree(rows))
    out = format_paths(best_paths(nodes.drop("conv")))

    def digest(frames):
        for f in frames:
            got = []
            for tree, text, loss in zip(f["tree"], f["formatted"], f["loss"], strict=True):
                turns = read(text)
                lost = "".join(unescape(text[s["begin"] : s["end"]]) for s in loss)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                got.append((None if tree == -(1 << 62) else tree, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
            d = pd.DataFrame(got, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield d.astype({"conv_id": "Int64"})

    return out.select("tree", "formatted", "loss").mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_ESC = r"regexp_replace(regexp_replace({x}, '\\', '\\\\', 'g'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"
OP6_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS lost,
  sum(32 + length({_ESC.format(x="role")}) + length({_ESC.format(x="text")})) + count(*) - 1 AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256, chars::BIGINT AS formatted_chars FROM o
"""
