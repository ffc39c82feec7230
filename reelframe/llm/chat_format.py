"""Chat formatting: reply trees to conversations.

A tree is a table of messages with an id and the id of the message they answer.
Root-to-leaf paths come from iterative self-joins: a table of jumps to the ancestor
1, 2, 4, ... steps up is joined with itself until no jump is left, then every leaf
takes the jumps from the longest to the shortest and so meets each ancestor once.
The number of joins grows with the logarithm of the depth, the rows with the length of
the paths.  Branches of a tree are ranked by the sum of their messages' scores, by numbers
alone; texts are joined to the chosen paths only, and each is formatted as one conversation.

The template marks turns with control strings.  Where a text holds one, the string
gets a backslash before it, and backslashes that stood there are doubled; nothing
else changes, so the texts can be read back.  The loss mask is a list of spans of the
formatted string (from, to), one for each assistant text.

Nulls and odd input: a null text or role is the empty string; a null tree id is a tree
of its own; a missing score counts 0; an answer to a message that is not there starts a
path; ties in rank go to the longer path, then the smaller leaf; repeated rows of a
flat table are turns of their own; of several messages with one id in one tree the least
stays (by parent, null first, then role, text and score), so repeated rows count once;
in a circle of answers the message with the smallest id counts as one that answers
nothing, and starts a path; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.llm.common import Scratch, read

#: What opens and closes a turn of a role; any other role is named inside its turn.
MARKS = {"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s> ", " </s>\n")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]\n")
CONTROL = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]"]
_control = "|".join(map(re.escape, CONTROL))
_plain, _escaped = re.compile(rf"(\\*)({_control})"), re.compile(rf"(\\+)({_control})")
_roles = {marks[0].strip(): role for role, marks in MARKS.items()}


def escape(text: str) -> str:
    return _plain.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[1][: (len(m[1]) - 1) // 2] + m[2], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        if role in MARKS:
            before, after = MARKS[role]
        else:
            before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
        inner = escape(text)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(inner)))
        parts += [before, inner, after]
        at += len(before) + len(inner) + len(after)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, role, start = [], None, 0
    for m in _plain.finditer(formatted):
        if m[1]:
            continue  # an escaped one, inside a text
        if m[2] in _roles:
            role, start = _roles[m[2]], m.end() + 1
        elif m[2] == "[ROLE]":
            start = m.end() + 1
        elif m[2] == "[TEXT]":
            role, start = unescape(formatted[start : m.start() - 1]), m.end() + 1
        else:
            turns.append((role, unescape(formatted[start : m.start() - 1])))
    return turns


def chain(rows: DataFrame, *, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A flat table of turns as trees in which each turn answers the one before."""
    own = W.partitionBy("tree").orderBy("turn", "role", "text")
    flat = rows.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return flat.withColumn("node", F.row_number().over(own).cast("long")).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, hop, node) for every leaf: its ancestors, itself at hop 0.

    messages: tree, node, parent.
    """
    scratch = Scratch(messages.sparkSession, "reply-trees")
    up = F.when(F.col("parent").isNotNull(), F.struct("tree", F.col("parent").alias("n")))
    nodes = scratch.keep(messages.select(F.struct("tree", F.col("node").alias("n")).alias("v"), up.alias("up")), "nodes")
    jumps, circles = _jumps(nodes, scratch, "jump")
    if circles is not None:
        cut = circles.select("v", F.lit(True).alias("cut"))
        nodes = scratch.keep(nodes.join(cut, "v", "left").select("v", F.when(F.col("cut").isNull(), F.col("up")).alias("up")), "cut-nodes")
        jumps, _ = _jumps(nodes, scratch, "cut-jump")
    leaves = nodes.join(jumps[0].select(F.col("up").alias("v")), "v", "left_anti")
    out = leaves.select(F.col("v").alias("leaf"), F.lit(0).cast("long").alias("hop"), "v")
    for k in range(len(jumps) - 2, -1, -1):
        out = out.join(jumps[k], "v", "left").select("leaf", F.explode(F.array(F.struct("hop", "v"), F.struct((F.col("hop") + (1 << k)).alias("hop"), F.col("up").alias("v")))).alias("s")).select("leaf", "s.hop", "s.v").where("v is not null")
    return out.select(F.col("leaf.tree").alias("tree"), F.col("leaf.n").alias("leaf"), "hop", F.col("v.n").alias("node"), "v")


def _jumps(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables of jumps 1, 2, 4, ... steps up, the last one empty; or the smallest message of each circle.

    Jumps longer than there are messages exist only along circles, and end on them.
    """
    total = nodes.count()
    there = nodes.select(F.col("v").alias("up"))
    jumps = [scratch.keep(nodes.where("up is not null").join(there, "up").select("v", "up"), f"{name}-0")]
    while jumps[-1].take(1):
        if 1 << (len(jumps) - 1) > total:
            return jumps, _smallest(jumps, scratch, name)
        last = jumps[-1]
        jumps.append(scratch.keep(last.join(last.select(F.col("v").alias("up"), F.col("up").alias("then")), "up").select("v", F.col("then").alias("up")), f"{name}-{len(jumps)}"))
    return jumps, None


def _smallest(jumps: list[DataFrame], scratch: Scratch, name: str) -> DataFrame:
    """(v) of the messages on a circle that are the smallest of their own circle."""
    least = scratch.keep(jumps[-1].select(F.col("up").alias("v")).distinct().withColumn("m", F.col("v")), f"{name}-on")
    for k, steps in enumerate(jumps):
        # the smallest of 2 ** k messages from v on, then of twice as many
        further = least.select(F.col("v").alias("up"), F.col("m").alias("then"))
        least = scratch.keep(least.join(steps, "v").join(further, "up").select("v", F.least("m", "then").alias("m")), f"{name}-least-{k}")
    return least.where(F.col("v") == F.col("m")).select("v")


def format_trees(messages: DataFrame, *, best: int | None = None) -> DataFrame:
    """One row per chosen branch: tree, leaf, rank, score, formatted, loss.

    messages: tree, node, parent, role, text, score.  best: so many branches of each
    tree; all if not given.  loss: spans of ``formatted`` under the loss mask.
    """
    scratch = Scratch(messages.sparkSession, "branches")
    kinds = dict(messages.dtypes)
    own = messages.select("tree", "node", "parent", "role", "text", "score")
    if not own.groupBy("tree", "node").count().where("count > 1").isEmpty():
        own = own.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    key = F.struct("tree", F.col("node").alias("n")).alias("v")
    steps = scratch.keep(paths(own), "steps")
    scores = own.select(key, F.coalesce("score", F.lit(0.0)).alias("score"))
    branches = steps.join(scores, "v").groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    ranked = branches.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    leaf = F.struct("tree", "leaf").alias("branch")
    chosen = scratch.keep(ranked.select(leaf, "rank", "score"), "chosen")
    content = own.select(key, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct((-F.col("hop")).alias("at"), "role", "text")
    whole = steps.select(leaf, "hop", "v").join(chosen.select("branch"), "branch", "left_semi").join(content, "v").groupBy("branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    told = whole.join(chosen, "branch").select("branch.tree", "branch.leaf", "rank", "score", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render([(x["role"], x["text"]) for x in turns.as_py()]) for turns in b.column("turns")]
            spans = pa.array([[{"from": x, "to": y} for x, y in s] for _, s in done], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("tree", "leaf", "rank", "score")] + [pa.array([f for f, _ in done], pa.string()), spans], names=["tree", "leaf", "rank", "score", "formatted", "loss"])

    return told.mapInArrow(run, f"tree {kinds['tree']}, leaf {kinds['node']}, rank int, score double, formatted string, loss array<struct<from: bigint, to: bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: counts and digests."""
    kind = dict(formatted.dtypes)["tree"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for f, loss in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
                turns = parse(f)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                learned = "".join(unescape(f[s["from"] : s["to"]]) for s in loss)
                out.append((len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(f)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("tree"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return digests(format_trees(chain(rows.unionByName(extra)), best=1))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (
  SELECT *, regexp_replace(text, '(\\*)(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[TEXT\]|\[/ROLE\])', '\1\1\\\2', 'g') AS esc,
         regexp_replace(role, '(\\*)(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[TEXT\]|\[/ROLE\])', '\1\1\\\2', 'g') AS esc_role
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(esc) + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 ELSE 24 + length(esc_role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
