"""Chat formatting of reply trees.

Messages form trees: each has an id, its parent's id, a role, a text and a score.
Root-to-leaf paths come from iterative self-joins by pointer doubling: after k
joins a message knows its ancestor 2^k steps up and the number and score of the
messages passed, so a path of n messages takes log2(n) joins and no row holds a
path. Leaves are ranked within their conversation by mean score (ties: longer, then greater leaf id);
each chosen leaf's path is the chain of its ancestors, found by walking the same doubled
pointers downwards in powers of two, and is formatted as one conversation.

A conversation is a sequence of rows of at most about `SEGMENT_CHARS` characters of
whole turns, so a conversation of any length is written and read in bounded
memory. The loss mask is a list of [start, end) spans of code points in the segment.

Template: `### Role: text </turn>` and a line feed for each turn. In texts a backslash
is doubled and each control string gets a backslash before it; in roles a colon too. So
every control string that has no backslash before it is the template's, and `unescape` gives the text back.

Defined results: a null text or role is empty; equal turn numbers are ordered by role, then text,
and all are kept; a conversation id of null is a conversation of its own; a message whose
parent is missing is a root; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_table, table

CONTROLS = ("</turn>", "### ")
SEGMENT_CHARS = 200_000
LEARNT_ROLE = "assistant"
#: What the query adds to the table: a text made of the template's own strings.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"
SEGMENTS = "conv_id long, path_rank int, segment long, n_turns long, formatted string, loss_spans array<array<int>>"
_ESCAPE, _ROLE = re.compile(r"\\|</turn>|### "), re.compile(r"\\|</turn>|### |:")
_UNESCAPE = re.compile(r"\\(\\|</turn>|### |:)")


def escape(text: str, pattern: re.Pattern = _ESCAPE) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its escaped text starts and ends."""
    head = f"### {escape(role, _ROLE)}: "
    body = escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts: a turn ends at the first ` </turn>` and line feed with no escape."""
    at = 0
    while at < len(formatted):
        head = formatted.index(": ", at + 4)
        while _odd_backslashes(formatted, head):
            head = formatted.index(": ", head + 1)
        end = formatted.index(" </turn>\n", head + 1)
        yield unescape(formatted[at + 4 : head]), unescape(formatted[head + 2 : end])
        at = end + 9


def _odd_backslashes(text: str, at: int) -> bool:
    n = 0
    while at - n > 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def linear_messages(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees of one path each: every turn answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """conv_id, path_rank, position, message: the messages of each conversation's best paths.

    messages: conv_id, message, parent, score.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    nodes = kept_table(messages.select(key.alias("c"), "message", "parent", "score"), "messages")
    ids = nodes.select("c", F.col("message").alias("parent"))
    real = nodes.join(ids.distinct(), ["c", "parent"], "left_semi").select("c", "message", "parent")
    nodes = nodes.drop("parent").join(real, ["c", "message"], "left")
    # jump: the ancestor 2^k up; n and total: messages and scores from here to just below it, or to the root where jump is null.
    # Only messages with a jump take part in the next join.
    step = nodes.select("c", "message", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("n"), F.col("score").cast("double").alias("total"))
    ended, levels = [], []
    while True:
        step = kept_table(step, "jumps")
        ended.append(step.filter("jump is null"))
        levels.append(step.filter("jump is not null"))
        if not levels[-1].limit(1).count():
            break
        state = reduce(DataFrame.unionByName, [*ended, levels[-1]])
        up = state.select("c", F.col("message").alias("jump"), F.col("jump").alias("next"), F.col("n").alias("n_up"), F.col("total").alias("total_up"))
        step = levels[-1].join(up, ["c", "jump"]).select("c", "message", F.col("next").alias("jump"), (F.col("n") + F.col("n_up")).alias("n"), (F.col("total") + F.col("total_up")).alias("total"))
    level = reduce(DataFrame.unionByName, ended)
    parents = levels[0].select("c", F.col("jump").alias("message")).distinct()
    leaves = level.join(parents, ["c", "message"], "left_anti")
    ranked = leaves.groupBy("c").agg(F.slice(F.sort_array(F.collect_list(F.struct((F.col("total") / F.col("n")).alias("mean"), "n", "message")), False), 1, best).alias("best")) if best > 1 else leaves.groupBy("c").agg(F.array(F.max(F.struct((F.col("total") / F.col("n")).alias("mean"), "n", "message"))).alias("best"))
    chosen = ranked.select("c", F.posexplode("best").alias("path_rank", "leaf")).select("c", "path_rank", (F.col("leaf.n") - 1).alias("position"), F.col("leaf.message").alias("message"))
    # every row below already stands for the ancestors between it and the next row; halving the step adds those in between
    for k in range(len(levels) - 2, -1, -1):
        step = levels[k].select("c", "message", "jump")
        both = F.explode(F.array(F.struct("position", "message"), F.struct((F.col("position") - (1 << k)).alias("position"), F.col("jump").alias("message"))))
        chosen = chosen.join(step, ["c", "message"], "left").select("c", "path_rank", both.alias("x")).select("c", "path_rank", "x.position", "x.message").filter("message is not null")
    return chosen


def format_paths(messages: DataFrame, best: int = 1, learnt_role: str = LEARNT_ROLE, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """The best paths' conversations as SEGMENTS rows. messages: conv_id, message, parent, role, text, score."""
    messages = kept_table(messages.select("conv_id", "message", "parent", "role", "text", "score"), "turns")
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    turns = paths(messages, best).join(messages.select(key.alias("c"), "conv_id", "message", "role", "text"), ["c", "message"])
    ordered = turns.repartition(F.col("c"), F.col("path_rank")).sortWithinPartitions("c", "path_rank", "position")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, segment, turns, parts, spans, size = None, 0, 0, [], [], 0
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal segment, turns, parts, spans, size
            if turns:
                rows.append((None if now[0] == "null" else int(now[0]), now[1], segment, turns, "".join(parts), spans))
            segment, turns, parts, spans, size = segment + 1, 0, [], [], 0

        for pdf in batches:
            for c, rank, role, text in zip(pdf["c"], pdf["path_rank"], pdf["role"], pdf["text"]):
                if (c, rank) != now or size > segment_chars:
                    flush()
                    if (c, rank) != now:
                        now, segment = (c, rank), 0
                turn, a, b = format_turn(role or "", text or "")
                if role == learnt_role:
                    spans.append([size + a, size + b])
                parts.append(turn)
                size, turns = size + len(turn), turns + 1
            yield pd.DataFrame(rows, columns=["conv_id", "path_rank", "segment", "n_turns", "formatted", "loss_spans"])
            rows = []
        flush()
        yield pd.DataFrame(rows, columns=["conv_id", "path_rank", "segment", "n_turns", "formatted", "loss_spans"])

    return ordered.select("c", "path_rank", "role", "text").mapInPandas(run, SEGMENTS)


def digests(segments: DataFrame) -> DataFrame:
    """conv_id and digests of each conversation, read from its segments in turn."""
    ordered = segments.repartition("conv_id", "path_rank").sortWithinPartitions("conv_id", "path_rank", "segment")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = state = None
        rows: list[tuple] = []

        def flush() -> None:
            if now is not None:
                n, turns, loss, chars, size = state
                rows.append((None if now[0] is None else now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size, now[1]))

        for pdf in batches:
            for conv, rank, formatted, spans in zip(pdf["conv_id"], pdf["path_rank"], pdf["formatted"], pdf["loss_spans"]):
                key = (None if pd.isna(conv) else int(conv), int(rank))
                if key != now:
                    flush()
                    now, state = key, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for role, text in parse_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for a, b in spans:
                    text = unescape(formatted[a:b])
                    state[2].update(text.encode())
                    state[3] += len(text)
                state[4] += len(formatted)
            yield pd.DataFrame(rows, columns=columns)
            rows = []
        flush()
        yield pd.DataFrame(rows, columns=columns)

    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "path_rank"]
    return ordered.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, path_rank int")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(kept_table(format_paths(linear_messages(turns)), "chats"))
