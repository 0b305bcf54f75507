"""Chat formatting: reply trees to single conversations, with a loss mask.

Native DataFrame code only.  Messages form trees through ``parent``; pointer
doubling (each round joins the table of 2^k-step ancestors with itself) gives
every message its depth and score total and every chosen leaf its whole path
in log2(depth) self-joins.

Defined results
* null text or role: the empty string; null score: 0
* a parent that is missing from its tree: the message is a root
* messages on a reference cycle have no root and appear on no path
* ties between branches: the longer path, then the smaller leaf id
* an empty table gives an empty table; extra columns are ignored
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.durable import durable

#: Control strings of the template; each starts with ``<`` or ``[``.
TURN_OPEN, TEXT_OPEN, TEXT_CLOSE, TURN_CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_TAILS = "|".join(re.escape(c[1:]) for c in (TURN_OPEN, TURN_CLOSE, TEXT_OPEN, TEXT_CLOSE))


def escape(text: Column) -> Column:
    """Put one more backslash after the first character of control strings.

    A control string that already holds k backslashes there gets k+1, so the
    mapping is one-to-one and leaves every other text as it is.
    """
    return F.regexp_replace(text, rf"([<\[])(\\*)({_TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_TAILS})", r"$1$2$3")


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Best root-to-leaf paths.

    ``messages``: tree, node, parent, role, text, score.  Returns tree, leaf,
    branch (1 = best), pos (0 = root), role, text.
    """
    base = durable(messages.select(
        "tree", "node", "parent",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("score", F.lit(0)).cast("double").alias("score"),
    ), "chat-messages")
    ids = base.select("tree", F.col("node").alias("up")).distinct()
    edge = base.select("tree", "node", F.col("parent").alias("up"), "score")
    known = edge.join(
        ids.withColumn("found", F.lit(True)).withColumnRenamed("tree", "t"),
        (edge.tree.eqNullSafe(F.col("t"))) & (edge.up == ids.up), "left",
    ).select(edge.tree, edge.node, F.when(F.col("found"), edge.up).alias("up"), edge.score)
    moved = durable(known.select("tree", "node", "up", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "chat-step")
    at_root, levels = moved.where("up is null"), []
    while not (open_ := moved.where("up is not null")).isEmpty():
        if not levels:
            limit = base.count()
        elif 1 << len(levels) > limit:
            break  # only cycles are left
        levels.append(open_)
        q = at_root.unionByName(open_).select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("s2"))
        moved = durable(
            open_.join(q, open_.tree.eqNullSafe(q.t2) & (open_.up == q.n2)).select(
                "tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("s2")).alias("total")
            ),
            "chat-step",
        )
        at_root = at_root.unionByName(moved.where("up is null"))
    parents = known.where("up is not null").select(F.col("tree").alias("t3"), F.col("up").alias("u3")).distinct()
    leaves = at_root.join(parents, at_root.tree.eqNullSafe(parents.t3) & (at_root.node == parents.u3), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    path = durable(chosen.select("tree", F.col("node").alias("leaf"), "branch", "node", (F.col("depth") - 1).alias("pos")), "chat-path")
    for k, level in enumerate(levels):
        up = level.select(F.col("tree").alias("t4"), F.col("node").alias("n4"), F.col("up").alias("u4"))
        more = path.join(up, path.tree.eqNullSafe(up.t4) & (path.node == up.n4)).select(
            "tree", "leaf", "branch", F.col("u4").alias("node"), (F.col("pos") - (1 << k)).alias("pos")
        )
        path = durable(path.unionByName(more), "chat-path")
    text = base.select(F.col("tree").alias("t5"), F.col("node").alias("n5"), "role", "text")
    return path.join(text, path.tree.eqNullSafe(text.t5) & (path.node == text.n5)).select("tree", "leaf", "branch", "pos", "role", "text")


def format_paths(paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per path: tree, leaf, branch, formatted, loss_spans.

    ``loss_spans`` holds (start, length) in code points of ``formatted``; each
    covers the escaped text of one turn of ``loss_role``.
    """
    lead = F.concat(F.lit(TURN_OPEN), escape(F.col("role")), F.lit(TEXT_OPEN))
    body = escape(F.col("text"))
    tail = F.lit(TEXT_CLOSE + TURN_CLOSE)
    w = Window.partitionBy("tree", "leaf", "branch").orderBy("pos")
    pieces = paths.select("tree", "leaf", "branch", "pos", "role", lead.alias("lead"), body.alias("body")).withColumn("piece", F.concat("lead", "body", tail))
    placed = pieces.withColumn("ended", F.sum(F.length("piece").cast("long")).over(w)).select(
        "tree", "leaf", "branch",
        F.struct(
            "pos", "piece", (F.col("role") == loss_role).alias("loss"),
            (F.col("ended") - F.length("piece") + F.length("lead")).alias("start"),
            F.length("body").cast("long").alias("length"),
        ).alias("turn"),
    )
    turns = F.array_sort(F.collect_list("turn"))
    return placed.groupBy("tree", "leaf", "branch").agg(turns.alias("turns")).select(
        "tree", "leaf", "branch",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
    )


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pattern = rf"(?s){re.escape(TURN_OPEN)}(.*?){re.escape(TEXT_OPEN)}(.*?){re.escape(TEXT_CLOSE)}{re.escape(TURN_CLOSE)}"
    return F.arrays_zip(
        F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1)), unescape).alias("role"),
        F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2)), unescape).alias("text"),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All unescaped text under the loss mask, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Each turn replies to the turn before it (null turns last; ties by role, then text)."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    pos = F.row_number().over(w).cast("long")
    return conversations.select(
        F.col("conv_id").alias("tree"), pos.alias("node"), "role", "text",
        (F.col("role") == "assistant").cast("double").alias("score"),
    ).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Digest of every formatted conversation, read back from the formatted text."""
    done = format_paths(reply_paths(conversations_as_trees(conversations)))
    read = done.withColumn("turns", parse_formatted(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
