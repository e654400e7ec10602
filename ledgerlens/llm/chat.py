"""Chat formatting of reply trees, in DataFrame functions only.

Messages point to the message they reply to. Root-to-leaf paths are found by self-joins that double the distance each
time: after k joins a message knows its ancestor 2^k replies up, its depth and the summed score on the way. Leaves are
ranked by the mean score of their path; each chosen path is then spelled out by the same pointers, from the longest
jump to the shortest, which reaches every message of the path once. A tree of depth d takes log2(d) joins, on unique
(tree, message) keys.

A conversation is formatted as ``<s>[role]text</s>`` per message. In roles and texts ``&``, ``<`` and ``[`` are written
as ``&amp;``, ``&lt;`` and ``&lsqb;`` (and ``]`` in roles as ``&rsqb;``), so the control strings never occur in them
and the original is recovered exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import stage

ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;")]


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """(tree, rank, leaf, score, depth, node) of the messages on the ``paths`` best root-to-leaf paths of each tree.

    ``messages``: (tree, node, parent, score); (tree, node) is unique. A message whose parent is null or absent is a
    root. ``score`` null counts as 0. Paths are ranked by mean score, then by length (longer first), then by leaf.
    Messages on a circle of replies have no root and are left out. ``depth`` counts from 0 at the root.
    """
    own = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = own.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    rooted = own.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), "score")
    # steps: messages from the node up to `up`, the node included; total: their scores. A null `up`: the root is reached.
    level = stage(rooted.select("tree", "node", "up", F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")), "chat-up-0")
    levels = [level]
    limit = own.count()
    while (1 << (len(levels) - 1)) <= limit and not level.where("up is not null").isEmpty():
        above = level.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("total").alias("sum"))
        climbed = level.where("up is not null").join(above, ["tree", "up"]).select(
            "tree", "node", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("sum")).alias("total")
        )
        level = stage(climbed.unionByName(level.where("up is null")), f"chat-up-{len(levels)}")
        levels.append(level)
    parents = levels[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = level.where("up is null").join(parents, ["tree", "node"], "left_anti")
    # Of any number of leaves a task holds only the best so far: the rank filter is applied before the shuffle and in the sort.
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= paths).select(
        "tree", "rank", F.col("node").alias("leaf"), (F.col("total") / F.col("steps")).alias("score"), "node"
    )
    for k in range(len(levels) - 1, -1, -1):
        jump = levels[k].where("up is not null").select("tree", "node", "up")
        onward = chosen.join(jump, ["tree", "node"]).select("tree", "rank", "leaf", "score", F.col("up").alias("node"))
        chosen = stage(chosen.unionByName(onward), f"chat-path-{k}")
    depth = level.select("tree", "node", (F.col("steps") - 1).alias("depth"))
    return chosen.join(depth, ["tree", "node"])


def formatted(turns: DataFrame, key: list[str]) -> DataFrame:
    """A row per ``key``: ``formatted``, and ``loss`` = [(start, length)] of the assistant texts in it, in characters.

    ``turns``: (key, depth, role, text), text not null. The messages of one conversation make one row of output.
    """
    before = Window.partitionBy(*key).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    cut = turns.select(
        *key, "depth", F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]")).alias("head"),
        F.concat(escape(F.col("text")), F.lit("</s>")).alias("body"), (F.col("role") == "assistant").alias("learned"),
    )
    begins = F.coalesce(F.sum(F.length("head") + F.length("body")).over(before), F.lit(0)) + F.length("head")
    one = F.struct("depth", "head", "body", "learned", begins.cast("long").alias("start"))
    held = cut.withColumn("one", one).groupBy(*key).agg(F.sort_array(F.collect_list("one")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body)), "")
    spans = F.transform(F.filter("turns", lambda t: t.learned), lambda t: F.struct(t.start.alias("start"), (F.length(t.body) - len("</s>")).alias("length")))
    return held.select(*key, whole.alias("formatted"), spans.alias("loss"))


def conversations(messages: DataFrame, paths: int = 1) -> DataFrame:
    """(tree, rank, score, formatted, loss) of the ``paths`` best paths of each reply tree.

    ``messages``: (tree, node, parent, role, text, score). Null texts and roles are empty. Rows without tree or node are
    left out, since nothing can reply to them; of rows that share (tree, node) the least by (parent, role, text) stays.
    An empty table gives an empty result; other columns are ignored.
    """
    own = messages.where("tree is not null and node is not null").select(
        "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score"
    )
    one = own.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    path = best_paths(one, paths).join(one.select("tree", "node", "role", "text"), ["tree", "node"])
    scores = path.select("tree", "rank", "depth", "role", "text", "score")
    out = formatted(scores, ["tree", "rank", "score"])
    return out.select("tree", "rank", "score", "formatted", "loss")


def linear(rows: DataFrame) -> DataFrame:
    """``conversations`` rows (conv_id, turn, role, text) as reply trees: a turn replies to the one before it.

    Rows are taken by turn; of equal turns, or null ones (first), by role and text, and every repeated row stays. Each row
    gets a number of its own in the conversation, so nothing is merged.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return numbered.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def read_back(out: DataFrame) -> DataFrame:
    """Digest columns of formatted conversations, read from ``formatted`` and ``loss`` alone."""
    cells = F.filter(F.split("formatted", "<s>\\["), lambda c: c != "")
    turns = F.transform(cells, lambda c: F.struct(
        unescape(F.substring_index(c, "]", 1)).alias("role"),
        unescape(F.regexp_replace(F.regexp_replace(c, r"(?s)\A[^\]]*\]", ""), r"</s>\z", "")).alias("text"),
    ))
    # Four bytes a character, bound once a row: a span is cut at its place without a walk from the start of the text.
    wide = F.transform(F.array(F.encode("formatted", "UTF-32")), lambda w: F.transform("loss", lambda s: F.decode(w.substr((s.start * 4 + 1).cast("int"), s.length * 4), "UTF-32")))
    learned = F.array_join(wide[0], "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.withColumn("turns", turns).withColumn("learned", unescape(learned)).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast(T.LongType()).alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast(T.LongType()).alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast(T.LongType()).alias("formatted_chars"),
    )
