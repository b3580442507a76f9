"""Reply trees: root-to-leaf paths, branch ranking, chat formatting and its inverse.

Paths come from iterative self-joins with doubling: round k knows each node's
ancestor 2^k steps up and the ancestors of every leaf less than 2^(k+1) steps up,
so a tree of depth d takes log2(d) rounds, each written to the shared folder.
Only ids move; texts join the chosen paths at the end.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In role and text
the escape character and the first character of every control string become two
characters, which keeps them from being read as control and can be undone.

Defined cases: null role and text are empty; a parent that isn't there makes a
root; repeated (tree, node) rows keep the least (role, text); nodes on or under a
cycle reach no root and are left out; ties of the score go to the smaller leaf;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

START, END = "<|im_start|>", "<|im_end|>"
#: First characters of control strings, of this template and of common others.
_ANGLE = r"<(?=\|)|<(?=/?s>)|<(?=</?SYS>>)"
_SQUARE = r"\[(?=/?INST\])"


def escape(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\e")
    t = F.regexp_replace(t, _ANGLE, r"\\l")
    return F.regexp_replace(t, _SQUARE, r"\\b")


def unescape(c: Column) -> Column:
    t = F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(t, F.lit("\\e"), F.lit("\\"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for all nodes on the way from each leaf to its root. nodes: (tree, node, parent), unique."""
    n = nodes.alias("n").join(nodes.select(F.col("tree").alias("pt"), F.col("node").alias("pn")), (F.col("tree").eqNullSafe(F.col("pt"))) & (F.col("parent") == F.col("pn")), "left")
    jump = written(n.select("tree", "node", F.col("pn").alias("up_node")), "jump")
    parents = jump.where("up_node is not null").select(F.col("tree").alias("pt"), F.col("up_node").alias("pn")).distinct()
    leaves = jump.join(parents, F.col("tree").eqNullSafe(F.col("pt")) & (F.col("node") == F.col("pn")), "left_anti")
    on_way = written(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "way")
    most = jump.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < 2 * most:
        far = jump.where("up_node is not null").select(F.col("tree").alias("jt"), F.col("node").alias("jn"), "up_node")
        if far.isEmpty():
            break
        more = on_way.join(far, F.col("tree").eqNullSafe(F.col("jt")) & (F.col("node") == F.col("jn"))).select("tree", "leaf", F.col("up_node").alias("node"), (F.col("up") + step).alias("up"))
        next_way = written(on_way.unionByName(more), "way")
        hop = far.select(F.col("jt").alias("ht"), F.col("jn").alias("hn"), F.col("up_node").alias("hu"))
        next_jump = written(far.join(hop, F.col("jt").eqNullSafe(F.col("ht")) & (F.col("up_node") == F.col("hn"))).select(F.col("jt").alias("tree"), F.col("jn").alias("node"), F.col("hu").alias("up_node")), "jump")
        drop_written(on_way)
        drop_written(jump)
        on_way, jump, step = next_way, next_jump, step * 2
    if step >= 2 * most and not jump.where("up_node is not null").isEmpty():  # only cycles are left
        bad = jump.where("up_node is not null").select(F.col("tree").alias("jt"), F.col("node").alias("jn")).distinct()
        on_way = on_way.join(bad, F.col("tree").eqNullSafe(F.col("jt")) & (F.col("leaf") == F.col("jn")), "left_anti")
    return on_way


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, score, rank, turns [(up, role, text)]) of the best-scored root-to-leaf paths of each tree. messages: (tree, node, parent, role, text, score)."""
    one = messages.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))).alias("m")).select("tree", "node", "m.*")
    one = written(one.where("node is not null"), "messages")
    way = ancestors(one.select("tree", "node", "parent"))
    keyed = one.select(F.col("tree").alias("mt"), F.col("node").alias("mn"), "role", "text", "score")
    same = F.col("tree").eqNullSafe(F.col("mt")) & (F.col("node") == F.col("mn"))
    scored = way.join(keyed.select("mt", "mn", "score"), same).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf"))
    chosen = scored.withColumn("rank", rank).where(F.col("rank") <= best).select(F.col("tree").alias("ct"), F.col("leaf").alias("cl"), F.col("score").alias("path_score"), "rank")
    full = way.join(chosen, F.col("tree").eqNullSafe(F.col("ct")) & (F.col("leaf") == F.col("cl"))).join(keyed.drop("score"), same)
    turns = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text")))
    return full.groupBy("tree", "leaf").agg(F.first("path_score").alias("score"), F.first("rank").alias("rank"), turns.alias("turns"))


def format_turns(turns: Column) -> tuple[Column, Column]:
    """(formatted, loss spans [(start, past)] in code points over the escaped assistant texts)."""
    role = lambda t: F.regexp_replace(escape(t["role"]), "\n", r"\\n")
    parts = F.transform(turns, lambda t: F.struct(F.concat(F.lit(START), role(t), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    formatted = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,past:bigint>>").alias("spans"))

    def add(acc, p):
        start = acc["at"] + F.length(p["head"])
        past = start + F.length(p["body"])
        own = F.when(p["loss"], F.array(F.struct(start.alias("start"), past.alias("past")))).otherwise(F.array().cast("array<struct<start:bigint,past:bigint>>"))
        return F.struct((past + len(END) + 1).alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return formatted, F.aggregate(parts, begin, add)["spans"]


def conversations(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, score, rank, formatted, loss_spans): each chosen path as one conversation."""
    p = paths(messages, best)
    formatted, spans = format_turns(F.col("turns"))
    return p.select("tree", "leaf", "score", "rank", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """[(role, text)] back from a formatted conversation."""
    chunks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda c: c != "")
    role = lambda c: F.substring_index(c, "\n", 1)
    body = lambda c: c.substr(F.length(role(c)) + 2, F.length(c) - F.length(role(c)) - 2 - len(END))
    return F.transform(chunks, lambda c: F.struct(unescape(F.replace(role(c), F.lit("\\n"), F.lit("\n"))).alias("role"), unescape(body(c)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["past"] - s["start"]).cast("int")))), "")


def replies(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as trees: each row replies to the one before it by turn, then role and text."""
    at = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    r = rows.select(F.col(conv).alias("tree"), "role", "text", F.row_number().over(at).cast("long").alias("node"))
    return r.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))
