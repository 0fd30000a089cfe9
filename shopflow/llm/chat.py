"""Operator 9: chat formatting over reply trees, with DataFrame functions only.

Messages form trees (node, parent). Self-joins list every root-to-leaf path: the jump table
doubles its stride in each round, so rounds grow with the logarithm of the depth. The paths
of a tree are ranked by score and each chosen one becomes one conversation.

The template marks a turn as ``<|im_start|>role LF text <|im_end|> LF``. Control strings of
this and of other common templates that stand inside a role or text are escaped with ``~`` and a digit, and can
be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.common import materialise

START, END = "<|im_start|>", "<|im_end|>\n"
# The escape character first; then a digit for each control string.
ESCAPES = [("~", "~0"), ("<|", "~1"), ("|>", "~2"), ("[INST]", "~3"), ("[/INST]", "~4"), ("</s>", "~5"), ("<s>", "~6"),
           ("<<SYS>>", "~7"), ("<</SYS>>", "~8")]
LINE = ("\n", "~9")  # in a role, which ends with its line


def escape(col: Column, line: bool = False) -> Column:
    for plain, code in [*ESCAPES, *[LINE] * line]:
        col = F.replace(col, F.lit(plain), F.lit(code))
    return col


def unescape(col: Column) -> Column:
    for plain, code in [LINE, *ESCAPES[::-1]]:
        col = F.replace(col, F.lit(code), F.lit(plain))
    return col


def reply_paths(nodes: DataFrame) -> DataFrame:
    """``nodes(tree, node, parent)`` -> ``(tree, leaf, node, up)``: for each leaf, every node on
    the way to its root, ``up`` steps away.

    A parent that isn't in the tree makes its child a root. Nodes on or below a cycle have no
    root, hence no path. ``tree`` and ``node`` must not be null, ``(tree, node)`` must be unique.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    links = nodes.where("parent is not null").select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi")
    jump = materialise(links.select("tree", "node", F.col("parent").alias("up_node")), "jump")
    inner = links.select("tree", F.col("parent").alias("node")).distinct()
    path = materialise(nodes.select("tree", "node").join(inner, ["tree", "node"], "left_anti")
                       .select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")), "paths")
    roots = nodes.select("tree", "node").join(links.select("tree", "node"), ["tree", "node"], "left_anti")
    step, all_nodes = 1, nodes.count()
    while jump.limit(1).count() and step <= 2 * all_nodes:
        path = materialise(path.union(path.join(jump, ["tree", "node"]).select(
            "tree", "leaf", F.col("up_node").alias("node"), (F.col("up") + step).alias("up"))), "paths")
        again = jump.select("tree", F.col("node").alias("up_node"), F.col("up_node").alias("far"))
        jump = materialise(jump.join(again, ["tree", "up_node"]).select("tree", "node", F.col("far").alias("up_node")), "jump")
        step *= 2
    rooted = path.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    return path.join(rooted, ["tree", "leaf"], "left_semi") if jump.limit(1).count() else path


def format_trees(nodes: DataFrame, best: int = 1, train_role: str = "assistant") -> DataFrame:
    """``nodes(tree, node, parent, role, text, score)`` -> ``(tree, leaf, rank, formatted, spans)``
    for the ``best`` branches of each tree.

    A branch's score is the sum of its nodes' scores (null: 0); ties go to the longer branch, then
    to the smaller leaf. ``spans`` (start, length in code points of ``formatted``) is the loss mask: the
    texts of ``train_role``. Null roles and texts count as empty.
    """
    paths = reply_paths(nodes.select("tree", "node", "parent"))
    own = nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))
    ranked = (paths.join(own.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf")
              .agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("depth"))
              .withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "leaf")))
              .where(F.col("rank") <= best).select("tree", "leaf", "rank"))
    turns = (paths.join(ranked, ["tree", "leaf"]).join(own, ["tree", "node"]).groupBy("tree", "leaf", "rank")
             .agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns")))
    turns = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), escape(t["role"], line=True), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == train_role).alias("train"))))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    spans = F.aggregate("turns", zero, lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
        F.when(t["train"], F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans")))
    return turns.select("tree", "leaf", "rank",
                        F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("formatted"),
                        spans["spans"].alias("spans"))


def read_formatted(formatted: Column) -> Column:
    """A formatted conversation -> array of (role, text)."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.lit(1) + F.locate("\n", p))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))))


def thread_nodes(rows: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as trees: each turn replies to the one before.

    Turns are ordered by turn (null first), then role and text; a null conv_id is a conversation.
    """
    key = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id"))
    rows = rows.select(key.alias("tree"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")))
    return materialise(rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
                                   F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score")), "nodes")


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conversations`` -> ``(conv_id, formatted, spans)``, one row for each conversation."""
    out = format_trees(thread_nodes(rows))
    return out.select(F.when(~F.col("tree.none"), F.col("tree.id")).alias("conv_id"), "formatted", "spans")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from ``format_conversations``' output."""
    turns, loss = read_formatted(F.col("formatted")), read_loss(F.col("formatted"), F.col("spans"))
    d = formatted.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")
