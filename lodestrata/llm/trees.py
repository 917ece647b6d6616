"""Reply trees: root-to-leaf paths, ranked and formatted as conversations; native expressions only.

Ancestors are found by pointer doubling: round k joins the table of 2**k-th ancestors with
itself, so a chain of n turns takes log2(n) rounds. Every path is then read off leaf by leaf
in as many joins. Paths of a root are ranked by score and the chosen ones formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.session import cut

#: Template: a turn is OPEN + role + CLOSE_HEAD + text + END. These, and common markers of
#: other templates, are control strings and never stand unescaped inside a text.
OPEN, CLOSE_HEAD, END = "<|", "|>\n", "</s>\n"
CONTROL = r"<(?=\||/?s>)|\|(?=>)|\[(?=/?INST\])|<(?=/?SYS>>)|<(?=</?SYS>>)"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Double every backslash, then put one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, node, depth, branch_score, branch_rank) of the ``top`` paths of each tree.

    ``nodes``: tree, node (unique in its tree), parent (null at a root), score (double). A
    branch's score is the mean over its nodes; ties go to the smaller leaf. A parent that is
    not in the tree makes its child a root. Null trees or nodes are left out; of repeated
    nodes the row with the least parent counts. A parent chain that never ends has no leaf
    and gives no path.
    """
    own = nodes.where(F.col("tree").isNotNull() & F.col("node").isNotNull()).groupBy("tree", "node").agg(F.min_by(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score")), F.struct(F.col("parent").isNull(), "parent", "score")).alias("x"))
    own = own.select("tree", "node", F.col("x.parent").alias("parent"), F.col("x.score").alias("score"))
    known = own.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    own = cut(own.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"))

    jumps = [own.where(F.col("parent").isNotNull()).select("tree", "node", F.col("parent").alias("up"))]
    limit = own.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while (1 << len(jumps)) < limit:
        last = jumps[-1]
        further = cut(last.join(last.select("tree", F.col("node").alias("up"), F.col("up").alias("next")), ["tree", "up"]).select("tree", "node", F.col("next").alias("up")))
        if further.isEmpty():
            break
        jumps.append(further)

    inner = own.where(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node")).distinct()
    found = own.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up_by"))
    for k in reversed(range(len(jumps))):
        here = F.struct(F.col("node").alias("node"), F.col("up_by").alias("up_by"))
        there = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("up_by") + (1 << k)).alias("up_by")))
        both = found.join(jumps[k], ["tree", "node"], "left").select("tree", "leaf", F.explode(F.filter(F.array(here, there), lambda x: x.isNotNull())).alias("x"))
        found = both.select("tree", "leaf", "x.node", "x.up_by")
    found = cut(found)
    ranked = found.join(own.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"), F.max("up_by").alias("longest"))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    ranked = ranked.withColumn("branch_rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("branch_rank") <= top)
    return found.join(ranked, ["tree", "leaf"]).select("tree", "leaf", "node", (F.col("longest") - F.col("up_by")).alias("depth"), "branch_score", "branch_rank")


def format_paths(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per chosen path: tree, leaf, branch_rank, branch_score, formatted, segments.

    ``turns``: tree, node, role, text (null role or text: empty). ``segments`` are the pieces of
    ``formatted`` in order, each with the loss mask over it: true for what an assistant says.
    """
    rows = chosen.join(turns.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE_HEAD))
    piece = F.struct("depth", head.alias("head"), text.alias("text"), (role == LOSS_ROLE).alias("loss"))
    rows = rows.groupBy("tree", "leaf", "branch_rank", "branch_score").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    segments = F.flatten(
        F.transform(
            "pieces",
            lambda p: F.array(
                F.struct(p["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(p["text"].alias("text"), p["loss"].alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    rows = rows.withColumn("segments", segments).drop("pieces")
    return rows.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    parts = F.split(formatted, "(?<=</s>\n)")
    kept = F.filter(parts, lambda p: p != "")
    return F.transform(
        kept,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)\A<\|(.*?)\|>\n", 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)\A<\|.*?\|>\n(.*)</s>\n\z", 1)).alias("text"),
        ),
    )


#: The tree of turns without a conversation; no conversation has this id.
NO_CONVERSATION = -(1 << 63)


def conversation(tree: Column) -> Column:
    """The conversation of a tree that ``linear`` made: null for ``NO_CONVERSATION``."""
    return F.when(tree != NO_CONVERSATION, tree)


def linear(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of conversations without branches: the parent of a turn is the turn before it.

    Turns are in order of ``turn``, null first; equal turns follow by role and text, so repeated
    rows stay whole. Rows without a conversation are one of their own (``NO_CONVERSATION``).
    Very long texts stay whole; other columns are ignored; no rows give no rows.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    own = rows.select(F.coalesce(F.col(tree).cast("long"), F.lit(NO_CONVERSATION)).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    own = own.withColumn("node", F.row_number().over(order).cast("long"))
    return own.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))
