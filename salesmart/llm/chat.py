"""Reply trees to conversations, in DataFrame functions only.

Messages point to the message they answer. Iterated self-joins double the length of known
stretches towards the root, so depth and score of every branch take as many rounds as the
depth has binary digits. The best leaves of each tree are chosen by mean score, their paths
are spelled out with the same jump tables, and each path becomes one conversation:

    ### User: text</turn>
    ### Assistant: text</turn>

A backslash goes after every backslash, after `<` before `/turn>` and after `#` before `#`
of a text, so neither mark of the template can stand inside one, and taking these
backslashes out again restores it. Other roles than the four named are written as they are
after a `=`.

Defined cases: null texts and roles are empty ones; a null tree is a tree; messages of one
id count once (the least by role and text); a message whose parent is missing is a root;
messages in a cycle of replies, or below one, are in no path; ties of score go to the
longer branch, then to the smaller leaf id; empty tables give no conversations; further
columns of the input are not looked at. A conversation is one row, so it must fit in
memory, as it must wherever it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import quoted
from .storage import written

END = "</turn>\n"
SHOWN = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
SALTS = 32


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|<(?=/turn>)|#(?=#)", "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\/# ])", "$1")


def shown_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair])
    other = F.regexp_replace(role, r"\\|<(?=/turn>)|#(?=#)|:(?= )", "$0\\\\")
    return F.coalesce(known[role], F.concat(F.lit("="), other))


def read_role(shown: Column) -> Column:
    return F.when(F.startswith(shown, F.lit("=")), unescape(F.substring(shown, 2, F.length(shown)))).otherwise(F.lower(shown))


def _messages(messages: DataFrame, names: dict[str, str]) -> DataFrame:
    own = messages.select(
        quoted(names["tree"]).alias("tree"),
        quoted(names["message"]).alias("id"),
        quoted(names["parent"]).alias("parent"),
        F.coalesce(quoted(names["role"]), F.lit("")).alias("role"),
        F.coalesce(quoted(names["text"]), F.lit("")).alias("text"),
        F.coalesce(quoted(names["score"]).cast("double"), F.lit(0.0)).alias("score"),
    )
    one = F.min(F.struct("role", "text", "parent", "score")).alias("m")
    return own.where(F.col("id").isNotNull()).groupBy("tree", "id").agg(one).select("tree", "id", "m.*")


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Level k: each node, its 2**k-th ancestor (null above the root), and what lies between.

    `total` and `depth` sum up the node and the ancestors before that one. The last level
    reaches no further ancestor, but for nodes in a cycle or below one.
    """
    parents = nodes.select(F.col("tree").alias("t"), F.col("id").alias("p"))
    start = nodes.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left")
    level = written(start.select("tree", "id", F.col("p").alias("above"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")))
    levels, rounds = [level], max(1, level.count()).bit_length()
    while len(levels) <= rounds and not level.where(F.col("above").isNotNull()).isEmpty():
        # Only nodes that have not reached the root take part; there are ever fewer of them.
        far = level.select(*[F.col(c).alias(f"far_{c}") for c in level.columns])
        met = F.col("tree").eqNullSafe(F.col("far_tree")) & (F.col("above") == F.col("far_id"))
        moved = level.where(F.col("above").isNotNull()).join(far, met)
        moved = moved.select(
            "tree",
            "id",
            F.col("far_above").alias("above"),
            (F.col("total") + F.col("far_total")).alias("total"),
            (F.col("depth") + F.col("far_depth")).alias("depth"),
        )
        level = written(moved.unionByName(level.where(F.col("above").isNull())))
        levels.append(level)
    return levels


def _chosen_leaves(nodes: DataFrame, reach: DataFrame, branches: int) -> DataFrame:
    """tree, leaf and rank of the best branches of each tree.

    A tree may hold a large share of all messages: its leaves are ranked in parts first.
    """
    parents = nodes.where(F.col("parent").isNotNull()).select(F.col("tree").alias("t"), F.col("parent").alias("p"))
    answered = F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p"))
    leaves = reach.where(F.col("above").isNull()).join(parents, answered, "left_anti")
    order = [F.desc(F.col("total") / F.col("depth")), F.desc("depth"), F.asc("id")]
    part = Window.partitionBy("tree", "salt").orderBy(*order)
    whole = Window.partitionBy("tree").orderBy(*order)
    leaves = leaves.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    leaves = leaves.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= branches)
    leaves = leaves.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= branches)
    return leaves.select("tree", F.col("id").alias("leaf"), "rank", "depth")


def _paths(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree, rank, position from the root (0 on) and message of every chosen path."""
    paths = leaves.select("tree", "rank", "depth", F.lit(0).cast("long").alias("steps"), F.col("leaf").alias("id"))
    for k, level in enumerate(levels[:-1]):
        jump = level.where(F.col("above").isNotNull()).select(F.col("tree").alias("t"), F.col("id").alias("from"), "above")
        up = paths.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("from")))
        up = up.select("tree", "rank", "depth", (F.col("steps") + (1 << k)).alias("steps"), F.col("above").alias("id"))
        paths = written(paths.unionByName(up))
    return paths.select("tree", "rank", (F.col("depth") - 1 - F.col("steps")).alias("position"), "id")


def format_trees(
    messages: DataFrame,
    tree: str = "tree_id",
    message: str = "message_id",
    parent: str = "parent_id",
    role: str = "role",
    text: str = "text",
    score: str = "score",
    branches: int = 1,
    learned: str = "assistant",
) -> DataFrame:
    """One row per chosen branch: tree, rank, n_turns, formatted and loss_spans.

    loss_spans are the code points of `formatted`, from and up to, that hold the (escaped)
    texts of the `learned` role.
    """
    nodes = written(_messages(messages, {"tree": tree, "message": message, "parent": parent, "role": role, "text": text, "score": score}))
    levels = _jumps(nodes)
    paths = _paths(_chosen_leaves(nodes, levels[-1], branches), levels)
    texts = nodes.select(F.col("tree").alias("t"), F.col("id").alias("i"), "role", "text")
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
    head = F.concat(F.lit("### "), shown_role(F.col("role")), F.lit(": "))
    turns = turns.select("tree", "rank", "position", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    before = Window.partitionBy("tree", "rank").orderBy("position")
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END)))
    turns = turns.withColumn("end", F.sum(F.length("turn")).over(before) - len(END))
    span = F.when(F.col("role") == learned, F.struct((F.col("end") - F.length("body")).alias("begin"), F.col("end").alias("end")))
    joined = turns.groupBy("tree", "rank").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("position", "turn"))).alias("turns"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )
    return joined.select(
        F.col("tree").alias(tree), "rank", "n_turns", F.array_join(F.col("turns")["turn"], "").alias("formatted"), "loss_spans"
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    parts = F.split(formatted, END)

    def turn(part):
        stop = F.instr(part, ": ")
        role = read_role(F.substring(part, F.lit(5), stop - 5))
        return F.struct(role.alias("role"), unescape(F.substring(part, stop + 2, F.length(part))).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    own = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))))
    return F.array_join(own, "")


def chains(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it.

    Rows of one turn follow by role and text; all rows count, repeated ones too.
    """
    own = conversations.select(quoted(conversation).alias("tree_id"), quoted(turn).alias("turn"), quoted(role).alias("role"), quoted(text).alias("text"))
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    own = own.withColumn("message_id", F.row_number().over(order).cast("long"))
    return own.select("tree_id", "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
