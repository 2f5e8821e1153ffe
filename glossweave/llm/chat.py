"""Chat formatting with DataFrame functions only.

Replies form trees. Jump pointers double by self-joins (parent, grandparent, four up, ...), and each round
doubles the part of every root-to-leaf path that is known, so rounds grow with the logarithm of the depth.
Branches are ranked by score, and each chosen path becomes one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, written

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"


def escaped(text: Column) -> Column:
    """Text in which neither a header nor an end of turn can stand: every change is a backslash more."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\:"))


def reply_paths(messages: DataFrame, top_k: int | None = None) -> DataFrame:
    """(tree, leaf, depth, node) of each chosen root-to-leaf path; depth is 0 at the root.

    messages: tree, node, parent (all strings) and score. A message whose parent is null or absent is a root.
    A branch's score is the mean of its messages' scores (null: 0); the top_k best of a tree are chosen (None:
    all), at a tie those with the smaller leaf. Messages on a cycle, and leaves that hang on one, have no path.
    Rows that repeat a node count once, with the smallest parent. Rows with a null tree or node are left out.
    """
    nodes = messages.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    nodes = written(nodes, "chat-nodes")
    present = nodes.select("tree", F.col("node").alias("parent"))
    linked = nodes.select("tree", "node", "parent").join(present, ["tree", "parent"])
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps, step = [written(linked.select("tree", "node", F.col("parent").alias("above")), "chat-jumps")], 1
    while step < most and not jumps[-1].isEmpty():
        over = jumps[-1].select("tree", F.col("node").alias("low"), F.col("above").alias("node"))
        jumps.append(written(over.join(jumps[-1], ["tree", "node"]).select("tree", F.col("low").alias("node"), "above"), "chat-jumps"))
        step *= 2
    endless = jumps[-1].select("tree", "node")  # as many steps up as a tree has messages: on a cycle, or hanging on one
    inner = linked.select("tree", F.col("parent").alias("node")).distinct()
    leaves = nodes.join(inner, ["tree", "node"], "left_anti").join(endless, ["tree", "node"], "left_anti")
    path = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    for k, jump in enumerate(jumps[:-1]):
        longer = path.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        last, path = path, written(path.unionByName(longer), "chat-paths")
        if k:
            forget(last)
        forget(jump)
    roots = nodes.select("tree", "node", "score").join(linked.select("tree", "node", F.lit(1).alias("has_parent")), ["tree", "node"], "left")
    scored = path.join(roots, ["tree", "node"])
    branch = scored.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.max("up").alias("top"), F.max(F.col("has_parent").isNull()).alias("rooted")).where("rooted")
    if top_k is not None:
        branch = branch.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).where(F.col("rank") <= top_k)
    return path.join(branch.select("tree", "leaf", "top"), ["tree", "leaf"]).select("tree", "leaf", (F.col("top") - F.col("up")).alias("depth"), "node")


def format_paths(paths: DataFrame, messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, conversation, loss): turns in order, and for each turn the start and length in characters of its text
    where its role is loss_role, else null.

    A turn is `### role: text</turn>` and a line end, with role and text escaped; a null role or text is empty.
    Of rows that repeat a node the smallest role and text count.
    """
    said = messages.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m")).select("tree", "node", "m.*")
    head, body = F.concat(F.lit(HEAD), _role(F.col("role")), F.lit(COLON)), escaped(F.col("text"))
    own = paths.join(said, ["tree", "node"]).select("tree", "leaf", "depth", head.alias("head"), body.alias("body"), (F.col("role") == loss_role).alias("loss"))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("head") + F.length("body") + len(TAIL)).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("loss"), F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length")))
    turn = F.struct("depth", F.concat("head", "body", F.lit(TAIL)).alias("said"), span.alias("span"))
    turns = own.withColumn("at", at.cast("long")).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t.said), "").alias("conversation"), F.transform("turns", lambda t: t.span).alias("loss"))


def _pieces(conversation: Column) -> Column:
    return F.filter(F.split(conversation, "</turn>\n"), lambda p: p != "")


def parse(conversation: Column) -> Column:
    """The turns of a formatted conversation: an array of role and text."""
    head = r"(?s)^### ((?:[^\\:]++|\\.)*+): "  # possessive: matched by a loop, however long a role is

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, head, 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(p, F.length(role) + len(HEAD) + len(COLON) + 1)).alias("text"))

    return F.transform(_pieces(conversation), turn)


def loss_text(conversation: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. A span ends where its turn's text does."""
    texts = F.zip_with(_pieces(conversation), loss, lambda p, s: F.when(s.isNotNull(), unescaped(F.substr(p, F.length(p) - s.length + 1))))
    return F.array_join(texts, "")


def chat_format(messages: DataFrame, top_k: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, conversation, loss) for the chosen paths of messages (tree, node, parent, score, role, text).

    An empty table gives no rows; other columns are ignored. See reply_paths and format_paths.
    """
    own = messages.select(*(F.col(c).cast("string").alias(c) for c in ("tree", "node", "parent")), F.col("score").cast("double").alias("score"), "role", "text")
    return format_paths(reply_paths(own, top_k), own, loss_role)


def linear_messages(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches: each row answers the one before it.

    Rows of a conversation stand by turn, role and text, nulls first; a null conv_id is a conversation of its own.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    own = turns.select(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("tree"), "turn", "role", "text")
    placed = own.withColumn("n", F.row_number().over(order))
    return placed.select("tree", F.format_string("%012d", "n").alias("node"), F.when(F.col("n") > 1, F.format_string("%012d", F.col("n") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def conversation_id(tree: Column) -> Column:
    """The conv_id that linear_messages has made a tree's name of."""
    return F.when(tree != "", F.substring(tree, 2, 40).cast("bigint"))


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """What a table of chat_format says: tree, leaf, conversation, turns (role, text) and loss_text."""
    rows = spark.read.parquet(path)
    return rows.select("tree", "leaf", "conversation", parse(F.col("conversation")).alias("turns"), loss_text(F.col("conversation"), F.col("loss")).alias("loss_text"))
