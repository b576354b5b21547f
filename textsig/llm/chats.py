"""Reply trees to conversations.

Messages name the message they reply to. Iterative self-joins double the known stretch of each message's path towards its root:
after k rounds every message knows the message 2 ** k replies above it, and the score of the stretch, so a tree of depth d takes
log2(d) rounds, each a written table of a row for each message. Leaves are ranked in their tree by the score of their paths; the messages of the chosen
paths alone are then gathered, through the same jumps from the longest to the shortest, and each path becomes one conversation in a chat template.

Defined results: a message whose parent is null or not there is a root; rows without tree or message id are left out; of rows
that repeat a message id the one with the greatest score counts (then the least parent, role and text); messages on a circle of replies have no root and are in
no path; a null text counts as empty and a null role as user; a null score is 0; ties of the score go to the least leaf id. Clashing further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

TOP = None
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """Messages of conversations with numbered turns: a turn replies to the one before it that is there, and messages of one turn are alternatives.
    A message's score is the number of unlike words in it."""
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null and turn is not null").distinct()
    place = Window.partitionBy("conv_id").orderBy("turn")
    rank = Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), "text")
    step = c.select("conv_id", "turn").distinct().withColumn("before", F.lag("turn").over(place))
    # alternatives of turn t have ids t * 2 ** 20 + 0, 1, ...; a reply to a turn with alternatives goes on from the first
    c = c.withColumn("k", F.row_number().over(rank) - 1).join(step, ["conv_id", "turn"])
    shift = F.lit(1 << 20).cast("long")
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    return c.select(
        F.col("conv_id").cast("long").alias("tree_id"), (F.col("turn") * shift + F.col("k")).alias("message_id"), (F.col("before") * shift).alias("parent_id"), "role", "text",
        F.size(F.array_distinct(words)).cast("double").alias("score"),
    )


def branching(conversations: DataFrame) -> DataFrame:
    """As `turns`, but a message replies to any earlier one, chosen by its text: with n messages before it in its tree, that of number
    (characters of the text) mod n, from 0."""
    c = turns(conversations).drop("parent_id")
    c = written(c.withColumn("before", F.row_number().over(Window.partitionBy("tree_id").orderBy("message_id")) - 1), "chat-numbered")
    c = c.withColumn("to", F.expr("cast(length(text) % nullif(before, 0) as int)"))
    return c.join(c.select("tree_id", F.col("before").alias("to"), F.col("message_id").alias("parent_id")), ["tree_id", "to"], "left").drop("to", "before")


def _ranked(ends: DataFrame, top: int | None) -> DataFrame:
    """ends with rank in their trees, from 1. A tree may hold any share of all leaves: they are sorted by ranges, counted in each, and a leaf's
    rank is its place in its range and the tree's leaves in the ranges before."""
    order = [F.col("score").desc(), F.col("leaf_id")]
    ends = written(ends.repartitionByRange("tree_id", *order).withColumn("part", F.spark_partition_id()), "chat-ranges")
    before = F.sum("n").over(Window.partitionBy("tree_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = ends.groupBy("tree_id", "part").agg(F.count("*").alias("n")).select("tree_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    out = ends.withColumn("rank", F.row_number().over(Window.partitionBy("tree_id", "part").orderBy(*order)))
    out = (out if top is None else out.where(F.col("rank") <= top)).join(before, ["tree_id", "part"])
    out = out.withColumn("rank", (F.col("rank") + F.col("before")).cast("int")).drop("part", "before")
    return out if top is None else out.where(F.col("rank") <= top)


def leaves(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree_id, message_id, score, n_turns: every leaf with a root above it, the sum of the scores and the number of the messages on its
    path; jumps). jumps[k]: tree_id, message_id, up: the message 2 ** k replies above, where there is one."""
    m = messages.select("tree_id", "message_id", "parent_id", "score")
    known = m.select("tree_id", F.col("message_id").alias("parent_id"), F.lit(True).alias("there"))
    m = m.join(known, ["tree_id", "parent_id"], "left").withColumn("up", F.when(F.col("there"), F.col("parent_id")))
    at = written(m.select("tree_id", "message_id", "up", "score", F.lit(1).cast("long").alias("n_turns")), "chat-0")
    ends = written(at.select("tree_id", "message_id").join(at.where("up is not null").select("tree_id", F.col("up").alias("message_id")), ["tree_id", "message_id"], "left_anti"), "chat-leaves")
    jumps, whole = [], []
    rounds = (at.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1).bit_length()
    for k in range(1, rounds + 2):
        whole.append(at.where("up is null"))
        open_ = at.where("up is not null")
        if k > rounds or open_.isEmpty():  # what is open after `rounds` is on a circle or hangs from one
            break
        jumps.append(open_.select("tree_id", "message_id", "up"))
        # what is above a stretch is another one, of this round or whole already
        every = at if k == 1 else reduce(DataFrame.unionByName, whole[:-1], at)
        above = every.select("tree_id", F.col("message_id").alias("up"), F.col("up").alias("next"), F.col("score").alias("score2"), F.col("n_turns").alias("n2"))
        grown = open_.join(above, ["tree_id", "up"])
        at = written(grown.select("tree_id", "message_id", F.col("next").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("n_turns") + F.col("n2")).alias("n_turns")), f"chat-{k}")
    return reduce(DataFrame.unionByName, whole).drop("up").join(ends, ["tree_id", "message_id"]), jumps


def paths(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """tree_id, leaf_id, message_id, above: a row for each message on the path of each chosen leaf (tree_id, leaf_id), and how many replies above
    the leaf it stands. A distance is a sum of unlike powers of two, so every jump, from the longest on, is taken from all places reached or left out."""
    at = chosen.select("tree_id", "leaf_id", F.col("leaf_id").alias("message_id"), F.lit(0).cast("long").alias("above"))
    for k, jump in reversed(list(enumerate(jumps))):
        up = at.join(jump, ["tree_id", "message_id"]).select("tree_id", "leaf_id", F.col("up").alias("message_id"), (F.col("above") + (1 << k)).alias("above"))
        at = written(at.unionByName(up), "chat-path")
    return at


def _line(role: Column, text: Column) -> Column:
    head, tail = OPEN.split("{role}")
    return F.concat(F.lit(head), role, F.lit(tail), text, F.lit("\n" + CLOSE))


def conversations(messages: DataFrame, top: int | None = TOP) -> DataFrame:
    """tree_id, rank, leaf_id, score, n_turns, text: the `top` best paths of each tree (None: all), formatted."""
    key = F.struct((-F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score"), F.col("parent_id").cast("long").alias("parent_id"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    given = messages.where("tree_id is not null and message_id is not null").groupBy(F.col("tree_id").cast("long").alias("tree_id"), F.col("message_id").cast("long").alias("message_id")).agg(F.min(key).alias("k"))
    one = written(given.select("tree_id", "message_id", "k.*").withColumn("score", -F.col("score")), "chat-messages")
    ends, jumps = leaves(one)
    best = written(_ranked(ends.withColumnRenamed("message_id", "leaf_id"), top), "chat-best")
    said = paths(best, jumps).join(one.select("tree_id", "message_id", "role", "text"), ["tree_id", "message_id"])
    lines = said.groupBy("tree_id", "leaf_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("i"), _line(F.col("role"), F.col("text")).alias("line")))).alias("lines"))
    return lines.join(best, ["tree_id", "leaf_id"]).select("tree_id", "rank", "leaf_id", "score", F.col("n_turns").cast("int").alias("n_turns"), F.concat_ws("", F.col("lines.line")).alias("text"))
