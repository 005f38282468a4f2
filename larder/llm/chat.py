"""Chat formatting of reply trees (DataFrame functions only).

A message names the message it replies to.  Root-to-leaf paths come from
iterative self-joins that double the distance each time (who stands 2**k
replies above whom), so a path of length n takes log2(n) rounds.  Each branch
is scored by the sum of its messages' scores; the best branches of a tree are
formatted, one conversation each:

    <s>[INST] role [/INST]text</s> ... repeated, nothing in between

Control strings inside roles and texts are escaped by one backslash after
their first character (``<\\/s>``), on top of any backslashes already there,
which undoes exactly.  The loss mask covers the assistants' texts.

Null texts and roles are empty; a null tree or message id is an id of its own
in its tree; a message whose parent is missing is a root; messages on a reply
cycle and below are in no path; messages that repeat an id of their tree are
both formatted, one after the other; scores default to 0, and branches that
tie are ranked by leaf id.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark import stored

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: What can be mistaken for a control string, with any backslashes after its first character.
PLAIN = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), PLAIN, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def reply_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, message, step, branch, branch_score) of the best branches of each tree.

    ``messages(tree, message, parent, score)``; step counts from the root,
    branch from 1; ``best=None`` keeps every branch.
    """
    nodes = stored(messages.select("tree", "message", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))

    single = nodes.groupBy("tree", "message").agg(F.max("parent").alias("parent"), F.sum("score").alias("score"))
    single = stored(single)
    most = single.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    children = single.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    up = single.where("parent is not null").join(single.select(F.col("tree").alias("t"), F.col("message").alias("m")),
                                                 F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("m")))
    up = up.select("tree", "message", F.col("parent").alias("above"))
    paths = (single.join(children, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("p")), "left_anti")
             .select("tree", F.col("message").alias("leaf"), "message", F.lit(0).cast("long").alias("height")))
    top = up  # who stands directly above whom; `paths` reaches distances below 2**k
    for k in range(max(0, math.ceil(math.log2(most))) if most else 0):
        top = stored(top)
        if top.isEmpty():
            break
        a = top.select(F.col("tree").alias("t"), F.col("message").alias("m"), "above")
        more = (paths.join(a, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")))
                .select("tree", "leaf", F.col("above").alias("message"), (F.col("height") + (1 << k)).alias("height")))
        paths = stored(paths.unionByName(more))
        b = top.select(F.col("tree").alias("t"), F.col("message").alias("m"), F.col("above").alias("next"))
        top = (top.join(b, F.col("tree").eqNullSafe(F.col("t")) & (F.col("above") == F.col("m")))
               .select("tree", "message", F.col("next").alias("above")))
    # whole paths only: the top message is a root (replies to nothing that exists)
    s = single.select(F.col("tree").alias("t"), F.col("message").alias("m"), "score")
    u = up.select(F.col("tree").alias("ut"), F.col("message").alias("um"))
    scored = (paths.join(s, F.col("tree").eqNullSafe(F.col("t")) & F.col("message").eqNullSafe(F.col("m"))).drop("t", "m")
              .join(u, F.col("tree").eqNullSafe(F.col("ut")) & (F.col("message") == F.col("um")), "left"))
    branch = (scored.groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"), F.max("height").alias("length"),
                                                 F.count(F.when(F.col("um").isNull(), 1)).alias("roots"))
              .where("roots > 0").drop("roots"))
    if best == 1:
        first = branch.groupBy("tree").agg(F.min(F.struct((-F.col("branch_score")).alias("s"), "leaf", "length")).alias("b"))
        branch = first.select(F.col("tree").alias("bt"), F.col("b.leaf").alias("bl"), F.lit(1).alias("branch"),
                              (-F.col("b.s")).alias("branch_score"), F.col("b.length").alias("length"))
    else:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
        branch = branch.withColumn("branch", rank)
        branch = branch if best is None else branch.where(F.col("branch") <= best)
        branch = branch.withColumnsRenamed({"tree": "bt", "leaf": "bl"})
    return (paths.join(branch, F.col("tree").eqNullSafe(F.col("bt")) & F.col("leaf").eqNullSafe(F.col("bl")))
            .select("tree", "leaf", "message", (F.col("length") - F.col("height")).alias("step"), "branch", "branch_score"))


def formatted(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, branch, branch_score, formatted, mask) of ``messages(tree, message, parent, role, text, score)``.

    mask holds (start, length) in code points of each assistant text inside ``formatted``.
    """
    paths = reply_paths(messages, best)
    text = messages.select(F.col("tree").alias("t"), F.col("message").alias("m"), "role", "text")
    turns = (paths.join(text, F.col("tree").eqNullSafe(F.col("t")) & F.col("message").eqNullSafe(F.col("m")))
             .withColumn("head", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE)))
             .withColumn("body", escaped(F.col("text")))
             .withColumn("size", F.char_length("head") + F.char_length("body") + len(CLOSE)))
    order = Window.partitionBy("tree", "branch").orderBy("step", "role", "text")
    turns = (turns.withColumn("at", F.row_number().over(order))
             .withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    start = F.col("end") - len(CLOSE) - F.char_length("body")
    each = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
                    (F.col("role") == "assistant").alias("masked"), start.cast("long").alias("start"),
                    F.char_length("body").cast("long").alias("length"))
    rows = turns.groupBy("tree", "branch", "branch_score").agg(F.array_sort(F.collect_list(each)).alias("turns"))
    return rows.select("tree", "branch", "branch_score",
                       F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
                       F.transform(F.filter("turns", lambda t: F.coalesce(t["masked"], F.lit(False))),
                                   lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("mask"))


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(text, CLOSE)  # the last is what follows the last mark: nothing

    def turn(piece):
        head = F.substring_index(piece, MIDDLE, 1)
        return F.struct(unescaped(head.substr(F.lit(len(OPEN) + 1), F.char_length(head))).alias("role"),
                        unescaped(piece.substr(F.char_length(head) + F.lit(len(MIDDLE) + 1), F.char_length(piece))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def masked(text: Column, mask: Column) -> Column:
    """The texts under the mask of a formatted conversation."""
    return F.transform(mask, lambda x: unescaped(text.substr((x["start"] + 1).cast("int"), x["length"].cast("int"))))


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations: each turn replies to the one before it.

    Rows that tie in turn follow each other by role, then text; all are kept.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("place", place)
    return rows.select(F.col("conv_id").alias("tree"), F.col("place").alias("message"),
                       F.when(F.col("place") > 1, F.col("place") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
