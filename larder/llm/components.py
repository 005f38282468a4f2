"""Connected components by repeated contraction (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import stored

#: Rows of a table of a round that one task writes: late rounds are small, and a file for each partition would cost more than its rows.
TASK_ROWS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``.

    Each round, every node takes the neighbour (or itself) of lowest random
    rank and the graph is contracted along those choices; the ranks change
    from round to round, so the expected number of rounds is logarithmic
    whatever the shape of the graph.  Only the contracted edges and one
    label per node are kept, both as stored tables.  No edges: no rows.
    """
    few = lambda df, rows: stored(df.coalesce(max(1, math.ceil(rows / TASK_ROWS))))
    edges = stored(edges.select("a", "b").where("a <> b").distinct())
    labels, turn, nodes = None, 0, 0
    while count := edges.count():
        turn += 1
        nodes = nodes or 2 * count
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("v"))
        low = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("low"))
        step = low.select(F.col("a").alias("node"), F.least(F.col("low"), rank(F.col("a"))).getField("v").alias("root"))
        step = few(step, 2 * count)
        labels = step if labels is None else few(
            labels.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            .select("node", F.coalesce("next", "root").alias("root")), nodes)
        to = lambda side: step.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        edges = few(edges.join(to("a"), "a").join(to("b"), "b")
                    .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
                    .where("a <> b").distinct(), count)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
