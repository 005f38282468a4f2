"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf: the sha256 of its fields.  The leaves of one source, in
order of doc_id, are the leaves of a tree whose nodes hash three children
each; the roots of the sources, in order of source, are the leaves of a last
tree.  A node's label is (level, place); children come before their parent.
In the upward sweep a priority queue ordered by the label of the receiver
delivers child digests to parents; in the reversed sweep it delivers, from
the root down, the suffix of the proof that a node shares with all leaves
below it, so each leaf ends up with its whole proof.

The queue is external: what crosses a block of 3**LEVELS neighbouring leaves
is a row of a stored table, which Spark deals out and sorts by label, and the
queue inside a task holds the messages of one block only.  So no task ever
holds a tree, however many rows one source has, and a tree of n leaves takes
log(n) / (LEVELS * log(3)) rounds.

Rows and cases: null fields are written ``-`` and a null source is a source
of its own, the first one; empty texts are the value ``0:``.  Rows that repeat
a doc_id within a source are leaves of their own in order of their digest
(rows equal in every field are interchangeable); null doc_ids come first.
Very long texts are hashed by Spark and never reach Python.  An empty table
has no leaf, no root and no row.  Columns other than FIELDS are not part of a
leaf and do not pass through, so none can clash.
"""

from __future__ import annotations

import gc
import heapq
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark import arrow_schema, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
LEVELS = 7
#: Results of one leaf; ``path`` has a ``left:right;`` entry a level, the digests beside the node.
RESULT = ("doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean, path string")


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- leaves

def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    """sha256 (binary) of the fields; ``replaced`` gives other values for some of them."""
    return F.unhex(F.sha2(F.concat(*[encoded(replaced.get(name, F.col(name))) for name in FIELDS]), 256))


def without_line_ends(every: int = 2) -> Column:
    """Tampered text: line ends deleted where ``every`` divides the crc32 of the doc_id."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(chosen, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Each row's place in its tree (``pos``, from 0) and the tree's size, for rows ordered within ``tree``.

    The rows are range partitioned and sorted; each partition's count of a
    tree's rows then shifts the places of the following ones.  No task sees
    a whole tree.
    """
    runs = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    runs = stored(runs.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    counts = runs.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return runs.join(shifts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


# ---------------------------------------------------------------- one block

def height(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def swept_up(first: int, digests: list[str], levels: int) -> list[dict[int, list[str]]]:
    """Per level, the digests that reached each parent, by the parent's place; then the block's root alone.

    ``digests`` belong to neighbouring nodes from place ``first``, a multiple of 3**levels.
    """
    queue = [(1, (first + k) // ARITY, k, digest) for k, digest in enumerate(digests)]
    runs: list[dict[int, list[str]]] = [{} for _ in range(levels + 1)]
    if not levels:
        return [{first: digests}]
    heapq.heapify(queue)
    while queue:
        level, place, _, digest = heapq.heappop(queue)
        run = [digest]
        while queue and queue[0][:2] == (level, place):
            run.append(heapq.heappop(queue)[3])
        runs[level - 1][place] = run
        if level < levels:
            heapq.heappush(queue, (level + 1, place // ARITY, place, hashed("".join(run))))
        else:
            runs[levels][place] = [hashed("".join(run))]
    return runs


def swept_down(runs: list[dict[int, list[str]]], suffix: str) -> list[str]:
    """The path of each node of the block, in order; ``suffix`` is that of the block's root."""
    levels = len(runs) - 1
    if not levels:
        return [suffix]
    queue = [(-levels, -place, suffix) for place in runs[levels]]
    paths: dict[int, str] = {}
    while queue:  # parents come before their children
        level, place, suffix = heapq.heappop(queue)
        run = runs[-level - 1][-place]
        for k in range(len(run)):
            child = -place * ARITY + k
            path = f"{''.join(run[:k])}:{''.join(run[k + 1:])};{suffix}"
            if level == -1:
                paths[child] = path
            else:
                heapq.heappush(queue, (level + 1, -child, path))
    return [paths[place] for place in sorted(paths)]


# ---------------------------------------------------------------- rounds

def _blocks(nodes: DataFrame) -> DataFrame:
    """The block of every node: 3**LEVELS neighbours."""
    return nodes.withColumn("block", F.expr(f"pos div {ARITY ** LEVELS}"))


def _by_block(rows: DataFrame, function, ddl: str) -> DataFrame:
    """``function(tree, block, rows of it in order of pos) -> dicts`` over blocks, which a task reads one after the other."""
    schema = arrow_schema(ddl)
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")

    def batches_of(made):
        for first in range(0, len(made), 2_000):
            yield pa.RecordBatch.from_pylist(made[first: first + 2_000], schema=schema)

    def run(batches):
        gc.collect()
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["tree"], row["block"]) != key:
                    if held:
                        yield from batches_of(function(*key, held))
                    key, held = (row["tree"], row["block"]), []
                held.append(row)
        if held:
            yield from batches_of(function(*key, held))

    return dealt.mapInArrow(run, ddl)


def _raised(tree, block, rows):
    levels = min(LEVELS, height(rows[0]["size"]))
    runs = swept_up(rows[0]["pos"], [r["digest"].hex() for r in rows], levels)
    (root,), = runs[-1].values()
    return [{"tree": tree, "size": -(-rows[0]["size"] // ARITY ** levels), "pos": block, "digest": bytes.fromhex(root)}]


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of every round, from the given ones to the roots (one of place 0 a tree)."""
    rounds = [nodes]
    size = nodes.agg(F.max("size")).head()[0] or 0
    while size > 1:
        narrow = _blocks(rounds[-1].select("tree", "size", "pos", "digest"))
        rounds.append(stored(_by_block(narrow, _raised, "tree string, size long, pos long, digest binary")))
        size = -(-size // ARITY ** LEVELS)
    return rounds


def _lowered(result):
    def run(tree, block, rows):
        message, nodes = rows[0]["message"], rows[1:]
        head, _, suffix = message.rpartition(",")
        levels = min(LEVELS, height(nodes[0]["size"]))
        runs = swept_up(nodes[0]["pos"], [r["digest"].hex() for r in nodes], levels)
        return [result(tree, r, f"{head},{path}") for r, path in zip(nodes, swept_down(runs, suffix), strict=True)]
    return run


def descended(rounds: list[DataFrame], roots: DataFrame, result, ddl: str) -> DataFrame:
    """``result(tree, node, message)`` of the nodes of the first round; ``roots`` has a message a tree.

    A message is ``subroot,root,path``: it reaches each block as a row in front of the block's nodes.
    """
    said = roots.select("tree", F.lit(0).cast("long").alias("block"), "message")
    for k in reversed(range(max(len(rounds) - 1, 1))):
        messages = said.select("tree", "block", F.lit(-1).cast("long").alias("pos"), "message")
        rows = _blocks(rounds[k]).unionByName(messages, allowMissingColumns=True)
        if k:
            made = _by_block(rows, _lowered(lambda tree, node, m: {"tree": tree, "block": node["pos"], "message": m}),
                             "tree string, block long, message string")
            said = stored(made)
    return _by_block(rows, _lowered(result), ddl)


# ---------------------------------------------------------------- manifest

def folded(digest: str, path: str) -> str:
    """The root that a leaf's digest and a proof give."""
    for level in path.split(";")[:-1]:
        left, right = level.split(":")
        digest = hashed(f"{left}{digest}{right}")
    return digest


def _leaf_result(paths: bool):
    def result(tree, node, message):
        subroot, root, path = message.split(",")
        leaf = node["digest"].hex()
        got = folded(node["changed"].hex() if node["changed"] is not None else leaf, path)
        return {"doc_id": node["doc_id"], "source": tree[1:] if tree else None, "leaf": leaf, "subroot": subroot, "root": root,
                "proof_sha256": hashed(path.replace(":", "").replace(";", "")), "folded_root": got, "verified": got == root,
                "path": path if paths else None}
    return result


def manifest(docs: DataFrame, tampered: Column | None = None, paths: bool = False) -> DataFrame:
    """One row of RESULT a row of ``docs``; ``paths`` adds the proofs themselves.

    ``tampered`` gives the text a verifier would see: ``folded_root`` is
    recomputed from it and the proofs of the untampered rows, and
    ``verified`` says whether that is the root.
    """
    rows = docs.select(*FIELDS)
    seen = leaf_digest() if tampered is None else leaf_digest(text=tampered)
    # null sorts before every source, bytewise
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), seen.alias("seen"))
    leaves = leaves.select("tree", "doc_id", "digest", F.when(F.col("seen") != F.col("digest"), F.col("seen")).alias("changed"))
    leaves = stored(leaves.withColumn("row", F.monotonically_increasing_id()))
    rounds = climbed(stored(placed(leaves, ["doc_id", "digest", "row"]).drop("row")))
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest")
    upper = climbed(stored(placed(subroots, ["key"])))
    tops = upper[-1].select("tree", F.concat(F.lower(F.hex("digest")), F.lit(",")).alias("message"))
    said = descended(upper, tops, lambda tree, node, m: {"tree": node["key"], "message": f"{node['digest'].hex()},{m}"},
                     "tree string, message string")
    return descended(rounds, stored(said), _leaf_result(paths), RESULT)
