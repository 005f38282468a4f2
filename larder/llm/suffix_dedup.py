"""Exact removal of long repeated byte strings, by sharded suffix arrays.

A byte goes if some LENGTH-byte string that covers it starts at another place
of the corpus too (in another document or in the same one).

1. Every LENGTH-byte window picks an anchor: its GRAM-byte string of lowest
   hash (the leftmost of equals).  Equal windows pick anchors of equal bytes
   at the same distance, so windows need only be compared within an anchor's
   group.  Neighbouring windows that share an anchor form an interval.
2. Intervals of equal bytes are settled by counting: all their windows repeat.
   An interval alone in its anchor group has no repeat.  What is open are
   groups of intervals that agree around the anchor and differ further out.
3. The bytes of open intervals go to shards by anchor.  A shard sorts its
   suffixes by Larsson-Sadakane refinement (ranks of 8, 16, 32 ... bytes,
   only groups that are still equal are sorted again), takes the common
   prefixes of neighbours by Kasai's rule, and marks windows with a neighbour
   of LENGTH common bytes.
4. A group too large for a shard is dealt over several by interval.  Such
   shards hand out sorted keys of their windows; each key range merges the
   shards' lists by binary search, and the shards search the merged keys.

Intervals and keys are compared by 64-bit hashes, suffixes by their bytes.
Null and empty texts have nothing to remove; rows that repeat a text repeat
all its windows, whatever their doc_id; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import extend_batches, fresh, map_batches, release, stored
from .text import prefix_hashes, slices, span_hashes, utf8

LENGTH, GRAM = 400, 64
SHARD_BYTES = 1 << 20
GROUP_BYTES = 1 << 18
RANGE_KEYS = 1 << 20
PIECE_BYTES = 4 << 20


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (block prefix and suffix minima)."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def intervals(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Arrays document, first window, number of windows, anchor hash, interval hash (window starts count from the document)."""
    out = []
    for first, last in slices(offsets):
        part = data[offsets[first]: offsets[last]]
        local = offsets[first: last + 1] - offsets[first]
        if len(part) < length:
            continue
        prefix = prefix_hashes(part)
        at = np.arange(len(part) - gram + 1)
        hashes = span_hashes(prefix, at, at + gram)
        bits = np.uint64(max(28, int(len(at)).bit_length()))
        lowest = sliding_min((hashes >> bits << bits) | at.astype(np.uint64), length - gram + 1)
        anchor = (lowest & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        # windows that lie inside one document
        doc = np.searchsorted(local, np.arange(len(anchor)), "right") - 1
        valid = np.flatnonzero(np.arange(len(anchor)) + length <= local[doc + 1])
        if not len(valid):
            continue
        anchor, doc = anchor[valid], doc[valid]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(valid)))
        begin, where = valid[heads], doc[heads]
        out.append((where + first, begin - local[where], count, hashes[anchor[heads]],
                    span_hashes(prefix, begin, begin + count + length - 1)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` (a power of two, 8 or more) bytes; equal prefixes have equal ranks."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k: n + k]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    heads = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    first = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    h = 8
    while h < depth:
        # only members of groups of two or more are refined
        tied = ~heads
        tied[:-1] |= ~heads[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        members = order[slots]
        behind = members + h
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        group = rank[members]
        again = np.argsort(group.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64), kind="stable")
        members, group, second = members[again], group[again], second[again]
        order[slots] = members
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        heads[slots] = new
        first = np.maximum.accumulate(np.where(new, slots, 0))
        rank[members] = first
        h *= 2
    return rank


def common_prefixes(data: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Kasai: lengths (up to ``most``) of the common prefixes of the suffix pairs (left, right), left ascending.

    The pair one byte further on from a pair of common length l > 0, where it
    is paired alike, has length l - 1; only the others are compared.
    """
    n, size = len(left), len(data)
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    follows = np.concatenate(([False], (left[1:] == left[:-1] + 1) & (right[1:] == right[:-1] + 1)))
    out = np.full(n, -1, dtype=np.int64)
    while (todo := np.flatnonzero(out < 0)).size:
        # chains of pairs still open; the head's length is found far enough to serve its whole chain
        linked = follows[todo] & np.concatenate(([False], todo[1:] == todo[:-1] + 1))
        heads = np.flatnonzero(~linked)
        chain = np.diff(np.append(heads, len(todo)))
        a, b, reach = left[todo[heads]], right[todo[heads]], chain + most
        length = np.zeros(len(heads), dtype=np.int64)
        live = np.arange(len(heads))
        while len(live):
            at, bt = a[live] + length[live], b[live] + length[live]
            room = np.minimum(size - np.maximum(at, bt), reach[live] - length[live])
            same = words[np.minimum(at, size)] == words[np.minimum(bt, size)]
            step = np.minimum(np.where(same.all(axis=1), 8, np.argmin(same, axis=1)), room)
            length[live] += step
            live = live[step == 8]
        run = np.arange(len(todo)) - np.repeat(heads, chain)
        known = np.repeat(length, chain) - run
        sure = (known >= 0)
        out[todo[sure]] = np.minimum(known[sure], most)
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int = LENGTH):
    """Of windows at ``starts`` (ascending): whether another one has the same bytes, and a group number for equal ones."""
    if not len(starts):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    depth = 8
    while depth * 2 <= length:
        depth *= 2
    rank = suffix_ranks(data, depth)
    a, b = rank[starts], rank[starts + length - depth]
    order = np.lexsort((starts, b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    # neighbours in suffix order, confirmed by their common prefixes
    left, right = starts[order][:-1][same], starts[order][1:][same]
    by = np.argsort(left, kind="stable")
    confirmed = np.empty(len(left), dtype=bool)
    confirmed[by] = common_prefixes(data, left[by], right[by], length) >= length
    joined = np.zeros(len(order), dtype=bool)
    joined[1:][same] = confirmed
    hit = joined.copy()
    hit[:-1] |= joined[1:]
    out, group = np.empty(len(order), dtype=bool), np.empty(len(order), dtype=np.int64)
    out[order], group[order] = hit, np.cumsum(~joined)
    return out, group


def runs_of(flags: np.ndarray) -> list[int]:
    """Flat [start, end, ...] of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges.tolist()


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(th, first, windows, fp, kt) of every interval; th names the text by its hash."""
    def run(batch):
        data, offsets = utf8(batch.column(1))
        doc, first, count, fp, kt = intervals(data, offsets, length, gram)
        return {"th": batch.column(0).take(pa.array(doc, pa.int64())), "first": pa.array(first, pa.int32()),
                "windows": pa.array(count, pa.int32()), "fp": pa.array(fp.view(np.int64)), "kt": pa.array(kt.view(np.int64))}

    return map_batches(docs.select(F.xxhash64("text").alias("th"), "text"), run, "th long, first int, windows int, fp long, kt long")


def _shards(pieces: DataFrame, length: int) -> DataFrame:
    """Per shard of (shard, shared, fp, kt, windows, piece): rows (fp, kt, spans) of repeated windows and, for shared
    groups, rows (shard, keys, fp, kt) with each interval's window keys."""
    def run(table: pa.Table) -> pa.Table:
        raw = table.column("piece").to_pylist()
        sizes = np.array([len(x) for x in raw])
        at = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(raw), np.uint8)
        windows = table.column("windows").to_numpy()
        offsets = np.cumsum(windows) - windows
        starts = np.repeat(at - offsets, windows) + np.arange(windows.sum())
        hit, _ = repeated_windows(data, starts, length)
        shared = table.column("shared").to_pylist()
        prefix = prefix_hashes(data) if any(shared) else None
        spans, keys = [], []
        for k in range(len(raw)):
            spans.append(runs_of(hit[offsets[k]: offsets[k] + windows[k]]))
            if shared[k]:
                begin = at[k] + np.arange(windows[k])
                keys.append(span_hashes(prefix, begin, begin + length).tobytes())
            else:
                keys.append(None)
        return pa.table({"shard": table.column("shard"), "fp": table.column("fp"), "kt": table.column("kt"),
                         "spans": pa.array(spans, pa.list_(pa.int32())), "keys": pa.array(keys, pa.binary())})

    return pieces.groupBy("shard").applyInArrow(run, "shard long, fp long, kt long, spans array<int>, keys binary")


def _by_shard(shard: np.ndarray, keys: list[bytes]):
    """Each shard number and the sorted distinct keys of its lists."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(shard[rows[0]]), np.unique(np.frombuffer(b"".join([keys[i] for i in rows]), np.uint64))


def _merged(local: DataFrame, ranges_log: int) -> DataFrame:
    """(fp, kt, spans) of shared groups' windows that also stand in another shard; keys are merged in 2**ranges_log ranges."""
    shared = local.where("keys is not null").select("shard", "fp", "kt", "keys")
    edges = np.arange((1 << ranges_log) + 1)

    def split(batches):
        schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary())])
        for batch in batches:
            for s, own in _by_shard(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                bounds = np.searchsorted(own >> np.uint64(64 - ranges_log), edges)
                full = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array(np.full(len(full), s), pa.int64()),
                     pa.array([own[bounds[k]: bounds[k + 1]].tobytes() for k in full], pa.binary())], schema=schema)

    def merge(table: pa.Table) -> pa.Table:
        own = dict(_by_shard(table.column("shard").to_numpy(), table.column("keys").to_pylist()))
        everything = np.sort(np.concatenate(list(own.values())))
        many = []
        for keys in own.values():
            low, high = np.searchsorted(everything, keys, "left"), np.searchsorted(everything, keys, "right")
            many.append(keys[high - low > 1])  # also in another shard's list
        return pa.table({"shard": pa.array(list(own), pa.int64()), "found": pa.array([k.tobytes() for k in many], pa.binary())})

    def mark(intervals_: pa.Table, found: pa.Table) -> pa.Table:
        out = pa.schema([("fp", pa.int64()), ("kt", pa.int64()), ("spans", pa.list_(pa.int32()))])
        if not intervals_.num_rows or not found.num_rows:
            return out.empty_table()
        other = np.sort(np.frombuffer(b"".join(found.column("found").to_pylist()), np.uint64))
        spans = []
        for keys in intervals_.column("keys").to_pylist():
            own = np.frombuffer(keys, np.uint64)
            at = np.minimum(np.searchsorted(other, own), len(other) - 1)
            spans.append(runs_of(other[at] == own))
        return pa.table({"fp": intervals_.column("fp"), "kt": intervals_.column("kt"), "spans": pa.array(spans, pa.list_(pa.int32()))}, schema=out)

    parts = shared.select("shard", "keys").mapInArrow(split, "part long, shard long, keys binary")
    found = parts.groupBy("part").applyInArrow(merge, "shard long, found binary").where(F.octet_length("found") > 0)
    # a shard's intervals meet its found keys once, both within the size of a shard
    return shared.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(mark, "fp long, kt long, spans array<int>")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(th, spans): for each text (by hash) with repeats, its byte intervals (start, end) to remove, unordered."""
    texts = docs.select("text").where("text is not null")
    anchors = stored(_anchors(texts, length, gram))
    kinds = anchors.groupBy("fp", "kt").agg(F.count("*").alias("n"), F.max("windows").alias("windows"), F.min("th").alias("th"))
    groups = kinds.groupBy("fp").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(F.col("windows") + length).alias("bytes"))
    groups = groups.where("total > 1")
    state = stored(kinds.join(groups, "fp").select("fp", "kt", "th", "windows", (F.col("n") > 1).alias("settled"), (F.col("kinds") > 1).alias("open"), "bytes"))
    whole = anchors.join(state.where("settled").select("fp", "kt"), ["fp", "kt"], "left_semi").select(
        "th", F.col("first").alias("a"), (F.col("first") + F.col("windows") + length - 1).alias("b"))
    # one place of each open kind: the first in its lowest text (the key has the text, so that a common kind is spread)
    place = (anchors.select("fp", "kt", "th", "first").join(state.where("open"), ["fp", "kt", "th"])
             .groupBy("fp", "kt").agg(*(F.min(c).alias(c) for c in ("th", "first", "windows", "bytes"))))
    place = stored(place)
    size, crossing = (x or 0 for x in place.agg(F.sum(F.col("windows") + length), F.sum(F.when(F.col("bytes") > group_bytes, F.col("windows")))).first())
    shards = max(1, math.ceil(size / shard_bytes))
    ranges_log = max(6, (crossing // RANGE_KEYS).bit_length())
    wanted = place.groupBy("th").agg(F.collect_list(F.struct("fp", "kt", "first", "windows", "bytes")).alias("places"))

    def take(batches):
        schema = pa.schema([("fp", pa.int64()), ("kt", pa.int64()), ("windows", pa.int32()), ("bytes", pa.int64()), ("piece", pa.binary())])
        release()
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            places = pc.list_flatten(batch.column(1))
            of = pc.list_parent_indices(batch.column(1)).to_numpy()
            begin = offsets[of] + places.field("first").to_numpy()
            end = begin + places.field("windows").to_numpy() + length - 1
            # pieces overlap, so they are several times the text: handed out a few megabytes at a time
            for low, high in slices(np.concatenate(([0], np.cumsum(end - begin))), PIECE_BYTES):
                pick = places.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*(pick.field(f).cast(schema.field(f).type) for f in schema.names[:-1]),
                     pa.array([data[x:y].tobytes() for x, y in zip(begin[low:high].tolist(), end[low:high].tolist(), strict=True)], pa.binary())],
                    schema=schema)

    pieces = (texts.withColumn("th", F.xxhash64("text")).join(wanted, "th").select("text", "places")
              .mapInArrow(take, "fp long, kt long, windows int, bytes long, piece binary")
              .groupBy("fp", "kt").agg(F.first("windows").alias("windows"), F.first("bytes").alias("bytes"), F.first("piece").alias("piece")))
    ways = F.ceil(F.col("bytes") / group_bytes)
    dealt = pieces.select("fp", "kt", "windows", "piece", (ways > 1).alias("shared"),
                          F.pmod(F.xxhash64("fp", F.pmod("kt", ways)), F.lit(shards)).alias("shard"))
    local = stored(_shards(dealt, length))
    spans = local.select("fp", "kt", "spans").union(_merged(local, ranges_log)).where(F.size("spans") > 0)
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 1, F.lit(2)), lambda i: F.struct(F.get("spans", i).alias("x"), F.get("spans", i + 1).alias("y")))
    part = (anchors.join(spans.select("fp", "kt", F.explode(pairs).alias("s")), ["fp", "kt"])
            .select("th", (F.col("first") + F.col("s.x")).alias("a"), (F.col("first") + F.col("s.y") + length - 1).alias("b")))
    return whole.union(part).groupBy("th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def cleaned(docs: DataFrame, length: int = LENGTH, **sizes) -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with the bytes that remain (binary) and the numbers of bytes and of maximal runs removed; names of these columns."""
    names = tuple(fresh(docs, x) for x in ("kept_bytes", "n_removed", "n_spans"))
    th, spans = fresh(docs, "text_hash"), fresh(docs, "spans_found")
    found = stored(repeats(docs, length, **sizes)).select(F.col("th").alias(th), F.col("spans").alias(spans))
    both = docs.withColumn(f"{th}_", F.xxhash64("text")).join(found, F.col(f"{th}_") == F.col(th), "left").drop(th, f"{th}_")

    def run(batch):
        field = batch.schema.get_field_index
        kept, removed, count = [], [], []
        data, offsets = utf8(batch.column(field("text")))
        for d, spans_ in enumerate(batch.column(field(spans)).to_pylist()):
            raw = data[offsets[d]: offsets[d + 1]]
            out, n, at = [], 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in spans_ or ()):
                if a > at or not n:
                    out.append(raw[at:a])
                    n += 1
                at = max(at, b)
            out.append(raw[at:])
            rest = np.concatenate(out).tobytes()
            kept.append(rest), removed.append(len(raw) - len(rest)), count.append(n)
        return dict(zip(names, (kept, removed, count), strict=True))

    return extend_batches(both, run, "`{}` binary, `{}` long, `{}` long".format(*names)).drop(spans), names
