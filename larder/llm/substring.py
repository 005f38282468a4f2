"""Near-duplicate passages by compact windows.

A text is the sequence of its 5-word shingles.  For each of HASHES hash
functions, the passage windows that have their lowest hash at shingle c form
one compact window (l, c, r): the subtree of c in the Cartesian tree over the
hashes.  Only trees of at least SPAN shingles matter, so a text of n shingles
has about 2 n / SPAN of them.  Two passages with the same lowest shingle share
that signature, aligned at it; passages of Jaccard similarity s share a
signature with probability s for each function.

1. Every compact window is an entry (function and shingle as its key, text, l,
   c, r).  Where AGREE of HASHES functions share a signature, one of the first
   HASHES - AGREE + 1 does, so only these are listed.
2. Entries whose key no other entry has are out.  The others go to their
   texts and come back with their context: the shingles of the window, at most
   SPAN - 1 on either side of c, as 16-bit names.
3. The interval join: inside a group (equal key) contexts lie aligned at c.  Two
   stretches of SPAN shingles are partners if they have 41 shingles in common
   (similarity 0.8: 41 / (46 + 46 - 41)); a word more or less between them moves
   one side by a place.  Equal contexts are one; small groups are compared pair
   by pair.  In larger ones each stretch without a partner yet takes its 6
   rarest shingles: a partner lacks at most 5, so it holds one of them, and all
   windows that do are compared.  No pair is left out for a group's size.

The result names, per text, the word spans of passages that near-duplicate a
passage elsewhere (or elsewhere in the same text).  Copies of a whole text
are one text with a multiplicity; all its words are such a passage if it has
enough.  Words are runs of non-blank characters, ASCII letters lower-cased.
Null, empty and short texts have no passages; rows that repeat a doc_id are
judged one by one; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import extend_batches, fresh, parts, release, stored
from .suffix_dedup import sliding_min
from .text import LOWER, NOT_BLANK, mix, prefix_hashes, slices, span_hashes, utf8, windows, words

WORDS, SHINGLE = 50, 5
SPAN = WORDS - SHINGLE + 1
HASHES, AGREE, PERCENT = 4, 2, 80
BUCKET_ENTRIES = 500_000
#: Characters of text whose windows get their contexts together; parts of a bucket once its windows have them.
ROOM_CHARS, DEAL = 4 << 20, 8
#: Pairs of windows compared at once; windows whose stretches are looked up at once; bits of a place in a context.
PAIRS, BLOCK, PLACE_BITS = 1 << 14, 1 << 9, 8
#: A part of a bucket beyond this size gives its freed memory back at once.
LARGE_BYTES = 3 << 20
#: Windows searched at once (or one group), names looked up in one round, partners tried before that.
ROWS, NAMES, FIRST = 1 << 13, 1 << 17, 6


def shingles(column, size: int = SHINGLE):
    """Per document: the hashes of its word shingles in order, and its number of words."""
    data, offsets = utf8(column)
    for first, last in slices(offsets):
        part = LOWER[data[offsets[first]: offsets[last]]]
        starts, ends, at = words(part, offsets[first: last + 1] - offsets[first], NOT_BLANK)
        full = windows(span_hashes(prefix_hashes(part), starts, ends), size)
        for d in range(last - first):
            yield full[at[d]: max(at[d], at[d + 1] - size + 1)], int(at[d + 1] - at[d])


def compact_windows(hashes: np.ndarray, span: int = SPAN):
    """Arrays l, c, r (inclusive) of the Cartesian-tree subtrees of at least ``span`` entries; ties go to the left entry.

    The lowest entries of all runs of ``span`` are the nodes of these
    subtrees, so the tree is built over them alone.
    """
    n = len(hashes)
    if n < span:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(max(28, n.bit_length()))
    key = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
    low = sliding_min(key, span)
    nodes = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # the lowest places of later runs are no earlier
    nodes = nodes[np.concatenate(([True], nodes[1:] != nodes[:-1]))]
    value = key[nodes].tolist()
    left, right, stack = [0] * len(nodes), [n - 1] * len(nodes), []
    place = nodes.tolist()
    for i, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = place[i] - 1
        left[i] = place[stack[-1]] + 1 if stack else 0
        stack.append(i)
    l, r = np.array(left), np.array(right)
    keep = r - l + 1 >= span
    return l[keep], nodes[keep], r[keep]


ENTRY = np.dtype([("key", "<u8"), ("th", "<i8"), ("c", "<i4"), ("lo", "u1"), ("hi", "u1")])
#: The smallest doc_id of a text; not known: all are null.
OWNER = np.dtype([("doc", "<i8"), ("known", "?")])
LAST = np.iinfo(np.int64).max


def entries_of(texts, span: int, functions: int) -> np.ndarray:
    """The compact windows of (text hash, shingles) pairs, each cut to ``span`` - 1 shingles on either side of its lowest one."""
    keys, ths, ends = [np.zeros(0, np.uint64)], [], [(np.zeros(0, np.int64),) * 3]
    for th, grams in texts:
        if len(grams) < span:
            continue
        for f in range(functions):
            values = mix(grams ^ mix(np.array([f + 1], dtype=np.uint64)))
            l, c, r = compact_windows(values, span)
            keys.append(values[c]), ths.append(th), ends.append((l, c, r))
    l, c, r = (np.concatenate(x) for x in zip(*ends, strict=True))
    out = np.empty(len(c), dtype=ENTRY)
    out["key"], out["c"] = np.concatenate(keys), c
    out["th"] = np.repeat(np.array(ths, np.int64), [len(x) for x in keys[1:]])
    out["lo"], out["hi"] = np.minimum(c - l, span - 1), np.minimum(r - c, span - 1)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which beats the hash table of ``np.unique`` here."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))]


def by_bucket(bucket: np.ndarray, buckets: int):
    """(bucket, row numbers) of each bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    full, first = np.unique(bucket[order], return_index=True)
    yield from zip(full.tolist(), np.split(order, first[1:]), strict=True) if len(order) else ()


def repeated(entries: np.ndarray) -> np.ndarray:
    """The distinct entries whose key another entry has too, by key."""
    order = np.argsort(entries["key"])
    key = entries["key"][order]
    equal = key[1:] == key[:-1]
    some = entries[order[np.concatenate((equal, [False])) | np.concatenate(([False], equal))]] if len(key) else entries
    some = some[np.lexsort((some["c"], some["th"], some["key"]))]
    if len(some):  # a text may be listed by several tasks
        some = some[np.concatenate(([True], some[1:] != some[:-1]))]
    _, group, size = np.unique(some["key"], return_inverse=True, return_counts=True)
    return some[size[group] > 1]


def contexts(entries: np.ndarray, grams: np.ndarray, first=0) -> np.ndarray:
    """16-bit names of the shingles in the entries' windows, one after the other; a text's shingles begin at ``first`` in ``grams``."""
    lo, size = entries["lo"].astype(np.int64), entries["lo"].astype(np.int64) + entries["hi"] + 1
    at = np.repeat(entries["c"] + first - lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.maximum(mix(grams[at]) >> np.uint64(48), np.uint64(2)).astype(np.uint16)


def context_matrix(entries: np.ndarray, names: np.ndarray, span: int) -> np.ndarray:
    """One row of 2 ``span`` - 1 names an entry, its lowest shingle in the middle; 0 outside the window."""
    lo, size = entries["lo"].astype(np.int64), entries["lo"].astype(np.int64) + entries["hi"] + 1
    out = np.zeros((len(entries), 2 * span - 1), dtype=np.uint16)
    row = np.repeat(np.arange(len(entries)), size)
    out[row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(span - 1 - lo, size)] = names
    return out


class Windows:
    """Compact windows with their contexts, and which of their stretches of ``span`` shingles have a partner."""

    def __init__(self, entries: np.ndarray, matrix: np.ndarray, span: int, apart: int, percent: int, owner: np.ndarray | None = None):
        self.entries, self.matrix, self.span, self.apart = entries, matrix, span, apart
        self.th, self.c = entries["th"].copy(), entries["c"].astype(np.int64)
        self.group = np.unique(entries["key"], return_inverse=True)[1].astype(np.int64)
        #: equal shingles that make two stretches similar enough: m / (2 span - m) >= percent / 100
        self.need = -(-2 * span * percent // (100 + percent))
        #: a word more or less costs SHINGLE - 1 shingles and itself
        self.reach = max(0, span - self.need - SHINGLE + 1)
        k = np.arange(span)
        self.valid = (k >= span - 1 - entries["lo"][:, None].astype(np.int64)) & (k <= entries["hi"][:, None])
        self.marked = np.zeros_like(self.valid)
        #: of each window's text the smallest doc_id, and the smallest one of its partners so far: links themselves are not kept
        self.owner = np.zeros(len(entries), OWNER) if owner is None else owner
        self.mate, self.sure = np.full(len(entries), LAST), np.zeros(len(entries), bool)

    def allowed(self, i, j):
        return (self.th[i] != self.th[j]) | (np.abs(self.c[i] - self.c[j]) >= self.apart)

    def link(self, i, j) -> None:
        for x, y in ((i, j), (j, i)):
            known = self.owner["known"][y]
            np.minimum.at(self.mate, x[known], self.owner["doc"][y[known]])
            self.sure[x[known]] = True

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """Mark the similar stretches of all pairs of windows."""
        pick = (i != j) & self.allowed(i, j)
        i, j = i[pick], j[pick]
        for low in range(0, len(i), PAIRS):
            self._compare(i[low: low + PAIRS], j[low: low + PAIRS])

    def _compare(self, i, j) -> None:
        span, reach, width = self.span, self.reach, self.matrix.shape[1]
        one, two = self.matrix[i], np.zeros((len(j), width + 2 * reach), np.uint16)
        two[:, reach: reach + width] = self.matrix[j]
        one[one == 0] = 1
        equal = [one == two[:, reach + e: reach + e + width] for e in range(-reach, reach + 1)]
        any_ = equal[0].copy()
        for x in equal[1:]:
            any_ |= x
        run = np.zeros((len(i), width + 1), np.int16)
        np.cumsum(any_, axis=1, out=run[:, 1:])
        near = (run[:, span:] - run[:, :-span] >= self.need) & self.valid[i]
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            return
        i, j, near, equal = i[some], j[some], near[some], [x[some] for x in equal]
        linked, run = np.zeros(len(i), bool), np.zeros((len(i), width + 1), np.int16)
        for e in range(-reach, reach + 1):
            # stretches that lie against each other as a whole
            np.cumsum(equal[e + reach], axis=1, out=run[:, 1:])
            pair, k = np.nonzero((run[:, span:] - run[:, :-span] >= self.need) & near)
            inside = (k + e >= 0) & (k + e < span)
            pair, k = pair[inside], k[inside]
            inside = self.valid[j[pair], k + e]
            pair, k = pair[inside], k[inside]
            self.marked[i[pair], k] = True
            self.marked[j[pair], k + e] = True
            linked[pair] = True
        self.link(i[linked], j[linked])
        pair, k = np.nonzero(near)
        for low in range(0, len(pair), PAIRS):
            p, s = pair[low: low + PAIRS], k[low: low + PAIRS]
            at = np.arange(span)
            for move in range(-reach, reach + 1):
                end = s + move
                ok = np.flatnonzero((end >= 0) & (end < span))
                ok = ok[self.valid[j[p[ok]], end[ok]]]
                ok = ok[~(linked[p[ok]] & self.marked[i[p[ok]], s[ok]] & self.marked[j[p[ok]], end[ok]])]
                if not len(ok):
                    continue
                here, there = np.zeros((len(ok), span), bool), np.zeros((len(ok), span), bool)
                for e in range(-reach, reach + 1):
                    # shingle t of the one stretch is shingle t + e - move of the other
                    d = e - move
                    x = equal[e + reach][p[ok][:, None], s[ok][:, None] + at[max(0, -d): span - max(0, d)]]
                    here[:, max(0, -d): span - max(0, d)] |= x
                    there[:, max(0, d): span - max(0, -d)] |= x
                hit = ok[np.minimum(here.sum(axis=1), there.sum(axis=1)) >= self.need]
                if len(hit):
                    a, b = i[p[hit]], j[p[hit]]
                    self.marked[a, s[hit]] = True
                    self.marked[b, end[hit]] = True
                    self.link(a, b)

    def same(self) -> np.ndarray:
        """Windows of one group and of equal contexts are partners; the windows that others still have to meet."""
        order = np.lexsort((self.c, self.th))
        order = order[np.argsort(self.matrix[order].view(f"V{2 * self.matrix.shape[1]}").ravel(), kind="stable")]
        order = order[np.argsort(self.group[order], kind="stable")]
        names, group = self.matrix[order], self.group[order]
        head = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (names[1:] != names[:-1]).any(axis=1))))
        size = np.diff(np.append(head, len(order)))
        inside = np.repeat(size > 1, size)
        other = np.arange(len(order)) + 1
        other[head + size - 1] = head
        inside[inside] = self.allowed(order[inside], order[other[inside]])
        self.marked[order[inside]] |= self.valid[order[inside]]
        self.link(order[inside], order[other[inside]])
        # the first and the last of a class: one of them is another text, or far enough in the same one, if any is
        return order[np.unique(np.concatenate((head, head + size - 1, np.flatnonzero(~inside))))]

    def beside(self, rows: np.ndarray) -> None:
        """Windows meet those next to them by the shingles after and before the lowest one: settles most of a dense group."""
        middle = self.span - 1
        for part in (self.matrix[rows][:, middle:], self.matrix[rows][:, middle::-1]):
            near = rows[np.argsort(np.ascontiguousarray(part).view(f"V{2 * part.shape[1]}").ravel(), kind="stable")]
            near = near[np.argsort(self.group[near], kind="stable")]
            pick = self.group[near[1:]] == self.group[near[:-1]]
            self.compare(near[1:][pick], near[:-1][pick])

    def open(self, rows: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Stretches without a partner of which enough shingles occur in other windows of the group."""
        shared = np.zeros((len(rows), often.shape[1] + 1), np.int16)
        np.cumsum(often > 1, axis=1, out=shared[:, 1:])
        return self.valid[rows] & ~self.marked[rows] & (shared[:, self.span:] - shared[:, :-self.span] >= self.need)

    def places(self, rows: np.ndarray):
        """Codes (group, name, place) of all names of the windows, sorted, and where each stands; a large group is one, so its codes are short."""
        width, short = self.matrix.shape[1], len(rows) > ROWS
        if not short:
            context = self.matrix[rows]
            at = np.flatnonzero(context).astype(np.int32)
            code = (self.group[rows][at // width] << 16 | context.ravel()[at]) << PLACE_BITS | at % width
            order = np.argsort(code)
            return code[order], at[order]
        both, done = np.empty(sum(np.count_nonzero(self.matrix[rows[x: x + ROWS]]) for x in range(0, len(rows), ROWS)), "<i8"), 0
        for low in range(0, len(rows), ROWS):
            context = self.matrix[rows[low: low + ROWS]].ravel()
            at = np.flatnonzero(context)
            both[done: done + len(at)] = (context[at].astype(np.int64) << PLACE_BITS | at % width) << 32 | (at + low * width)
            done += len(at)
        both.sort()
        halves = both.view("<i4")
        return halves[1::2].copy(), halves[::2].copy()

    def search(self, rows: np.ndarray) -> None:
        """Every stretch without a partner meets all windows that have one of its rarest shingles at its place, or as far from it as a partner may."""
        lost, width, reach = self.span - self.need, self.matrix.shape[1], self.reach
        while True:
            code, at = self.places(rows)
            new = np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1]))
            first = np.flatnonzero(new)
            names = code[first]
            low = np.searchsorted(names, names - reach)
            high = np.searchsorted(names, names + reach, "right")
            # no name of another shingle or group is that near, as places of it leave a margin
            start, total = first[low], np.append(first, len(code))[high] - first[low]
            del code, names, low, high, first
            index = np.full((len(rows), width), -1, np.int32)
            name_of = np.cumsum(new, dtype=np.int32)
            name_of -= 1
            index.ravel()[at] = name_of
            del new, name_of
            at //= width
            holder, times = at, np.append(total, 0).astype(np.int32)
            often = lambda part: times[index[part]]  # noqa: E731, B023
            # whether marked or not: a window stays while it can be a partner
            alive = np.zeros(len(rows), bool)
            for low in range(0, len(rows), ROWS):
                part = np.arange(low, min(low + ROWS, len(rows)))
                can = np.zeros((len(part), width + 1), np.int16)
                np.cumsum(often(part) > 1, axis=1, out=can[:, 1:])
                alive[part] = (self.valid[rows[part]] & (can[:, self.span:] - can[:, :-self.span] >= self.need)).any(axis=1)
            if not len(rows) or alive.mean() > 0.95:
                break
            rows = rows[alive]
            if not len(rows):
                return
        for low in range(0, len(rows), BLOCK):
            part = np.arange(low, min(low + BLOCK, len(rows)))
            # the place of the rarest shingle of each stretch
            rarest = sliding_min((often(part).astype(np.int64) << PLACE_BITS | np.arange(width)).ravel(), self.span).astype(np.int64)
            rarest = np.append(rarest, np.zeros(self.span - 1, np.int64)).reshape(len(part), width)[:, :self.span] & ((1 << PLACE_BITS) - 1)
            # likely partners first, one that has the rarest shingle: what they settle is not asked again
            for likely in (*range(1, FIRST + 1), None):
                at, k = np.nonzero(self.open(rows[part], often(part)))
                if not len(at):
                    break
                if likely:
                    ask = distinct(at * width + rarest[at, k])
                else:
                    seen = often(part)[at[:, None], k[:, None] + np.arange(self.span)]
                    ask = distinct(((at * width + k)[:, None] + np.argpartition(seen, lost, axis=1)[:, :lost + 1]).ravel())
                who, name = part[ask // width], index[part].ravel()[ask]
                if likely:
                    pick = start[name] + (who + likely * (1 + total[name] // (2 * FIRST))) % total[name]
                    pair = distinct(who * len(rows) + holder[pick])
                    self.compare(rows[pair // len(rows)], rows[pair % len(rows)])
                    continue
                begin = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
                end = np.append(begin[1:], len(who))
                done = np.concatenate(([0], np.cumsum(total[name])))
                x = 0
                while x < len(begin):
                    # some windows a round, with all they ask for
                    y = max(x + 1, int(np.searchsorted(done[end], done[begin[x]] + NAMES, "right")))
                    still = self.open(rows[who[begin[x:y]]], often(who[begin[x:y]])).any(axis=1)
                    asked = np.flatnonzero(np.repeat(still, (end - begin)[x:y])) + begin[x]
                    x = y
                    size, from_ = total[name[asked]], start[name[asked]]
                    two = holder[np.repeat(from_ - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                    pair = distinct(np.repeat(who[asked], size) * len(rows) + two)
                    self.compare(rows[pair // len(rows)], rows[pair % len(rows)])

    def found(self) -> pa.Table:
        """Text hash, its partners' smallest doc_id and its word intervals, of each text that has any."""
        texts, text = np.unique(self.th, return_inverse=True)
        mate, sure = np.full(len(texts), LAST), np.zeros(len(texts), bool)
        np.minimum.at(mate, text, self.mate)
        sure[text[self.sure]] = True
        at = [np.zeros(0, np.int64)]
        for low in range(0, len(text), ROWS):
            row, k = np.nonzero(self.marked[low: low + ROWS])
            at.append(distinct(text[low + row].astype(np.int64) << 32 | (self.c[low + row] + k - self.span + 1)))
        at = distinct(np.concatenate(at))
        words_ = self.span + SHINGLE - 1
        owner, at = at >> 32, at & 0xFFFFFFFF
        new = np.flatnonzero((owner[1:] != owner[:-1]) | (np.diff(at) > words_)) + 1
        begin, end = np.concatenate(([0], new))[:len(at)], (np.append(new, len(at)) - 1)[:len(at)]
        have, count = np.unique(owner[begin], return_counts=True)
        spans = np.stack([at[begin], at[end] + words_], axis=1).ravel().astype(np.int32)
        return pa.table({"th": pa.array(texts[have]), "partner": pa.array(mate[have], mask=~sure[have]),
                         "spans": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], 2 * np.cumsum(count))).astype(np.int32)), pa.array(spans))})


def partners(entries: np.ndarray, matrix: np.ndarray, span: int, apart: int, percent: int, owner: np.ndarray | None = None) -> Windows:
    """The windows with all stretches marked that have a partner in a window of equal key.

    A stretch has a partner only if at most ``span`` - ``need`` of its shingles
    are missing there; so of one more than that number of its shingles, the
    rarest are taken, at least one is in the partner.
    """
    windows_ = Windows(entries, matrix, span, apart, percent, owner)
    rows = windows_.same()
    windows_.beside(rows)
    # whole groups, some windows at a time
    ends = np.append(np.flatnonzero(np.diff(windows_.group[rows])) + 1, len(rows))
    x = 0
    while x < len(rows):
        y = int(ends[max(np.searchsorted(ends, x, "right"), np.searchsorted(ends, x + ROWS, "right") - 1)])
        windows_.search(rows[x:y])
        x = y
    return windows_


def passages(docs: DataFrame, words_: int = WORDS, hashes: int = HASHES, agree: int = AGREE, percent: int = PERCENT) -> DataFrame:
    """(th, spans, partner): word intervals of each text (by hash) that near-duplicate a passage elsewhere, unordered.

    ``docs(doc_id, text)``; partner is the smallest doc_id that holds one of the passages met.
    """
    span = words_ - SHINGLE + 1
    # of any hashes - agree + 1 functions one is among the agreeing ones, so no more are needed
    functions = hashes - agree + 1
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    owner = stored(texts.groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"),
                                           F.max("doc_id").alias("last"), F.max(F.length("text")).alias("chars")))
    size = owner.agg(F.sum("chars")).first()[0] or 0
    # about SPAN / 2 shingles of six characters to an entry of each function
    buckets = max(1, math.ceil(size * functions / (3 * span) / BUCKET_ENTRIES))
    rooms = max(1, math.ceil(size / ROOM_CHARS))

    def list_entries(batches):
        release()
        schema = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])
        seen: set[int] = set()
        for whole in batches:
            for batch in parts(whole):
                new = [th not in seen and not seen.add(th) for th in batch.column(0).to_pylist()]
                batch = batch.filter(pa.array(new, pa.bool_()))
                some = entries_of(zip(batch.column(0).to_pylist(), (g for g, _ in shingles(batch.column(1))), strict=True), span, functions)
                full = list(by_bucket((some["key"] % np.uint64(buckets)).astype(np.int64), buckets))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in full], pa.int32()),
                                                  pa.array([some[rows].tobytes() for _, rows in full], pa.binary())], schema=schema)

    def keep_repeated(table: pa.Table) -> pa.Table:
        release()
        some = repeated(np.concatenate([np.frombuffer(x.as_buffer(), dtype=ENTRY) for x in table.column("entries").combine_chunks()]))
        full = list(by_bucket(some["th"] % rooms, rooms))
        return pa.table({"room": pa.array([k for k, _ in full], pa.int32()),
                         "entries": pa.array([some[rows].tobytes() for _, rows in full], pa.binary())})

    def once(batches):
        release()
        # each text once per task; a copy of a smaller doc_id adds a row without text
        schema = pa.schema([("room", pa.int32()), ("th", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64())])
        seen: dict[int, int | None] = {}
        for batch in batches:
            ths, docs_ = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows, texts_ = [], []
            for at, (th, doc) in enumerate(zip(ths, docs_, strict=True)):
                new = th not in seen
                if new or doc is not None and (seen[th] is None or doc < seen[th]):
                    seen[th] = doc
                    rows.append(at), texts_.append(at if new else None)
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([ths[at] % rooms for at in rows], pa.int32()), part.column(0),
                                              batch.column(1).take(pa.array(texts_, pa.int64())).cast(pa.string()), part.column(2)], schema=schema)

    def add_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        out = {"bucket": [], "entries": [], "names": [], "owners": []}
        if left.num_rows and right.num_rows:
            asked = np.concatenate([np.frombuffer(x.as_buffer(), dtype=ENTRY) for x in left.column("entries").combine_chunks()])
            asked = asked[np.argsort(asked["th"], kind="stable")]
            every, text, doc = right.column("th").to_numpy(), right.column("text").combine_chunks(), right.column("doc_id")
            full = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
            ths, at = np.unique(every[full], return_index=True)
            asker, size = np.unique(asked["th"], return_counts=True)
            # a text may come from several tasks
            owner = np.zeros(len(ths), OWNER)
            owner["doc"] = LAST
            known = doc.is_valid().to_numpy()
            copy = np.searchsorted(ths, every[known])
            np.minimum.at(owner["doc"], copy, doc.drop_null().to_numpy())
            owner["known"][copy] = True
            owner = owner[np.searchsorted(ths, asked["th"])]
            at = full[at[np.searchsorted(ths, asker)]]
            grams = [g for g, _ in shingles(text.take(pa.array(at, pa.int64())))]
            if grams:
                first = np.cumsum([0, *map(len, grams)])[:-1]
                head, name = asked, contexts(asked, np.concatenate(grams), np.repeat(first, size))
                long_ = head["lo"].astype(np.int64) + head["hi"] + 1
                for k, rows in by_bucket(group_of(head["key"]), buckets * DEAL):
                    begin = (np.cumsum(long_) - long_)[rows]
                    n = long_[rows]
                    where = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    out["bucket"].append(k), out["entries"].append(head[rows].tobytes()), out["names"].append(name[where].tobytes())
                    out["owners"].append(owner[rows].tobytes())
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "entries": pa.array(out["entries"], pa.binary()),
                         "names": pa.array(out["names"], pa.binary()), "owners": pa.array(out["owners"], pa.binary())})

    def group_of(key: np.ndarray) -> np.ndarray:
        return (key % np.uint64(buckets) + np.uint64(buckets) * (key // np.uint64(buckets) % np.uint64(DEAL))).astype(np.int64)

    def settle(table: pa.Table) -> pa.Table:
        if table.nbytes > LARGE_BYTES:
            release()
        heads = np.concatenate([np.frombuffer(x.as_buffer(), dtype=ENTRY) for x in table.column("entries").combine_chunks()])
        names = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in table.column("names").combine_chunks()])
        owner = np.concatenate([np.frombuffer(x.as_buffer(), dtype=OWNER) for x in table.column("owners").combine_chunks()])
        out = partners(heads, context_matrix(heads, names, span), span, words_, percent, owner).found()
        if table.nbytes > LARGE_BYTES:
            release()
        return out

    met = (texts.select("th", "text").mapInArrow(list_entries, "bucket int, entries binary")
           .groupBy("bucket").applyInArrow(keep_repeated, "room int, entries binary"))
    whole = texts.select("th", "text", "doc_id").mapInArrow(once, "room int, th long, text string, doc_id long")
    framed = met.groupBy("room").cogroup(whole.groupBy("room")).applyInArrow(add_contexts, "bucket int, entries binary, names binary, owners binary")
    found = stored(framed.groupBy("bucket").applyInArrow(settle, "th long, partner long, spans array<int>"))
    return found.groupBy("th").agg(F.collect_set("spans").alias("spans"), F.min("partner").alias("partner")), owner


def marked(docs: DataFrame, words_: int = WORDS, **options) -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with the number of words, the sorted disjoint word spans (flat) of repeated passages and a partner's doc_id."""
    names = tuple(fresh(docs, x) for x in ("n_words", "passage_spans", "partner_id"))
    found, owner = passages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words_, **options)
    th, key = fresh(docs, "text_hash"), fresh(docs, "found_hash")
    extra = (owner.join(found, "th", "full").where("copies > 1 or spans is not null")
             .select(F.col("th").alias(key), F.col("spans").alias("spans_found"), F.col("partner").alias("partner_found"),
                     F.col("copies").alias("copies_found"), F.col("doc_id").alias("first_found"), F.col("last").alias("last_found")))
    extra = stored(extra)
    both = docs.withColumn(th, F.xxhash64("text")).join(extra, F.col(th) == F.col(key), "left").drop(th, key)

    def run(batch):
        field = batch.schema.get_field_index
        n, spans, partner = [], [], []
        ids = batch.column(field("doc_id")).to_pylist()
        found = [batch.column(field(f"{x}_found")).to_pylist() for x in ("spans", "partner", "copies", "first", "last")]
        for i, (_, count) in enumerate(shingles(batch.column(field("text")))):
            lists, mate, copies, first, last = (x[i] for x in found)
            pairs = sorted(p for flat in lists or () for p in zip(flat[::2], flat[1::2], strict=True))
            if (copies or 1) > 1 and count >= words_:
                pairs, mate = [(0, count)], min((v for v in (mate, last if first == ids[i] else first) if v is not None), default=None)
            out: list[int] = []
            for x, y in pairs:
                if out and x <= out[-1]:
                    out[-1] = max(out[-1], y)
                else:
                    out += [x, y]
            n.append(count), spans.append(out), partner.append(mate if out else None)
        return dict(zip(names, (n, spans, partner), strict=True))

    out = extend_batches(both, run, "`{}` long, `{}` array<int>, `{}` long".format(*names))
    return out.drop(*(f"{x}_found" for x in ("spans", "partner", "copies", "first", "last"))), names
