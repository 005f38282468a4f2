"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the benchmark's word windows: 13 consecutive words of an
item, or all its words where it has fewer.  Patterns of one length form a
pattern set with its own tables:

* a shift table over blocks of two words: how far the search may jump when a
  block stands at the end of the current window;
* suffix buckets: the patterns whose last block hashes to a slot, compared
  with the window word by word (hashes first, then the bytes).

A batch of documents is searched in lanes of at most ``LANE`` windows that
advance together, so the jumps are numpy steps.  The benchmark is sent to the
tasks in blocks of at most ``BLOCK_BYTES`` of text; a larger benchmark takes
several passes over the documents, one per block.

Words are runs of ASCII letters and digits and of non-ASCII characters, ASCII
letters lower-cased.  Null and empty texts have no words and no hits; items
without words have no windows; item rows that repeat an id count once; a null
item_id is named "null".  Other columns of the documents pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import extend_batches, fresh, stored
from .text import ALNUM, LOWER, mix, prefix_hashes, slices, span_hashes, utf8, words

WINDOW = 13
LANE = 256
BLOCK_BYTES = 8 << 20


def _split(column):
    """Per slice: lower-cased bytes, word starts and ends, word offsets by document, word hashes."""
    data, offsets = utf8(column)
    for first, last in slices(offsets):
        part = LOWER[data[offsets[first]: offsets[last]]]
        starts, ends, at = words(part, offsets[first: last + 1] - offsets[first], ALNUM)
        yield part, starts, ends, at, span_hashes(prefix_hashes(part), starts, ends)


def _blocks(hashes: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    out = hashes[ends]
    return mix(out + hashes[ends - 1] * np.uint64(0x9E3779B97F4A7C15)) if width == 2 else out


class PatternSet:
    """Wu-Manber tables of the patterns of one length."""

    def __init__(self, length: int, patterns: dict[bytes, tuple[np.ndarray, set[str]]]):
        self.length, self.width = length, min(2, length)
        self.texts = list(patterns)
        self.items = [patterns[t][1] for t in self.texts]
        self.words = np.stack([patterns[t][0] for t in self.texts])
        n = len(self.texts)
        self.mask = np.uint64((1 << max(8, (n * length * 4).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, length - self.width + 1, dtype=np.int32)
        flat, rows = self.words.ravel(), np.arange(n) * length
        for end in range(self.width - 1, length):
            np.minimum.at(self.shift, self._slot(flat, rows + end), length - 1 - end)
        last = self._slot(flat, rows + length - 1)
        self.order = np.argsort(last, kind="stable")
        self.first = np.searchsorted(last[self.order], np.arange(int(self.mask) + 2))

    def _slot(self, hashes, ends):
        return (_blocks(hashes, ends, self.width) & self.mask).astype(np.int64)

    def search(self, hashes: np.ndarray, at: np.ndarray):
        """(window start, pattern) of all windows whose word hashes equal a pattern's."""
        m = self.length
        count = np.maximum(np.diff(at) - m + 1, 0)
        lanes = -(-count // LANE)
        doc = np.repeat(np.arange(len(count)), lanes)
        begin = (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        stop = np.minimum(begin + LANE, count[doc]) + at[doc] + m - 1
        cursor = begin + at[doc] + m - 1
        found = []
        while len(cursor):
            step = self.shift[self._slot(hashes, cursor)]
            if (hit := step == 0).any():
                found.append(cursor[hit])
            cursor = cursor + np.maximum(step, 1)
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
        ends = np.concatenate(found) if found else np.zeros(0, np.int64)
        slot = self._slot(hashes, ends) if len(ends) else ends
        starts, which = [], []
        low, high = self.first[slot], self.first[slot + 1]
        while len(ends):
            pattern = self.order[low]
            same = np.ones(len(ends), dtype=bool)
            for k in range(m):
                same &= hashes[ends - m + 1 + k] == self.words[pattern, k]
            starts.append(ends[same] - m + 1)
            which.append(pattern[same])
            low = low + 1
            more = low < high
            ends, low, high = ends[more], low[more], high[more]
        return (np.concatenate(starts), np.concatenate(which)) if starts else (np.zeros(0, int), np.zeros(0, int))


def pattern_sets(items: list[tuple], window: int = WINDOW) -> list[PatternSet]:
    by: dict[int, dict] = {}
    texts = pa.array([t for _, t in items], pa.large_string())
    at_item = 0
    for part, starts, ends, at, hashes in _split(texts):
        for d in range(len(at) - 1):
            a, b = int(at[d]), int(at[d + 1])
            name = "null" if items[at_item][0] is None else str(items[at_item][0])
            at_item += 1
            length = min(window, b - a)
            if not length:
                continue
            names = [part[starts[i]: ends[i]].tobytes() for i in range(a, b)]
            for i in range(b - a - length + 1):
                text = b" ".join(names[i: i + length])
                by.setdefault(length, {}).setdefault(text, (hashes[a + i: a + i + length], set()))[1].add(name)
    return [PatternSet(length, found) for length, found in sorted(by.items())]


def occurrences(column, sets: list[PatternSet]):
    """Per document: number of words, sorted disjoint word intervals that are hit, names of the items found."""
    for part, starts, ends, at, hashes in _split(column):
        n = len(at) - 1
        hits: list[list] = [[] for _ in range(n)]
        names: list[set[str]] = [set() for _ in range(n)]
        for s in sets:
            first, which = s.search(hashes, at)
            docs = np.searchsorted(at, first, "right") - 1
            for i, p, d in zip(first.tolist(), which.tolist(), docs.tolist(), strict=True):
                text = b" ".join(part[starts[k]: ends[k]].tobytes() for k in range(i, i + s.length))
                if text == s.texts[p]:
                    hits[d].append((i - int(at[d]), i - int(at[d]) + s.length))
                    names[d] |= s.items[p]
        for d in range(n):
            yield int(at[d + 1] - at[d]), hits[d], names[d]


def joined(intervals) -> list[int]:
    """Sorted disjoint [start, end, start, end, ...] of intervals."""
    out: list[int] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """``docs`` with columns for its words, hit intervals and items; returns (frame, names of the three columns)."""
    names = [fresh(docs, x) for x in ("found_words", "found_spans", "found_items")]
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    size = bench.agg(F.sum(F.octet_length("text") + 16).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // (block_bytes // 2)))
    out = docs
    for block in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = [(r.item_id, r.text) for r in part.collect()]  # at most about block_bytes, by the count above
        sent = docs.sparkSession.sparkContext.broadcast(items)
        made = names if not block else [fresh(out, x) for x in names]
        tables: list = []

        def run(batch, sent=sent, tables=tables, later=block > 0, made=made):
            if not tables:
                tables.append(pattern_sets(sent.value, window))
            field = batch.schema.get_field_index
            found = list(occurrences(batch.column(field("text")), tables[0]))
            spans, items = [x[1] for x in found], [x[2] for x in found]
            if later:
                old = batch.column(field(names[1])).to_pylist()
                spans = [s + list(zip(o[::2], o[1::2], strict=True)) for s, o in zip(spans, old, strict=True)]
                items = [s | set(o) for s, o in zip(items, batch.column(field(names[2])).to_pylist(), strict=True)]
            return dict(zip(made, ([x[0] for x in found], [joined(s) for s in spans], [sorted(s) for s in items]), strict=True))

        out = extend_batches(out, run, "`{}` long, `{}` array<long>, `{}` array<string>".format(*made))
        if block:
            out = out.drop(*names).withColumnsRenamed(dict(zip(made, names, strict=True)))
        if blocks > 1:
            out = stored(out)
    return out, names


def hit_words(spans: str):
    """Number of words in a column of flat intervals."""
    return F.expr(f"aggregate(transform(`{spans}`, (x, i) -> IF(i % 2 = 0, -x, x)), 0L, (t, x) -> t + x)")


def is_contaminated(n_words, n_hit, percent: int = 5):
    """The contract's rule: some word is hit, and at least ``percent`` of all words."""
    return (n_hit > 0) & (n_hit * 100 >= n_words * percent)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 5) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    marked, (n, spans, _) = contamination(docs, benchmark)
    return marked.where(~is_contaminated(F.col(f"`{n}`"), hit_words(spans), percent)).select(*(f"`{c}`" for c in docs.columns))
