"""Order-preserving packing of token streams by dynamic programming.

Every partition's documents, in their order, form one token stream.  Windows
of at most SIZE tokens cut it; the allowed cuts are document ends (free),
one cut in every STRIDE tokens of the stream: its last sentence end
(SENTENCE_COST) or, where it has none, its own end (BREAK_COST).  The cuts minimise

    sum of padding tokens + sum of the costs of the cuts

by f(j) = cost(j) + min over i in [j - SIZE, j) of f(i) + padding(j - i).
Padding is SIZE - (j - i), so the minimum runs over f(i) + i in a sliding
window, which a monotone queue yields in linear time.  (A window whose length
happens to be a power of two needs no padding; such lengths are not sought,
since many short windows are worse than a little padding.)

Tokens are those of the 50k byte-level BPE vocabulary, then the end token.
The fast tokenizer serves texts of long-settled scripts; any other text takes
the library that defines the ids (their Unicode tables may differ there).

Null and empty texts are the end token alone; rows that repeat a doc_id are
packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import release
from .text import NOT_BLANK, prefix_hashes, slices, span_hashes, utf8

SIZE, STRIDE = 1024, 16
SENTENCE_COST, BREAK_COST = 2, 8
END = 0
BLOCK_BYTES = 2 << 20
#: Code points from U+0500 on; below are Latin, Greek and Cyrillic, whose character classes have long been settled.
LATER = re.compile("[\u0500-\U0010ffff]")


class Tokens:
    """Token ids of texts, and which ids end a sentence.

    No token spans the start of a run of blanks, so a text is a sequence of
    segments (blanks, then the word after them) that are tokenised on their
    own.  The distinct segments of a block of texts are tokenised once each.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        from tiktoken import registry
        self.vocabulary, self.exact = vocabulary or public_tokenizers.path("byte_bpe_50k.json"), None
        path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
        made = registry.ENCODINGS  # the library's own cache: workers are reused, so a process loads the ranks once
        if path not in made:
            with open(path, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            made[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.fast = made[path]
        words = [self.fast.decode_single_token_bytes(i) for i in range(self.fast.n_vocab)]
        self.ends = np.array([w[-1:] in (b".", b"!", b"?", b"\n") for w in words] + [False])
        self.bytes = np.array([len(w) for w in words] + [0], dtype=np.int64)

    def _whole(self, raw: bytes) -> np.ndarray:
        text = raw.decode()
        if LATER.search(text):
            if self.exact is None:  # few texts need it
                from tokenizers import Tokenizer
                self.exact = Tokenizer.from_file(self.vocabulary)
                self.exact.encode_special_tokens = True
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's documents, and each document's offset among them."""
        hashes, starts = [], []
        for first, last in slices(offsets):
            part = data[offsets[first]: offsets[last]]
            blank = ~NOT_BLANK[part]
            head = blank.copy()
            head[1:] &= ~blank[:-1]
            edges = offsets[first: last] - offsets[first]
            head[edges[edges < len(part)]] = True
            at = np.flatnonzero(head)
            hashes.append(span_hashes(prefix_hashes(part), at, np.append(at[1:], len(part))) if len(at) else np.zeros(0, np.uint64))
            starts.append(at + offsets[first])
        starts, hashes = np.concatenate(starts), np.concatenate(hashes)
        stops = np.append(starts[1:], len(data))
        where = np.searchsorted(starts, offsets)
        # documents that go whole: later scripts, and blanks beyond ASCII's
        odd = data >= 0xD4
        if len(data) > 1:
            odd[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        whole = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
        apart = np.zeros(len(starts), dtype=bool)
        for d in whole:
            apart[where[d]: where[d + 1]] = True
        # segments that do not begin with a blank (a text's first) or do not end in a word (its last) are tokenised one by one
        alone = NOT_BLANK[data[starts]] | ~NOT_BLANK[data[stops - 1]] if len(starts) else apart
        usual = np.flatnonzero(~apart & ~alone)
        _, one, inverse = np.unique(hashes[usual], return_index=True, return_inverse=True)
        one = usual[one]
        raw = data.tobytes()
        text = b"".join([raw[a:b] for a, b in zip(starts[one].tolist(), stops[one].tolist(), strict=True)])
        ids = np.array(self.fast.encode_ordinary(text.decode()), dtype=np.uint32)
        bounds = np.concatenate(([0], np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(stops[one] - starts[one])) + 1)) if len(one) else np.zeros(1, int)
        first, count = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        first[usual], count[usual] = bounds[:-1][inverse], np.diff(bounds)[inverse]
        more, total = [ids], len(ids)

        def own(at: int, found: np.ndarray):
            nonlocal total
            first[at], count[at] = total, len(found)
            more.append(found)
            total += len(found)

        for at in np.flatnonzero(alone & ~apart).tolist():
            own(at, np.array(self.fast.encode_ordinary(raw[starts[at]: stops[at]].decode()), dtype=np.uint32))
        for d in whole.tolist():
            own(int(where[d]), self._whole(raw[offsets[d]: offsets[d + 1]]))
        ids = np.concatenate(more)
        upto = np.concatenate(([0], np.cumsum(count)))
        flat = ids[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])]
        return flat, upto[where]

    def documents(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a text column, each followed by END, and their offsets."""
        data, offsets = utf8(column)
        ids, at = self.block(data, offsets)
        n = len(at) - 1
        out = np.full(len(ids) + n, END, dtype=np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
        return out, at + np.arange(n + 1)


def cut_points(ids: np.ndarray, offsets: np.ndarray, sentence: np.ndarray, stride: int = STRIDE):
    """Allowed cuts of a block's token stream and their costs.

    Document ends; besides them at most one cut per ``stride`` tokens: the
    last sentence end there, or else the end of the stride.
    """
    n = len(ids)
    ends = np.flatnonzero(sentence[ids]) + 1
    ends = ends[ends < n]
    last = np.flatnonzero(np.concatenate((ends[1:] // stride != ends[:-1] // stride, [True]))) if len(ends) else ends
    cell = np.arange(n // stride + 1)
    points, costs = (cell + 1) * stride, np.full(len(cell), BREAK_COST)
    points[ends[last] // stride], costs[ends[last] // stride] = ends[last], SENTENCE_COST
    points, costs = points[points < n], costs[points < n]
    at = np.searchsorted(points, offsets[1:])
    points, costs = np.insert(points, at, offsets[1:]), np.insert(costs, at, 0)
    free = np.isin(points, offsets[1:])
    keep = np.concatenate((points[1:] != points[:-1], [True]))
    return points[keep], np.where(free, 0, costs)[keep]


def best_cuts(points: list[int], costs: list[int], size: int = SIZE) -> list[int]:
    """Cuts of least total padding and cost; points rise from above 0, the last is the end of the stream."""
    at, f, back = [0], [0], [0]
    queue, head = [0], 0  # indices with rising f + point
    for k, (point, cost) in enumerate(zip(points, costs, strict=True), 1):
        while at[queue[head]] < point - size:
            head += 1
        i = queue[head]
        best = f[i] + at[i] + size - point
        at.append(point)
        f.append(best + cost)
        back.append(i)
        key = f[k] + point
        while len(queue) > head and f[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(k)
    out, k = [], len(points)
    while k:
        out.append(at[k])
        k = back[k]
    return out[::-1]


def pieces(ids: np.ndarray, offsets: np.ndarray, sentence: np.ndarray, size: int = SIZE):
    """Arrays document, start in the stream, length, window, offset: the pieces of a block, and its number of windows."""
    points, costs = cut_points(ids, offsets, sentence)
    cuts = np.array(best_cuts(points.tolist(), costs.tolist(), size))
    begin = np.unique(np.concatenate((offsets[:-1], [0], cuts[:-1])))
    end = np.append(begin[1:], len(ids))
    window = np.searchsorted(cuts, begin, "right")
    document = np.searchsorted(offsets, begin, "right") - 1
    return document, begin, end - begin, window, begin - np.concatenate(([0], cuts))[window], len(cuts)


def packed(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of ``docs(doc_id, text)``.

    ``ids`` holds little-endian unsigned 32-bit ids.  Sequence ids rise within
    a partition and carry its number in their upper bits, as
    monotonically_increasing_id does.  The stream is cut in blocks of about
    BLOCK_BYTES of text, so memory is bounded.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        from pyspark import TaskContext
        release()  # workers are reused: drop the tokenizers of earlier tasks
        used = TaskContext.get().partitionId() << 33
        tokens = Tokens(vocabulary, ranks)
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else None
            _, offsets = utf8(batch.column(1))
            for first, last in slices(offsets, BLOCK_BYTES):
                ids, at = tokens.documents(batch.column(1).slice(first, last - first))
                document, begin, length, window, offset, windows = pieces(ids, at, tokens.ends, size)
                raw = memoryview(ids.astype("<u4").tobytes())
                for low in range(0, len(begin), 8192):
                    x = slice(low, low + 8192)
                    doc = document[x] + first
                    yield pa.RecordBatch.from_arrays([
                        pa.array(names[doc], pa.int64()) if names is not None else batch.column(0).take(pa.array(doc)),
                        pa.array(begin[x] - at[document[x]], pa.int64()), pa.array(length[x], pa.int64()),
                        pa.array([raw[4 * a: 4 * (a + n)] for a, n in zip(begin[x].tolist(), length[x].tolist(), strict=True)], pa.binary()),
                        pa.array(np.diff(at)[document[x]], pa.int64()), pa.array(window[x] + used, pa.int64()),
                        pa.array(offset[x], pa.int64())], schema=schema)
                used += windows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
