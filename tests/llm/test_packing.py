import collections
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larder.llm import packing
from larder.llm.packing import SIZE, Tokens, best_cuts, packed

DDL = "doc_id long, text string"
TEXTS = ["", None, "Hello world. This is it!\nNew  line   here \t\n", " lead", "trail ", "\n\n\n", "a\u00a0 b\u00a0c d", "a\u0085 b", "日本語 テキスト です。 ok",
         "don't we'll 123 4567 x_y --- ...", "é" * 50, "naïve café  über", "x" * 3000, "   ", "<|endoftext|> x", "a\u3000 b", "\x1c \x1d a\x0b\x0c b"]


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_are_the_tokenizer_s(exact):
    import pyarrow as pa
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(" \n\tab.é日!1'\u00a0\u2028") for _ in range(rng.randrange(80))) for _ in range(400)]
    ids, at = Tokens().documents(pa.array(texts))
    for d, text in enumerate(texts):
        assert ids[at[d]: at[d + 1]].tolist() == [*exact.encode(text or "", add_special_tokens=False).ids, 0], repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_best(seed):
    rng = random.Random(seed)
    points = sorted(rng.sample(range(1, 60), 14))
    points = [p for p in points]
    while any(b - a > 10 for a, b in itertools.pairwise([0, *points])):
        points = sorted({*points, *(a + 10 for a, b in itertools.pairwise([0, *points]) if b - a > 10)})
    costs = [rng.randrange(9) for _ in points]

    def total(cuts):
        return sum(10 - (b - a) for a, b in itertools.pairwise([0, *cuts])) + sum(costs[points.index(c)] for c in cuts)

    cuts = best_cuts(points, costs, 10)
    best = {0: 0}
    for p, c in zip(points, costs, strict=True):
        best[p] = min(best[q] + 10 - (p - q) + c for q in best if 0 < p - q <= 10)
    assert cuts[-1] == points[-1] and total(cuts) == best[points[-1]]
    assert all(b - a <= 10 for a, b in itertools.pairwise([0, *cuts]))


def test_pieces_cover_every_token_once(frame, exact):
    rng = random.Random(9)
    rows = [(i, " ".join(f"word{rng.randrange(500)}{rng.choice(['', '.', ','])}" for _ in range(rng.choice([3, 40, 900])))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (5, "again"), (200, "y " * 6000)]
    out = packed(frame(rows, DDL)).collect()
    by_sequence, length = collections.defaultdict(list), collections.Counter()
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and r.length > 0
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= SIZE
        length[at] += 1
    want = collections.Counter()
    for d, t in rows:
        want[d, tuple([*exact.encode(t or "", add_special_tokens=False).ids, 0])] += 1
    texts = collections.defaultdict(dict)
    for r in out:
        if r.doc_id not in (None, 5):
            texts[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4")
            assert r.doc_tokens == sum(len(x) for x in [np.frombuffer(r.ids, "<u4")]) or r.doc_tokens > r.length
    for d, parts in texts.items():
        ids, at = [], 0
        for start in sorted(parts):
            assert start == at
            ids += parts[start].tolist()
            at = len(ids)
        assert want[d, tuple(ids)] == 1
    assert sum(r.length for r in out) == sum(len(k[1]) * n for k, n in want.items())


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    used = collections.Counter()
    for r in packed(docs).select("sequence_id", "length").collect():
        used[r.sequence_id] += r.length
    padding = sum(SIZE - n for n in used.values() if n & (n - 1))
    assert padding < 0.015 * sum(used.values())


def test_empty_table(frame):
    assert packed(frame([], DDL)).count() == 0


def test_extra_columns(spark):
    wide = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, ids int, sequence_id string")
    assert packed(wide).count() == 1
    assert packing.SIZE == 1024
