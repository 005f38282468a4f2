import collections
import random

import numpy as np

from larder.llm import suffix_dedup as sd

DDL = "doc_id long, text string"
LENGTH, GRAM = 40, 12


def brute(rows, length=LENGTH):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(b[i:i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, kept, int(gone.sum()), len(sd.runs_of(gone)) // 2))
    return out


def got(df, **sizes):
    out, (kept, removed, spans) = sd.cleaned(df, LENGTH, gram=GRAM, **sizes)
    return [(r.doc_id, bytes(r[kept]), r[removed], r[spans]) for r in out.collect()]


def key(rows):
    return sorted((d is None, d or 0, k, n, s) for d, k, n, s in rows)


def data(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("ab é") for _ in range(k))
    passage = [text(rng.choice([30, 45, 90, 200])) for _ in range(4)]
    rows = []
    for d in range(n):
        parts = [text(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passage), text(rng.randrange(60))]
        rows.append((d, "".join(parts)))
    return rows + [(n, rows[3][1]), (n + 1, "ab" * 90), (n + 2, "x" * 300), (n + 3, rows[5][1] + "tail")]


def test_removals_equal_brute_force(frame):
    for seed in (1, 2):
        rows = data(seed)
        assert key(got(frame(rows, DDL))) == key(brute(rows))


def test_groups_dealt_over_several_shards(frame):
    rows = data(3, 150)
    want = brute(rows)
    assert key(got(frame(rows, DDL), shard_bytes=1500, group_bytes=300)) == key(want)
    assert sum(n for _, _, n, _ in want) > 3000


def test_suffix_ranks_and_common_prefixes():
    rng = np.random.default_rng(5)
    data_ = rng.integers(97, 99, 600).astype(np.uint8)
    data_[300:420] = data_[100:220]
    raw = data_.tobytes()
    rank = sd.suffix_ranks(data_, 16)
    by = sorted(range(600), key=lambda i: raw[i:i + 16].ljust(16, b"\0"))
    first = {}
    for place, i in enumerate(by):
        first.setdefault(raw[i:i + 16], place)
    assert all(rank[i] == first[raw[i:i + 16]] for i in range(585))
    left = np.sort(rng.choice(500, 200, replace=False))
    right = np.concatenate([(left[:100] + 7), rng.choice(500, 100)])
    want = [next((k for k in range(30) if max(a, b) + k >= 600 or raw[a + k] != raw[b + k]), 30) for a, b in zip(left, right, strict=True)]
    assert sd.common_prefixes(data_, left, right, 30).tolist() == want


def test_edge_rows(frame, spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(200))
    rows = [(1, long), (1, long), (None, long + "z"), (None, None), (2, ""), (3, "short"), (4, "é" * 39)]
    assert key(got(frame(rows, DDL))) == key(brute(rows))
    assert got(frame([], DDL)) == []
    wide = spark.createDataFrame([(1, long, 3, b"x"), (2, long, 4, b"y")], "doc_id long, text string, n_spans int, kept_bytes binary")
    out, names = sd.cleaned(wide, LENGTH, gram=GRAM)
    assert set(wide.columns) < set(out.columns) and out.agg({names[1]: "sum"}).first()[0] == 400
