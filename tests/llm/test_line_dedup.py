import random

import numpy as np

from larder.llm import line_dedup
from larder.llm.text import prefix_hashes, span_hashes

DDL = "doc_id long, text string"


def cut(text):
    """Chunks of a text as (lines, text), by the same line hashes."""
    lines = text.encode().split(b"\n")
    if len(lines) < 2:
        return [(1, text)]
    hashes = np.concatenate([span_hashes(prefix_hashes(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)])) for x in lines])
    out, begin = [], 0
    for end in line_dedup.chunk_ends(hashes):
        out.append((end - begin, b"\n".join(lines[begin:end]).decode()))
        begin = end
    assert begin == len(lines)
    return out


def brute(rows):
    first, out = {}, []
    places = sorted(((d is not None, d or 0), k, c) for d, t in rows if t for k, (n, c) in enumerate(cut(t)) if n > 1)
    for d, k, c in places:
        first.setdefault(c, (d, k))
    for d, t in rows:
        if not t:
            out.append((d, t))
            continue
        kept = [c for k, (n, c) in enumerate(cut(t)) if n < 2 or first[c] == ((d is not None, d or 0), k)]
        out.append((d, "\n".join(kept)))
    return out


def key(rows):
    return sorted(((d is None, d or 0), t is None, t or "") for d, t in rows)


def got(df):
    return [(r.doc_id, r.text) for r in line_dedup.cleaned(df)[0].collect()]


def test_removals_equal_brute_force(frame):
    rng = random.Random(1)
    pool = [f"line {i} é" for i in range(60)]
    block = [f"shared {i}" for i in range(12)]
    rows = []
    for d in range(60):
        lines = [rng.choice(pool) + str(rng.randrange(9)) for _ in range(rng.randrange(8))]
        if d % 3 == 0:
            lines[rng.randrange(len(lines) + 1):0] = block
        rows.append((d, "\n".join(lines)))
    rows += [(100, rows[0][1]), (101, rows[0][1] + "\nmore")]
    want = brute(rows)
    assert key(got(frame(rows, DDL))) == key(want)
    assert sum(len(t) for _, t in want) < sum(len(t) for _, t in rows) - 1000


def test_boundaries_resist_shifts():
    rng = random.Random(2)
    body = np.array([rng.getrandbits(64) for _ in range(200)], dtype=np.uint64)
    shifted = np.concatenate([np.array([1, 2, 3], dtype=np.uint64), body])
    a, b = set(line_dedup.chunk_ends(body)), {x - 3 for x in line_dedup.chunk_ends(shifted)}
    assert len(a & b) > 0.9 * len(a)
    same = line_dedup.chunk_ends(np.full(1000, 5, dtype=np.uint64))
    assert max(np.diff([0, *same])) <= line_dedup.MAX_LINES


def test_edge_rows(frame, spark):
    text = "\n".join(f"row {i}" for i in range(9))
    rows = [(2, text), (2, text), (None, text), (3, None), (4, ""), (5, "one line"), (6, "\n\n\n\n"), (7, "\n\n\n\n"), (8, text)]
    assert key(got(frame(rows, DDL))) == key(brute(rows))
    assert got(frame([], DDL)) == []
    wide = spark.createDataFrame([(1, text, 4, "k"), (2, text, 5, "l")], "doc_id long, text string, n_lines int, lost_chunks string")
    out, lines, removed = line_dedup.cleaned(wide)
    assert lines != "n_lines" and set(wide.columns) < set(out.columns)
    assert out.where("doc_id = 2").first()["n_lines"] == 5


def test_rows_of_one_doc_id_keep_what_is_theirs_alone(frame):
    rows = [(0, "p q\nr s"), (1, "p q\nr s"), (1, "unique one\nunique two"), (2, "p q\nr s"), (2, "p q\nr s"), (None, "null one\nnull two"), (None, None)]
    out = sorted(got(frame(rows, DDL)), key=repr)
    assert (1, "unique one\nunique two") in out and (None, "null one\nnull two") in out and (0, "p q\nr s") in out
    assert sum(t == "p q\nr s" for _, t in out) == 1
