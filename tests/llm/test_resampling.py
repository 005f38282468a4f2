"""Resampling and its sort against plain Python over all rows."""

import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import order, resampling

DDL = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, max_n):
    w = words(text)
    return [" ".join(w[k:k + n]) for n in range(1, max_n + 1) for k in range(len(w) - n + 1)]


def expected(docs, target, max_n=1):
    count = lambda texts: np.bincount([zlib.crc32(g.encode()) % 10000 for t in texts for g in grams(t, max_n)], minlength=10000)
    s, t = count([x for _, x in docs]), count(target)
    big_s, big_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log(float(t[k] + 1) * float(big_s + 10000) / (float(s[k] + 1) * float(big_t + 10000)))) for k in range(10000)]
    rows = []
    for doc_id, text in docs:
        got = [gain[zlib.crc32(g.encode()) % 10000] for g in grams(text, max_n)]
        weight = sum(got) // len(got) if got else 0
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(got), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for k, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(docs, target, **kinds):
    out, (_, n, weight, score, rank) = resampling.resampled(docs, target, drop=("text",), **kinds)
    return sorted(map(tuple, out.select("doc_id", n, weight, score, rank).collect()), key=repr)


def corpus(n=600):
    rng = random.Random(4)
    vocabulary = [f"wörd{k}" if k % 9 == 0 else f"Word{k}" for k in range(300)] + ["x" * 90, "été", "日本", "İ"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 21, 60])))) for k in range(n)]
    docs += [(3, docs[3][1]), (3, "other words " * 15), (None, "no id " * 12), (None, None), (-8, None), (n, ""), (n + 1, "a,b;c " * 9 + "tail")]
    docs += [(n + 2, "Long " * 300_000)]
    return docs, [" ".join(rng.choices(vocabulary[:40], k=50)) for _ in range(8)] + [None, ""]


@pytest.mark.parametrize("max_n", [1, 3])
def test_all_rows_as_brute_force(frame, max_n):
    docs, target = corpus()
    assert got(frame(docs, DDL), frame([(x,) for x in target], "text string"), max_n=max_n) == expected(docs, target, max_n)


def test_empty_tables_and_extra_columns(frame):
    docs, target = corpus(60)
    none = frame([], "text string")
    assert got(frame(docs, DDL), none) == expected(docs, [])
    assert got(frame([], DDL), frame([(x,) for x in target], "text string")) == []
    extra = frame(docs, DDL).selectExpr("*", "'k' AS score", "1 AS `rank`", "2 AS row", "3 AS n_words", "4 AS Weight")
    out, names = resampling.resampled(extra, none)
    assert out.columns[:7] == extra.columns and not {x.lower() for x in names} & {x.lower() for x in extra.columns}
    assert sorted(r[0] for r in out.select("text").collect() if r[0]) == sorted(t for _, t in docs if t)


def test_crc_of_spans():
    rng = random.Random(1)
    spans = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 7, 64, 65, 500]))) for _ in range(300)]
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    out = resampling.extended(np.full(300, 0xFFFFFFFF, np.uint32), data, ends - [len(s) for s in spans], ends)
    assert (out ^ np.uint32(0xFFFFFFFF)).tolist() == [zlib.crc32(s) for s in spans]


def test_features_of_a_column():
    texts = ["A b a", None, "", "b c d e", "-"]
    assert [n for n, _ in resampling.features(pa.array(texts), 2)] == [3, 0, 0, 4, 0]
    for text, (_, found) in zip(texts, resampling.features(pa.array(texts), 2), strict=True):
        assert found.tolist() == [zlib.crc32(g.encode()) % 10000 for g in grams(text, 2)]


@pytest.mark.parametrize("kind", ["mixed", "sorted", "equal"])
def test_ranks_of_crowded_ranges(spark, monkeypatch, kind):
    """Few samples and small limits: ranges come out crowded and are cut again; equal keys split by row."""
    for name, value in dict(RUN=700, SAMPLES=3, TARGET=50, LIMIT=120, CHUNK=64).items():
        monkeypatch.setattr(order, name, value)
    rng = random.Random(2)
    key = {"mixed": lambda k: rng.randrange(-40, 40), "sorted": lambda k: k, "equal": lambda k: 0}[kind]
    rows = [(key(k), k) for k in range(3000)]
    out = order.ranked(spark.createDataFrame(rows, "a long, row long").repartition(3), ["a", "row"], 2500).collect()
    assert {r["row"]: r["rank"] for r in out} == {row: k + 1 for k, (_, row) in enumerate(sorted(rows)[:2500])}
