import hashlib
import random

from pyspark.sql import functions as F

from larder.llm import decontamination as dec

DDL, ITEMS = "doc_id long, text string", "item_id long, text string"


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not ("a" <= c <= "z" or "0" <= c <= "9"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute(docs, items):
    patterns = {}
    for name, text in items:
        w = split(text)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[i:i + m]), set()).add("null" if name is None else str(name))
    out = []
    for d, text in docs:
        w, hit, names = split(text), set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(w) - m + 1):
                if found := patterns.get(tuple(w[i:i + m])):
                    hit.update(range(i, i + m))
                    names |= found
        out.append((d, len(w), len(hit), sorted(names)))
    return out


def got(docs, items, **options):
    out, (n, spans, names) = dec.contamination(docs, items, **options)
    rows = out.select("doc_id", F.col(n).alias("n"), dec.hit_words(spans).alias("h"), F.col(names).alias("i")).collect()
    return [(r.doc_id, r.n, r.h, r.i) for r in rows]


def key(rows):
    return sorted((d is None, d or 0, n, h, tuple(i)) for d, n, h, i in rows)


def data(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(f"b{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 2, 5, 12, 13, 14, 40])))) for i in range(20)]
    docs = []
    for d in range(120):
        words = [f"B{rng.randrange(40)}" for _ in range(rng.randrange(700 if d % 10 == 0 else 60))]
        if d % 3 == 0:
            words[rng.randrange(len(words) + 1):0] = rng.choice(items)[1].split()
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words)))
    return docs, items


def test_hits_equal_brute_force(frame):
    for seed in (1, 2):
        docs, items = data(seed)
        assert key(got(frame(docs, DDL), frame(items, ITEMS))) == key(brute(docs, items))


def test_large_benchmark_in_blocks(frame):
    docs, items = data(3)
    assert key(got(frame(docs, DDL), frame(items, ITEMS), block_bytes=400)) == key(brute(docs, items))


def test_edge_rows(frame, spark):
    docs = [(1, None), (2, ""), (3, "É x"), (3, "É x"), (None, "éa É"), (4, "É-X!")]
    items = [(None, "É X"), (7, None), (8, ""), (9, "é x"), (9, "é x"), (10, "É x")]
    assert key(got(frame(docs, DDL), frame(items, ITEMS))) == key(brute(docs, items))
    assert got(frame([], DDL), frame(items, ITEMS)) == []
    assert key(got(frame(docs, DDL), frame([], ITEMS))) == key(brute(docs, []))
    wide = spark.createDataFrame([(1, "É x", 5, "k"), (2, "q", 6, "l")], "doc_id long, text string, found_words int, found_items string")
    kept = dec.without_contaminated(wide, frame(items, ITEMS))
    assert kept.columns == wide.columns and [r.doc_id for r in kept.collect()] == [2]


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
