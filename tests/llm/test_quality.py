import collections
import random
import re

from larder.llm import quality

DDL = "doc_id long, text string"


def brute(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = collections.Counter(runs)
    hit = {j for i, r in enumerate(runs) if count[r] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def counts(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.statistics(df).collect()}


def test_statistics_equal_brute_force(frame):
    rng = random.Random(1)
    texts = ["", None, "\n\n", "a b c d e", "a b c d e a b c d e", "x " * 40, "a b c d e f a b c d e f g", "one\none\n\none \none", "#*$%&|<> é😀 <b>", "\x1c a b \x0b c"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d\t", "| ", "é "]) for _ in range(rng.randrange(120))) for _ in range(150)]
    rows = list(enumerate(texts))
    got = counts(frame(rows, DDL))
    for doc, text in rows:
        assert got[doc] == brute(text or ""), repr(text)


def corpus(n):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 60))]
        kind = i % 6
        if kind == 0:
            words = [w + "%%%" for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind > 1)))
    return rows, labels


def test_learned_list_separates_labelled_rows(frame):
    rows, labels = corpus(600)
    out, rules = quality.judged(frame(rows, DDL), frame(labels, "doc_id long, quality int"))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert rules and all(1 <= len(r) <= quality.CONDITIONS for r in rules)
    assert all(kept[d] for d, q in labels if q == 1)
    assert sum(not kept[d] for d, q in labels if q == 0) > 190


def test_edge_rows(frame, spark):
    rows = [(1, "a " * 30), (1, "a " * 30), (None, None), (2, "short")]
    out, rules = quality.judged(frame(rows, DDL), frame([], "doc_id long, quality int"))
    got = out.collect()
    assert rules == [] and len(got) == 4
    assert all(r.base_failed and not r.kept for r in got)
    out, _ = quality.judged(frame([], DDL), frame([(1, None), (None, 0)], "doc_id long, quality int"))
    assert out.count() == 0
    wide = spark.createDataFrame([(1, "a b c d e f g h i j k", 3)], "doc_id long, text string, n_words int")
    out, _ = quality.judged(wide, frame([(1, 0), (1, 1), (3, 0)], "doc_id long, quality int"))
    assert out.first().n_words == 11
