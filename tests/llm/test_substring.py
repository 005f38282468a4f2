import random

import numpy as np
import pyarrow as pa

from larder.llm import substring

DDL = "doc_id long, text string"


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def got(df):
    out, (n, spans, partner) = substring.marked(df)
    return {r.doc_id: (r[n], r[spans], r[partner]) for r in out.collect()}


def covered(spans):
    return {i for a, b in zip(spans[::2], spans[1::2], strict=True) for i in range(a, b)}


def cartesian(hashes, span):
    """All subtrees of the Cartesian tree with at least ``span`` entries, by recursion."""
    out, todo = [], [(0, len(hashes) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a + 1 >= span:
            c = a + int(np.argmin(hashes[a: b + 1]))
            out.append((a, c, b))
            todo += [(a, c - 1), (c + 1, b)]
    return sorted(out)


def test_compact_windows_are_the_large_subtrees():
    rng = np.random.default_rng(1)
    for n in (0, 5, 46, 47, 300):
        hashes = rng.integers(0, 2**63, n).astype(np.uint64)
        l, c, r = substring.compact_windows(hashes, 10)
        assert sorted(zip(l.tolist(), c.tolist(), r.tolist(), strict=True)) == cartesian(hashes, 10)


def test_repeated_passages_are_found_and_clean_texts_left_alone(frame):
    rng = random.Random(3)
    rows, where = [], {}
    shared = [words(rng, n) for n in (55, 60, 120)]
    for d in range(90):
        own = words(rng, rng.randrange(20, 200))
        if d % 3 == 0:
            p = shared[d % 9 // 3]
            at = rng.randrange(len(own) + 1)
            own[at:at] = p
            where[d] = set(range(at, at + len(p)))
        rows.append((d, " ".join(own)))
    result = got(frame(rows, DDL))
    for d, text in rows:
        n, spans, partner = result[d]
        assert n == len(text.split())
        if d in where:
            assert len(covered(spans) & where[d]) >= 0.9 * len(where[d]) and partner is not None and partner != d
            assert len(covered(spans) - where[d]) <= 25
        else:
            assert spans == [] and partner is None


def test_near_duplicate_passages_recall(frame):
    rng = random.Random(4)
    rows, pairs = [], 0
    for d in range(0, 120, 2):
        p = words(rng, 120)
        q = list(p)
        for k in rng.sample(range(120), 2):
            q[k] = f"x{k}"
        rows += [(d, " ".join(words(rng, 60) + p + words(rng, 30))), (d + 1, " ".join(words(rng, 15) + q + words(rng, 70)))]
        pairs += 1
    result = got(frame(rows, DDL))
    found = sum(bool(result[d][1]) and result[d][2] == d + 1 for d in range(0, 120, 2))
    assert found >= 0.9 * pairs


def test_edge_rows(frame, spark):
    rng = random.Random(5)
    text, other = " ".join(words(rng, 80)), " ".join(words(rng, 300))
    rows = [(1, text), (2, text.upper()), (3, text), (4, None), (5, ""), (6, "a b"), (7, other), (8, " ".join(["z"] * 200)), (9, text[:200])]
    result = got(frame(rows, DDL))
    assert covered(result[1][1]) == covered(result[3][1]) == set(range(80)) and result[1][2] == 2 and result[3][2] == 1
    assert covered(result[2][1]) == set(range(80)) and result[8][1] and result[8][2] == 8
    assert all(result[d][1] == [] for d in (4, 5, 6, 7, 9))
    again = frame([(1, text), (1, text), (None, text)], DDL)
    out, (n, spans, partner) = substring.marked(again)
    assert [r[spans] for r in out.collect()] == [[0, 80]] * 3
    assert substring.marked(frame([], DDL))[0].count() == 0
    wide = spark.createDataFrame([(1, text, 2, "k")], "doc_id long, text string, n_words int, spans string")
    assert set(wide.columns) < set(substring.marked(wide)[0].columns)


def test_pairs_behind_a_common_run_are_found(frame):
    """Sixty texts share a run of 30 words; only two each share what follows it."""
    rng = random.Random(6)
    run, rows = words(rng, 30), []
    for d in range(0, 60, 2):
        tail = words(rng, 30)
        rows += [(x, " ".join(words(rng, 40) + run + tail + words(rng, 40))) for x in (d, d + 1)]
    result = got(frame(rows, DDL))
    for d in range(60):
        assert covered(result[d][1]) >= set(range(42, 98)) and result[d][2] == d ^ 1, d


def test_search_loses_no_partner_of_all_pairs():
    """A large group of related texts: what ``partners`` marks is what comparing all pairs marks."""
    rng = random.Random(7)
    anchor, runs, texts = words(rng, 30), [words(rng, 25) for _ in range(12)], []
    for _ in range(150):
        text = [w for k in range(2) for w in rng.choice(runs)] + anchor + [w for k in range(2) for w in rng.choice(runs)]
        for k in rng.sample(range(len(text)), rng.randrange(4)):
            text[k: k + 1] = rng.choice(([], [f"x{rng.random()}"], [text[k], f"y{rng.random()}"]))
        texts.append(" ".join(text))
    grams = [g for g, _ in substring.shingles(pa.array(texts))]
    entries = substring.repeated(substring.entries_of(enumerate(grams), 46, 3))
    names = np.concatenate([substring.contexts(entries[i: i + 1], grams[entries["th"][i]]) for i in range(len(entries))])
    matrix = substring.context_matrix(entries, names, 46)
    whole = substring.Windows(entries, matrix, 46, 50, 80)
    i, j = np.triu_indices(len(entries), 1)
    same = entries["key"][i] == entries["key"][j]
    whole.compare(i[same], j[same])
    found = substring.partners(entries, matrix, 46, 50, 80)
    assert (found.marked == whole.marked).all() and 0 < whole.marked.sum() < whole.valid.sum()
    assert np.bincount(whole.group).max() > 100


def jaccard(one, two):
    sets = [{tuple(x[k: k + 5]) for k in range(len(x) - 4)} for x in (one, two)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_passages_with_a_word_more_are_found(frame):
    """50-word passages of similarity 0.8 with a word put in: place by place they differ after it."""
    rng = random.Random(8)
    rows = []
    for d in range(0, 200, 2):
        p = words(rng, 50)
        q = p[:25] + ["new"] + p[25:]
        assert jaccard(p, q[:50]) >= 0.8
        rows += [(d, " ".join(words(rng, 60) + p + words(rng, 30))), (d + 1, " ".join(words(rng, 15) + q + words(rng, 70)))]
    result = got(frame(rows, DDL))
    assert sum(result[d][2] == d + 1 and result[d + 1][2] == d for d in range(0, 200, 2)) >= 90


def test_found_names_each_text_once_with_its_lowest_partner():
    """Many windows of equal contexts: one row a text, whatever the number of links."""
    rng = random.Random(9)
    grams = next(g for g, _ in substring.shingles(pa.array([" ".join(words(rng, 90))])))
    entries = substring.repeated(substring.entries_of([(th, grams) for th in range(300)], 46, 3))
    names = substring.contexts(entries, np.concatenate([grams] * 300), np.arange(300)[entries["th"]] * len(grams))
    owner = np.zeros(len(entries), substring.OWNER)
    owner["doc"], owner["known"] = 1000 - entries["th"], entries["th"] != 299
    found = substring.partners(entries, substring.context_matrix(entries, names, 46), 46, 50, 80, owner).found()
    assert found.num_rows == 300 and found.column("th").to_pylist() == list(range(300))
    assert all(s == [0, 90] for s in found.column("spans").to_pylist())
    assert all(p is None or 702 <= p <= 1000 for p in found.column("partner").to_pylist())


def test_large_group_is_searched_in_little_memory(monkeypatch):
    """One group of windows: same marks whether its places are coded short or not, and few bytes a window."""
    import tracemalloc
    rng = random.Random(10)
    anchor, texts = words(rng, 30), []
    runs = [words(rng, 25) for _ in range(12)]
    for _ in range(150):
        text = [w for k in range(2) for w in rng.choice(runs)] + anchor + [w for k in range(2) for w in rng.choice(runs)]
        texts.append(" ".join(text[:rng.randrange(60, 130)]))
    grams = [g for g, _ in substring.shingles(pa.array(texts))]
    entries = substring.repeated(substring.entries_of(enumerate(grams), 46, 3))
    names = np.concatenate([substring.contexts(entries[i: i + 1], grams[entries["th"][i]]) for i in range(len(entries))])
    matrix = substring.context_matrix(entries, names, 46)
    want = substring.partners(entries, matrix, 46, 50, 80).marked
    monkeypatch.setattr(substring, "ROWS", 32)
    assert (substring.partners(entries, matrix, 46, 50, 80).marked == want).all()
    monkeypatch.undo()

    some = np.zeros(20_000, substring.ENTRY)
    some["th"], some["c"], some["lo"], some["hi"] = np.arange(20_000), 45, 45, 45
    filled = np.random.default_rng(1).integers(2, 9, (20_000, 91)).astype(np.uint16)
    windows = substring.Windows(some, filled, 46, 50, 80)
    windows.marked |= windows.valid
    tracemalloc.start()
    windows.search(np.arange(20_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2500 * 20_000
