import itertools
import random

import pytest

from larder.llm import ngram_join
from larder.llm.ngram_join import near_duplicates

BLANK = " \t\n\x0b\x0c\r"
DDL = "doc_id long, text string"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANK:
        low = low.replace(b, " ")
    words = [w for w in low.split(" ") if w]
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return out


def got(frame, rows):
    found = near_duplicates(frame(rows, DDL)).collect()
    return [(r.doc_id, r.n_shingles, r.component_id) for r in found]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_edited_copies(frame, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 8, 20, 60, 150, 400]))]
        for _ in range(rng.randrange(1, 7)):
            rows.append((len(rows), edited(rng, base, rng.randrange(0, 1 + len(base) // 20))))
    assert key(got(frame, rows)) == key(brute(rows))


def test_large_family_and_shared_passage(frame, monkeypatch):
    """Long lists: many near copies of one text, and many short texts around one passage."""
    monkeypatch.setattr(ngram_join, "LIST", 3)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, edited(rng, base, rng.randrange(0, 4))) for i in range(40)]
    passage = " ".join(f"p{i}" for i in range(50))
    rows += [(100 + i, f"{passage} {' '.join(f'q{rng.randrange(10**6)}' for _ in range(rng.choice([6, 12, 30, 60])))}") for i in range(60)]
    assert key(got(frame, rows)) == key(brute(rows))


def test_nulls_ties_repeats_and_clashing_columns(frame, spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B\tC d e  f"), (None, "a b c d e f"), (None, None), (3, ""), (4, None),
            (5, "one two"), (6, "ONE two"), (7, " \n "), (None, "lonely words here"), (8, "ÀB c"), (9, "àb c")]
    assert key(got(frame, rows)) == key(brute(rows))
    wide = spark.createDataFrame([(1, "a b c", 5, "x")], "doc_id long, text string, cls int, root string")
    assert near_duplicates(wide).count() == 1
    assert near_duplicates(frame([], DDL)).count() == 0


def test_short_texts_around_one_hot_passage_at_the_threshold(frame):
    """Each long text has the passage's 16 shingles and 4 of its own: similarity to the passage is exactly 0.8, to the others 2/3.

    The 4 may stand alone in their segments, which are then empty in the passage.
    """
    rng = random.Random(2)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(20)]
    rows = [(i, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(4)])) for i in range(1, 25)] + [(0, " ".join(passage))]
    want = brute(rows)
    assert {c for _, _, c in want} == {0}
    assert key(got(frame, rows)) == key(want)


def test_sets_of_four_and_five_shingles(frame):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "a b c d e f g"), (4, "a b c d"), (5, "a b c d e")]
    assert key(got(frame, rows)) == key(brute(rows))
    assert {r[0]: r[2] for r in got(frame, rows)} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


@pytest.mark.parametrize("seed", [3, 4])
def test_short_sets_with_inserted_deleted_and_changed_words(frame, seed):
    """Every size from 1 to 12 words and shingles, each text with its neighbours by one edit at every place."""
    rng = random.Random(seed)
    texts = []
    for n in range(1, 17):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for at in rng.sample(range(n), min(n, 4)) + [0, n - 1]:
            texts += [words, words[:at] + words[at + 1:], words[:at] + ["new"] + words[at:], words[:at] + ["other"] + words[at + 1:],
                      words + [f"end{at}"], ["front", *words]]
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert key(got(frame, rows)) == key(brute(rows))


def test_rare_shingles_meet_no_pair_without_room_for_a_link(frame, monkeypatch):
    """Groups around one text, each 24 shingles from the next: similarity 0.78, and the common shingles come after the 24."""
    monkeypatch.setattr(ngram_join, "LIST", 3)
    met, inner = [], ngram_join._order
    monkeypatch.setattr(ngram_join, "_order", lambda pairs: met.append(pairs.count()) or inner(pairs))
    common = [f"c{i}" for i in range(184)]
    rows = [(3 * v + k, " ".join(common[:90] + [f"u{v}_{i}" for i in range(20)] + common[90:] + [f"t{v}_{k}"])) for v in range(20) for k in range(3)]
    assert key(got(frame, rows)) == key(brute(rows))
    assert len(met) == 2 and met[1] < 5000  # 24768 where every shared rare shingle counts


def test_sketches_rule_out_pairs_of_long_texts_without_their_texts(frame, monkeypatch):
    """Pairs of long texts that share a segment but little else are not verified; links between them are."""
    seen, inner = [], ngram_join.verify
    monkeypatch.setattr(ngram_join, "verify", lambda texts, pairs, size, bands: seen.extend(pairs.collect()) or inner(texts, pairs, size, bands))
    rng = random.Random(7)
    common = [f"c{i}" for i in range(700)]
    rows = [(k, " ".join(common[:500] + [f"u{k}_{i}" for i in range(900)] + common[500:])) for k in range(8)]
    rows += [(100 + k, edited(rng, text.split(), 12)) for k, text in rows[:3]]
    assert key(got(frame, rows)) == key(brute(rows))
    assert 3 <= len(seen) <= 6  # two of the others differ in some 1800 shingles, of which 512 bits show 256


def test_wide_sketches_never_exceed_the_difference():
    import numpy as np
    rng = np.random.default_rng(3)
    for n in (513, 900, 1024, 1025, 2100):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for cut, more in ((0, 0), (3, 0), (40, 60), (n // 6, 0), (n // 2, n)):
            y = np.unique(np.concatenate([x[cut:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
            one, two = (ngram_join._wide(s, np.array([0, len(s)]))[0] for s in (x, y))
            if one and two:
                assert ngram_join._apart(one, two) <= len(np.setxor1d(x, y))
                assert cut + more == 0 or ngram_join._apart(one, two) >= (cut + more) // 4


def test_a_set_has_its_entries_in_the_buckets_of_two_groups(spark, monkeypatch):
    """Spark and numpy name a list alike, and groups share no bucket: a set meets few buckets however many there are."""
    import numpy as np
    monkeypatch.setattr(ngram_join, "BUCKET_ENTRIES", 1000)
    bands = ngram_join.Bands(80)
    edges = bands.edges(5000)
    buckets = ngram_join.Buckets({0: 10, 3: 40_000, 12: 90_000, 20: 500}, edges)
    rng = np.random.default_rng(1)
    key = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    group = rng.integers(0, 22, 400)
    made = buckets.of(key, group)
    df = spark.createDataFrame([(int(k), int(g)) for k, g in zip(key.view(np.int64), group)], "key long, g int")
    named = [r[0] for r in df.select(buckets.named(df["key"], df["g"])).collect()]
    assert named == [int(b) << 32 | int(k) & 0xFFFFFFFF for b, k in zip(made, key)]
    held = [set(made[group == g]) for g in range(22)]
    assert sum(map(len, held)) == len(set().union(*held)) and len(held[12]) > 1


def test_representatives_tell_rows_of_one_doc_id_apart_and_key_no_others(frame, monkeypatch):
    """Document 2 has a copy of document 1 and a text of its own; only its rows go through Python a second time."""
    seen, inner = [], ngram_join.extend_batches
    monkeypatch.setattr(ngram_join, "extend_batches", lambda docs, *rest: seen.append(docs.count()) or inner(docs, *rest))
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "quite another text here it is"), (3, "a b c d e f"), (None, "a b c d e f"),
            (4, None), (5, "alone"), (1, "a b c d e f")]
    kept = [(r.doc_id, r.text) for r in ngram_join.representatives(frame(rows, DDL)).collect()]
    assert key(kept) == key([rows[i] for i in (0, 2, 4, 5, 6, 7)])
    assert seen == [2]
