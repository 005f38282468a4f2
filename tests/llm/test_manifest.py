"""The manifest against trees built in memory, level by level."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from larder.llm import manifest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k:k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, place):
    out = []
    for nodes in tree[:-1]:
        run = nodes[place - place % 3:place - place % 3 + 3]
        out.append((run[:place % 3], run[place % 3 + 1:]))
        place //= 3
    return out


def expected(rows):
    """(doc_id, leaf, subroot, root, proof hash, folded root, verified), sorted."""
    by_source = {}
    for doc_id, text, lang, source, n_chars in rows:
        by_source.setdefault(source, []).append((doc_id, leaf(doc_id, source, lang, n_chars, text), text, lang, n_chars))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        by_source[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = levels([r[1] for r in by_source[source]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        for place, (doc_id, digest, text, lang, n_chars) in enumerate(by_source[source]):
            path = siblings(trees[source], place) + siblings(top, k)
            seen = text
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                seen = text.replace("\n", "")
            node = leaf(doc_id, source, lang, n_chars, seen)
            for left, right in path:
                node = h("".join([*left, node, *right]))
            proof = h("".join("".join([*left, *right]) for left, right in path))
            out.append((doc_id, digest, trees[source][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def got(frame):
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    rows = manifest.manifest(frame, manifest.without_line_ends()).select(*cols).collect()
    return sorted(map(tuple, rows), key=repr)


ROWS = [
    *[(k, f"line {k}\nsecond", "en", "hot", k) for k in range(50)],
    *[(100 + k, f"t{k}", None, f"s{k % 7}", None) for k in range(10)],
    (200, None, "en", None, 3), (201, "", "", "", 0), (None, "no id\n", "en", "hot", 1), (None, None, None, None, None),
    (7, "another row of doc 7\n", "en", "hot", 2), (7, "line 7\nsecond", "en", "hot", 7), (300, "ß é😀\n", "de", "é", 5),
    (301, "long " * 200_000 + "\nend", "en", "Z", 1), (-4, "minus\n", "en", "hot", -1),
]


def test_trees_of_every_shape(frame, monkeypatch):
    assert got(frame(ROWS, DDL)) == expected(ROWS)
    monkeypatch.setattr(manifest, "LEVELS", 1)  # several rounds and blocks of three leaves
    assert got(frame(ROWS, DDL)) == expected(ROWS)


@pytest.mark.parametrize("n", [1, 3, 4, 10])
def test_sizes_at_the_edges_of_blocks(frame, monkeypatch, n):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    rows = [(k, f"a\n{k}", "en", "s", k) for k in range(n)]
    assert got(frame(rows, DDL)) == expected(rows)


def test_proofs_fold_to_the_root_and_others_do_not(frame):
    rows = manifest.manifest(frame(ROWS[:20], DDL), paths=True).collect()
    for r in rows:
        assert r.verified and manifest.folded(r.leaf, r.path) == r.root == r.folded_root
        assert manifest.folded(h("other"), r.path) != r.root
    told = manifest.manifest(frame(ROWS[:20], DDL), F.lit("other text")).collect()
    assert not any(r.verified for r in told)


def test_empty_table_and_extra_columns(frame):
    assert got(frame([], DDL)) == []
    extra = frame(ROWS[:5], DDL).selectExpr("*", "1 AS tree", "2 AS pos", "3 AS digest", "4 AS message", "5 AS size", "6 AS row")
    assert got(extra) == expected(ROWS[:5])
