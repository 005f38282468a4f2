"""The byte network: held-out accuracy, folded tables against plain convolution, edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
from conftest import SF_MID

from larder.llm import language
from larder.llm.queries import op13_language

DDL = "doc_id long, text string, lang string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "er"], "cc": ["ção", "ão", "nh", "lh"]}


def made(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(n))


def corpus(n=240):
    rng = random.Random(9)
    return [(k, made(rng, lang := sorted(SYLLABLES)[k % 3], rng.choice([3, 40, 200])), lang) for k in range(n)]


def results(frame, docs, taught=None):
    out, (name, score) = language.predicted(frame(docs, DDL).drop("lang"), language.train(frame(taught or docs, DDL), epochs=4))
    return {(r.doc_id, r.text): (r[name], r[score]) for r in out.collect()}


def test_held_out_accuracy_on_the_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op13_language(spark, SF_MID).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    told = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in told) >= 0.97 * len(told)


def test_languages_and_rows_without_one(frame):
    docs = corpus()
    edge = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", "aa"), (1003, docs[0][1], None), (None, docs[1][1], "bb"),
            (0, "ção " * 300_000, "cc"), (1004, "\x00 \x00", "aa")]
    got = results(frame, docs + edge)
    assert sum(got[k, text][0] == lang for k, text, lang in docs) >= 0.97 * len(docs)
    for k, text, _ in edge[:3] + edge[-1:]:
        assert got[k, text] == ("und", 0.0)
    assert got[1003, docs[0][1]][0] == "aa" and got[None, docs[1][1]][0] == "bb" and got[0, "ção " * 300_000][0] == "cc"


def test_held_out_rows_and_labels_do_not_teach(frame):
    docs = corpus(90)
    held = [(k, text, lang) for k, text, lang in docs if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(r == ("und", 0.0) for r in results(frame, docs, held).values())
    changed = [(k, t, "zz" if zlib.crc32(str(k).encode()) % 4 == 2 else lang) for k, t, lang in docs]
    assert results(frame, docs) == results(frame, docs, changed)


def test_empty_table_and_clashing_columns(frame):
    assert results(frame, []) == {}
    docs = frame(corpus(30), DDL).selectExpr("*", "1 AS lang_pred", "2 AS Lang_Score", "3 AS has_letter", "4 AS windows")
    out, names = language.predicted(docs, language.train(docs, epochs=1))
    assert out.columns == [*docs.columns, *names] and out.count() == 30


def test_sample_is_bounded_and_repeats_count_once(frame):
    docs = corpus(150) + [(0, f"ka lo mi {k}", "aa") for k in range(50)]
    rows = language.sample(frame(docs, DDL), size=10, windows=2).collect()
    assert len(rows) == 30 == len({(r.lang, r.doc_id) for r in rows}) and all(len(r.windows) <= 2 * language.WINDOW for r in rows)


def test_folded_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    network = language.ByteNetwork(3)
    network.filter_bias += rng.normal(size=network.filter_bias.shape).astype(np.float32)
    windows = rng.integers(0, 256, (130, language.WINDOW)).astype(np.uint8)
    windows[5, 40:] = 0
    _, hidden, _ = network._forward(windows)
    plain = np.log(language.softmax(hidden @ network.out + network.out_bias))
    folded = language.log_probabilities(windows, network.folded(), network.filter_bias, network.out, network.out_bias)
    assert np.abs(plain - folded).max() < 1e-4


def test_gradients_by_difference():
    rng = np.random.default_rng(1)
    network = language.ByteNetwork(3)
    network.embedding, network.filters = network.embedding.astype(float), [f.astype(float) for f in network.filters]
    windows, labels = rng.integers(1, 256, (4, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        _, hidden, _ = network._forward(windows)
        return -np.log(language.softmax(hidden @ network.out + network.out_bias)[np.arange(4), labels]).mean()

    for p, g in zip(network.parameters(), network._gradients(windows, labels), strict=True):
        p, g = p.reshape(-1), g.reshape(-1)
        for k in np.argsort(-np.abs(g))[:3]:
            kept, step = p[k], 1e-4 if p.dtype == float else 1e-2
            p[k] = kept + step
            up = loss()
            p[k] = kept - step
            down = loss()
            p[k] = kept
            assert abs((up - down) / (2 * step) - g[k]) < 2e-2 * max(abs(g[k]), 1e-3) + 1e-4


def test_windows_cover_every_byte():
    texts = ["", "a" * 256, "b" * 257, "c" * 1000, None, "é" * 300]
    data, offsets = language.utf8(pa.array(texts))
    windows, held, at = language.cut(data, offsets)
    for k, text in enumerate(texts):
        rows = [windows[j, : held[j]].tobytes() for j in range(at[k], at[k + 1])]
        assert b"".join(rows) == (text or "").encode()
