import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from larder.llm import toxicity

DDL, LABELS = "doc_id long, text string", "doc_id long, toxic int"


def corpus(n, seed=1):
    """Toxic: an insult together with a group; either alone is harmless."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(10, 40))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        if insult:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum"]))
        if group:
            words.insert(rng.randrange(len(words)), rng.choice(["martians", "Plutonians"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return docs, labels


def test_pairwise_interaction_on_held_out_rows(frame):
    docs, labels = corpus(3000)
    out, score = toxicity.scored(frame(docs, DDL), toxicity.train(frame(docs, DDL), frame(labels, LABELS)))
    held = {r.doc_id: r.h for r in out.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert held == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _ in docs}
    right = [(r[score] >= 0.5) == bool(dict(labels)[r.doc_id]) for r in out.collect() if held[r.doc_id]]
    assert len(right) > 400 and np.mean(right) > 0.97  # an additive model cannot exceed about 0.75


def test_held_out_labels_teach_nothing(frame):
    docs, labels = corpus(400)
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels]
    a, b = (toxicity.train(frame(docs, DDL), frame(x, LABELS)) for x in (labels, flipped))
    assert np.array_equal(a.slots, b.slots) and np.allclose(a.weight, b.weight) and a.bias == b.bias


def test_edge_rows(frame, spark):
    docs = [(1, None), (1, ""), (None, "x"), (2, "x " * 20000)]
    out, score = toxicity.scored(frame(docs, DDL), toxicity.train(frame(docs, DDL), frame([(9, 1), (None, 1), (1, None)], LABELS)))
    rows = out.collect()
    assert len(rows) == 4 and all(0 <= r[score] < 0.5 for r in rows)
    assert out.select(toxicity.held_out().alias("h")).where("h is null").count() == 0
    docs, labels = corpus(300)
    model = toxicity.train(frame(docs, DDL), frame(labels + labels, LABELS))
    wide = spark.createDataFrame([(1, "idiot martians", 0.5)], "doc_id long, text string, toxic_score double")
    kept = toxicity.scored(wide, model)
    assert kept[1] != "toxic_score" and kept[0].columns[:3] == wide.columns
    assert toxicity.scored(frame([], DDL), model)[0].count() == 0
    assert kept[0].where(F.col("toxic_score") == 0.5).count() == 1


def test_pairs_of_terms_with_balanced_marginals(frame):
    """Toxic: exactly one of insult and group; neither term alone says anything about the label."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(4000):
        insult, group = i % 4 in (1, 3), i % 4 in (2, 3)
        own = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(6, 12))]
        docs.append((i, " ".join(own + ["idiot"] * insult + ["martians"] * group)))
        labels.append((i, int(insult != group)))
    out, score = toxicity.scored(frame(docs, DDL), toxicity.train(frame(docs, DDL), frame(labels, LABELS)))
    rows = out.select("doc_id", score, toxicity.held_out().alias("h")).collect()
    right = [(r[score] >= 0.5) == bool(dict(labels)[r.doc_id]) for r in rows if r.h]
    assert len(right) > 600 and np.mean(right) > 0.9
