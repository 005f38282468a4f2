"""Every stage of the pipeline against a brute-force version of it, stage after stage."""

import collections

import public_tokenizers
import test_decontamination
import test_line_dedup
import test_ngram_join
from tokenizers import Tokenizer

import corpus_pipeline
from larder.llm import toxicity
from larder.llm.spark import stored, table

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_equal_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]
    docs = table(spark, SF, "documents")

    def step(name, docs):
        out = stored(stages[name](spark, docs, SF))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        return out

    out = step("toxicity", docs)
    scored, score = toxicity.scored(docs, toxicity.train(docs, table(spark, SF, "labels")))
    assert sorted(pairs(out)) == sorted(pairs(scored.where(scored[score] < 0.5)))
    docs, out = out, step("line_dedup", out)
    assert test_line_dedup.key(pairs(out)) == test_line_dedup.key(test_line_dedup.brute(pairs(docs)))
    assert out.where("n_chars <> char_length(text)").count() == 0
    docs, out = out, step("ngram_join", out)
    first = {d for d, _, component in test_ngram_join.brute(pairs(docs)) if d == component}
    assert {d for d, _ in pairs(out)} == first
    docs, out = out, step("decontamination", out)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {d for d, n, hit, _ in test_decontamination.brute(pairs(docs), items) if not (hit and 20 * hit >= n)}
    assert {d for d, _ in pairs(out)} == clean
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in pairs(out)}
    got, length = collections.Counter(), collections.Counter()
    for r in stages["packing"](spark, out, SF).collect():
        got[r.doc_id] += r.length
        length[r.sequence_id] += r.length
    assert got == want and max(length.values()) <= 1024
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(want)
