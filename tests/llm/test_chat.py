from pyspark.sql import functions as F

from larder.llm import chat, queries

DDL = "tree long, message long, parent long, role string, text string, score double"
MARKS = "<s>[INST] </s> [/INST] \\</s> <\\/s> <\\\\s> [\\INST] <</s>> [[INST]] <s"


def talk(frame, rows, best=1):
    out = chat.formatted(frame(rows, DDL), best).withColumn("turns", chat.parsed(F.col("formatted")))
    return {(r.tree, r.branch): r for r in out.collect()}


def test_best_branch_and_all_branches(frame):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0),
            (1, 4, 3, "user", "more", None), (1, 5, 4, "assistant", "end", 0.5), (2, 1, 9, "user", "orphan", 0.0)]
    got = talk(frame, rows)
    assert [t.text for t in got[1, 1].turns] == ["q", "good", "more", "end"] and got[1, 1].branch_score == 2.5
    assert [t.text for t in got[2, 1].turns] == ["orphan"]
    got = talk(frame, rows, None)
    assert [t.text for t in got[1, 2].turns] == ["q", "bad"] and len(got) == 3


def test_round_trip_of_control_strings_and_mask(frame):
    rows = [(1, 1, None, "user", MARKS, 0.0), (1, 2, 1, "assistant", MARKS * 2, 0.0), (1, 3, 2, "[/INST]", "", 0.0), (1, 4, 3, "assistant", None, 0.0),
            (1, 5, 4, None, "é😀<", 0.0), (1, 6, 5, "assistant", "[/INST]</s>", 0.0)]
    r = talk(frame, rows)[1, 1]
    assert [(t.role, t.text) for t in r.turns] == [(x[3] or "", x[4] or "") for x in rows]
    assert r.formatted.count("</s>") == 6 and r.formatted.count("[/INST]") == 6
    texts = [r.formatted[m.start:m.start + m.length] for m in r.mask]
    assert len(texts) == 3 and texts[1] == "" and texts[2] == "[\\/INST]<\\/s>"


def test_deep_chain_cycle_and_ties(frame):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(150)]
    rows += [(2, 1, 2, "user", "a", 0.0), (2, 2, 1, "user", "b", 0.0)]  # a cycle has no path
    rows += [(3, 1, None, "user", "same", 0.0), (3, 1, None, "user", "same", 0.0)]
    rows += [(None, 1, None, "user", "x", 0.0), (None, 2, 1, "assistant", "y", 0.0)]
    got = talk(frame, rows)
    assert [t.text for t in got[1, 1].turns] == [str(i) for i in range(150)]
    assert (2, 1) not in got and len(got[3, 1].turns) == 2
    assert [t.text for t in got[None, 1].turns] == ["x", "y"]
    assert not talk(frame, [])


def test_chains_order_rows_by_turn(frame):
    rows = [(7, 2, "user", "c"), (7, 1, "assistant", "b"), (7, 1, "assistant", "b"), (7, None, None, None), (8, 0, "user", "z")]
    made = chat.chains(frame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1)))
    out = {r.tree: r for r in chat.formatted(made).withColumn("turns", chat.parsed(F.col("formatted"))).collect()}
    assert [t.text for t in out[7].turns] == ["", "b", "b", "c"] and len(out[8].turns) == 1


def test_query_reads_the_texts_back_under_the_mask(spark, monkeypatch):
    sf, make = "/root/testdata/sf0.001", chat.formatted
    right = {r.conv_id: r for r in queries.op3_chat(spark, sf).collect()}
    assert right[-1].loss_chars == len("</s>[INST] ok [/INST]")
    assert "mask" in queries.op3_chat(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    late = F.transform("mask", lambda m: F.struct((m["start"] + 1).alias("start"), m["length"].alias("length")))
    monkeypatch.setattr(chat, "formatted", lambda *a: make(*a).withColumn("mask", late))
    wrong = {r.conv_id: r for r in queries.op3_chat(spark, sf).collect()}
    assert wrong[-1].loss_sha256 != right[-1].loss_sha256 and wrong[-1].turns_sha256 == right[-1].turns_sha256
