import hashlib
import random
import re

from pyspark.sql import functions as F

from larder.llm import pii

DDL = "doc_id long, text string"


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def found(df, column):
    return {r.doc_id: [(x.kind, x.s, x.e) for x in r[column]] for r in pii.personal_data(df).collect()}


HAND = [
    "", None, "a@b.co x_y@z", "a@b@c.de", "..@..", "a@b.c-_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4 1.2.3.999", "1.2.3",
    "4539 1488 0343 6467", "4539-1488-0343-6467 1", "4539148803436467", "4539  1488 0343 6467", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1",
    "+1 (017) 555-7713.", "+1", "++12345678901", "+123456789-", "é😀 a@b.co 😀 10.0.0.1", "ü+49 30 123456 x@y.zz,+44 20 7946 0958",
    "0" * 4000, "a" * 5000 + "@" + "b" * 50, "7 " * 3000, "+" + "1 " * 2000, "4539148803436467" * 40,
]


def test_base_spans_equal_brute_force(frame):
    rng = random.Random(3)
    rows = list(enumerate(HAND))
    for i in range(300):
        rows.append((100 + i, "".join(rng.choice("0123456789.+-@() ab_%é") for _ in range(rng.randrange(60)))))
    got = found(frame(rows, DDL), "base")
    for doc, text in rows:
        assert got[doc] == brute(text or ""), text


def test_context_discovers_unseen_identifiers(frame):
    cards = ["4539148803436467", "4485275742308327", "4916338506082832", "4024007198964305"]
    rows = [(i, f"noise word{i} pay with card number {c} thanks") for i, c in enumerate(cards)]
    rows += [(50, "please use card number 1234567890123456 now"), (51, "plain words 1234567890123455 here")]
    rows += [(60 + i, f"the word{i} of nothing") for i in range(5)]
    got = {r.doc_id: r for r in pii.personal_data(frame(rows, DDL)).collect()}
    assert [x.kind for x in got[50].spans] == ["card"] and not got[50].base
    assert not got[51].spans
    assert all(got[i].spans == got[i].base and len(got[i].base) == 1 for i in range(4))


def test_edge_rows(frame, spark):
    rows = [(1, "x a@b.co"), (1, "x a@b.co"), (None, "a@b.co"), (None, None)]
    out = pii.personal_data(frame(rows, DDL)).collect()
    assert sorted(len(r.base) for r in out) == [0, 1, 1, 1]
    assert pii.personal_data(frame([], DDL)).count() == 0
    wide = spark.createDataFrame([(1, "a@b.co", "x", 2)], "doc_id long, text string, kind string, row int")
    one = pii.personal_data(wide).withColumn("t", pii.listed("spans")).withColumn("h", F.sha2("t", 256)).first()
    assert one.t == "email:0:6" and one.h == hashlib.sha256(b"email:0:6").hexdigest()
