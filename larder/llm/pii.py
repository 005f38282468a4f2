"""Personal data: fixed forms, and bootstrapped contextual extraction (DataFrame functions only).

Base spans have a fixed form each (e-mail, IPv4, payment card, telephone).
They seed a bootstrap over lexical patterns:

1. a pattern is a kind and the two words before an identifier;
2. its confidence is the share of all places of these two words in the whole
   corpus that an accepted identifier of the kind follows, and it needs
   SUPPORT different identifiers;
3. an identifier of looser form (a card number that fails its checksum, a
   telephone number without "+", ...) scores 1 - prod(1 - confidence) over the
   confident patterns it stands in, and counts as accepted from ACCEPT on;
4. steps 2 and 3 repeat ROUNDS times, so what was discovered teaches further
   patterns.  The spans of accepted identifiers are added to the base spans.

The regular expressions are linear on any text: where the plain form would
try every start of a long run, a look-behind admits only the run's first
character, and groups are possessive; the matches are the same.

Offsets are code points.  Null and empty texts have no spans; rows that repeat
a doc_id, or have none, are handled one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import stored

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENT, ACCEPT, ROUNDS = 3, 0.5, 0.5, 3
CONTEXT_CHARS = 120

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
FORMS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # maximal runs of digits with single separators, of 13 digits or more
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12}+(?:[\x20-]?+[0-9])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Looser forms, which count only where confident patterns say so.
LOOSE = {
    "email": r"(?<![^\s<(])[^\s@<>()]++(?:@|[\[(]at[\])])[^\s@<>()]++",
    "ip": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){3,7}+",
    "card": FORMS["card"],
    "phone": r"(?<![0-9A-Za-z+.()-])(?<![0-9(][\x20])[0-9(](?:[\x20().-]?+[0-9]){6,14}+(?![\x20().-]?[0-9])",
}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def weight(i):
        d = number.substr(F.char_length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    each = F.transform(F.sequence(F.lit(0), F.char_length(number) - 1), weight)
    return F.aggregate(each, F.lit(0), lambda x, y: x + y) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        size = F.char_length(digits(value))
        return F.when(size.between(13, 19), luhn(digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits(value)).between(9, 15)
    return F.lit(True)


def is_valid(kind: str):
    return lambda x: valid(kind, x["v"])


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v, c>> of the leftmost non-overlapping matches: code points, value, two words before."""
    kind = "array<struct<s:int,e:int,v:string,c:string>>"
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                      lambda gap, value: F.struct(gap.alias("g"), value.alias("v")))

    def step(done, x):
        start = done["at"] + F.char_length(x["g"])
        end = start + F.char_length(x["v"])
        near = F.split(F.trim(F.regexp_replace(F.lower(F.right(x["g"], F.lit(CONTEXT_CHARS))), r"\s+", " ")), " ")
        words = F.array_join(F.slice(near, F.greatest(F.size(near) - 1, F.lit(1)), 2), " ")
        one = F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v"), words.alias("c"))
        return F.struct(end.alias("at"), F.array_append(done["out"], one).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.filter(both, lambda x: x["v"].isNotNull()), start, step, lambda done: done["out"])


def _none():
    return F.array().cast("array<struct<s:int,e:int,v:string,c:string>>")


def findings(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: row, doc_id, base_<kind> and loose_<kind> arrays."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    may = {"email": F.col("text").contains("@"), "ip": F.col("text").rlike("[0-9]"), "card": F.col("text").rlike("[0-9]"),
           "phone": F.col("text").contains("+")}
    loose_may = {"email": F.col("text").rlike("@|[(\\[]at[)\\]]"), "ip": F.col("text").rlike("[0-9A-Fa-f]:[0-9A-Fa-f:]"), "phone": may["card"]}
    found = rows.select("row", "doc_id", "text", *(F.when(may[k], matches(F.col("text"), FORMS[k])).otherwise(_none()).alias(k) for k in KINDS),
                        *(F.when(loose_may[k], matches(F.col("text"), LOOSE[k])).otherwise(_none()).alias(f"wide_{k}") for k in loose_may))
    good = {k: F.filter(k, is_valid(k)) for k in KINDS}
    base = found.select("row", "doc_id", "card", *(f"wide_{k}" for k in loose_may), *(good[k].alias(f"base_{k}") for k in KINDS))
    taken = F.concat(*(F.col(f"base_{k}") for k in KINDS))
    free = lambda x: ~F.exists("taken", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    base = base.withColumn("taken", taken)
    wide = {k: F.col(f"wide_{k}") for k in loose_may}
    card = F.filter("card", lambda x: F.char_length(digits(x["v"])).between(13, 19))
    wide["card"] = card
    return base.select("row", "doc_id", *(f"base_{k}" for k in KINDS), *(F.filter(wide[k], free).alias(f"loose_{k}") for k in KINDS))


def places(found: DataFrame, prefix: str) -> DataFrame:
    """(row, kind, s, e, v, c) of one family of arrays."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{prefix}_{k}").alias("x")) for k in KINDS))
    return (found.select("row", F.explode(each).alias("k")).select("row", "k.kind", F.explode("k.x").alias("x"))
            .select("row", "kind", "x.s", "x.e", "x.v", "x.c"))


def context_counts(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(c, total): how often each two-word context stands in the corpus."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col("text")), r"\s+", " ")), " ")
    rows = docs.where("text is not null").select(words.alias("w"))
    pairs = rows.select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))),
                                             F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))),
                                             lambda a, b: F.xxhash64(F.concat_ws(" ", a, b)))).alias("h"))
    return (pairs.join(contexts.select("c", F.xxhash64("c").alias("h")), "h")
            .groupBy("c").agg(F.count("*").alias("total")))


def discovered(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(row, kind, s, e) of the spans that the bootstrap adds."""
    loose = stored(places(found, "loose").where(F.col("c").contains(" ")))
    seeds = places(found, "base").where(F.col("c").contains(" "))
    # a pattern matters only where a looser identifier stands in it
    contexts = loose.select("c").distinct()
    seeds = stored(seeds.join(contexts, "c", "left_semi").groupBy("kind", "c", "v").agg(F.count("*").alias("n")))
    empty = loose.select("row", "kind", "s", "e").limit(0)
    learnable = stored(loose.join(seeds.select("kind", "c").distinct(), ["kind", "c"], "left_semi").select("c").distinct())
    if learnable.isEmpty():
        return empty
    totals = stored(context_counts(docs, contexts))
    edges = stored(loose.groupBy("kind", "c", "v").agg(F.count("*").alias("n")))  # the graph of patterns and instances
    accepted = edges.select("kind", "v").limit(0)
    for _ in range(ROUNDS):
        known = seeds.unionByName(edges.join(accepted, ["kind", "v"], "left_semi"))
        patterns = (known.groupBy("kind", "c").agg(F.count("*").alias("support"), F.sum("n").alias("hits")).where(F.col("support") >= SUPPORT)
                    .join(totals, "c").withColumn("confidence", F.least(F.col("hits") / F.col("total"), F.lit(0.99)))
                    .where(F.col("confidence") >= CONFIDENT).select("kind", "c", "confidence"))
        score = 1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))
        accepted = stored(edges.join(patterns, ["kind", "c"]).groupBy("kind", "v").agg(score.alias("score"))
                          .where(F.col("score") >= ACCEPT).select("kind", "v"))
    return loose.join(accepted, ["kind", "v"], "left_semi").select("row", "kind", "s", "e")


def _ranked(rank: int, kind: str):
    return lambda x: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base and spans; each an array of struct(rank, kind, s, e) by kind as listed, then start."""
    docs = docs.select("doc_id", "text")
    found = stored(findings(docs))
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    more = (discovered(docs, found).groupBy("row")
            .agg(F.collect_list(F.struct(rank[F.col("kind")].alias("rank"), "kind", "s", "e")).alias("more")))
    base = F.concat(*(F.transform(f"base_{k}", _ranked(i, k)) for i, k in enumerate(KINDS)))
    return (found.join(more, "row", "left").select("doc_id", base.alias("base"), "more")
            .select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans")))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
