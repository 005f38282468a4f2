"""Quality rules as a learned decision list (DataFrame functions only).

Statistics of a text are built-in array functions.  A list of rules is learned
from labelled statistics by sequential covering: a rule is a conjunction of up
to CONDITIONS thresholds, grown greedily on two thirds of the labelled rows by
information gain for the bad class and pruned on the last third; rows that a
rule covers leave the data, and the next rule is learned on the rest, until no
rule is PRECISE on the pruning rows.  What the driver sees are counts by
feature, threshold bin and label: their number is fixed by the parameters.
The verdict is an ordered conditional expression: the first rule that holds
rejects, otherwise the text is kept.

Null and empty texts have no words and zero statistics.  Labels that repeat a
doc_id count once, as bad if any says so; null labels are not used; with no
usable labels the list is empty and rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import stored

RULES, CONDITIONS, BINS, PRECISE, LEAST = 8, 3, 32, 0.95, 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Shares are in thousandths of the words or of the characters in words.
FEATURES = ("n_words", "word_chars", "n_dup_lines", "word_length", "symbol_share", "repeat_share", "upper_share", "mark_share", "distinct_share")


def statistics(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, the counts and the derived shares, all whole numbers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    without = lambda chars: F.char_length("text") - F.char_length(F.translate("text", chars, ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "").alias("w"), lines.alias("lines"),
        (F.char_length("text") - without(BLANKS)).cast("long").alias("word_chars"), without(SYMBOLS).cast("long").alias("n_symbols"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"), without("!?").cast("long").alias("n_marks"))
    rows = rows.select("doc_id", "word_chars", "n_symbols", "n_upper", "n_marks", F.size("w").cast("long").alias("n_words"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    five = F.when(F.size("h") >= 5, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("h") - 5, F.lit(0))), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(5)))))
    rows = rows.withColumn("g", F.coalesce(five, F.array().cast("array<bigint>")))
    rows = rows.withColumn("n_distinct", F.size(F.array_distinct("h")).cast("long")).drop("h")
    # windows by hash, then place: those that have an equal neighbour are found twice or more
    ordered = F.when(F.size(F.array_distinct("g")) < F.size("g"),
                     F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    rows = rows.withColumn("o", ordered).drop("g")
    twice = F.filter("o", lambda x, k: F.get("o", k + 1)["x"].eqNullSafe(x["x"]) | F.get("o", k - 1)["x"].eqNullSafe(x["x"]))
    rows = rows.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("o")
    cover = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(5), F.coalesce(F.get("at", k + 1) - x, F.lit(5)))),
                        F.lit(0).cast("long"), lambda a, b: a + b)
    rows = rows.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long"))).drop("at")
    per = lambda a, b: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       per("word_chars", "n_words").alias("word_length"), per("n_symbols", "word_chars").alias("symbol_share"),
                       per("n_repeat_words", "n_words").alias("repeat_share"), per("n_upper", "word_chars").alias("upper_share"),
                       per("n_marks", "word_chars").alias("mark_share"), per("n_distinct", "n_words").alias("distinct_share"))


def _holds(rule) -> Column:
    out = F.lit(True)
    for feature, side, limit in rule:
        out = out & ((F.col(feature) >= limit) if side == ">=" else (F.col(feature) < limit))
    return out


def _not_above(feature: str):
    return lambda x: x <= F.col(feature)


def _counts(rows: DataFrame, limits: dict[str, list[int]]):
    """Counts of good and bad rows by feature and bin (bin k: at or above k of the feature's limits)."""
    each = F.explode(F.array(*(
        F.struct(F.lit(f).alias("f"), F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in v)), _not_above(f))).alias("b"))
        for f, v in limits.items() if v)))
    found = rows.select("bad", each.alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    out = {f: [[0, 0] for _ in range(len(v) + 1)] for f, v in limits.items()}
    for r in found.collect():  # at most features * (BINS + 1) rows
        out[r.f][r.b] = [r.bad, r.good]
    return out


def _gain(bad, good, bad0, good0) -> float:
    """Information gain of a condition for the bad class, weighted by the bad rows that it keeps."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def _grow(rows: DataFrame, limits) -> list:
    rule: list = []
    while len(rule) < CONDITIONS:
        counts = _counts(rows.where(_holds(rule)), limits)
        best, choice = 1e-9, None
        total = [sum(x) for x in zip(*next(iter(counts.values())), strict=True)] if counts else [0, 0]
        if not total[0] or not total[1]:
            break
        for f, bins in sorted(counts.items()):
            low = [0, 0]
            for k, limit in enumerate(limits[f]):
                low = [a + b for a, b in zip(low, bins[k], strict=True)]
                high = [a - b for a, b in zip(total, low, strict=True)]
                for side, (bad, good) in ((">=", high), ("<", low)):
                    if (g := _gain(bad, good, *total)) > best:
                        best, choice = g, (f, side, limit)
        if choice is None:
            break
        rule.append(choice)
    return rule


def _prune(rows: DataFrame, rule: list):
    """The beginning of the rule that does best on the pruning rows, and its precision and bad rows there."""
    if not rule:
        return rule, 0.0, 0
    sums = [F.sum(F.when(_holds(rule[:k]), F.lit(1) if kind == "n" else F.col("bad")).otherwise(0)).alias(f"{kind}{k}")
            for k in range(1, len(rule) + 1) for kind in ("n", "bad")]
    r = rows.agg(*sums).first()
    scored = []
    for k in range(1, len(rule) + 1):
        n, bad = r[f"n{k}"] or 0, r[f"bad{k}"] or 0
        # v = (bad - good) / covered, the usual pruning measure, with ties to the shorter rule
        scored.append(((2 * bad - n) / n if n else -1.0, -k, bad / n if n else 0.0, bad))
    v, k, precision, bad = max(scored)
    return rule[:-k], precision, bad


def learn(stats: DataFrame, labels: DataFrame) -> list:
    """Rules, each a list of (feature, side, limit); a text that one holds for is rejected."""
    known = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
             .select("doc_id", (F.col("quality") == 0).cast("int").alias("bad")))
    rows = stored(stats.select("doc_id", *FEATURES).join(known, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(3))))
    points = [k / BINS for k in range(1, BINS)]
    cuts = rows.agg(*(F.percentile_approx(f, points, 10_000).alias(f) for f in FEATURES),
                    *(F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), points, 10_000).alias(f"bad_{f}") for f in FEATURES)).first()
    limits = {f: sorted({*(cuts[f] or []), *(cuts[f"bad_{f}"] or [])}) for f in FEATURES}
    rules: list = []
    while len(rules) < RULES and all(limits.values()):  # no labelled rows, no limits
        rest = rows
        for done in rules:
            rest = rest.where(~_holds(done))
        rule, precision, bad = _prune(rest.where("part = 0"), _grow(rest.where("part > 0"), limits))
        if not rule or precision < PRECISE or bad < LEAST:
            break
        rules.append(rule)
    return rules


def verdict(rules: list) -> Column:
    """The decision list as one ordered conditional: false where a rule rejects."""
    out = None
    for rule in rules:
        out = F.when(_holds(rule), F.lit(False)) if out is None else out.when(_holds(rule), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list]:
    """Statistics of each row with base_failed and kept, and the rules."""
    stats = stored(statistics(docs.select("doc_id", "text")))
    rules = learn(stats, labels)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules)), rules
