"""Registered queries of the subpackage: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, language, line_dedup, manifest, ngram_join, oracles, packing, pii, quality, resampling, substring, suffix_dedup, toxicity
from .spark import stored, table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_size")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), "
                      "(-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.formatted(stored(chat.chains(talks))).withColumn("turns", chat.parsed(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(chat.masked(F.col("formatted"), F.col("mask")), "")
    return out.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, lines, removed = line_dedup.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col(lines).alias("n_lines"), F.col(removed).alias("n_removed_lines"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, (n, spans, items) = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    out = out.select("doc_id", F.col(n).alias("n_words"), decontamination.hit_words(spans).alias("n_hit"), F.col(items).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                      decontamination.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, score = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), F.col(score).alias("score"),
                      (F.col(score) >= 0.5).cast("int").alias("predicted"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, (kept, removed, spans) = suffix_dedup.cleaned(docs)
    return out.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.col(removed).alias("n_removed"),
                      F.col(spans).alias("n_spans"), F.sha2(F.col(kept), 256).alias("kept_sha256"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, (n, spans, partner) = substring.marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col(n).alias("n_words"), F.expr(f"cast(size(`{spans}`) div 2 as long)").alias("n_passages"),
                      F.array_join(F.transform(spans, lambda x: x.cast("string")), ",").alias("spans"), F.col(partner).alias("partner_id"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, (_, n, weight, score, rank) = resampling.resampled(docs, table(spark, sf_dir, "benchmark"), drop=("text",))
    return out.select("doc_id", F.col(n).alias("n_features"), F.col(weight).alias("weight"), F.col(score).alias("score"), F.col(rank).alias("rank"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"), manifest.without_line_ends()).drop("source", "path")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out, (name, score) = language.predicted(docs.drop("lang"), language.train(docs))
    return out.select("doc_id", language.held_out().alias("held_out"), F.col(name).alias("lang_pred"), F.col(score).alias("score"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_join, op2_pii, op3_chat, op4_line_dedup, op5_packing, op6_quality, op7_decontamination, op8_toxicity,
    op9_suffix_dedup, op10_substring, op11_resampling, op12_manifest,
    op13_language)}

ORACLE_SQL = {"op1_ngram_join": oracles.NGRAM_JOIN, "op3_chat": oracles.CHAT, "op7_decontamination": oracles.DECONTAMINATION,
              "op11_resampling": oracles.RESAMPLING, "op12_manifest": oracles.MANIFEST}
