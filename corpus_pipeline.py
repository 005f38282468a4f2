"""Corpus pipeline: filter, clean, deduplicate, decontaminate and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.
"""

import uuid

from pyspark.sql import functions as F

from larder.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from larder.llm.spark import shared_folder, table


def reject_toxic(spark, docs, sf_dir):
    """Operator 8: documents scored 0.5 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark, docs, sf_dir):
    """Operator 4: multi-line chunks stay at their first place only; every row stays."""
    out, _, _ = line_dedup.cleaned(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark, docs, sf_dir):
    """Operator 1: of linked documents the one with the smallest doc_id stays."""
    return ngram_join.representatives(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Operator 7: documents of which 5 % of the words or more are benchmark passages go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """Operator 5: pieces of sequences of at most 1024 tokens."""
    return packing.packed(docs).withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# SQL can express neither the learned scores nor the rolling hashes nor the tokens.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole documents table; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
