"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept;
all but the last return the columns of ``documents``, whatever columns those are.  The
operators see the columns they need and the rest as one struct, so no column of
``documents`` can clash with a result.  ``run`` writes each stage's result as Parquet in
the shared folder and reads it back, so a lost executor costs no more than one stage's tasks.

Defined cases, by stage, are those of its operator: a null or empty text goes in the
first stage (as do very short ones); a null id is kept through the others, and counts as
a document of its own; rows that repeat an id are judged and cut each, and stay or go
together as near-duplicates of others; of equal documents the smallest id stays; very
long texts are handled whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import minmax, packing, quality, shared, substrings
from trailweave.llm.queries import tokenizer

#: Near-duplicates share this many hundredths of their 5-word shingles.
SIMILARITY = 80
END_ID, CAPACITY = 2, 1024


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence from their language let pass."""
    rest = F.struct(*shared.pick(shared.others(docs, "text"))).alias("row")
    kept = quality.judge(docs.select(rest, "text", "lang")).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return minmax.keep_one(docs, percent=SIMILARITY).select(*shared.pick(docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that an earlier document holds; n_chars follows."""
    rest = F.struct(F.lit(0).alias("none"), *shared.pick(shared.others(docs, "doc_id", "text", "n_chars"))).alias("row")
    cut = substrings.remove_repeats(docs.select("doc_id", "text", rest))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.char_length(text).cast("long")}
    return cut.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence and the checksum of its ids.

    The ids themselves don't travel with the lengths; ``packing.sequences`` makes whole sequences of pieces that carry them.
    """
    pieces = packing.cut(docs.select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), END_ID, CAPACITY)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, by=["doc_id", "piece"], capacity=CAPACITY)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]

#: The Jensen-Shannon test and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.table(stage(spark, docs, sf_dir), name)
    return docs
