"""From raw documents to a mixed, tokenised corpus: five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return
the columns of documents. SQL cannot express the tokeniser, so ORACLE_SQL is None and the tests hold run()
against brute-force versions of the stages.

Line dedup leaves later copies of a document without a line, most of them before the join sees them; texts
that it empties go there, as no later stage could use them.

Defined results: null and empty texts fail the quality rules; repeated rows and ties are decided as the
operators state; an empty table gives an empty result; very long texts are rows like others. Columns beside
those of documents travel under names of the pipeline's own while a stage works, so that no name clashes.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarespan.llm import bpe, line_dedup, mixing, ngram_join, quality
from rarespan.llm.common import ensure_checkpoint_dir, remove, table
from rarespan.llm.queries import token_pattern, tokenizer_file

CORE = ("doc_id", "text", "lang", "source", "n_chars")


def keeping_columns(stage):
    """The stage sees the columns of documents by their names and all others by neutral ones, and returns every column as it was named."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        neutral = [c if c in CORE else f"carried_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*neutral), sf_dir).select(neutral).toDF(*docs.columns)

    return run_stage


@keeping_columns
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.judge(docs).where("kept")


@keeping_columns
def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose later occurrences of repeated passages of three lines or more; documents that lose every word go."""
    out = line_dedup.dedup(docs)
    once = out.select(F.explode(F.array(F.struct("*"))).alias("r")).select("r.*")  # the filter cannot move below this and measure every text again
    out = once.where(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@keeping_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of alike texts stays."""
    return ngram_join.one_of_each(docs)


@keeping_columns
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them, as whole documents."""
    mixed = mixing.mix(docs, whole_rows=True).withColumn("_times", mixing.copies(F.col("size"), F.col("taken")))
    return mixed.where("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and whether they decode to its text."""
    return bpe.tokenise(docs, tokenizer_file("byte_bpe_50k.tiktoken"), token_pattern())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("mix_sources", source_mixing),
    ("byte_bpe", byte_bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's folder lives until the next one is written; the last one is the result's."""
    docs, folder = table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
