"""Corpus preparation in five stages, each a step of the operators in newsmill.llm on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.llm import decontaminate, line_crf, mixing, near_dedup, secrets
from newsmill.llm.common import drop_stored, stored, without
from newsmill.shared import one_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counting rules or hold mostly boilerplate lines go."""
    return line_crf.keep_content(docs, line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, by five-word shingles at a similarity of 0.8."""
    key = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    row = lambda k: F.concat_ws(":", F.col("doc_id").cast("string"), k)
    marked = near_dedup.near_duplicates(docs, k=5, percent=80, n_hashes=100, rows_per_band=4, row_key=key)
    gone = marked.where(~F.col("kept")).select(row(F.col("row_key")).alias("key")).distinct()
    return without(docs, row(key), stored(gone, "pipeline-copies"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with mix_copies (how often) and mix_words."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: The line field and the secret links have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents table, each result written to the shared folder and read again; what a stage stored on the way goes at its end,
    and its input once its result is there, so two copies of the corpus lie there at most and one at the end."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = one_table(spark, f"pipeline-{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), always=True)
        if last is not None:
            drop_stored(last)
        last = docs
    return docs
