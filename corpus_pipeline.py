"""The corpus pipeline: quality rules, line dedup, one of each near copy, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._base import stash
from quillspark.llm.decontaminate import leaks
from quillspark.llm.line_dedup import line_dedup
from quillspark.llm.mixing import mix
from quillspark.llm.ngram_join import one_of_each
from quillspark.llm.quality_rules import keep_good


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document of which no line is left goes. n_chars follows the text."""
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup(docs, keep=other).where("n_removed < n_lines")
    if "n_chars" in other:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks(docs, benchmark).where(F.size("_leaks") == 0).drop("_leaks")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix(docs)


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("ngram_join", near_copies), ("decontamination", clean_of_benchmark), ("mixing", mixed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{name}")
    return docs
