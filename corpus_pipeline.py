"""A training corpus from raw documents, in five stages; each reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.common import stage
from orderlens.llm.decontam import decontaminate
from orderlens.llm.langid import keep_known
from orderlens.llm.line_dedup import left_after
from orderlens.llm.mixing import mix, spelled
from orderlens.llm.near_copies import keep_first


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches; those without a letter, or far from all centroids, go."""
    return keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus, or nearly so, go; a document that loses all its text goes with them."""
    left = left_after(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share 0.8 of their five-word shingles with one before them go: SimHash balls and bands propose, whole sets decide."""
    return keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, or an edited copy, go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each text, how often it is taken whole and which part of it once more, so that sources meet their target weights."""
    return spelled(mix(docs))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture)]

#: SQL can't express language ID, fingerprints and alignment; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Null texts go in the first stage (no letter); null ids come last in line dedup and stay in near-dedup;
    repeated rows lose their lines to the first; null sources are a source of their own. An empty table gives an empty mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
