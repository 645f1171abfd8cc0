"""A training corpus from documents: language ID, near-dedup, decontamination, mixing, sharding. Each stage works on all that the one
before kept; run() writes each stage to the folder in spark.checkpoint.dir and reads it again.

Each stage gives the columns of documents, whatever else docs has beside them, and no rows for none. A null text counts as empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ligature.llm.common import stored
from ligature.llm.decontamination import drop_contaminated
from ligature.llm.language import drop_unidentified
from ligature.llm.mixing import mixed
from ligature.llm.sharding import sharded
from ligature.llm.shingles import drop_near_copies


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language can't be told, go: null and empty texts among them. Rows that repeat stay or go alike."""
    return drop_unidentified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by fingerprints or bands of shingles and verified by shingle similarity, the document with the smallest
    doc_id stays, null last; ties go by hashes of the text, then of the row, so one row stays of rows that repeat."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more stand in benchmark windows; one without words stays."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target weight asks for; null is a source. Rows that share a doc_id are drawn alike."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets its shard, by a hash of doc_id and text; rows alike in both share one."""
    return sharded(docs)


STAGES = [
    ("language", identify_language),
    ("simhash", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The language model and the fingerprints can't be said in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
