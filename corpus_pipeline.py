"""Documents through quality rules, quality classifier, near-duplicate removal and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forcejobs.llm.common import discard, written
from forcejobs.llm.line_crf import score_quality
from forcejobs.llm.near_copies import one_of_near_copies
from forcejobs.llm.packing import pack_documents
from forcejobs.llm.quality_rules import quality_rules
from forcejobs.llm.queries import quality_fold, trusted_ids, vocabulary


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each by its own verdict: ids may be null, repeated or shared."""
    return quality_rules(docs, trusted_ids(spark, sf_dir), carry=True).where("kept").select("row.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the line field calls good, each by its own verdict: ids may be null, repeated or shared.

    It is fitted on labelled documents of the whole table, junk included.
    """
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality_fold())
    return score_quality(docs, labelled, labels, carry=True).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id (null last), of each group of texts linked by a five-word similarity of 0.8 or more.

    Links of op8 and bands of minima are the candidates.
    """
    return one_of_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("simhash_near_dedup", near_duplicates),
    ("best_fit_packing", packing),
]
#: Hash buckets, the line field and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written before the next one reads it, and deleted after that."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
