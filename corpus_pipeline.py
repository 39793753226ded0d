"""From raw documents to packed sequences: quality, near copies, test items, packing. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinfold.llm import decontaminate, kneser_ney, packing, simhash
from twinfold.llm.tables import stored, table


#: Documents that pass between Spark and a Python worker at a time: whole texts, so fewer than Spark's 10,000.
BATCH_ROWS = 2000


def _in_small_batches(stage):
    """The stage with small batches, which bounds the copies of texts that an executor and its workers hold."""
    def smaller(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return smaller


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier keeps."""
    return kneser_ney.judged(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: candidates are verified on their sets of five-word shingles."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all pieces with their places in the sequences."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    (name, _in_small_batches(stage))
    for name, stage in (("quality_classifier", quality), ("simhash_near_dedup", near_copies), ("decontamination", decontamination), ("packing", pack))
]

#: Models, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
