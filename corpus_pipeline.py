"""The corpus pipeline: toxicity, quality rules, exact duplicates, near duplicates, packing.

Every stage reads what the one before kept, takes its decisions on all of it, and returns the columns of ``documents``
(the last one the packed pieces). ``run`` writes each stage's rows as Parquet in the shared folder and reads them again.
Classifier and decision list learn from the labels of documents that are still there.

Cases: a null text counts as empty, is not toxic and fails the quality rule (fewer than ten words); repeated rows share
their fate in the first two stages, of rows with one text one stays in the third; rows are told apart by doc_id and text,
so rows that share a doc_id, or have none, are judged each for itself; texts of any length are read whole; ties go to the
largest doc_id (equal texts) or the smallest (near copies); an empty table gives no rows; further columns stay until the
last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import cutting_stock, decision_list, golomb, signature_tree, toxicity
from postmill.llm.work import work_dir, written
from postmill.plans.session import ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic."""
    ship(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list."""
    return decision_list.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def once_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    ship(spark)
    return golomb.once_each(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, the one with the smallest doc_id."""
    ship(spark)
    return signature_tree.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 2048."""
    import public_tokenizers

    ship(spark)
    return cutting_stock.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("quality", of_quality), ("exact_dedup", once_each), ("near_dedup", no_near_copies), ("packing", packed)]

#: A classifier, a learned list and a solved plan have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = work_dir(spark, "corpus")
    for k, (name, stage) in enumerate(STAGES):
        rows = written(stage(spark, rows, sf_dir), f"{home}/{k}-{name}")
    return rows
