"""The corpus pipeline: quality rules, quality classifier, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written and read again as Parquet.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import packing, quality_classifier, quality_rules, simhash
from helixframe.llm.common import table
from helixframe.schema import shared_folder


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose posterior quality, or length or repetition, speaks against them."""
    return quality_rules.keep_good(docs)


def reject_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on labelled rows of ``documents``, scores below 0.7."""
    model = quality_classifier.fit(quality_classifier.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return quality_classifier.keep_predicted(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near-duplicates, the row with the smallest doc_id; see :func:`simhash.one_of_each_component`.

    Rows that share a doc_id but not the text are documents of their own. A group without any doc_id keeps one row too.
    """
    return simhash.one_of_each_component(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    return packing.best_fit_packing(docs)


STAGES = [("quality rules", reject_by_rules), ("quality classifier", reject_by_classifier), ("near-duplicates", one_of_each_group), ("packing", pack)]

#: SQL can express neither the fitted models nor the components and the packing; tests hold the rows against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, all stages applied to ``documents`` one after another.

    Each stage's rows are written to the shared folder; those that the next one has read are then removed.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            read = path(f"{folder}/{k - 1}")
            read.getFileSystem(spark._jsc.hadoopConfiguration()).delete(read, True)
    return docs
