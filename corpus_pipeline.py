"""From raw documents to packed training sequences.

Each stage is a function of ``(spark, docs, sf_dir)``; what it returns is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``. :func:`run` deletes what a stage left
in the shared folder when its result has been written; the last stage's tables,
and those of stages that are called one by one, stay until the session ends, since
results that are not written yet read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pactum.llm.common import drop_scratch, free, materialize, read_table, scratch_made, small_batches
from pactum.llm.mixing import mix_documents
from pactum.llm.neardup import drop_near_duplicates
from pactum.llm.packing import pack_documents
from pactum.llm.quality_knn import drop_low_quality
from pactum.llm.suffix_dedup import remove_repeats


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)  # for this and the following stages: whole texts go to Python
    return drop_low_quality(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest document stays."""
    return drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that an earlier document has are cut from the texts."""
    return remove_repeats(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or cut to their exact word budgets."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens get a place in a sequence."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("near-duplicate removal", keep_one_of_near_duplicates),
    ("repeated-string removal", cut_repeats),
    ("source mixing", mix_to_weights),
    ("sequence packing", pack),
]

#: Classifier, string matching and tokenisation have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), STAGES[-1][1]
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch_made() as left:
            kept = stage(spark, docs, sf_dir)
        kept = materialize(kept, f"pipeline-{k}")
        drop_scratch(left)
        free(docs)
        docs = kept
    return last(spark, docs, sf_dir)
