"""Operators as stages over ``documents``: each takes (spark, docs, sf_dir) and keeps all columns of the rows it keeps.

Every row goes by its own verdict, found by id and the text's hash, so also rows that share an id or have none.
Near-duplicate grouping keeps one row of each group; of rows of a group that share its smallest id, or of a group without
ids, it keeps one of each text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, near_dup, packing, quality
from .common import table
from .queries import PACK_END, SEQUENCE, tokenizer_file

#: Near-duplicate stages take five words and a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an id and text in ``verdicts``."""
    keys = verdicts.select(F.col("doc_id").alias("_kept_id"), F.col("tag").alias("_kept_tag")).distinct().hint("merge")  # ids grow with the documents: never broadcast
    return docs.join(keys, docs["doc_id"].eqNullSafe(F.col("_kept_id")) & (F.xxhash64(docs["text"]) == F.col("_kept_tag")), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep."""
    return _kept(docs, quality.judge(docs, table(spark, sf_dir, "labels"), tagged=True).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    verdicts = near_dup.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT, tagged=True).where("kept")
    out = _kept(docs, verdicts)
    # texts are shuffled once more only if an id occurs twice
    repeated = verdicts.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return _kept(docs, decontam.contamination(docs, table(spark, sf_dir, "benchmark"), tagged=True).where("NOT contaminated"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a document, placed in a sequence."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), False, PACK_END, SEQUENCE)
