"""Documents to packed training sequences, in stages that are written as Parquet and read again.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import stages
from ledgerflow.llm.common import table, written

STAGES = [
    ("quality rules", stages.quality_rules),
    ("MinHash near-dedup", stages.near_duplicates),
    ("benchmark decontamination", stages.decontamination),
    ("best-fit packing", stages.best_fit_packing),
]

#: The forest's verdicts and the genetic packing have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
