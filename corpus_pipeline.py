"""From raw documents to a training mix: STAGES in order, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glimmer.llm import decontaminate, mix, quality, secrets, simhash
from glimmer.session import table, written

STAGES = [
    ("quality classifier", quality.keep_good),
    ("simhash near-dedup", simhash.keep_one),
    ("benchmark decontamination", decontaminate.drop_contaminated),
    ("secret scans", secrets.mask_secrets),
    ("mixing sources", mix.take),
]
#: Fingerprints, forests and the flight phase are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
