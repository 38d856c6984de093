"""A corpus pipeline: toxicity, near-duplicates, repeated passages, secrets, packing.

Every stage reads what its predecessor kept, from a Parquet table in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lanewise.llm import stages
from lanewise.llm._common import pipeline_folder, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash_near_dedup", stages.drop_near_duplicates),
    ("suffix_array_dedup", stages.drop_repeats),
    ("secret_scan", stages.redact_secrets),
    ("best_fit_packing", stages.pack),
]

#: No SQL for trained scores, linked fingerprints and tokenizers: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{pipeline_folder(spark)}/{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
