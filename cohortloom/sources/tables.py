"""Parquet table access by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings manifest evidence_bank "
    "context_deliveries anchor generation_attempts eval_items mix_targets"
).split()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root``, a file or a folder of part files."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
