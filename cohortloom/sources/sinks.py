"""Sinks: atomic documents, tables, logs that only grow, and outputs that must not change."""

from __future__ import annotations

import json
import math
import os
import tempfile
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.identity import signature


def write_document(path: str, value: Any) -> None:
    """One JSON document, replaced as a whole; NaN and infinities are refused."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, made = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump(value, out, ensure_ascii=False, indent=2, allow_nan=False)
        os.replace(made, path)
    except BaseException:
        os.unlink(made)
        raise


def finite_or_null(value: Any) -> Any:
    """A value with every NaN and infinity replaced by null, however nested."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): finite_or_null(v) for k, v in value.items()}
    return [finite_or_null(v) for v in value] if isinstance(value, (list, tuple)) else value


def write_table(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """A parquet table that replaces the old one; the commit protocol publishes whole jobs only."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Attempts added to a log as JSON lines."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_once(df: DataFrame, path: str) -> None:
    """A table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def write_csv(parts: Sequence[DataFrame], path: str) -> bool:
    """Frames under one header, the union of their columns in first-seen order; nothing is written without rows."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    if union.isEmpty():
        return False
    union.write.mode("overwrite").option("header", True).csv(path)
    return True


def table_signature(df: DataFrame, columns: Sequence[str]) -> str:
    """An order-free signature of a table's rows: the sum of their hashes and their count."""
    hashed = df.select(F.conv(F.substring(signature(*columns), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    row = hashed.agg(F.sum("h").alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{row.n}:{row.s or 0}"


def freeze(spark: SparkSession, df: DataFrame, columns: Sequence[str], path: str) -> str:
    """Store a table's signature, or fail if a different one is stored already."""
    now = table_signature(df, columns)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)["signature"]
        if stored != now:
            raise ValueError(f"frozen as {stored}, now {now}")
    else:
        write_document(path, {"signature": now, "columns": list(columns)})
    return now


def resumed(done: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """A sparse result table after another run: rows done before stay, fresh rows fill what was missing."""
    return done.unionByName(fresh.join(done.select(*key).distinct(), list(key), "left_anti"), allowMissingColumns=True)
