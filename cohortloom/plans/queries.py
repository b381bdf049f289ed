"""The core queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import delivery
from cohortloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(r"""
  WITH keyed AS (
    SELECT delivery_id, delivered_at, lower(regexp_replace(sample_id, '^\s+|\s+$', '', 'g')) AS a,
           lower(regexp_replace(condition, '^\s+|\s+$', '', 'g')) AS b, lower(regexp_replace(context_signature, '^\s+|\s+$', '', 'g')) AS c
    FROM context_deliveries
  ),
  ranked AS (
    SELECT delivery_id, row_number() OVER (PARTITION BY a, b, c ORDER BY delivered_at NULLS LAST, delivery_id) AS i
    FROM keyed WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
  )
  SELECT delivery_id FROM ranked WHERE i > 1""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The surplus copies of deliveries."""
    return delivery.surplus_ids(table(spark, d, "context_deliveries"), ["sample_id", "condition", "context_signature"], ["delivered_at", "delivery_id"], "delivery_id")


_KEPT = r"""
  WITH keyed AS (
    SELECT delivery_id, batch_id, method, delivered_at, lower(regexp_replace(sample_id, '^\s+|\s+$', '', 'g')) AS a,
           lower(regexp_replace(condition, '^\s+|\s+$', '', 'g')) AS b, lower(regexp_replace(context_signature, '^\s+|\s+$', '', 'g')) AS c
    FROM context_deliveries
  )
  SELECT delivery_id, batch_id, method FROM (
    SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY delivered_at NULLS LAST, delivery_id) AS i FROM keyed
  ) WHERE i = 1 OR a IS NULL OR b IS NULL OR c IS NULL"""
_KEYS, _ORDER = ["sample_id", "condition", "context_signature"], ["delivered_at", "delivery_id"]


@query(_KEPT)
def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    """One copy of each delivery; those with a null key are all kept."""
    return delivery.split_copies(table(spark, d, "context_deliveries"), _KEYS, _ORDER)[0].select("delivery_id", "batch_id", "method")


@query(_KEPT)
def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """One copy of each over stored and new deliveries: new are those of the last month, or without a time."""
    rows = table(spark, d, "context_deliveries")
    since = rows.agg((F.max("delivered_at") - F.expr("INTERVAL 30 DAYS")).alias("since"))
    parted = rows.join(since).withColumn("fresh", F.coalesce(F.col("delivered_at") > F.col("since"), F.lit(True))).drop("since")
    stored, new = parted.where("NOT fresh").drop("fresh"), parted.where("fresh").drop("fresh")
    return delivery.merge_new(stored, new, _KEYS, _ORDER).select("delivery_id", "batch_id", "method")
