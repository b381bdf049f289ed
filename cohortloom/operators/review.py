"""Blinded review samples, agreement and adjudication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.operators.controls import hash_order, hashed_sample


def blinded_sample(rows: DataFrame, strata: Sequence[str], key: str, n: int = 5, seed: str = "4409") -> DataFrame:
    """``review_id`` and the sampled rows: n per stratum in hash order, numbered in another hash order."""
    chosen = hashed_sample(rows, strata, key, n, seed).drop("sample_rank")
    order = Window.orderBy(hash_order(f"{seed}:blind", key), F.col(key))
    return chosen.withColumn("review_id", F.row_number().over(order))


def domain_violations(form: DataFrame, fields: dict[str, Sequence[str]]) -> DataFrame:
    """``field, value, n``: answers outside their domain; null is outside."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value")) for k in fields)))
    allowed = F.lit(False)
    for k, v in fields.items():
        allowed = allowed | ((F.col("field") == k) & F.coalesce(F.col("value").isin(list(v)), F.lit(False)))
    return form.select(cells.alias("x")).select("x.*").where(~allowed).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def agreement(first: DataFrame, second: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``field, n, agreement``: how often two reviewers agree where neither says NA."""
    a = first.select(key, *(F.col(f).alias(f"{f}_a") for f in fields))
    b = second.select(key, *(F.col(f).alias(f"{f}_b") for f in fields))
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_a").cast("string").alias("a"), F.col(f"{f}_b").cast("string").alias("b")) for f in fields)))
    both = a.join(b, key).select(cells.alias("x")).select("x.*").where("a <> 'NA' AND b <> 'NA'")
    return both.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 9).alias("agreement"))


def distribution(form: DataFrame, field: str) -> DataFrame:
    """``value, n, share`` of the applicable answers; NA and null don't count."""
    kept = form.where(F.col(field).isNotNull() & (F.col(field) != "NA")).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return kept.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


def adjudicated(first: DataFrame, second: DataFrame, third: DataFrame, key: str, field: str) -> DataFrame:
    """``key, final, source``: the agreed answer, else the third reviewer's, else unresolved."""
    joined = (
        first.select(key, F.col(field).alias("a"))
        .join(second.select(key, F.col(field).alias("b")), key)
        .join(third.select(key, F.col(field).alias("c")), key, "left")
    )
    agreed: Column = F.col("a").eqNullSafe(F.col("b"))
    return joined.select(key, F.when(agreed, F.col("a")).otherwise(F.col("c")).alias("final"), F.when(agreed, "agreed").when(F.col("c").isNotNull(), "third").otherwise("unresolved").alias("source"))
