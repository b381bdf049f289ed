"""Append-only attempt logs: selection, coverage, resumption and paired contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def selected_attempts(log: DataFrame, key: Sequence[str], good: Column, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first good attempt, else the last; ``attempts`` and ``good_attempts`` beside it.

    The choice is a pair of combined ``min_by`` / ``max_by`` aggregates; a null ``good`` is not good.
    """
    at = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    row = F.struct(*(F.col(c) for c in log.columns if c not in key))
    ok = F.coalesce(good, F.lit(False))
    per = log.groupBy(*key).agg(
        F.min_by(F.when(ok, row), F.when(ok, at)).alias("_first_good"),
        F.max_by(row, at).alias("_last"),
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(ok).alias("good_attempts"),
    )
    return per.withColumn("_r", F.coalesce("_first_good", "_last")).select(*key, "_r.*", "attempts", "good_attempts")


def coverage(expected: DataFrame, log: DataFrame, key: Sequence[str], by: Sequence[str], good: Column, order: Sequence[Column]) -> DataFrame:
    """expected, successful, failed, pending, attempts, duplicates and availability per group; a failed cell is done."""
    chosen = selected_attempts(log, key, good, order).select(*key, "attempts", "good_attempts")
    cells = expected.select(*key, *[c for c in by if c not in key]).distinct().join(chosen, list(key), "left")
    done, won = F.col("attempts").isNotNull(), F.coalesce(F.col("good_attempts"), F.lit(0)) > 0
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if(won).alias("successful"),
        F.count_if(done & ~won).alias("failed"),
        F.count_if(~done).alias("pending"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"),
        F.coalesce(F.sum(F.col("attempts") - 1), F.lit(0)).alias("duplicates"),
        F.round(F.count_if(won) / F.greatest(F.count(F.lit(1)), F.lit(1)), 9).alias("availability"),
    )


def pending(expected: DataFrame, log: DataFrame, key: Sequence[str], retry: Column | None = None) -> DataFrame:
    """Expected cells without an attempt; attempts for which ``retry`` holds count as none."""
    done = log if retry is None else log.where(~F.coalesce(retry, F.lit(False)))
    return expected.join(done.select(*key).distinct(), list(key), "left_anti")


def mismatch(expected: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """``side, cells``: cells only one of two tables has."""
    a, b = expected.select(*key).distinct(), actual.select(*key).distinct()
    missing = a.join(b, list(key), "left_anti").agg(F.count(F.lit(1)).alias("cells")).withColumn("side", F.lit("missing"))
    extra = b.join(a, list(key), "left_anti").agg(F.count(F.lit(1)).alias("cells")).withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra).select("side", "cells")


def precedence(sources: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Rows of several sources, the earlier source winning a key: later ones fill gaps only."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select(*key).distinct(), list(key), "left_anti"))
    return out


def conflicts(log: DataFrame, key: Sequence[str], good: Column, value: str) -> DataFrame:
    """Keys whose good attempts disagree: ``key, versions``."""
    versions = log.where(good).select(*key, value).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("versions"))
    return versions.where("versions > 1")


def round_robin(rows: DataFrame, strata: Sequence[str], order: Sequence[Column], n: int | None) -> DataFrame:
    """Rows in turns over the sorted strata, first in order inside each; the first ``n`` or all.

    ``rn`` is the turn. A null stratum comes first. The limit is the feature: a pilot of n rows.
    """
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    kept = ranked if n is None else ranked.where(F.col("rn") <= n).orderBy("rn", *(F.col(s).asc_nulls_first() for s in strata)).limit(n)
    return kept


def paired(rows: DataFrame, condition: str, a: str, b: str, match: Sequence[str], contract: Sequence[str]) -> DataFrame:
    """Pairs of one row under each of two conditions, equal in ``match``, with ``ok`` where ``contract`` agrees.

    A null in ``match`` pairs nothing. A null in ``contract`` never agrees.
    """
    other = [c for c in rows.columns if c not in match]
    left = rows.where(F.col(condition) == a).select(*match, *(F.col(c).alias(f"{c}_a") for c in other))
    right = rows.where(F.col(condition) == b).select(*match, *(F.col(c).alias(f"{c}_b") for c in other))
    ok = F.lit(True)
    for c in contract:
        ok = ok & F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False))
    return left.join(right, list(match)).withColumn("ok", ok)


def non_report(text: Column, echo: Sequence[str]) -> Column:
    """``empty``, ``schema_echo`` (no words beyond the schema's own) or null for a report."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z_]+"), F.lit(0))
    blank = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
    return F.when(blank, "empty").when((F.size(tokens) > 0) & (F.size(F.array_except(tokens, F.array(*map(F.lit, echo)))) == 0), "schema_echo")
