"""Partitions without leakage, study linkage and deduplication by identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.identity import patient_split, uid


def split_leakage(rows: DataFrame, subject: Column, split: Column) -> DataFrame:
    """``subject, n_splits`` of every subject in more than one split; null subjects and splits leak nothing."""
    found = rows.select(subject.alias("subject"), split.alias("split")).where("subject IS NOT NULL AND split IS NOT NULL").distinct()
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("n_splits")).where("n_splits > 1")


def split_overlap(rows: DataFrame, subject: str, split: str) -> DataFrame:
    """``split_a, split_b, shared``: subjects that two splits share, by a join on the subject."""
    found = rows.select(F.col(subject).alias("s"), F.col(split).alias("p")).where("s IS NOT NULL AND p IS NOT NULL").distinct()
    a, b = found.select("s", F.col("p").alias("split_a")), found.select("s", F.col("p").alias("split_b"))
    return a.join(b, "s").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))


def protected_partition(rows: DataFrame, subject: str, protected: DataFrame, seed: str) -> DataFrame:
    """``rows`` with ``partition``: ``removed`` for protected subjects, ``quarantine`` for unknown ones, else a hashed split.

    The protected side is made distinct first; a hot subject stays spread out as its other side has one row.
    """
    known = protected.select(uid(F.col(protected.columns[0])).alias("_u")).where("_u IS NOT NULL").distinct().withColumn("_held", F.lit(True))
    joined = rows.withColumn("_u", uid(subject)).join(known, "_u", "left")
    part = F.when(F.col("_u").isNull(), "quarantine").when(F.col("_held"), "removed").otherwise(patient_split(F.col("_u"), seed))
    return joined.withColumn("partition", part).drop("_u", "_held")


def identity_ladder(rows: DataFrame, sources: Sequence[tuple[str, Column]], target: str = "identity") -> DataFrame:
    """The first known identity of several sources with its provenance; rows without one are ``rejected``."""
    found = [uid(c) for _, c in sources]
    provenance = F.lit("rejected")
    for (name, _), c in reversed(list(zip(sources, found, strict=True))):
        provenance = F.when(c.isNotNull(), name).otherwise(provenance)
    return rows.withColumn(target, F.coalesce(*found)).withColumn("identity_provenance", provenance)


def first_per_identity(rows: DataFrame, identity: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``kept``: the first row of each identity, the first known of several columns.

    The order must be total. Rows without identity are kept. The first comes from a combined ``min``, not a sort.
    """
    key = F.coalesce(*(c.cast("string") for c in identity))
    named = rows.withColumn("_k", key).withColumn("_o", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    first = named.where("_k IS NOT NULL").groupBy("_k").agg(F.min("_o").alias("_first"))
    return named.join(first, "_k", "left").withColumn("kept", F.col("_k").isNull() | (F.col("_o") == F.col("_first"))).drop("_k", "_o", "_first")


def identity_conflicts(rows: DataFrame, identity: str, owner: str) -> DataFrame:
    """Identities that several owners claim: ``identity, owners``."""
    pairs = rows.select(F.col(identity).alias("identity"), F.col(owner).alias("o")).where("identity IS NOT NULL AND o IS NOT NULL").distinct()
    return pairs.groupBy("identity").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")


def linked(rows: DataFrame, studies: Sequence[tuple[str, DataFrame, str, Sequence[str]]], on: Sequence[str] | None = None) -> DataFrame:
    """Left lookups of several study tables, each ``(name, table, key, columns)``, with a flag ``has_<name>``.

    ``on`` names the column of ``rows`` that meets each key; without it the names are the same. A study table must have
    one row per key; its columns come out under ``<name>_<column>``, so equal names don't clash. A null key finds nothing.
    """
    out = rows
    for (name, found, key, columns), mine in zip(studies, on or [s[2] for s in studies], strict=True):
        side = found.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *(F.col(c).alias(f"{name}_{c}") for c in columns), F.lit(True).alias(f"has_{name}"))
        out = out.join(side, F.col(mine) == F.col("_key"), "left").drop("_key").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return out


def contract(rows: DataFrame, required: Sequence[str], key: Sequence[str]) -> DataFrame:
    """One row ``rows, null_<column> ..., duplicate_keys``: what a manifest must show before use."""
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required))
    twice = rows.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_keys"))
    return counts.crossJoin(twice)  # one row each


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that is first in ``order``, by a combined ``min_by`` over the packed row."""
    packed = F.struct(*(F.col(c) for c in rows.columns if c not in key))
    ranked = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    best = rows.groupBy(*key).agg(F.min_by(packed, ranked).alias("_r"))
    return best.select(*key, "_r.*")


def merged(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of both tables, the new one's where both have a key."""
    return new.unionByName(old.join(new.select(*key).distinct(), list(key), "left_anti"), allowMissingColumns=True)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other; empty if nothing was lost or added."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def ranked_in_order(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
