"""Checked linkage: one-to-one joins, identities that must agree, constant identities, frozen signatures and first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.identity import signature


def repeated_keys(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """``on, n`` of the keys that occur more than once. A key with a null is no key."""
    known = rows.dropna(subset=list(on))
    return known.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(joined, problems)``: the inner join of the keys that are unique on both sides, and ``side, on, n`` of those that are not.

    Repeated keys are counted before anything is joined, so a hot key is never multiplied. Null keys join nothing.
    """
    a, b = repeated_keys(left, on), repeated_keys(right, on)
    keep = lambda df: df.join(a, list(on), "left_anti").join(b, list(on), "left_anti")
    problems = a.select(F.lit("left").alias("side"), *on, "n").unionByName(b.select(F.lit("right").alias("side"), *on, "n"))
    return keep(left).join(keep(right), list(on)), problems


def identity_join(left: DataFrame, right: DataFrame, on: Sequence[str], identity: Sequence[str], state: str = "state") -> DataFrame:
    """The left join with a ``state``: ``missing`` partner, ``conflict`` in an identity column, or ``ok``.

    Identity columns exist on both sides and compare as trimmed text; two nulls agree, one null does not. The right side's
    come back as ``<name>_right``. Keys of the right side should be unique (see :func:`one_to_one`); a null key is missing.
    """
    text = lambda c: F.trim(c.cast("string"))
    rest = [c for c in right.columns if c not in (*on, *identity)]
    r = right.select(*on, *(F.col(c).alias(f"{c}_right") for c in identity), *rest, F.lit(True).alias("_there"))
    same = F.lit(True)
    for c in identity:
        same = same & text(F.col(c)).eqNullSafe(text(F.col(f"{c}_right")))
    known = F.when(F.col("_there").isNull(), "missing").when(~same, "conflict").otherwise("ok")
    return left.join(r, list(on), "left").withColumn(state, known).drop("_there")


def agreement(*values: Column) -> Column:
    """``agree`` or ``conflict`` of several sources of one identity, or ``unknown`` where fewer than two are known."""
    known = F.array_compact(F.array(*(F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values)))
    return F.when(F.size(known) < 2, "unknown").when(F.size(F.array_distinct(known)) == 1, "agree").otherwise("conflict")


def first_text(keys: Sequence[Column], parts: Sequence[Column] = ()) -> Column:
    """The first non-blank text, else the non-blank ``parts`` joined by a blank, else null."""
    plain = lambda c: F.nullif(F.trim(c), F.lit(""))
    joined = F.nullif(F.concat_ws(" ", *map(plain, parts)), F.lit("")) if parts else F.lit(None).cast("string")
    return F.coalesce(*map(plain, keys), joined)


def varying_identity(rows: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """``key, versions`` of the keys whose known identity is not constant. Null keys and wholly null identities don't count."""
    known = rows.where(F.col(key).isNotNull()).select(key, F.struct(*(F.col(c).cast("string").alias(c) for c in identity)).alias("_i"))
    some = F.lit(False)
    for c in identity:
        some = some | F.col(f"_i.{c}").isNotNull()
    versions = known.where(some).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("versions"))
    return versions.where("versions > 1")


def signature_state(rows: DataFrame, columns: Sequence[str], stored: str, state: str = "state") -> DataFrame:
    """Rows with the state of their stored signature: ``missing``, ``changed`` or ``ok`` against one computed anew."""
    anew = signature(*columns)
    return rows.withColumn(state, F.when(F.col(stored).isNull(), "missing").when(F.col(stored) != anew, "changed").otherwise("ok"))


def order_problems(left: DataFrame, right: DataFrame, position: str, key: str) -> DataFrame:
    """``position, left_key, right_key`` where two tables that must be in the same order differ, also by length."""
    a, b = left.select(position, F.col(key).alias("left_key")), right.select(position, F.col(key).alias("right_key"))
    return a.join(b, position, "full").where(~F.col("left_key").eqNullSafe(F.col("right_key")))


def largest_gap(a: Column, b: Column) -> Column:
    """The largest absolute difference of two arrays; infinite where the widths differ or one side has no number, 0 for two nulls."""
    one = lambda x, y: F.when(x.isNull() & y.isNull(), 0.0).otherwise(F.coalesce(F.abs(x.cast("double") - y.cast("double")), F.lit(float("inf"))))
    gap = F.coalesce(F.array_max(F.zip_with(a, b, one)), F.lit(0.0))
    return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), float("inf")).otherwise(gap)


def first_per_key(rows: DataFrame, key: str, order: str, vector: str, tolerance: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """``(first, disagreeing)``: the first row of each key, and ``key, rows, gap`` where later rows' vectors differ from it.

    The first row is a combined ``min_by``; each row then meets one row of its key, so a hot key is neither sorted nor gathered.
    Null keys are left out; ties in ``order`` must not occur.
    """
    known = rows.where(F.col(key).isNotNull())
    row = F.struct(*(c for c in rows.columns if c != key))
    first = known.groupBy(key).agg(F.min_by(row, order).alias("_r")).select(key, "_r.*").select(rows.columns)
    met = known.select(key, F.col(vector).alias("_v")).join(first.select(key, F.col(vector).alias("_f")), key)
    gaps = met.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.max(largest_gap(F.col("_v"), F.col("_f"))).alias("gap"))
    return first, gaps.where(F.col("gap") > tolerance)


def salient(values: Column, lower: float, upper: float, middle: float, limit: int = 12, tolerance: float = 1e-7) -> Column:
    """The positions whose value is at most ``lower`` or at least ``upper``, farthest from ``middle`` first, at most ``limit``.

    Structs of ``i``, ``x`` and ``direction``; limits are inclusive within ``tolerance``; ties go to the smaller position. Nulls
    and NaN have no direction.
    """
    x = lambda v: v.cast("double")
    coded = F.transform(values, lambda v, i: F.struct(-F.abs(x(v) - middle), i.alias("i"), x(v).alias("x"), F.when(F.isnan(x(v)), None).when(x(v) <= lower + tolerance, "low").when(x(v) >= upper - tolerance, "high").alias("direction")))
    found = F.array_sort(F.filter(coded, lambda c: c["direction"].isNotNull()))
    return F.slice(F.transform(found, lambda c: F.struct(c["i"].alias("i"), c["x"].alias("x"), c["direction"].alias("direction"))), 1, limit)


def imputation_problems(rows: DataFrame, key: str, values: str, mask: str, means: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """``key, i, problem``: masked-out positions that don't hold the mean, observed ones without a number, masks that are neither 0 nor 1.

    ``means``: ``i, mean``, one row per position, which is the size of the join's other side.
    """
    cells = rows.select(key, F.posexplode(F.arrays_zip(F.col(values).alias("x"), F.col(mask).alias("o"))).alias("i", "c")).select(key, "i", "c.x", "c.o")
    met = cells.join(means.select("i", "mean"), "i", "left")
    off = F.coalesce(F.abs(F.col("x") - F.col("mean")) > tolerance, F.lit(True))
    problem = F.when(F.coalesce(~F.col("o").isin(0, 1), F.lit(True)), "mask").when((F.col("o") == 1) & (F.col("x").isNull() | F.isnan("x")), "observed").when((F.col("o") == 0) & off, "imputed")
    return met.select(key, "i", problem.alias("problem")).where("problem IS NOT NULL")
