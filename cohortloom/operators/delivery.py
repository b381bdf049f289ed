"""At-least-once deliveries: one copy of each message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise

#: White space at either end, the no-break space included.
OUTER_SPACE = r"^[\s ]+|[\s ]+$"


def folded(column: str | Column) -> Column:
    """An identifier without letter case and outer white space; null stays null."""
    return F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, OUTER_SPACE, ""))


def _identified(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``__key``: 128 bits of the folded keys, null where any key is null; ``__place``: the order of copies.

    A null order value ranks last, as a copy without a time can't be shown to be the first. Behind the order stand
    128 bits of the whole row, so that only rows equal in every column have an equal place.
    """
    parts = [folded(k) for k in keys]
    known = parts[0].isNotNull()
    for part in parts[1:]:
        known = known & part.isNotNull()
    ranked = [x for i, o in enumerate(order) for x in (F.col(o).isNull().alias(f"u{i}"), F.col(o).alias(f"o{i}"))]
    whole = [F.array_sort(F.map_entries(c)) if t.startswith("map") else F.col(c) for c, t in df.dtypes]
    joined = F.concat_ws("\u0001", *parts)
    return df.select(
        "*",
        F.when(known, F.struct(F.xxhash64(joined).alias("a"), F.xxhash64(F.lit("salt"), joined).alias("b"))).alias("__key"),
        F.struct(*ranked, F.xxhash64(*whole).alias("a"), F.xxhash64(F.lit("salt"), *whole).alias("b")).alias("__place"),
    )


def repeated_identifiers(rows: DataFrame) -> DataFrame:
    """``__key`` of every identifier that occurs more than once, by its frequency counted before the shuffle; written once."""
    counted = rows.where("__key IS NOT NULL").groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    return materialise(counted.where("__n > 1").select("__key"), "repeated")


def split_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(kept, surplus)``: exactly one copy of each message, and all others.

    Identifiers are split by their aggregated frequency. Rows with a null key and singletons (an anti join with the
    repeated identifiers) pass without being ranked; only rows of repeated identifiers are, and both results are united.
    No group is sorted or gathered in one task: the first copy is a ``min`` that is combined before the shuffle, and the
    rows of a hot identifier meet one row each, which adaptive execution splits. A copy that is equal in every column is a
    surplus copy as often as it came again; if rows tie in ``order`` and differ elsewhere, a hash of the row decides. Empty
    input gives two empty frames; other columns pass through unchanged.
    """
    columns = df.columns
    rows = _identified(df, keys, order)
    repeated = repeated_identifiers(rows)
    alone = rows.where("__key IS NULL").unionByName(rows.where("__key IS NOT NULL").join(repeated, "__key", "left_anti").select(rows.columns))
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    unpacked = [F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)]
    # rows of repeated identifiers, equal ones as one with their number
    ranked = rows.where("__key IS NOT NULL").join(repeated, "__key", "left_semi").groupBy("__key", "__place").agg(F.first(row).alias("r"), F.count(F.lit(1)).alias("__n"))
    ranked = materialise(ranked, "ranked")
    kept = alone.select(columns).unionByName(ranked.groupBy("__key").agg(F.min_by("r", "__place").alias("r")).select(unpacked))
    first = ranked.groupBy("__key").agg(F.min("__place").alias("__first"))
    copies = F.col("__n") - (F.col("__place") == F.col("__first")).cast("int")
    surplus = ranked.join(first, "__key").withColumn("__n", copies).where("__n > 0").select("r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(unpacked)
    return kept, surplus


def surplus_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str], id_column: str) -> DataFrame:
    """The ids of the surplus copies (see :func:`split_copies`)."""
    need = list(dict.fromkeys([*keys, *order, id_column]))
    return split_copies(df.select(need), keys, order)[1].select(id_column)


def merge_new(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The kept copies over all stored and new messages: singletons pass, repeated groups are ranked once."""
    return split_copies(stored.unionByName(new, allowMissingColumns=True), keys, order)[0]
