"""Identity normalisation, label folding, hashed splits and signatures, all as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing identity.
MISSING = ["", "nan", "none", "null", "<na>"]
#: Fixed value: the seed of the patient split.
SPLIT_SEED = "experiment4-global-patient-split"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uid(value: str | Column) -> Column:
    """An identity as text: missing spellings are null, whole numbers lose signs of padding, others are trimmed."""
    text = F.trim(_c(value).cast("string"))
    whole = text.rlike(r"^[+-]?\d{1,38}$")
    return F.when(F.lower(text).isin(MISSING), None).when(whole, F.when(whole, text).cast("decimal(38,0)").cast("string")).otherwise(text)


def positive_labels(labels: Column) -> Column:
    """Sorted labels of a map that are asserted (1, true, positive); -1 is unknown, 0 and null are not asserted."""
    return F.array_sort(F.map_keys(F.map_filter(labels, lambda k, v: F.lower(v.cast("string")).isin("1", "1.0", "true", "positive"))))


def truthy_labels(labels: Column) -> Column:
    """The older reading of a label map: everything but 0, false and null counts, so -1 stays a label."""
    return F.array_sort(F.map_keys(F.map_filter(labels, lambda k, v: v.isNotNull() & ~F.lower(v.cast("string")).isin("0", "0.0", "false", ""))))


def label_texts(text: Column) -> Column:
    """Labels written as a JSON list or separated by comma, semicolon, pipe or line end; null and blanks have none."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    listed = F.when(plain.startswith("["), F.from_json(plain, "array<string>"))
    split = F.split(plain, r"[,;|\n]")
    return listed_labels(F.filter(F.transform(F.coalesce(listed, split), lambda x: F.trim(x)), lambda x: x != ""))


def listed_labels(labels: Column) -> Column:
    """Sorted distinct labels of an array; null is empty."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.isNotNull())))


def reference_labels(labels: Column, known: Sequence[str], nothing: str = "No Finding") -> Column:
    """The known labels among ``labels``; the label for nothing goes where there is another."""
    kept = F.array_intersect(listed_labels(labels), F.array(*map(F.lit, known)))
    return F.when(F.size(kept) > 1, F.array_remove(kept, nothing)).otherwise(kept)


def only_id(path: str | Column, pattern: str) -> Column:
    """The id that a path names, null unless exactly one distinct match exists."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(_c(path), F.lit("")), F.lit(pattern), F.lit(1)))
    return F.when(F.size(found) == 1, found[0])


def alias_value(values: Column, aliases: Sequence[str]) -> Column:
    """The first of several field names in a string map, letter case and punctuation ignored."""
    plain = F.map_from_entries(F.transform(F.map_entries(values), lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", ""), e["value"])))
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(plain, F.lit(a))), F.lit("")) for a in aliases))


def _bucket(digest: Column, digits: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, digits), 16, 10).cast("decimal(20,0)"), F.lit(100)).cast("int")


def patient_split(subject: str | Column, seed: str = SPLIT_SEED) -> Column:
    """80/10/10 by a seeded hash of the identity; an unknown identity is quarantined."""
    who = uid(subject)
    bucket = _bucket(F.sha2(F.concat(F.lit(f"{seed}:"), who), 256), 12)
    return F.when(who.isNull(), "quarantine").when(bucket < 80, "train").when(bucket < 90, "val").otherwise("test")


def stable_split(key: str | Column) -> Column:
    """The older unseeded 80/10/10 split."""
    bucket = _bucket(F.sha1(_c(key).cast("string")), 8)
    return F.when(bucket < 80, "train").when(bucket < 90, "val").otherwise("test")


def top_bucket_split(subject: Column, admission: Column, sample: Column, val_percent: int = 10) -> Column:
    """train or val by the first known key; here val is the top of the range."""
    key = F.coalesce(uid(subject), uid(admission), sample.cast("string"))
    return F.when(_bucket(F.sha1(key), 8) >= 100 - val_percent, "val").otherwise("train")


def signature(*columns: str | Column) -> Column:
    """A hash over columns in the given order; null differs from every text. Comparable within this engine only."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(_c(c).cast("string"), F.lit("\u0000")) for c in columns)), 256)


def group_hash(*columns: str | Column) -> Column:
    """Fifteen hexadecimal digits that name a group of rows."""
    return F.substring(F.sha1(F.concat_ws("\u0001", *(F.coalesce(_c(c).cast("string"), F.lit("\u0000")) for c in columns))), 1, 15)


def strict_signature(*columns: str | Column) -> Column:
    """:func:`signature` that refuses values which are not finite: such rows fail the query."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.lower(_c(c).cast("string")).isin("nan", "infinity", "-infinity"), F.lit(False))
    return F.when(bad, F.raise_error(F.lit("a value to sign is not finite"))).otherwise(signature(*columns))


def path_safe(name: Column) -> Column:
    """Whether a name may be part of a path: letters, digits, underscore and hyphen, at most 80, not led by a mark."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_-]{0,79}\z"), F.lit(False))


def sequence_hash(items: Column) -> Column:
    """A hash of an array of texts in which no two different arrays share an encoding: items carry their lengths."""
    return F.sha2(F.array_join(F.transform(items, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ""), 256)
