"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def finite(v: Column) -> Column:
    """Whether a vector is there and all of it is finite."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def usable(v: Column, dim: int | None = None) -> Column:
    """Finite, not all zero and, if asked for, of one length."""
    ok = finite(v) & F.exists(v, lambda x: x != 0)
    return ok & (F.size(v) == dim) if dim else ok


def unit(v: Column) -> Column:
    """The vector over its length; null for vectors that have none."""
    norm = F.sqrt(dot(v, v))
    return F.when(usable(v), F.transform(v, lambda x: x.cast("double") / norm))


def mean_vector(*vectors: Column) -> Column:
    """The equal-weight mean of vectors of one length; null if one is null."""
    total = doubles(vectors[0])
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda x, y: x + y.cast("double"))
    return F.transform(total, lambda x: x / len(vectors))


def lab_encode(percentiles: Column, observed: Column) -> Column:
    """Observed percentiles, one half elsewhere, followed by the observation flags."""
    values = F.zip_with(percentiles, observed, lambda p, o: F.when(o == 1, p).otherwise(F.lit(0.5).cast("float")))
    return F.concat(values, F.transform(observed, lambda o: o.cast("float")))


def mask_only(labs: Column, n: int) -> Column:
    """Lab vectors that keep the flags and forget the values."""
    return F.concat(F.array_repeat(F.lit(0.5).cast("float"), n), F.slice(labs, n + 1, n))


def lab_direction(percentile: Column, low: float = 0.1, high: float = 0.9, atol: float = 1e-7) -> Column:
    """low, high or middle; the limits belong to the outside within the tolerance."""
    return F.when(percentile <= low + atol, "low").when(percentile >= high - atol, "high").otherwise("middle")


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def chance_hit(n: Column, p: Column, k: Column) -> Column:
    """Probability that k draws without replacement from n meet one of p; 0 without positives, 1 if they can't be missed."""
    miss = F.aggregate(F.sequence(F.lit(0), F.least(k, n) - 1), F.lit(1.0), lambda acc, o: acc * (n - p - o) / (n - o))
    return F.when((p <= 0) | (k <= 0) | (n <= 0), 0.0).when(n - p < F.least(k, n), 1.0).otherwise(1 - miss)


def sign_codes(v: Column, chunk: int) -> Column:
    """One code per chunk of a vector: its pattern of positive signs, first value lowest."""
    n = F.floor(F.size(v) / chunk).cast("int")

    def code(i: Column) -> Column:
        part = F.slice(v, i * chunk + 1, chunk)
        bits = F.transform(part, lambda x, j: F.when(x > 0, F.pow(F.lit(2.0), j)).otherwise(0.0))
        return F.aggregate(bits, F.lit(0.0), lambda s, x: s + x).cast("int")

    return F.transform(F.sequence(F.lit(0), n - 1), code)


def nearest_codes(v: Column, codebook: Sequence[Sequence[float]], width: int) -> Column:
    """For each chunk of ``width`` values the number of the code with the largest cosine; ties go to the smaller number.

    The codebook is a literal of fixed size. A chunk without direction takes code 0; a null vector has no codes, and a last
    shorter chunk is left out.
    """
    unit_codes = [[float(x) / (sum(y * y for y in c) ** 0.5 or 1.0) for x in c] for c in codebook]
    codes = F.array(*(F.array(*map(F.lit, c)) for c in unit_codes))
    chunk = lambda i: F.transform(F.slice(v, i * width + 1, width), lambda x: x.cast("double"))
    score = lambda c, code: F.aggregate(F.zip_with(c, code, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = lambda c: F.array_max(F.transform(codes, lambda code, i: F.struct(F.round(score(c, code), 12).alias("s"), (-i).alias("i"))))
    n = F.floor(F.size(v) / width).cast("int")
    return F.when(v.isNull(), None).when(n < 1, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: -best(chunk(i))["i"]))
