"""Usage and distribution of vector codes per chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.labels import ratio


def chunk_counts(rows: DataFrame, codes: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, chunk, code, n``: how often each code occurs in each chunk; -1 (not encoded) is left out."""
    return rows.select(*by, F.posexplode(codes).alias("chunk", "code")).where("code >= 0").groupBy(*by, "chunk", "code").agg(F.count(F.lit(1)).alias("n"))


def code_usage(rows: DataFrame, codes: str, total_codes: int) -> DataFrame:
    """``chunk, used, dead, top_share, perplexity, utilization`` of each chunk."""
    counts = chunk_counts(rows, codes)
    whole = counts.groupBy("chunk").agg(F.sum("n").alias("t"))
    p = counts.join(whole, "chunk").withColumn("p", F.col("n") / F.col("t"))
    per = p.groupBy("chunk").agg(F.count(F.lit(1)).alias("used"), F.max("p").alias("top"), F.exp(-F.sum(F.col("p") * F.ln("p"))).alias("perp"))
    return per.select(
        "chunk",
        "used",
        (total_codes - F.col("used")).alias("dead"),
        F.round("top", 9).alias("top_share"),
        F.round("perp", 6).alias("perplexity"),
        F.round(F.col("used") / total_codes, 9).alias("utilization"),
    )


def unique_sequences(rows: DataFrame, codes: str) -> DataFrame:
    """One row ``rows, sequences, unique_fraction`` over whole code sequences."""
    per = rows.where(F.col(codes).isNotNull()).groupBy(codes).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("sequences"))
    return total.select("rows", "sequences", F.round(ratio(F.col("sequences"), F.col("rows")), 9).alias("unique_fraction"))


def code_divergence(rows: DataFrame, codes: str, side: str) -> DataFrame:
    """``chunk, js``: Jensen-Shannon divergence of the two sides' code histograms; ``side`` is boolean."""
    counts = chunk_counts(rows, codes, (side,))
    whole = counts.groupBy("chunk").agg(F.sum(F.when(F.col(side), F.col("n"))).alias("ta"), F.sum(F.when(~F.col(side), F.col("n"))).alias("tb"))
    both = counts.groupBy("chunk", "code").agg(F.sum(F.when(F.col(side), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col(side), F.col("n")).otherwise(0)).alias("b"))
    pq = both.join(whole, "chunk").select("chunk", (F.col("a") / F.greatest("ta", F.lit(1))).alias("p"), (F.col("b") / F.greatest("tb", F.lit(1))).alias("q"))
    mid, eps = (F.col("p") + F.col("q")) / 2, 1e-12
    half = lambda x: F.col(x) * (F.ln(F.col(x) + eps) - F.ln(mid + eps)) / 2
    return pq.groupBy("chunk").agg(F.round(F.sum(half("p") + half("q")), 9).alias("js"))


def code_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``rows, chunk_rate, sequence_rate`` of two code sequences of each row."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("double"))
    share = F.aggregate(same, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(share), 9).alias("chunk_rate"), F.round(F.avg((F.col(a) == F.col(b)).cast("double")), 9).alias("sequence_rate"))
