"""Mixing sources to target weights, in tokens of a public tokenizer.

Texts get a hash-random key and are range-bucketed by it within their source. Token sums per bucket give each
bucket its offset, a running sum inside the bucket gives each text its exact position, and a source is cut where
its budget ends; whole epochs come before the cut where the budget is larger than the source.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.session import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts in one bucket of a source, on average.
BUCKET_TEXTS = 20_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each text; null has none. Special tokens in a text are ordinary text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(vocabulary)
        for texts in batches:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0)

    return count(text)


def source_name(column: str = "source") -> Column:
    """A source without letter case, outer blanks and the choice between hyphen, blank and underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"^[\s ]+|[\s ]+$", "")), r"[\s-]+", "_")


def _shares(available: DataFrame, targets: DataFrame, total_tokens: int | None) -> tuple[list[dict], int]:
    """The budget of each target source; at most one row per target is collected."""
    rows = [r.asDict() for r in targets.select(source_name().alias("source"), "target_share", "max_repeats").join(available, "source", "left").orderBy("source").collect()]
    for r in rows:
        r["tokens"], r["texts"] = r["tokens"] or 0, r["texts"] or 0
    full = [r["tokens"] * r["max_repeats"] / r["target_share"] for r in rows if r["tokens"] and r["target_share"] > 0]
    total = total_tokens if total_tokens is not None else math.floor(min(full, default=0))
    for r in rows:
        r["budget"] = min(math.floor(total * r["target_share"]), r["tokens"] * r["max_repeats"])
    return rows, total


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """``(mix, shares)``. ``mix``: doc_id, source, tokens, repeats. ``shares``: what each target really reached.

    A text counts once however often and under whichever source it is stored: its smallest doc_id speaks for it.
    Null, empty and untargeted texts are left out. ``total_tokens`` defaults to the largest total at which every
    present source fills its share within its repeats; a given larger total leaves the short sources at all they
    have. A source ends at the last text that still fits its budget, so it misses it by less than one text.
    ``max_repeats`` below 1 and a share of 0 give nothing. Ties in the hash key are ordered by doc_id.
    """
    named = documents.where("length(text) > 0").select("doc_id", source_name().alias("source"), "text")
    wanted = targets.select(source_name().alias("source")).distinct()
    # one row per text: the smallest doc_id, found by 128 bits of the text with a map-side combined min
    keyed = named.join(wanted, "source", "left_semi").withColumn("_k", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(3), "text")))
    once = keyed.groupBy("_k").agg(F.min(F.struct("doc_id", "source")).alias("f")).select("f.doc_id", "f.source")
    counted = materialise(named.join(once, ["doc_id", "source"], "left_semi").select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("tokens")), "tokens")
    rows, total = _shares(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("texts")), targets, total_tokens)
    spark = documents.sparkSession
    plan = spark.createDataFrame(
        [(r["source"], max(1, r["texts"] // BUCKET_TEXTS), r["budget"] // max(1, r["tokens"]), r["budget"] % max(1, r["tokens"])) for r in rows],
        "source string, buckets long, epochs long, rest long",
    )
    key = F.xxhash64(F.lit(seed), "doc_id")
    # the top bits of the key give its range bucket, so buckets are in key order
    placed = counted.join(F.broadcast(plan), "source").withColumn("_h", key).withColumn("_b", F.shiftrightunsigned("_h", 33) * F.col("buckets") / F.lit(1 << 31))
    placed = placed.withColumn("_b", F.floor("_b"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("source", "_b").agg(F.sum("tokens").alias("t")).select("source", "_b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_before"))
    order = [F.shiftrightunsigned("_h", 33), F.col("_h"), F.col("doc_id")]
    inside = Window.partitionBy("source", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    reached = placed.withColumn("_sum", F.sum("tokens").over(inside)).join(offsets, ["source", "_b"]).withColumn("_end", F.col("_before") + F.col("_sum"))
    mix = reached.select("doc_id", "source", "tokens", (F.col("epochs") + (F.col("_end") <= F.col("rest")).cast("long")).cast("int").alias("repeats")).where("repeats > 0")
    wanted_rows = spark.createDataFrame(
        [(r["source"], float(r["target_share"]), int(r["max_repeats"]), int(r["tokens"]), int(math.floor(total * r["target_share"]))) for r in rows],
        "source string, target_share double, max_repeats int, available_tokens long, target_tokens long",
    )
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    shares = wanted_rows.join(used, "source", "left").na.fill(0, ["used_tokens", "most_repeats"])
    whole = F.sum("used_tokens").over(Window.partitionBy())
    shares = shares.withColumn("reached_share", F.when(whole > 0, F.col("used_tokens") / whole).otherwise(0.0))
    return mix, shares
