"""Multi-label scores in long form: one row per key and label, unknown references kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(rows: DataFrame, keys: Sequence[str], truth: Column, predicted: Column, names: Sequence[str], known: Column | None = None) -> DataFrame:
    """``keys, label, y_true, y_pred``; ``y_true`` is -1 where a label is not in ``known``."""
    label = F.explode(F.array(*map(F.lit, names)))
    base = rows.select(*keys, truth.alias("_t"), predicted.alias("_p"), (known if known is not None else F.lit(None)).alias("_k")).withColumn("label", label)
    y = F.array_contains("_t", F.col("label")).cast("int")
    y_true = y if known is None else F.when(F.array_contains("_k", F.col("label")), y).otherwise(-1)
    return base.select(*keys, "label", F.coalesce(y_true, F.lit(0)).alias("y_true"), F.coalesce(F.array_contains("_p", F.col("label")).cast("int"), F.lit(0)).alias("y_pred"))


def _counts() -> list[Column]:
    t, p = F.col("y_true"), F.col("y_pred")
    return [
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == p) & (t >= 0)).alias("correct"),
        F.count_if(t >= 0).alias("known"),
        F.count_if(t == 1).alias("positive"),
    ]


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1): never null, never a division by zero."""
    return a / F.greatest(b, F.lit(1))


def per_label(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, precision, recall and F1 of each label; rates are null where no reference is known."""
    c = long.groupBy(*by, "label").agg(*_counts())
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rate = lambda x: F.when(F.col("known") > 0, F.round(x, 9))
    return c.select(
        *by,
        "label",
        F.col("known").alias("known_n"),
        F.col("positive").alias("positive_n"),
        "tp",
        "fp",
        "fn",
        rate(ratio(tp, tp + fp)).alias("precision"),
        rate(ratio(tp, tp + fn)).alias("recall"),
        rate(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def summary(long: DataFrame, by: Sequence[str], key: Sequence[str], known_only: bool = False) -> DataFrame:
    """Micro and macro F1, exact match, Hamming accuracy and its all-negative baseline per group.

    Macro F1 averages all labels, or with ``known_only`` those with a known reference. Rows are first reduced to
    their key, and labels to theirs, so both partial aggregates shuffle counts only.
    """
    labels = long.groupBy(*by, "label").agg(*_counts())
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    total = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "correct", "known", "positive")]
    macro = F.avg(F.when(F.col("known") > 0, f1)) if known_only else F.avg(f1)
    whole = labels.groupBy(*by).agg(*total, macro.alias("macro"))
    t, p = F.col("y_true"), F.col("y_pred")
    row = long.groupBy(*by, *key).agg(F.min(((t == p) | (t < 0)).cast("int")).alias("exact"), F.max((t == 1).cast("int")).alias("some"))
    rows = row.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("some") == 0).alias("empty_reference_n"), F.avg("exact").alias("exact"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    joined = whole.join(rows, list(by)) if by else whole.crossJoin(rows)
    out = {
        "micro_precision": ratio(tp, tp + fp),
        "micro_recall": ratio(tp, tp + fn),
        "micro_f1": ratio(2 * tp, 2 * tp + fp + fn),
        "macro_f1": F.col("macro"),
        "exact_match": F.col("exact"),
        "hamming_accuracy": ratio(F.col("correct"), F.col("known")),
        "all_negative_baseline": 1 - ratio(F.col("positive"), F.col("known")),
    }
    return joined.select(*by, "n", "empty_reference_n", *(F.round(v, 9).alias(k) for k, v in out.items()))


def row_rates(truth: Column, predicted: Column, context: Column | None = None) -> dict[str, Column]:
    """Discordance, omission and, given the labels of the context, support and attribution, per row."""
    extra, missed = F.array_except(predicted, truth), F.array_except(truth, predicted)
    out = {"discordance": ratio(F.size(extra), F.size(predicted)), "omission": ratio(F.size(missed), F.size(truth))}
    if context is not None:
        out["context_supported"] = ratio(F.size(F.array_intersect(predicted, context)), F.size(predicted))
        out["context_attributable"] = ratio(F.size(F.array_intersect(extra, context)), F.size(extra))
    return out


def citation_validity(cited: Column, sources: Column) -> Column:
    """Share of cited sources that exist; nothing cited is right only where there was nothing to cite."""
    valid = F.size(F.filter(cited, lambda x: F.array_contains(sources, x)))
    return F.when(F.size(cited) > 0, valid / F.size(cited)).when(F.size(sources) == 0, 1.0).otherwise(0.0)


def citations(rows: DataFrame, key: str, signature: str, cited: Column, sources: DataFrame) -> DataFrame:
    """``key, validity`` by :func:`citation_validity`'s rule, without gathering the sources of a signature.

    ``sources`` has ``signature`` and ``source``. Cited sources meet the distinct known ones as rows, so a signature with
    very many sources stays spread out. A null signature has no sources; nulls among the cited are cited in vain.
    """
    known = sources.select(F.col("signature").alias("_g"), F.col("source").alias("_s")).where("_g IS NOT NULL AND _s IS NOT NULL").distinct()
    some = known.select("_g").distinct().withColumn("_some", F.lit(True))
    base = rows.select(key, F.col(signature).alias("_g"), cited.alias("_c"))
    each = base.select(key, "_g", F.explode_outer("_c").alias("_s"), (F.size("_c") > 0).alias("_any"))
    met = each.join(known.withColumn("_ok", F.lit(1)), ["_g", "_s"], "left").join(some, "_g", "left")
    per = met.groupBy(key).agg(F.max("_any").alias("_any"), F.count("_ok").alias("_valid"), F.count(F.lit(1)).alias("_n"), F.max("_some").alias("_some"))
    return per.select(key, F.when(F.col("_any"), F.col("_valid") / F.col("_n")).when(F.col("_some"), 0.0).otherwise(1.0).alias("validity"))


def prevalence(rows: DataFrame, labels: Column, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``label, positive, n, prevalence`` of every named label, 0 for those that never occur."""
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    hits = rows.select(*by, F.explode(F.array_distinct(labels)).alias("label")).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("positive"))
    grid = total.select("*", F.explode(F.array(*map(F.lit, names))).alias("label"))
    joined = grid.join(hits, [*by, "label"], "left").withColumn("positive", F.coalesce("positive", F.lit(0)))
    return joined.select(*by, "label", "positive", "n", F.round(ratio(F.col("positive"), F.col("n")), 9).alias("prevalence"))
