"""Deterministic evidence text for prompts, from nested anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capped(text: Column, cap: int, blank: str = "unavailable") -> Column:
    return F.coalesce(F.nullif(F.substring(F.coalesce(text, F.lit("")), 1, cap), F.lit("")), F.lit(blank))


def anchor_block(anchor_id: Column, linkage: Column, ecg: Column, labs: Column, labels: Column, report: Column, keep: Column, cap: int = 1800) -> Column:
    """One anchor as text: a head line and a line for each component in ``keep``, each cut at ``cap`` characters."""
    named = F.coalesce(F.nullif(F.array_join(labels, ", "), F.lit("")), F.lit("none listed"))
    has = lambda x: F.array_contains(keep, x)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Anchor "), anchor_id, F.lit(" (other patient; "), F.coalesce(linkage, F.lit("unknown")), F.lit(")")),
        F.when(has("ecg"), F.concat(F.lit("ECG statements: "), capped(ecg, cap))),
        F.when(has("labs"), F.concat(F.lit("Laboratory ranks: "), capped(labs, cap))),
        F.when(has("cxr"), F.concat(F.lit("Radiograph labels: "), named, F.lit(". Radiograph report: "), capped(report, cap))),
    )


def joined_blocks(blocks: Column) -> Column:
    return F.array_join(blocks, "\n\n")


def compact_blocks(blocks: Column, budget: int) -> Column:
    """Blocks in order until the budget of characters is used up; the last is cut, the line ends between are free."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        part = F.substring(x, F.lit(1), F.greatest(F.lit(budget) - acc["used"], F.lit(0)))
        return F.struct(F.when(part == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(part))).alias("out"), (acc["used"] + F.length(part)).alias("used"))

    return F.aggregate(blocks, start, step, lambda acc: F.array_join(acc["out"], "\n"))


def evidence_lines(prompt: Column) -> Column:
    """The lines of a prompt that carry evidence."""
    return F.filter(F.split(F.coalesce(prompt, F.lit("")), "\n"), lambda x: x.rlike(r"^\s*(?:ECG|CXR)\b"))


def evidence_length(*texts: Column) -> Column:
    """Characters of all evidence texts of an anchor; null counts nothing."""
    total = F.lit(0)
    for t in texts:
        total = total + F.coalesce(F.length(t), F.lit(0))
    return total
