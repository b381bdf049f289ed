"""Context grids: which components of which anchors each condition keeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Condition, whether it keeps the same modality, the labs and the cross modality.
CONDITIONS = [
    ("zero_shot", False, False, False),
    ("same_only", True, False, False),
    ("same_labs", True, True, False),
    ("same_cross", True, False, True),
    ("full_trimodal", True, True, True),
    ("full_random", True, True, True),
    ("full_trimodal_gated", True, True, True),
]
# The arms of the review study.
REVIEW_ARMS = ["zero_shot", "raw_ecg_same", "raw_ecg_full", "bridge_ecg_same", "trimodal_same", "trimodal_full", "trimodal_broken"]


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONDITIONS, "condition string, same boolean, labs boolean, cross boolean")


def kept_components(direction: Column, gate: Column) -> Column:
    """Names of the components an anchor keeps under the row's condition; a closed gate falls back to the same modality."""
    gated = F.col("condition") == "full_trimodal_gated"
    open_ = ~gated | F.coalesce(gate, F.lit(False))
    same, cross = F.when(direction == "ecg", "ecg").otherwise("cxr"), F.when(direction == "ecg", "cxr").otherwise("ecg")
    parts = F.array(F.when(F.col("same"), same), F.when(F.col("labs") & open_, F.lit("labs")), F.when(F.col("cross") & open_, cross))
    return F.array_compact(parts)


def condition_grid(anchors: DataFrame, threshold: float) -> DataFrame:
    """``query_id, direction, condition, components, anchor_ids`` from ranked anchors and a fixed margin threshold.

    ``anchors``: query_id, direction, margin, rank, cand_id. The condition table has seven rows and is the broadcast
    side; ``zero_shot`` has no anchors, and ``full_random`` is built from its own anchors by the caller.
    """
    grid = anchors.sparkSession
    per = anchors.groupBy("query_id", "direction", "margin").agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))).alias("a"))
    rows = per.crossJoin(F.broadcast(conditions(grid))).where("condition <> 'full_random'")
    ids = F.when(F.col("condition") == "zero_shot", F.array().cast("array<bigint>")).otherwise(F.transform("a", lambda x: x["cand_id"]))
    gate = F.col("margin") >= threshold
    return rows.select("query_id", "direction", "condition", kept_components(F.col("direction"), gate).alias("components"), ids.alias("anchor_ids"))


def full_grid(anchors: DataFrame, threshold: float, controls: Mapping[str, DataFrame]) -> DataFrame:
    """:func:`condition_grid` with the control conditions: each keeps all components of anchors of its own.

    ``controls``: condition (``full_random`` or ``full_`` with the name of a control bank) to ``query_id, rank, cand_id``. A
    query without anchors of a control has no row of it.
    """
    out = condition_grid(anchors, threshold)
    queries = anchors.select("query_id", "direction").distinct()
    full = F.when(F.col("direction") == "ecg", F.array(F.lit("ecg"), F.lit("labs"), F.lit("cxr"))).otherwise(F.array(F.lit("cxr"), F.lit("labs"), F.lit("ecg")))
    for condition, own in controls.items():
        per = own.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))), lambda x: x["cand_id"]).alias("anchor_ids"))
        out = out.unionByName(queries.join(per, "query_id").select("query_id", "direction", F.lit(condition).alias("condition"), full.alias("components"), "anchor_ids"))
    return out


def review_arms(queries: DataFrame, raw: DataFrame, single: DataFrame, joint: DataFrame, donors: DataFrame) -> DataFrame:
    """``query_id, condition, components, anchor_ids, donor_ids``: the seven arms from three retrievers.

    ``raw``, ``single`` and ``joint``: ``query_id, rank, cand_id`` by the raw vectors, the bridged single modality and the joint
    mean; ``donors``: ``query_id, rank, donor_id``, whose other components replace those of the joint anchors in the broken
    arm. A query without anchors keeps the arm with an empty list.
    """
    listed = lambda df, c: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]).alias("ids"))
    sources = {"raw_ecg_same": raw, "raw_ecg_full": raw, "bridge_ecg_same": single, "trimodal_same": joint, "trimodal_full": joint, "trimodal_broken": joint}
    none, out = F.array().cast("array<bigint>"), None
    for arm in REVIEW_ARMS:
        parts = [] if arm == "zero_shot" else ["ecg"] if arm.endswith("same") else ["ecg", "labs", "cxr"]
        rows = queries.select("query_id")
        rows = rows.join(listed(sources[arm], "cand_id"), "query_id", "left") if arm in sources else rows.withColumn("ids", none)
        rows = rows.join(listed(donors, "donor_id").withColumnRenamed("ids", "moved"), "query_id", "left") if arm == "trimodal_broken" else rows.withColumn("moved", none)
        kept = F.array(*map(F.lit, parts)).cast("array<string>")
        rows = rows.select("query_id", F.lit(arm).alias("condition"), kept.alias("components"), F.coalesce("ids", none).alias("anchor_ids"), F.coalesce("moved", none).alias("donor_ids"))
        out = rows if out is None else out.unionByName(rows)
    return out


def rendered_tasks(contexts: DataFrame, subset: Column, renderings: Sequence[str], default: str) -> DataFrame:
    """The tasks of each context: every rendering for the subset, the default one for the rest; a null ``subset`` is outside."""
    inside = F.coalesce(subset, F.lit(False))
    wanted = F.when(inside, F.array(*map(F.lit, renderings))).otherwise(F.array(F.lit(default)))
    return contexts.withColumn("rendering", F.explode(wanted))


def folded_condition(column: str = "condition") -> Column:
    return F.lower(F.trim(F.col(column)))


def cohort_balance(contexts: DataFrame, by: list[str], member: str) -> DataFrame:
    """``by, members, cohort``: a hash of the sorted distinct members of each cell, to compare cohorts across cells."""
    distinct = contexts.select(*by, F.col(member).cast("string").alias("m")).where("m IS NOT NULL").distinct()
    # an order-free sum of member hashes, so that no cell is gathered
    hashed = F.pmod(F.conv(F.substring(F.md5("m"), 1, 8), 16, 10).cast("long"), F.lit(2**31))
    return distinct.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), F.sum(hashed).alias("cohort"))


def evidence_problems(contexts: DataFrame, banked: DataFrame) -> DataFrame:
    """``delivery_id, problem``: anchors that are not in the bank, of the query's own subject, or repeated in a context."""
    exploded = contexts.select("delivery_id", "subject_id", F.explode("evidence").alias("e")).select("delivery_id", "subject_id", F.col("e.anchor_id").alias("anchor_id"))
    known = banked.groupBy(F.col("sample_id").alias("anchor_id")).agg(F.max("subject_id").alias("anchor_subject"))
    joined = exploded.join(known, "anchor_id", "left").withColumn("found", F.col("anchor_subject").isNotNull())
    own = joined.where(F.col("anchor_subject") == F.col("subject_id")).select("delivery_id", F.lit("own_subject").alias("problem"))
    twice = exploded.groupBy("delivery_id", "anchor_id").count().where("count > 1").select("delivery_id", F.lit("repeated_anchor").alias("problem"))
    lost = exploded.join(known, "anchor_id", "left_anti").select("delivery_id", F.lit("unknown_anchor").alias("problem"))
    return own.unionByName(twice).unionByName(lost).distinct()
