"""Selection: candidate pools, best runs, concept relevance, label coverage and paired effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Conditions that a gate can pivot to columns.
MAX_CONDITIONS = 1000
# Concepts that a finding of the other modality goes with.
COMPATIBLE = [
    ("ventricular_hypertrophy", "cardiomegaly"),
    ("paced_rhythm", "support_device"),
    ("heart_failure", "cardiomegaly"),
    ("heart_failure", "edema"),
    ("heart_failure", "pleural_effusion"),
]


def pool_problems(pools: DataFrame, group: str, label: str, size: int = 10) -> DataFrame:
    """``group, n, positives`` of the candidate pools without exactly ``size`` candidates and one positive."""
    per = pools.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("positives"))
    return per.where((F.col("n") != size) | (F.col("positives") != 1))


def pool_ranks(pools: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """``group, rank``: how many candidates of the pool score above its positive, plus one."""
    top = pools.groupBy(group).agg(F.max(F.when(F.col(label) == 1, F.col(score))).alias("_p"))
    return pools.join(top, group).groupBy(group).agg((F.count_if(F.col(score) > F.col("_p")) + 1).alias("rank"))


def rank_summary(ranks: DataFrame, count: Column) -> DataFrame:
    """Recall at 1, 5 and 10, reciprocal, median and mean rank, and the chance of a first rank among ``count`` candidates."""
    r = F.col("rank")
    recall = [F.avg((r <= k).cast("double")).alias(f"recall_at_{k}") for k in (1, 5, 10)]
    return ranks.agg(*recall, F.avg(1 / r).alias("mrr"), F.expr("percentile(rank, 0.5)").alias("median_rank"), F.avg(r).alias("mean_rank"), F.avg(1 / count).alias("chance_at_1"))


def best_runs(runs: DataFrame, by: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The run of each group with the best known score; ties go to the smallest ``ties``. NaN scores don't compete."""
    known = runs.where(F.col(score).isNotNull() & ~F.isnan(score))
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return known.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def seed_summary(runs: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and number of the finite values per group; a single seed has no deviation."""
    aggs = []
    for v in values:
        x = F.when(~F.isnan(v), F.col(v))
        aggs += [F.round(F.avg(x), 9).alias(f"{v}_mean"), F.round(F.stddev_samp(x), 9).alias(f"{v}_std"), F.count(x).alias(f"{v}_n")]
    return runs.groupBy(*by).agg(*aggs)


def compatible(spark: SparkSession, reverse: bool = False) -> DataFrame:
    """``source, target`` concept relations; five rows."""
    edges = spark.createDataFrame(COMPATIBLE, "source string, target string")
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target")) if reverse else edges


def concept_relevance(queries: DataFrame, targets: DataFrame, relations: DataFrame) -> DataFrame:
    """``query_id, concept, targets``: how many targets share a wanted concept with a query.

    ``queries`` and ``targets``: ``id, concept``. A query wants its own concepts and those related to them. Counted per
    concept before the join, so that a frequent concept meets a query once and no pairs are made.
    """
    own = queries.select(F.col("id").alias("query_id"), "concept").distinct()
    related = own.join(F.broadcast(relations), F.col("concept") == F.col("source")).select("query_id", F.col("target").alias("concept"))
    have = targets.select("id", "concept").distinct().groupBy("concept").agg(F.count(F.lit(1)).alias("targets"))
    return own.unionByName(related).distinct().join(have, "concept").select("query_id", "concept", "targets")


def coverage_first_cohort(rows: DataFrame, key: str, labels: str, n: int, seed: str) -> DataFrame:
    """``key, reason``: a cohort of n that covers the labels, rarest first, then fills up in hash order.

    Each label's first case in hash order is reserved; a case reserved by several labels counts once and the place goes to
    the next in hash order. Only one row per label and n rows of the fill are ranked globally. Taking the first case of each
    label at once replaces a walk over labels, so a rarer label never loses its case to a commoner one.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    ranked = rows.select(key, labels, order.alias("_h"))
    per = ranked.select(key, "_h", F.explode(F.array_distinct(labels)).alias("label"))
    first = per.groupBy("label").agg(F.min_by(key, "_h").alias(key), F.count(F.lit(1)).alias("cases"))
    kept = first.groupBy(key).agg(F.min("cases").alias("rarity")).join(ranked.select(key, "_h"), key).select(key, "_h", F.lit(0).alias("_p"), "rarity")
    rest = ranked.join(kept, key, "left_anti").orderBy("_h").limit(n).select(key, "_h", F.lit(1).alias("_p"), F.lit(0).cast("long").alias("rarity"))
    chosen = kept.unionByName(rest).orderBy("_p", "rarity", "_h").limit(n)
    return chosen.select(key, F.when(F.col("_p") == 0, "label").otherwise("fill").alias("reason"))


def sampled_pool(queries: DataFrame, bank: DataFrame, size: int, seed: str) -> DataFrame:
    """``query_id, cand_id, relevant``: each query's own positive and others in hash order, ``size`` in all.

    ``queries``: query_id, cand_id (its positive); ``bank``: cand_id. A stated query set against all rows.
    """
    pairs = queries.select("query_id", F.col("cand_id").alias("positive")).join(bank.select("cand_id"), F.lit(True))
    scored = pairs.withColumn("relevant", F.col("cand_id") == F.col("positive"))
    w = Window.partitionBy("query_id").orderBy(F.desc("relevant"), F.md5(F.concat_ws(":", F.lit(seed), "query_id", "cand_id")), "cand_id")
    return scored.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= size).select("query_id", "cand_id", "relevant")


def paired_effect(pairs: DataFrame, by: Sequence[str], left: str, right: str, lower_is_better: bool = False) -> DataFrame:
    """``n, mean_left, mean_right, delta`` of paired values per group; the sign is flipped where lower is better."""
    sign = -1 if lower_is_better else 1
    ok = F.col(left).isNotNull() & F.col(right).isNotNull()
    return pairs.where(ok).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(left), 9).alias("mean_left"),
        F.round(F.avg(right), 9).alias("mean_right"),
        F.round(sign * (F.avg(left) - F.avg(right)), 9).alias("delta"),
    )


def decision_gate(metrics: DataFrame, by: Sequence[str], condition: str, criteria: dict[str, Column]) -> DataFrame:
    """``by, criteria ..., passed``: metrics pivoted by condition, each criterion over the pivoted columns; null fails.

    Conditions become columns, so more than ``MAX_CONDITIONS`` of them are refused; none is left out.
    """
    values = [c for c in metrics.columns if c not in (*by, condition)]
    names = [r[0] for r in metrics.select(condition).where(F.col(condition).isNotNull()).distinct().orderBy(condition).limit(MAX_CONDITIONS + 1).collect()]
    if len(names) > MAX_CONDITIONS:
        raise ValueError(f"more than {MAX_CONDITIONS} conditions")
    wide = metrics.groupBy(*by).agg(*(F.max(F.when(F.col(condition) == c, F.col(v))).alias(f"{c}_{v}") for c in names for v in values))
    checked = wide.select(*by, *(F.coalesce(v, F.lit(False)).alias(k) for k, v in criteria.items()))
    passed = F.lit(True)
    for k in criteria:
        passed = passed & F.col(k)
    return checked.withColumn("passed", passed)


def column_means(rows: DataFrame, vector: str) -> DataFrame:
    """``i, mean, n``: the mean of each position of an array column over its finite values."""
    cells = rows.select(F.posexplode(vector).alias("i", "x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    return cells.groupBy("i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def vector_audit(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """One row of counts: null, wrong width, non-finite, all zero and usable vectors; each vector has one state."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    state = F.when(v.isNull(), "null").when(F.size(v) != width, "width").when(bad, "not_finite").when(~F.exists(v, lambda x: x != 0), "zero").otherwise("usable")
    states = rows.select(state.alias("s"))
    return states.agg(*(F.count_if(F.col("s") == s).alias(f"{s}_n") for s in ("null", "width", "not_finite", "zero", "usable")))
