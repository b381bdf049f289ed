"""Paired effects with resampling intervals, contrasts, abstentions, medians and homogeneity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.controls import dense_index, draw
from cohortloom.session import materialise

# Named contrasts of two conditions.
CONTRASTS = {
    "incremental_labs": ("same_labs", "same_only"),
    "incremental_cross": ("same_cross", "same_only"),
    "incremental_full_trimodal": ("full_trimodal", "same_only"),
    "retrieval_specificity": ("full_trimodal", "full_random"),
    "shuffled_bridge_attribution": ("full_trimodal", "full_shuffled"),
    "lab_value_attribution": ("full_trimodal", "full_mask_only"),
    "confidence_gate": ("full_trimodal_gated", "full_trimodal"),
    "code_match": ("full_trimodal", "full_no_code_match"),
}


def contrasts(spark: SparkSession, named: Mapping[str, tuple[str, str]] = CONTRASTS) -> DataFrame:
    """``contrast, a, b``: a registry as a table, one row per contrast."""
    return spark.createDataFrame([(k, *v) for k, v in named.items()], "contrast string, a string, b string")


def contrast_pairs(rows: DataFrame, registry: DataFrame, condition: str, by: Sequence[str], case: str, contract: Sequence[str] = ()) -> DataFrame:
    """``contrast, by, case, <column>_a, <column>_b`` of every case that both conditions of a contrast have.

    ``contract`` columns must be known and equal on both sides; other pairs are left out. Cases should be unique per group and
    condition. Rows are told their contrasts by a join with the registry (its size is a parameter) and meet on keys.
    """
    rest = [c for c in rows.columns if c not in (condition, *by, case)]
    side = lambda s: rows.join(F.broadcast(registry.select("contrast", F.col(s).alias(condition))), condition).select("contrast", *by, case, *(F.col(c).alias(f"{c}_{s}") for c in rest))
    met = side("a").join(side("b"), ["contrast", *by, case])
    for c in contract:
        met = met.where(F.col(f"{c}_a") == F.col(f"{c}_b"))
    return met


def paired_bootstrap(pairs: DataFrame, by: Sequence[str], cluster: str, sums: Sequence[str], metrics: Mapping[str, Column], lower_is_better: Sequence[str] = (), replicates: int = 1000, seed: int = 4408) -> DataFrame:
    """``by, metric, pairs, clusters, left, right, difference, ci_low, ci_high, positive``: effects a - b by whole clusters.

    ``pairs`` has ``<sum>_a`` and ``<sum>_b`` for every sufficient statistic, and ``n`` of them is the number of pairs. A metric
    is an expression over the plain names, evaluated on either side. For ``lower_is_better`` metrics the difference is turned, so
    that more is better throughout. Limits are percentiles over resampled clusters and null with fewer than two clusters;
    ``positive`` is the share of replicates with a difference above 0. A cluster that is a row's own id gives the row-level form.
    Statistics are summed per cluster first; draws are a distributed range per group, counted per cluster before the join, so
    a hot cluster is one row. Empty input gives no rows; rows with a null cluster are one cluster; null statistics count as 0.
    """
    names = [f"{s}_{side}" for s in sums for side in "ab"]
    per = pairs.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("_n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    order = [F.col(c).asc_nulls_first() for c in (*by, cluster)]
    indexed = dense_index(per, order, "_at")
    groups = indexed.groupBy(*by).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("clusters"), F.sum("_n").alias("pairs"), *(F.sum(c).alias(c) for c in names))
    groups = materialise(groups.withColumn("_g", F.struct(*(F.col(c) for c in by))), "groups")
    own = materialise(indexed.join(groups.select(*by, "_from", "clusters"), list(by)).select(F.struct(*(F.col(c) for c in by)).alias("_g"), (F.col("_at") - F.col("_from")).alias("i"), "clusters", *names), "clusters")
    # every cluster of a group is one draw of each replicate
    drawn = own.select("_g", "clusters", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep"))
    drawn = drawn.select("_g", "_rep", draw(seed, F.col("_rep"), F.col("j"), F.col("clusters")).alias("i")).groupBy("_g", "_rep", "i").agg(F.count(F.lit(1)).alias("_times"))
    total = drawn.join(own.drop("clusters"), ["_g", "i"]).groupBy("_g", "_rep").agg(*(F.sum(F.col(c) * F.col("_times")).alias(c) for c in names))

    def values(df: DataFrame, *keep: str) -> DataFrame:
        side = lambda s: df.select("_g", *keep, *(F.col(f"{c}_{s}").alias(c) for c in sums)).select("_g", *keep, *(v.cast("double").alias(k) for k, v in metrics.items()))
        long = lambda s: side(s).select("_g", *keep, F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias(s)) for k in metrics))).alias("m")).select("_g", *keep, "m.*")
        sign = F.when(F.col("metric").isin(list(lower_is_better)), -1).otherwise(1) if lower_is_better else F.lit(1)
        return long("a").join(long("b"), ["_g", *keep, "metric"]).withColumn("d", sign * (F.col("a") - F.col("b")))

    spread = values(total, "_rep").groupBy("_g", "metric").agg(
        F.expr("percentile(d, 0.025)").alias("lo"), F.expr("percentile(d, 0.975)").alias("hi"), F.avg((F.col("d") > 0).cast("double")).alias("up")
    )
    whole = values(groups).join(groups.select("_g", "pairs", "clusters"), "_g").join(spread, ["_g", "metric"])
    enough = F.col("clusters") >= 2
    out = [(F.round(c, 9) + 0.0).alias(n) for c, n in ((F.col("a"), "left"), (F.col("b"), "right"), (F.col("d"), "difference"))]
    limits = [F.when(enough, F.round(c, 9) + 0.0).alias(n) for c, n in (("lo", "ci_low"), ("hi", "ci_high"), ("up", "positive"))]
    return whole.select(*(F.col(f"_g.{c}").alias(c) for c in by), "metric", "pairs", "clusters", *out, *limits)


def with_abstentions(results: DataFrame, failed: DataFrame, empty: Mapping[str, Column]) -> DataFrame:
    """Results and failed cells scored as answers that say nothing: ``empty`` gives their columns, others are null; ``abstained`` marks them."""
    rest = [c for c in results.columns if c not in failed.columns and c not in empty]
    types = dict(results.dtypes)
    kept = [F.col(c) for c in failed.columns if c in results.columns and c not in empty]
    blank = failed.select(*kept, *(v.cast(types[k]).alias(k) for k, v in empty.items()), *(F.lit(None).cast(types[c]).alias(c) for c in rest))
    return results.withColumn("abstained", F.lit(False)).unionByName(blank.withColumn("abstained", F.lit(True)))


def counted_categories(rows: DataFrame, by: Sequence[str], category: str) -> DataFrame:
    """``by, category, n``; a null category is a group of its own."""
    return rows.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))


def medians(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The exact median of each value and how many rows have it, per group."""
    aggs = [a for v in values for a in (F.expr(f"percentile({v}, 0.5)").alias(f"{v}_median"), F.count(v).alias(f"{v}_n"))]
    return rows.groupBy(*by).agg(*aggs)


def homogeneity(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by, versions, unknown, homogeneous``: whether a group has exactly one known value and no null."""
    distinct = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    per = distinct.groupBy(*by).agg(F.count(value).alias("versions"), F.coalesce(F.sum(F.when(F.col(value).isNull(), F.col("_n"))), F.lit(0)).alias("unknown"))
    return per.withColumn("homogeneous", (F.col("versions") == 1) & (F.col("unknown") == 0))


def context_quality(anchors: DataFrame, key: str, own: Column, theirs: Column) -> DataFrame:
    """``key, any_overlap, mean_overlap``: whether a context shares a label with its query, and the mean shared share of the query's labels.

    Queries without labels have no share and don't count in a later mean.
    """
    share = F.when(F.size(own) > 0, F.size(F.array_intersect(own, theirs)) / F.size(own))
    return anchors.select(key, share.alias("_s")).groupBy(key).agg(F.max((F.col("_s") > 0).cast("int")).alias("any_overlap"), F.round(F.avg("_s"), 9).alias("mean_overlap"))


def mean_over(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """``groups, mean``: the mean of the groups' means, each group weighing the same."""
    return rows.groupBy(*by).agg(F.avg(value).alias("_m")).agg(F.count("_m").alias("groups"), F.round(F.avg("_m"), 9).alias("mean"))


def shuffled(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """``key, donor``: a permutation, the i-th key taking the i-th in hash order; both orders by range, none in one task."""
    keys = rows.select(key)
    a = dense_index(keys, [F.col(key).asc_nulls_first()])
    b = dense_index(keys.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))), [F.col("_h"), F.col(key)])
    return a.join(b.select("i", F.col(key).alias("donor")), "i").select(key, "donor")
