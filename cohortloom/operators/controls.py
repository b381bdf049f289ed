"""Controls and resampling: cluster bootstrap, broken linkage, gates and hashed cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.session import materialise


def draw(seed: int, b: Column, j: Column, n: Column) -> Column:
    """The j-th draw of replicate b from 0 .. n-1, by hash, equal on every engine."""
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), j.cast("string"))), 1, 8)
    return F.pmod(F.conv(hexed, 16, 10).cast("long"), n)


def dense_index(rows: DataFrame, order: Sequence[Column], name: str = "i") -> DataFrame:
    """``rows`` with their position 0, 1, 2 ... in a total order, without a sort in one task.

    Rows are range-partitioned and written once, so that partition numbers stay; a small table of partition
    sizes gives each partition its offset, and positions are counted inside partitions. Nulls come first by
    ``asc_nulls_first`` orders; the order must be total for the positions to be stable.
    """
    placed = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    kept = materialise(placed, "ordered")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return kept.withColumn("_inside", inside).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def cluster_bootstrap(stats: DataFrame, cluster: str, sums: Sequence[str], metrics: dict[str, Column], replicates: int = 200, seed: int = 4408) -> DataFrame:
    """``metric, observed, ci_low, ci_high``: percentile intervals over whole clusters drawn with replacement.

    Sufficient statistics are summed per cluster before anything is drawn. The draws are a distributed range, counted per
    replicate and cluster index first, so what is joined is one row per drawn cluster, and each replicate reduces to its
    sums. Intervals are null with fewer than two clusters; an empty table has null metrics. Rows with a null cluster are one cluster.
    """
    spark = stats.sparkSession
    per = stats.groupBy(cluster).agg(*(F.sum(c).alias(c) for c in sums))
    indexed = materialise(dense_index(per, [F.col(cluster).asc_nulls_first()]), "clusters")
    n = indexed.count()
    at = F.col("id")
    drawn = spark.range(replicates * n).select(F.floor(at / max(n, 1)).alias("b"), F.pmod(at, F.lit(max(n, 1))).alias("j"))
    drawn = drawn.select("b", draw(seed, F.col("b"), F.col("j"), F.lit(max(n, 1))).alias("i")).groupBy("b", "i").agg(F.count(F.lit(1)).alias("times"))
    total = drawn.join(indexed, "i").groupBy("b").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in sums))
    names = list(metrics)
    wide = total.select(*(v.alias(k) for k, v in metrics.items()))
    stack = lambda df, value: df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias(value)) for k in names))).alias("x")).select("x.*")
    whole = indexed.agg(*(F.sum(c).alias(c) for c in sums)).select(*(v.alias(k) for k, v in metrics.items()))
    limits = stack(wide, "v").groupBy("metric").agg(F.expr("percentile(v, 0.025)").alias("lo"), F.expr("percentile(v, 0.975)").alias("hi"))
    out = stack(whole, "observed").join(limits, "metric", "left")
    enough = F.lit(n >= 2)
    return out.select("metric", F.round("observed", 9).alias("observed"), F.when(enough, F.round("lo", 9)).alias("ci_low"), F.when(enough, F.round("hi", 9)).alias("ci_high"))


def broken_linkage(slots: DataFrame, slot: str, owner: str, cost: Column | None = None, length: str = "length") -> DataFrame:
    """``slot, donor_slot, shift``: the cyclic shift of owner-sorted slots with the least length cost and no donor of one's own.

    Shifts that keep an owner together are out; ties go to the smaller shift. Fails if none is left. The work is
    quadratic in the slots by definition, so it is for cohorts of a few thousand.
    """
    s = slots.select(F.col(slot).alias("slot"), F.col(owner).alias("owner"), F.col(length).alias("len")).select("*", (F.row_number().over(Window.orderBy("owner", "slot")) - 1).alias("i"))
    n = s.agg(F.count(F.lit(1)).alias("n"))
    shifts = n.where("n > 1").select("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("shift"))
    pair = s.crossJoin(shifts).withColumn("d", F.pmod(F.col("i") + F.col("shift"), F.col("n")))
    donor = s.select(F.col("i").alias("d"), F.col("owner").alias("donor_owner"), F.col("len").alias("donor_len"))
    costs = pair.join(donor, "d").groupBy("shift").agg(F.sum(F.abs(F.col("len") - F.col("donor_len"))).alias("cost"), F.max((F.col("owner") == F.col("donor_owner")).cast("int")).alias("bad"))
    best = costs.where("bad = 0").orderBy("cost", "shift").limit(1).select("shift")
    moved = s.crossJoin(best).crossJoin(n).withColumn("d", F.pmod(F.col("i") + F.col("shift"), F.col("n")))
    return moved.join(s.select(F.col("i").alias("d"), F.col("slot").alias("donor_slot")), "d").select("slot", "donor_slot", "shift")


def gate_threshold(cases: DataFrame, score: str, good: str, steps: int = 100, least: int = 20, coverage: float = 0.1) -> DataFrame:
    """``threshold, f1, coverage``: of the distinct score quantiles, the one whose acceptance has the best F1.

    Needs ``least`` cases, both classes and the coverage; ties go to the smaller threshold. No row if it can't be met.
    """
    c = cases.select(F.col(score).cast("double").alias("s"), F.col(good).cast("int").alias("g")).where("s IS NOT NULL AND g IS NOT NULL")
    at = F.expr(f"percentile(s, array({', '.join(f'{i / steps}D' for i in range(steps + 1))}))")
    stats = c.agg(at.alias("q"), F.count(F.lit(1)).alias("n"), F.sum("g").alias("pos"))
    grid = stats.where((F.col("n") >= least) & (F.col("pos") > 0) & (F.col("pos") < F.col("n"))).select("n", "pos", F.explode(F.array_distinct(F.transform("q", lambda x: F.round(x, 6)))).alias("t"))
    met = c.join(F.broadcast(grid), F.round("s", 6) >= F.col("t"))  # at most steps + 1 thresholds
    per = met.groupBy("t", "n", "pos").agg(F.count(F.lit(1)).alias("accepted"), F.sum("g").alias("tp"))
    f1 = 2 * F.col("tp") / F.greatest(F.col("accepted") + F.col("pos"), F.lit(1))
    scored = per.select(F.col("t").alias("threshold"), F.round(f1, 9).alias("f1"), F.round(F.col("accepted") / F.col("n"), 9).alias("coverage"))
    return scored.where(F.col("coverage") >= coverage).orderBy(F.desc("f1"), "threshold").limit(1)


def hash_order(seed: str, *ids: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids)))


def hashed_sample(rows: DataFrame, by: Sequence[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum in hash order: a sampling operator whose size is the parameter."""
    w = Window.partitionBy(*by).orderBy(hash_order(seed, key), F.col(key))
    return rows.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def rotation_control(rows: DataFrame, slot: str, owner: str) -> DataFrame:
    """``slot, donor``: a permutation without a donor of one's own, wherever no owner holds more than half of all rows.

    Owner-sorted slots are rotated by the size of the largest owner.
    """
    s = rows.select(F.col(slot).alias("slot"), F.col(owner).alias("owner"))
    i = materialise(dense_index(s, [F.col("owner").asc_nulls_first(), F.col("slot").asc_nulls_first()]), "slots")
    sizes = i.groupBy("owner").count().agg(F.max("count").alias("k"), F.sum("count").alias("n")).first()
    k, n = sizes.k or 0, sizes.n or 1
    moved = i.select("slot", F.pmod(F.col("i") + F.lit(k), F.lit(n)).alias("d"))
    return moved.join(i.select(F.col("i").alias("d"), F.col("slot").alias("donor")), "d").select("slot", "donor")


def length_matched(queries: DataFrame, pool: DataFrame, k: int = 2) -> DataFrame:
    """``query_id, cand_id, pick``: for each query the k pool rows of other owners nearest in text length.

    Ties go to the smaller id. Of each length, the pool keeps the first 2k ids with at most k of one owner: they hold
    the k first of other owners for any query, so nothing is lost, and the pool shrinks to the distinct lengths.
    """
    of_owner = Window.partitionBy("length", "owner").orderBy("id")
    of_length = Window.partitionBy("length").orderBy("id")
    slim = pool.select("id", "owner", "length").withColumn("i", F.row_number().over(of_owner)).where(F.col("i") <= k)
    slim = slim.withColumn("i", F.row_number().over(of_length)).where(F.col("i") <= 2 * k)
    near = queries.select(F.col("id").alias("query_id"), F.col("owner").alias("qo"), F.col("length").alias("ql")).join(slim, F.col("qo") != F.col("owner"))
    w = Window.partitionBy("query_id").orderBy(F.abs(F.col("ql") - F.col("length")), "id")
    return near.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k).select("query_id", F.col("id").alias("cand_id"), "pick")
