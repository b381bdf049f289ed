"""Similarity search with exclusions, rank policies, fusion and ranking metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.vector import unit

#: Rows of a block of queries and of a block of the bank: about 1 MB of vectors each.
QUERY_BLOCK, BANK_BLOCK = 512, 4096


def _blocks(df: DataFrame, rows: int, total: int, prefix: str) -> DataFrame:
    """Rows of ``(id, owner, v)`` gathered into blocks of about ``rows`` by hash of the id."""
    n = max(1, -(-total // rows))
    return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{prefix}_block")).agg(F.collect_list(F.struct("id", "owner", "v")).alias(prefix))


def scored(queries: DataFrame, bank: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``query_id, cand_id, score``: for each query the k best candidates of other owners, and all ties with none.

    ``queries`` and ``bank`` have ``id, owner, v``; vectors without a direction are left out. The stated query
    set meets all rows in blocks: each pair of blocks is one matrix product whose top k per query go on, so that
    neither all scores nor a whole side are ever in one place. Scores are cosines rounded to ``digits``; a tie
    goes to the smaller candidate id. A query is never its own candidate; a null owner excludes nothing else.
    """
    sides = []
    for df, size, name in ((queries, QUERY_BLOCK, "q"), (bank, BANK_BLOCK, "c")):
        usable = df.select("id", "owner", unit(F.col("v")).alias("v")).where("v IS NOT NULL")
        sides.append(_blocks(usable, size, df.count(), name))
    pairs = sides[0].crossJoin(sides[1]).select("q", "c")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, c in zip(batch.q, batch.c, strict=True):
                qi, ci = (np.array([r["id"] for r in x], dtype=np.int64) for x in (q, c))
                qo, co = (np.array([np.nan if r["owner"] is None else r["owner"] for r in x], dtype=float) for x in (q, c))
                qv, cv = (np.array([r["v"] for r in x]) for x in (q, c))
                s = np.round(qv @ cv.T, digits) + 0.0
                s[(qo[:, None] == co[None, :]) | (qi[:, None] == ci[None, :])] = -np.inf
                order = np.lexsort((np.broadcast_to(ci, s.shape), -s), axis=1)[:, :k]
                top = np.take_along_axis(s, order, 1)
                rows, cols = np.nonzero(top > -np.inf)
                yield pd.DataFrame({"query_id": qi[rows], "cand_id": ci[order[rows, cols]], "score": top[rows, cols]})

    return pairs.mapInPandas(best, "query_id long, cand_id long, score double")


def topk(queries: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """``query_id, cand_id, score, rank``: stable ranking, score first, then the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("cand_id"))
    return scored(queries, bank, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def margin(ranked: DataFrame) -> DataFrame:
    """``query_id, top1, margin``: how far the best is ahead of the second; null with one candidate."""
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    return ranked.groupBy("query_id").agg(F.round(first, 6).alias("top1"), F.round(first - second, 6).alias("margin"))


def ranks(scores: DataFrame, policy: str, by: Sequence[str] = ("query_id",), seed: str = "0") -> DataFrame:
    """``scores`` with ``rank``: ``mid``, ``optimistic``, ``stable`` (smaller id) or ``random`` (hashed) among ties."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"))
    if policy == "mid":
        same = F.count(F.lit(1)).over(Window.partitionBy(*by, "score"))
        return scores.withColumn("rank", F.rank().over(w) + (same - 1) / 2)
    if policy == "optimistic":
        return scores.withColumn("rank", F.rank().over(w))
    tie = F.col("cand_id") if policy == "stable" else F.md5(F.concat_ws(":", F.lit(seed), "query_id", "cand_id"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), tie)))


def retrieval_summary(ranked: DataFrame) -> DataFrame:
    """``queries, hit1, hit5, mrr`` over one relevant rank per query (columns ``query_id, rank``)."""
    rate = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return ranked.agg(F.count(F.lit(1)).alias("queries"), rate(1).alias("hit1"), rate(5).alias("hit5"), F.avg(1 / F.col("rank")).alias("mrr"))


def rank_fusion(lists: Sequence[DataFrame], c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``(query_id, cand_id, rank)``; ties by the smaller id."""
    union = lists[0].select("query_id", "cand_id", "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("query_id", "cand_id", "rank"))
    fused = union.groupBy("query_id", "cand_id").agg(F.round(F.sum(1 / (c + F.col("rank"))), 9).alias("rrf"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "cand_id")))


def metrics_at(ranked: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Precision, recall, hit, average precision and nDCG per query at each k, from ``query_id, rank, relevant``.

    Ranks are 1, 2, 3 ... without ties. A query without relevant candidates has 0 throughout.
    """
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = ranked.withColumn("rel", F.col("relevant").cast("double")).withColumn("seen", F.sum("rel").over(w))
    aggs = [F.sum("rel").alias("positives"), F.count(F.lit(1)).alias("n")]
    for k in ks:
        top = F.col("rank") <= k
        aggs += [
            F.sum(F.when(top, F.col("rel")).otherwise(0.0)).alias(f"_hits{k}"),
            F.sum(F.when(top, F.col("rel") * F.col("seen") / F.col("rank")).otherwise(0.0)).alias(f"_ap{k}"),
            F.sum(F.when(top, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"_dcg{k}"),
        ]
    per = r.groupBy("query_id").agg(*aggs)
    out = [F.col("query_id"), F.col("positives").cast("long").alias("positives")]
    for k in ks:
        cap = F.least(F.col("positives"), F.lit(k)).cast("int")
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(cap, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        hits = F.col(f"_hits{k}")
        some = F.col("positives") > 0
        out += [
            (hits / k).alias(f"p{k}"),
            F.when(some, hits / F.col("positives")).otherwise(0.0).alias(f"r{k}"),
            (hits > 0).cast("int").alias(f"hit{k}"),
            F.when(some, F.round(F.col(f"_ap{k}") / cap, 9)).otherwise(0.0).alias(f"ap{k}"),
            F.when(some, F.round(F.col(f"_dcg{k}") / ideal, 9)).otherwise(0.0).alias(f"ndcg{k}"),
        ]
    return per.select(*out)


def auroc(scores: DataFrame) -> DataFrame:
    """``query_id, auroc`` with half credit for ties, from ``query_id, score, relevant``; null without both classes."""
    up = Window.partitionBy("query_id").orderBy("score")
    same = F.count(F.lit(1)).over(Window.partitionBy("query_id", "score"))
    r = scores.withColumn("mid", F.rank().over(up) + (same - 1) / 2)
    p, n = F.sum(F.col("relevant").cast("long")), F.sum((~F.col("relevant")).cast("long"))
    area = (F.sum(F.when(F.col("relevant"), F.col("mid"))) - p * (p + 1) / 2) / (p * n)
    return r.groupBy("query_id").agg(F.when((p > 0) & (n > 0), F.round(area, 9)).alias("auroc"))


def all_scores(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """Every score of a stated query set, for metrics over whole rankings."""
    return scored(queries, bank, k=2**31 - 1)


def ranking_position(relevant: Column) -> Column:
    """Position of the first relevant candidate."""
    return F.min(F.when(relevant, F.col("rank")))
