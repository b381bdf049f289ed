"""Retrieval and ranking queries on the embeddings table: queries are the ids divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.vector import chance_hit as chance
from cohortloom.functions.vector import sign_codes
from cohortloom.operators import codes, controls, retrieval
from cohortloom.plans.queries import query
from cohortloom.sources.tables import table

#: Subject of an embedding, for the exclusion rule.
SUBJECTS = 50
# The SQL twin's score table: cosines rounded to 6 digits, own subject excluded.
_UNIT = """
  u AS (SELECT vec_id AS id, vec_id % 50 AS owner, label, list_transform(embedding{part}, lambda x: x::DOUBLE) AS v FROM embeddings),
  n AS (SELECT id, owner, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u),
  scores AS (
    SELECT q.id AS query_id, c.id AS cand_id, round(list_dot_product(q.v, c.v), 6) + 0.0 AS score, q.label = c.label AS relevant
    FROM n q JOIN n c ON q.owner <> c.owner WHERE q.id % 50 = 0
  )"""
_RANKED = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM scores)"


def _unit(part: str = "") -> str:
    return "WITH " + _UNIT.format(part=part)


def _sides(spark: SparkSession, d: str, part: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    v = F.slice("embedding", *part) if part else F.col("embedding")
    bank = e.select(F.col("vec_id").alias("id"), F.pmod("vec_id", F.lit(SUBJECTS)).alias("owner"), v.alias("v"))
    return bank.where(F.pmod("id", F.lit(50)) == 0), bank


def _scores(spark: SparkSession, d: str) -> DataFrame:
    label = table(spark, d, "embeddings").select("vec_id", "label")
    q, c = label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), label.select(F.col("vec_id").alias("cand_id"), F.col("label").alias("cl"))
    found = retrieval.all_scores(*_sides(spark, d))
    return found.join(q, "query_id").join(c, "cand_id").select("query_id", "cand_id", "score", (F.col("ql") == F.col("cl")).alias("relevant"))


@query(_unit() + _RANKED + " SELECT query_id, cand_id, score, rank FROM ranked WHERE rank <= 10")
def retrieval_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.topk(*_sides(spark, d), k=10)


@query(_unit() + _RANKED + " SELECT query_id, round(max(score) FILTER (WHERE rank = 1), 6) AS top1, round(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2), 6) AS margin FROM ranked GROUP BY query_id")
def retrieval_margin(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.margin(retrieval.topk(*_sides(spark, d), k=2))


@query(
    _unit()
    + """, mid AS (
    SELECT query_id, relevant, rank() OVER (PARTITION BY query_id ORDER BY score DESC) + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2.0 AS rank FROM scores
  ), best AS (SELECT query_id, min(rank) AS rank FROM mid WHERE relevant GROUP BY query_id)
  SELECT count(*) AS queries, avg((rank <= 1)::INT) AS hit1, avg((rank <= 5)::INT) AS hit5, round(avg(1 / rank), 9) AS mrr FROM best"""
)
def retrieval_mrr_midrank(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.ranks(_scores(spark, d), "mid")
    best = ranked.where("relevant").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return retrieval.retrieval_summary(best).withColumn("mrr", F.round("mrr", 9))


@query(
    _unit()
    + """, r AS (SELECT query_id, relevant, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS o,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, md5('7:' || query_id || ':' || cand_id)) AS x FROM scores),
  best AS (SELECT query_id, min(o) AS optimistic, min(x) AS random FROM r WHERE relevant GROUP BY query_id)
  SELECT avg(optimistic) AS mean_rank, median(optimistic) AS median_rank, avg((optimistic <= 10)::INT) AS hit10, avg(random) AS random_mean_rank FROM best"""
)
def rank_policies(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    best = lambda p: retrieval.ranks(s, p, seed="7").where("relevant").groupBy("query_id").agg(F.min("rank").alias(p))
    both = best("optimistic").join(best("random"), "query_id")
    return both.agg(
        F.avg("optimistic").alias("mean_rank"),
        F.expr("percentile(optimistic, 0.5)").alias("median_rank"),
        F.avg((F.col("optimistic") <= 10).cast("int")).alias("hit10"),
        F.avg("random").alias("random_mean_rank"),
    )


@query(
    "WITH a AS (" + _unit("[1:32]") + _RANKED + " SELECT query_id, cand_id, rank FROM ranked WHERE rank <= 20), b AS (" + _unit("[33:64]") + _RANKED
    + """ SELECT query_id, cand_id, rank FROM ranked WHERE rank <= 20),
  f AS (SELECT query_id, cand_id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
  SELECT query_id, cand_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, cand_id) AS rank FROM f"""
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rank_fusion([retrieval.topk(*_sides(spark, d, p), k=20) for p in ((1, 32), (33, 32))])


def _metric_sql() -> str:
    cols, sums = [], []
    for k in (1, 5, 10):
        sums.append(f"sum(rel) FILTER (WHERE rank <= {k}) AS h{k}, sum(rel * seen / rank) FILTER (WHERE rank <= {k}) AS a{k}, sum(rel / log2(rank + 1)) FILTER (WHERE rank <= {k}) AS g{k}")
        cols.append(
            f"h{k} / {k} AS p{k}, CASE WHEN positives > 0 THEN h{k} / positives ELSE 0 END AS r{k}, (h{k} > 0)::INT AS hit{k}, "
            f"CASE WHEN positives > 0 THEN round(a{k} / least(positives, {k}), 9) ELSE 0 END AS ap{k}, "
            f"CASE WHEN positives > 0 THEN round(g{k} / list_sum(list_transform(range(1, least(positives, {k})::BIGINT + 1), lambda i: 1 / log2(i + 1))), 9) ELSE 0 END AS ndcg{k}"
        )
    return (
        _unit()
        + _RANKED
        + ", c AS (SELECT query_id, rank, relevant::INT::DOUBLE AS rel, sum(relevant::INT) OVER (PARTITION BY query_id ORDER BY rank)::DOUBLE AS seen FROM ranked)"
        + f", s AS (SELECT query_id, sum(rel) AS positives, {', '.join(sums)} FROM c GROUP BY query_id) SELECT query_id, positives::BIGINT AS positives, {', '.join(cols)} FROM s"
    )


@query(_metric_sql())
def ranking_metrics_at_k(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.metrics_at(retrieval.ranks(_scores(spark, d), "stable"))


@query(
    _unit()
    + """, m AS (SELECT query_id, relevant, rank() OVER (PARTITION BY query_id ORDER BY score) + (count(*) OVER (PARTITION BY query_id, score) - 1) / 2.0 AS mid FROM scores),
  g AS (SELECT query_id, sum(mid) FILTER (WHERE relevant) AS s, count(*) FILTER (WHERE relevant) AS p, count(*) FILTER (WHERE NOT relevant) AS n FROM m GROUP BY query_id)
  SELECT query_id, CASE WHEN p > 0 AND n > 0 THEN round((s - p * (p + 1) / 2.0) / (p * n), 9) END AS auroc FROM g"""
)
def auroc_per_query(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.auroc(_scores(spark, d))


@query(
    """WITH g AS (SELECT DISTINCT n, p, k FROM (SELECT unnest([10, 100, 1000]) AS n), (SELECT unnest([0, 1, 5, 10]) AS p), (SELECT unnest([1, 5, 10]) AS k))
  SELECT n, p, k, round(CASE WHEN p = 0 THEN 0.0 WHEN n - p < k THEN 1.0 ELSE 1 - list_product(list_transform(range(0, k), lambda o: (n - p - o)::DOUBLE / (n - o))) END, 9) AS chance FROM g"""
)
def chance_hit(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(1)
    for name, values in (("n", (10, 100, 1000)), ("p", (0, 1, 5, 10)), ("k", (1, 5, 10))):
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return grid.select("n", "p", "k", F.round(chance(F.col("n"), F.col("p"), F.col("k")), 9).alias("chance"))


@query(
    _unit()
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM scores),
  c AS (SELECT round(max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2), 6) AS s, bool_or(relevant) FILTER (WHERE rank = 1) AS g FROM r GROUP BY query_id),
  q AS (SELECT DISTINCT round(unnest((SELECT quantile_cont(s, [{steps}]) FROM c)), 6) AS t),
  e AS (SELECT t, count(*) FILTER (WHERE s >= t) AS a, count(*) FILTER (WHERE s >= t AND g) AS tp, count(*) FILTER (WHERE g) AS pos, count(*) AS n FROM c, q GROUP BY t)
  SELECT t AS threshold, round(2.0 * tp / greatest(a + pos, 1), 9) AS f1, round(a / n, 9) AS coverage FROM e
  WHERE n >= 5 AND pos > 0 AND pos < n AND a / n >= 0.1 ORDER BY 2 DESC, 1 LIMIT 1""".replace("{steps}", ", ".join(str(i / 100) for i in range(101)))
)
def gate_threshold(spark: SparkSession, d: str) -> DataFrame:
    top = retrieval.ranks(_scores(spark, d), "stable").where("rank <= 2")
    first, second = F.max(F.when(F.col("rank") == 1, F.col("score"))), F.max(F.when(F.col("rank") == 2, F.col("score")))
    cases = top.groupBy("query_id").agg(F.round(first - second, 6).alias("s"), F.max(F.when(F.col("rank") == 1, F.col("relevant"))).alias("g"))
    return controls.gate_threshold(cases, "s", "g", least=5)


_CODES = """WITH c AS (
    SELECT vec_id, label, list_transform(range(0, 8), lambda i: list_sum(list_transform(range(1, 9), lambda j: CASE WHEN embedding[i * 8 + j] > 0 THEN 1 << (j - 1) ELSE 0 END))::INT) AS codes FROM embeddings
  ), x AS (SELECT vec_id, label, i::INT AS chunk, codes[i + 1] AS code FROM c, range(0, 8) t(i))"""


def _coded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", sign_codes(F.col("embedding"), 8).alias("codes"))


@query(
    _CODES
    + """, n AS (SELECT chunk, code, count(*) AS n FROM x GROUP BY ALL), p AS (SELECT chunk, n / sum(n) OVER (PARTITION BY chunk) AS p FROM n)
  SELECT chunk, count(*) AS used, 256 - count(*) AS dead, round(max(p), 9) AS top_share, round(exp(-sum(p * ln(p))), 6) AS perplexity, round(count(*) / 256, 9) AS utilization FROM p GROUP BY chunk"""
)
def codebook_usage(spark: SparkSession, d: str) -> DataFrame:
    return codes.code_usage(_coded(spark, d), "codes", 256)


@query(_CODES + " SELECT count(*) AS rows, count(DISTINCT codes) AS sequences, round(count(DISTINCT codes) / count(*), 9) AS unique_fraction FROM c")
def code_sequences(spark: SparkSession, d: str) -> DataFrame:
    return codes.unique_sequences(_coded(spark, d), "codes")


@query(
    _CODES
    + """, n AS (SELECT chunk, code, count(*) FILTER (WHERE label < 5) AS a, count(*) FILTER (WHERE label >= 5) AS b FROM x GROUP BY ALL),
  p AS (SELECT chunk, a / greatest(sum(a) OVER (PARTITION BY chunk), 1) AS p, b / greatest(sum(b) OVER (PARTITION BY chunk), 1) AS q FROM n)
  SELECT chunk, round(sum(p * (ln(p + 1e-12) - ln((p + q) / 2 + 1e-12)) / 2 + q * (ln(q + 1e-12) - ln((p + q) / 2 + 1e-12)) / 2), 9) AS js FROM p GROUP BY chunk"""
)
def code_js(spark: SparkSession, d: str) -> DataFrame:
    return codes.code_divergence(_coded(spark, d).withColumn("side", F.col("label") < 5), "codes", "side")


@query(
    """WITH s AS (SELECT vec_id AS slot, vec_id % 50 AS owner, label AS len, row_number() OVER (ORDER BY vec_id % 50, vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings),
  c AS (SELECT h AS shift, sum(abs(a.len - b.len)) AS cost, max((a.owner = b.owner)::INT) AS bad
        FROM s a, (SELECT unnest(range(1, (SELECT count(*) FROM embeddings))) AS h) JOIN s b ON b.i = (a.i + h) % a.n GROUP BY h),
  best AS (SELECT shift FROM c WHERE bad = 0 ORDER BY cost, shift LIMIT 1)
  SELECT a.slot, b.slot AS donor_slot, shift FROM s a, best JOIN s b ON b.i = (a.i + shift) % a.n"""
)
def broken_linkage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.pmod("vec_id", F.lit(SUBJECTS)).alias("owner"), F.col("label").alias("length"))
    return controls.broken_linkage(e, "vec_id", "owner")


@query(
    """WITH r AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY md5('5107:' || q.vec_id || ':' || c.vec_id), c.vec_id) AS pick
    FROM embeddings q JOIN embeddings c ON q.vec_id % 50 <> c.vec_id % 50 WHERE q.vec_id % 50 = 0)
  SELECT query_id, cand_id, pick FROM r WHERE pick <= 2"""
)
def random_control(spark: SparkSession, d: str) -> DataFrame:
    """Random candidates of other subjects by hash order: the query set against all rows."""
    q, c = _sides(spark, d)
    pairs = q.select(F.col("id").alias("query_id"), F.col("owner").alias("qo")).join(c.select(F.col("id").alias("cand_id"), "owner"), F.col("qo") != F.col("owner"))
    w = Window.partitionBy("query_id").orderBy(controls.hash_order("5107", "query_id", "cand_id"), "cand_id")
    return pairs.withColumn("pick", F.row_number().over(w)).where("pick <= 2").select("query_id", "cand_id", "pick")
