"""Paired effects, abstentions, medians, homogeneity and context quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import statistics
from cohortloom.plans.queries import query
from cohortloom.sources.tables import table

_PAIRS = """
  s AS (SELECT model_key, condition, method, direction || ':' || sample_id AS case_id, arg_min({g: generated_report, t: evidence_trace}, attempt_id) AS r FROM generation_attempts WHERE status = 'ok' AND model_key IS NOT NULL AND sample_id IS NOT NULL GROUP BY ALL),
  x AS (SELECT model_key, condition, method, case_id, len(regexp_extract_all(coalesce(r.g, ''), '\\S+'))::BIGINT AS words, coalesce(len(r.t), 0)::BIGINT AS claims, coalesce(list_sum(list_transform(r.t, lambda q: len(q.source_ids))), 0)::BIGINT AS cited, (coalesce(trim(r.g), '') = '')::BIGINT AS blank FROM s),
  k(contrast, ca, cb) AS (VALUES """ + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in statistics.CONTRASTS.items()) + """),
  p AS (SELECT contrast, a.model_key, a.case_id, a.words AS wa, b.words AS wb, a.claims AS ka, b.claims AS kb, a.cited AS ca_, b.cited AS cb_, a.blank AS ea, b.blank AS eb FROM k JOIN x a ON a.condition = k.ca JOIN x b ON b.condition = k.cb AND a.model_key = b.model_key AND a.case_id = b.case_id AND a.method = b.method)"""
_METRICS = """
  SELECT {keep}, 'words' AS metric, sum(wa) / sum(n) AS a, sum(wb) / sum(n) AS b, sum(wa) / sum(n) - sum(wb) / sum(n) AS d FROM {t} GROUP BY ALL
  UNION ALL SELECT {keep}, 'citations_per_claim', sum(ca_) / greatest(sum(ka), 1), sum(cb_) / greatest(sum(kb), 1), sum(ca_) / greatest(sum(ka), 1) - sum(cb_) / greatest(sum(kb), 1) FROM {t} GROUP BY ALL
  UNION ALL SELECT {keep}, 'blank', sum(ea) / sum(n), sum(eb) / sum(n), -(sum(ea) / sum(n) - sum(eb) / sum(n)) FROM {t} GROUP BY ALL"""


@query(
    f"""WITH {_PAIRS},
  c AS (SELECT contrast, model_key, case_id, count(*) AS n, sum(wa) AS wa, sum(wb) AS wb, sum(ka) AS ka, sum(kb) AS kb, sum(ca_) AS ca_, sum(cb_) AS cb_, sum(ea) AS ea, sum(eb) AS eb FROM p GROUP BY ALL),
  i AS (SELECT *, row_number() OVER (PARTITION BY contrast, model_key ORDER BY case_id) - 1 AS i, count(*) OVER (PARTITION BY contrast, model_key) AS clusters FROM c),
  dr AS (SELECT contrast, model_key, b AS rep, ('0x' || substr(md5('4408:' || b || ':' || i), 1, 8))::BIGINT % clusters AS i FROM i, range(0, 200) r(b)),
  v AS (SELECT dr.rep, i.* FROM dr JOIN i USING (contrast, model_key, i)),
  w AS ({_METRICS.format(keep='contrast, model_key, rep', t='v')}),
  l AS (SELECT contrast, model_key, metric, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, avg((d > 0)::INT) AS up FROM w GROUP BY ALL),
  o AS ({_METRICS.format(keep='contrast, model_key', t='i')}),
  g AS (SELECT contrast, model_key, sum(n)::BIGINT AS pairs, count(*) AS clusters FROM c GROUP BY ALL)
  SELECT contrast, model_key, metric, pairs, clusters, round(a, 9) + 0.0 AS left, round(b, 9) + 0.0 AS right, round(d, 9) + 0.0 AS difference, CASE WHEN clusters >= 2 THEN round(lo, 9) + 0.0 END AS ci_low, CASE WHEN clusters >= 2 THEN round(hi, 9) + 0.0 END AS ci_high, CASE WHEN clusters >= 2 THEN round(up, 9) END AS positive
  FROM o JOIN g USING (contrast, model_key) JOIN l USING (contrast, model_key, metric)""".replace("\\\\", "\\").replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"')
)
def contrast_effects(spark: SparkSession, d: str) -> DataFrame:
    """All named contrasts of conditions per model: effects and intervals of three metrics, whole samples resampled."""
    rows = table(spark, d, "generation_attempts").where("status = 'ok' AND model_key IS NOT NULL AND sample_id IS NOT NULL")
    first = rows.groupBy("model_key", "condition", "method", F.concat_ws(":", "direction", "sample_id").alias("case_id")).agg(F.min_by(F.struct("generated_report", "evidence_trace"), "attempt_id").alias("r"))
    text, trace = F.coalesce("r.generated_report", F.lit("")), F.col("r.evidence_trace")
    cited = F.aggregate(trace, F.lit(0), lambda s, x: s + F.size(x["source_ids"]))
    scored = first.select(
        "model_key",
        "condition",
        "case_id",
        "method",
        F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))).cast("long").alias("words"),
        F.coalesce(F.when(trace.isNotNull(), F.size(trace)), F.lit(0)).cast("long").alias("claims"),
        F.coalesce(cited, F.lit(0)).cast("long").alias("cited"),
        (F.trim(text) == "").cast("long").alias("blank"),
        F.lit(1).cast("long").alias("n"),
    )
    scored = scored.withColumn("study", F.col("method"))
    pairs = statistics.contrast_pairs(scored, statistics.contrasts(spark), "condition", ["model_key", "method"], "case_id", ["study"])
    metrics = {"words": F.col("words") / F.col("n"), "citations_per_claim": F.col("cited") / F.greatest(F.col("claims"), F.lit(1)), "blank": F.col("blank") / F.col("n")}
    return statistics.paired_bootstrap(pairs, ["contrast", "model_key"], "case_id", ["words", "claims", "cited", "blank", "n"], metrics, ["blank"], replicates=200)


@query(
    """SELECT model_key, count(*) AS cells, sum((status <> 'ok')::INT)::BIGINT AS abstained, round(avg(CASE WHEN status = 'ok' THEN coalesce(len(evidence_trace), 0) ELSE 0 END), 9) AS claims, round(avg(CASE WHEN status = 'ok' THEN coalesce(len(evidence_trace), 0) END), 9) AS claims_answered
  FROM generation_attempts WHERE status IS NOT NULL GROUP BY 1"""
)
def abstention_claims(spark: SparkSession, d: str) -> DataFrame:
    """Mean claims with failures as answers that say nothing, and among answers alone."""
    rows = table(spark, d, "generation_attempts").where("status IS NOT NULL")
    answered = rows.where("status = 'ok'").select("model_key", F.coalesce(F.when(F.col("evidence_trace").isNotNull(), F.size("evidence_trace")), F.lit(0)).alias("claims"))
    both = statistics.with_abstentions(answered, rows.where("status <> 'ok'").select("model_key"), {"claims": F.lit(0)})
    return both.groupBy("model_key").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if("abstained").alias("abstained"),
        F.round(F.avg("claims"), 9).alias("claims"),
        F.round(F.avg(F.when(~F.col("abstained"), F.col("claims"))), 9).alias("claims_answered"),
    )


@query("SELECT model_key, direction, finish_reason, count(*) AS n FROM generation_attempts WHERE status <> 'ok' GROUP BY ALL")
def failure_categories(spark: SparkSession, d: str) -> DataFrame:
    """Failed attempts by reason; an unknown reason is a category."""
    return statistics.counted_categories(table(spark, d, "generation_attempts").where("status <> 'ok'"), ["model_key", "direction"], "finish_reason")


@query(
    "SELECT model_key, condition, quantile_cont(p, 0.5) AS prompt_median, count(p) AS prompt_n, quantile_cont(r, 0.5) AS report_median, count(r) AS report_n FROM (SELECT model_key, condition, length(prompt)::DOUBLE AS p, length(generated_report)::DOUBLE AS r FROM generation_attempts) GROUP BY ALL"
)
def length_medians(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generation_attempts").select("model_key", "condition", F.length("prompt").cast("double").alias("prompt"), F.length("generated_report").cast("double").alias("report"))
    return statistics.medians(rows, ["model_key", "condition"], ["prompt", "report"])


@query(
    "SELECT model_key, direction, count(DISTINCT finish_reason) AS versions, count(*) - count(finish_reason) AS unknown, count(DISTINCT finish_reason) = 1 AND count(*) = count(finish_reason) AS homogeneous FROM generation_attempts WHERE status = 'ok' GROUP BY ALL"
)
def protocol_homogeneity(spark: SparkSession, d: str) -> DataFrame:
    return statistics.homogeneity(table(spark, d, "generation_attempts").where("status = 'ok'"), ["model_key", "direction"], "finish_reason")


@query(
    """WITH f AS (SELECT context_signature, arg_min({l: list_distinct(coalesce(cxr_labels, []))}, anchor_row_id).l AS own FROM anchor WHERE context_signature IS NOT NULL GROUP BY 1),
  s AS (SELECT a.context_signature, CASE WHEN len(own) > 0 THEN len(list_intersect(own, coalesce(a.cxr_labels, []))) / len(own) END AS s FROM anchor a JOIN f USING (context_signature))
  SELECT context_signature, max((s > 0)::INT) AS any_overlap, round(avg(s), 9) AS mean_overlap FROM s GROUP BY 1"""
)
def context_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How far the anchors of a context share the labels of its first one."""
    rows = table(spark, d, "anchor").where("context_signature IS NOT NULL").select("context_signature", "anchor_row_id", F.coalesce("cxr_labels", F.array().cast("array<string>")).alias("labels"))
    own = rows.groupBy("context_signature").agg(F.array_distinct(F.min_by("labels", "anchor_row_id")).alias("own"))
    return statistics.context_quality(rows.join(own, "context_signature"), "context_signature", F.col("own"), F.col("labels"))


@query("SELECT count(m) AS groups, round(avg(m), 9) AS mean FROM (SELECT query_modality, source, avg(1.0::DOUBLE / anchor_rank) AS m FROM anchor WHERE anchor_rank >= 1 GROUP BY ALL)")
def mean_rank_over_directions(spark: SparkSession, d: str) -> DataFrame:
    """The mean reciprocal rank, every modality and source weighing the same."""
    return statistics.mean_over(table(spark, d, "anchor").where("anchor_rank >= 1"), ["query_modality", "source"], 1 / F.col("anchor_rank"))


@query(
    "WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings), b AS (SELECT vec_id AS donor, row_number() OVER (ORDER BY md5('4101:' || vec_id), vec_id) AS i FROM embeddings) SELECT vec_id, donor FROM a JOIN b USING (i)"
)
def shuffled_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every query with the vector of another, by a hashed permutation."""
    return statistics.shuffled(table(spark, d, "embeddings"), "vec_id", "4101")


@query(
    "SELECT context_signature, r.a AS anchor_id, length(r.t) AS chars FROM (SELECT context_signature, arg_min({a: anchor_id, t: machine_diagnosis}, (coalesce(anchor_rank, 999999), anchor_row_id)) AS r FROM anchor WHERE context_signature IS NOT NULL GROUP BY 1)"
)
def nearest_copy(spark: SparkSession, d: str) -> DataFrame:
    """The baseline that answers with the text of the nearest anchor."""
    rows = table(spark, d, "anchor").where("context_signature IS NOT NULL")
    first = rows.groupBy("context_signature").agg(F.min_by(F.struct("anchor_id", "machine_diagnosis"), F.struct(F.coalesce("anchor_rank", F.lit(999999)), "anchor_row_id")).alias("r"))
    return first.select("context_signature", "r.anchor_id", F.length("r.machine_diagnosis").alias("chars"))
