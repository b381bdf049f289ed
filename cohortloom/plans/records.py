"""Partition, linkage, deduplication, contract and log queries on the record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import identity
from cohortloom.operators import attempts, contexts, partition
from cohortloom.plans.queries import query
from cohortloom.sources.tables import table

_UID = "CASE WHEN lower(trim({x}::VARCHAR)) IN ('', 'nan', 'none', 'null', '<na>') THEN NULL ELSE trim({x}::VARCHAR) END"
_SPLIT = "CASE WHEN {x} IS NULL THEN 'quarantine' WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END"
_SHA = "('0x' || substr(sha256('experiment4-global-patient-split:' || {x}), 1, 12))::BIGINT % 100"


@query(f"SELECT row_id, {_SPLIT.format(x='u')} AS split_hashed FROM (SELECT row_id, u, {_SHA.format(x='u')} AS b FROM (SELECT row_id, {_UID.format(x='subject_id')} AS u FROM manifest))")
def patient_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest").select("row_id", identity.patient_split("subject_id").alias("split_hashed"))


@query("SELECT c_custkey, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split_hashed FROM (SELECT c_custkey, ('0x' || substr(sha1(c_custkey::VARCHAR), 1, 8))::BIGINT % 100 AS b FROM customer)")
def stable_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", identity.stable_split("c_custkey").alias("split_hashed"))


_FOLDED = "CASE WHEN lower(trim(split)) = '' THEN NULL WHEN lower(trim(split)) = 'validation' THEN 'val' ELSE lower(trim(split)) END"


def _recorded(m: DataFrame) -> DataFrame:
    w = F.lower(F.trim("split"))
    return m.withColumn("p", F.when(w == "", None).when(w == "validation", "val").otherwise(w))


@query(f"SELECT subject_id AS subject, count(DISTINCT p) AS n_splits FROM (SELECT subject_id, {_FOLDED} AS p FROM manifest WHERE subject_id >= 1) WHERE p IS NOT NULL GROUP BY 1 HAVING count(DISTINCT p) > 1")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    m = _recorded(table(spark, d, "manifest").where("subject_id >= 1"))
    return partition.split_leakage(m, F.col("subject_id"), F.col("p"))


@query(
    f"""WITH s AS (SELECT DISTINCT subject_id AS s, {_FOLDED} AS p FROM manifest WHERE subject_id >= 1)
  SELECT a.p AS split_a, b.p AS split_b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.p < b.p GROUP BY ALL"""
)
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    return partition.split_overlap(_recorded(table(spark, d, "manifest").where("subject_id >= 1")), "subject_id", "p")


@query(
    f"""WITH p AS (SELECT DISTINCT {_UID.format(x='subject_id')} AS u FROM manifest WHERE subject_id IS NOT NULL), r AS (SELECT bank_id, {_UID.format(x='subject_id')} AS u FROM evidence_bank),
  j AS (SELECT r.bank_id, r.u, p.u AS held, {_SHA.format(x='r.u')} AS b FROM r LEFT JOIN p USING (u))
  SELECT CASE WHEN u IS NULL THEN 'quarantine' WHEN held IS NOT NULL THEN 'removed' ELSE {_SPLIT.format(x='u')} END AS partition, count(*) AS n FROM j GROUP BY 1"""
)
def protected_partition(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "manifest").select("subject_id")
    rows = table(spark, d, "evidence_bank").select("bank_id", "subject_id")
    return partition.protected_partition(rows, "subject_id", held, identity.SPLIT_SEED).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT row_id, coalesce(CASE WHEN subject_id >= 1 THEN subject_id::VARCHAR END, a, b) AS identity,
    CASE WHEN subject_id >= 1 THEN 'record' WHEN a IS NOT NULL THEN 'ecg_path' WHEN b IS NOT NULL THEN 'cxr_path' ELSE 'rejected' END AS identity_provenance
  FROM (SELECT row_id, subject_id, nullif(regexp_extract(ecg_path, 'p(\\d{8})(/|$)', 1), '') AS a, nullif(regexp_extract(cxr_path, 'p(\\d{8})(/|$)', 1), '') AS b FROM manifest)""".replace("\\\\", "\\")
)
def identity_ladder(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest")
    path = lambda c: identity.only_id(c, r"p(\d{8})(?:/|$)")
    sources = [("record", F.when(F.col("subject_id") >= 1, F.col("subject_id"))), ("ecg_path", path("ecg_path")), ("cxr_path", path("cxr_path"))]
    return partition.identity_ladder(m, sources).select("row_id", "identity", "identity_provenance")


@query(
    """WITH k AS (SELECT row_id, cxr_study_id, row_number() OVER (PARTITION BY cxr_study_id ORDER BY recorded_at NULLS LAST, row_id) AS i FROM manifest)
  SELECT row_id, cxr_study_id IS NULL OR i = 1 AS kept FROM k"""
)
def dedupe_studies(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select("row_id", "cxr_study_id", "recorded_at")
    order = [F.col("recorded_at").isNull(), F.col("recorded_at"), F.col("row_id")]
    return partition.first_per_identity(m, [F.col("cxr_study_id")], order).select("row_id", "kept")


@query("SELECT ecg_study_id AS identity, count(DISTINCT subject_id) AS owners FROM manifest WHERE ecg_study_id IS NOT NULL AND subject_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT subject_id) > 1")
def identity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return partition.identity_conflicts(table(spark, d, "manifest"), "ecg_study_id", "subject_id")


@query(
    """WITH e AS (SELECT hadm_id, count(*) AS n FROM evidence_bank WHERE status = 1 GROUP BY 1), a AS (SELECT hadm_id, count(*) AS n FROM anchor GROUP BY 1)
  SELECT row_id, e.n AS bank_n, e.hadm_id IS NOT NULL AS has_bank, a.n AS anchor_n, a.hadm_id IS NOT NULL AS has_anchor FROM manifest m LEFT JOIN e ON m.hadm_id = e.hadm_id LEFT JOIN a ON m.hadm_id = a.hadm_id"""
)
def linked_admissions(spark: SparkSession, d: str) -> DataFrame:
    count = lambda df: df.where("hadm_id IS NOT NULL").groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n"))
    e, a = count(table(spark, d, "evidence_bank").where("status = 1")), count(table(spark, d, "anchor"))
    m = table(spark, d, "manifest").select("row_id", "hadm_id")
    return partition.linked(m, [("bank", e, "hadm_id", ["n"]), ("anchor", a, "hadm_id", ["n"])]).select("row_id", "bank_n", "has_bank", "anchor_n", "has_anchor")


@query(
    """SELECT o.o_orderkey, c.c_mktsegment AS customer_c_mktsegment, c.c_custkey IS NOT NULL AS has_customer, l.lines AS item_lines, l.l_orderkey IS NOT NULL AS has_item
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey"""
)
def linked_orders(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    found = partition.linked(o, [("customer", table(spark, d, "customer"), "c_custkey", ["c_mktsegment"])], ["o_custkey"])
    found = partition.linked(found, [("item", items, "l_orderkey", ["lines"])], ["o_orderkey"])
    return found.select("o_orderkey", "customer_c_mktsegment", "has_customer", "item_lines", "has_item")


@query(
    """SELECT (SELECT count(*) FROM manifest) AS rows, (SELECT count(*) FROM manifest WHERE subject_id IS NULL) AS null_subject_id, (SELECT count(*) FROM manifest WHERE hadm_id IS NULL) AS null_hadm_id,
    (SELECT count(*) FROM manifest WHERE ecg_path IS NULL) AS null_ecg_path, (SELECT count(*) FROM (SELECT row_id FROM manifest GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys"""
)
def manifest_contract(spark: SparkSession, d: str) -> DataFrame:
    return partition.contract(table(spark, d, "manifest"), ["subject_id", "hadm_id", "ecg_path"], ["row_id"])


_KEY = "model_key, direction, sample_id, method, condition"


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY (status = 'ok') DESC, CASE WHEN status = 'ok' THEN attempted_at END, CASE WHEN status = 'ok' THEN attempt_id END, attempted_at DESC, attempt_id DESC) AS i,
    count(*) OVER (PARTITION BY {_KEY}) AS attempts, count(*) FILTER (WHERE status = 'ok') OVER (PARTITION BY {_KEY}) AS good_attempts FROM generation_attempts)
  SELECT {_KEY}, attempt_id, status, attempts, good_attempts FROM r WHERE i = 1"""
)
def latest_attempt(spark: SparkSession, d: str) -> DataFrame:
    key = _KEY.split(", ")
    log = table(spark, d, "generation_attempts").select(*key, "attempt_id", "status", "attempted_at")
    return attempts.selected_attempts(log, key, F.col("status") == "ok", [F.col("attempted_at"), F.col("attempt_id")]).drop("attempted_at")


_CELL = "direction, sample_id, method, condition"


@query(
    """WITH c AS (SELECT DISTINCT direction, sample_id, method, lower(trim(condition)) AS condition FROM context_deliveries WHERE context_signature IS NOT NULL),
  a AS (SELECT direction, sample_id, method, lower(trim(condition)) AS condition, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok FROM generation_attempts GROUP BY ALL)
  SELECT direction, method, condition, count(*) AS expected, count(*) FILTER (WHERE ok > 0) AS successful, count(*) FILTER (WHERE ok = 0) AS failed, count(*) FILTER (WHERE n IS NULL) AS pending,
    coalesce(sum(n), 0)::BIGINT AS attempts, coalesce(sum(n - 1), 0)::BIGINT AS duplicates, round(count(*) FILTER (WHERE ok > 0) / count(*), 9) AS availability
  FROM c LEFT JOIN a USING (direction, sample_id, method, condition) GROUP BY direction, method, condition"""
)
def attempt_coverage(spark: SparkSession, d: str) -> DataFrame:
    key = _CELL.split(", ")
    fold = lambda df: df.withColumn("condition", contexts.folded_condition())
    expected = fold(table(spark, d, "context_deliveries").where("context_signature IS NOT NULL"))
    log = fold(table(spark, d, "generation_attempts"))
    return attempts.coverage(expected, log.select(*key, "status", "attempt_id"), key, ["direction", "method", "condition"], F.col("status") == "ok", [F.col("attempt_id")])


@query(
    f"""WITH c AS (SELECT DISTINCT {_CELL} FROM context_deliveries), a AS (SELECT DISTINCT {_CELL} FROM generation_attempts)
  SELECT 'missing' AS side, count(*) AS cells FROM (SELECT * FROM c EXCEPT SELECT * FROM a) UNION ALL SELECT 'unexpected', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM c)"""
)
def cell_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return attempts.mismatch(table(spark, d, "context_deliveries"), table(spark, d, "generation_attempts"), _CELL.split(", "))


@query(f"SELECT {_KEY}, count(DISTINCT generated_report) AS versions FROM generation_attempts WHERE status = 'ok' AND generated_report IS NOT NULL GROUP BY ALL HAVING count(DISTINCT generated_report) > 1")
def conflicting_successes(spark: SparkSession, d: str) -> DataFrame:
    return attempts.conflicts(table(spark, d, "generation_attempts"), _KEY.split(", "), (F.col("status") == "ok") & F.col("generated_report").isNotNull(), "generated_report")


@query(
    """WITH r AS (SELECT attempt_id, model_key, direction, method, row_number() OVER (PARTITION BY model_key, direction, method ORDER BY md5('pilot:' || attempt_id), attempt_id) AS rn FROM generation_attempts)
  SELECT attempt_id, rn FROM r ORDER BY rn, model_key NULLS FIRST, direction NULLS FIRST, method NULLS FIRST LIMIT 60"""
)
def round_robin_pilot(spark: SparkSession, d: str) -> DataFrame:
    from cohortloom.operators.controls import hash_order

    rows = table(spark, d, "generation_attempts").select("attempt_id", "model_key", "direction", "method")
    return attempts.round_robin(rows, ["model_key", "direction", "method"], [hash_order("pilot", "attempt_id"), F.col("attempt_id")], 60).select("attempt_id", "rn")


@query(
    """WITH f AS (SELECT model_key, direction, method, sample_id, subject, condition FROM (SELECT a.model_key, a.direction, a.method, a.sample_id, a.condition, a.finish_reason AS subject,
      row_number() OVER (PARTITION BY model_key, direction, method, sample_id, condition ORDER BY attempt_id) AS i FROM generation_attempts a WHERE status = 'ok') WHERE i = 1)
  SELECT count(*) AS pairs, count(*) FILTER (WHERE a.subject = b.subject) AS matched, count(*) FILTER (WHERE (a.subject = b.subject) IS NOT TRUE) AS excluded
  FROM f a JOIN f b USING (model_key, direction, method, sample_id) WHERE a.condition = 'full_trimodal' AND b.condition = 'same_only'"""
)
def paired_contract(spark: SparkSession, d: str) -> DataFrame:
    key = ["model_key", "direction", "method", "sample_id"]
    log = table(spark, d, "generation_attempts").where("status = 'ok'").select(*key, "condition", "attempt_id", "finish_reason")
    one = partition.latest(log, [*key, "condition"], [F.col("attempt_id")])
    pairs = attempts.paired(one, "condition", "full_trimodal", "same_only", key, ["finish_reason"])
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("ok").alias("matched"), F.count_if(~F.col("ok")).alias("excluded"))


@query("SELECT event_type, user_id % 10 AS shard, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1 GROUP BY ALL")
def latest_event(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    last = e.groupBy("user_id", "event_type").agg(F.max_by("ts", F.struct("ts", "event_id")).alias("ts"))
    return last.groupBy("event_type", F.pmod("user_id", F.lit(10)).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    """SELECT lower(trim(condition)) AS condition, direction, count(DISTINCT sample_id) AS members,
    sum(('0x' || substr(md5(sample_id), 1, 8))::BIGINT % 2147483648)::BIGINT AS cohort FROM (SELECT DISTINCT lower(trim(condition)) AS condition, direction, sample_id FROM context_deliveries WHERE sample_id IS NOT NULL) GROUP BY ALL"""
)
def cohort_balance(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "context_deliveries").withColumn("condition", contexts.folded_condition())
    return contexts.cohort_balance(c, ["condition", "direction"], "sample_id")


@query(
    """WITH k AS (SELECT sample_id AS anchor_id, max(subject_id) AS s FROM evidence_bank GROUP BY 1), e AS (SELECT delivery_id, subject_id, x.anchor_id AS anchor_id FROM (SELECT delivery_id, subject_id, unnest(evidence) AS x FROM context_deliveries))
  SELECT DISTINCT delivery_id, problem FROM (
    SELECT delivery_id, 'own_subject' AS problem FROM e JOIN k USING (anchor_id) WHERE s = subject_id
    UNION ALL SELECT delivery_id, 'repeated_anchor' FROM e GROUP BY delivery_id, anchor_id HAVING count(*) > 1
    UNION ALL SELECT delivery_id, 'unknown_anchor' FROM e WHERE anchor_id NOT IN (SELECT anchor_id FROM k WHERE anchor_id IS NOT NULL))"""
)
def evidence_problems(spark: SparkSession, d: str) -> DataFrame:
    return contexts.evidence_problems(table(spark, d, "context_deliveries"), table(spark, d, "evidence_bank"))


@query(
    """SELECT direction, anchor_rank, count(*) AS n, count(score) AS scored, round(avg(score), 6) AS mean_score, round(stddev_samp(score), 6) AS sd_score, round(median(score), 6) AS median_score
  FROM (SELECT query_modality AS direction, anchor_rank, score FROM anchor) GROUP BY ALL"""
)
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "anchor")
    return a.groupBy(F.col("query_modality").alias("direction"), "anchor_rank").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("score").alias("scored"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.stddev_samp("score"), 6).alias("sd_score"),
        F.round(F.expr("percentile(score, 0.5)"), 6).alias("median_score"),
    )
