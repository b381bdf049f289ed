"""Selection, parsing, audit and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import parsing, prompts
from cohortloom.functions import text as T
from cohortloom.functions.vector import sign_codes
from cohortloom.operators import attempts, codes, contexts, controls, partition, selection
from cohortloom.plans.labels import _mentions, citations
from cohortloom.plans.queries import query
from cohortloom.sources.tables import table


@query(
    """WITH v AS (SELECT unnest([struct_pack(m := 'ecg', v := ecg), struct_pack(m := 'cxr', v := cxr), struct_pack(m := 'labs', v := labs)]) AS x FROM evidence_bank),
  s AS (SELECT x.m AS modality, CASE WHEN x.v IS NULL THEN 'null' WHEN len(x.v) <> 64 THEN 'width' WHEN len(list_filter(x.v, lambda y: y IS NULL OR isnan(y) OR isinf(y))) > 0 THEN 'not_finite'
    WHEN len(list_filter(x.v, lambda y: y <> 0)) = 0 THEN 'zero' ELSE 'usable' END AS s FROM v)
  SELECT modality, count(*) FILTER (WHERE s = 'null') AS null_n, count(*) FILTER (WHERE s = 'width') AS width_n, count(*) FILTER (WHERE s = 'not_finite') AS not_finite_n,
    count(*) FILTER (WHERE s = 'zero') AS zero_n, count(*) FILTER (WHERE s = 'usable') AS usable_n FROM s GROUP BY modality"""
)
def vector_audit(spark: SparkSession, d: str) -> DataFrame:
    b, out = table(spark, d, "evidence_bank"), None
    for m in ("ecg", "cxr", "labs"):
        one = selection.vector_audit(b, m, 64).select(F.lit(m).alias("modality"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT (i - 1)::INT AS i, round(avg(x::DOUBLE), 6) AS mean, count(*) AS n FROM (SELECT unnest(labs) AS x, unnest(range(1, len(labs) + 1)) AS i FROM evidence_bank WHERE status = 1 AND labs IS NOT NULL)
  WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) GROUP BY i"""
)
def lab_means(spark: SparkSession, d: str) -> DataFrame:
    return selection.column_means(table(spark, d, "evidence_bank").where("status = 1").select("labs"), "labs")


@query(
    """WITH t AS (SELECT floor(vec_id / 10)::BIGINT AS g, (vec_id % 10 = 0)::INT AS y, embedding[1]::DOUBLE AS s FROM embeddings), r AS (SELECT g, count(*) FILTER (WHERE s > p) + 1 AS rank FROM (SELECT *, max(s) FILTER (WHERE y = 1) OVER (PARTITION BY g) AS p FROM t) GROUP BY g)
  SELECT avg((rank <= 1)::INT) AS recall_at_1, avg((rank <= 5)::INT) AS recall_at_5, avg((rank <= 10)::INT) AS recall_at_10, avg(1 / rank) AS mrr, median(rank) AS median_rank, avg(rank) AS mean_rank, 0.1 AS chance_at_1 FROM r"""
)
def ten_candidate_pools(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    pools = e.select(F.floor(F.col("vec_id") / 10).alias("g"), (F.pmod("vec_id", F.lit(10)) == 0).cast("int").alias("y"), F.col("embedding")[0].cast("double").alias("s"))
    return selection.rank_summary(selection.pool_ranks(pools, "g", "y", "s"), F.lit(10))


@query("SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS i FROM lineitem) WHERE i = 1")
def best_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice")
    return selection.best_runs(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query("SELECT event_type, round(avg(value), 9) AS value_mean, round(stddev_samp(value), 9) AS value_std, count(value) AS value_n FROM events WHERE NOT isnan(value) GROUP BY event_type")
def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    return selection.seed_summary(table(spark, d, "events").select("event_type", "value"), ["event_type"], ["value"])


_CONCEPTS = {"ventricular_hypertrophy": T.ECG_RULES["ventricular_hypertrophy"], "paced_rhythm": T.ECG_RULES["paced_rhythm"]}
_FINDINGS = {"cardiomegaly": T.CXR_RULES["Cardiomegaly"], "edema": T.CXR_RULES["Edema"], "pleural_effusion": T.CXR_RULES["Pleural Effusion"], "support_device": T.CXR_RULES["Support Devices"]}


@query(
    f"""WITH qs AS (SELECT anchor_row_id AS key, machine_diagnosis AS t FROM anchor WHERE anchor_row_id % 50 = 0), ts AS (SELECT anchor_row_id AS key, cxr_report AS t FROM anchor), {_mentions('qs', _CONCEPTS, 'q')}, {_mentions('ts', _FINDINGS, 'c')},
  own AS (SELECT DISTINCT key, concept FROM q WHERE status = 'present'), rel(source, target) AS (VALUES {', '.join(str(x) for x in selection.COMPATIBLE)}),
  want AS (SELECT key, concept FROM own UNION SELECT key, target FROM own JOIN rel ON concept = source), have AS (SELECT concept, count(DISTINCT key) AS targets FROM c WHERE status = 'present' GROUP BY 1)
  SELECT key AS query_id, concept, targets FROM want JOIN have USING (concept)"""
)
def concept_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the rows divisible by 50, against the findings of all rows."""
    a = table(spark, d, "anchor")

    def concepts(rows: DataFrame, text: str, rules: dict) -> DataFrame:
        kept = F.filter(T.assertions(F.col(text), rules), lambda x: x["status"] == "present")
        return rows.select(F.col("anchor_row_id").alias("id"), F.explode(F.transform(kept, lambda x: x["concept"])).alias("concept"))

    q = concepts(a.where(F.pmod("anchor_row_id", F.lit(50)) == 0), "machine_diagnosis", _CONCEPTS)
    return selection.concept_relevance(q, concepts(a, "cxr_report", _FINDINGS), selection.compatible(spark))


@query(
    """WITH r AS (SELECT anchor_row_id, cxr_labels, md5('5107:' || anchor_row_id) AS h FROM anchor), l AS (SELECT anchor_row_id, h, unnest(list_distinct(cxr_labels)) AS label FROM r),
  f AS (SELECT label, arg_min(anchor_row_id, h) AS anchor_row_id, count(*) AS cases FROM l GROUP BY label), k AS (SELECT anchor_row_id, min(cases) AS rarity FROM f GROUP BY 1),
  c AS (SELECT r.anchor_row_id, h, CASE WHEN k.anchor_row_id IS NULL THEN 1 ELSE 0 END AS p, coalesce(rarity, 0) AS rarity FROM r LEFT JOIN k USING (anchor_row_id))
  SELECT anchor_row_id, CASE WHEN p = 0 THEN 'label' ELSE 'fill' END AS reason FROM c ORDER BY p, rarity, h LIMIT 40"""
)
def coverage_first_cohort(spark: SparkSession, d: str) -> DataFrame:
    """A cohort of 40: the size is the operator's parameter."""
    return selection.coverage_first_cohort(table(spark, d, "anchor").select("anchor_row_id", "cxr_labels"), "anchor_row_id", "cxr_labels", 40, "5107")


@query(
    """WITH s AS (SELECT context_signature, list(DISTINCT anchor_id) AS src FROM anchor WHERE context_signature IS NOT NULL AND anchor_id IS NOT NULL GROUP BY 1),
  c AS (SELECT model_key, sample_id, method, lower(trim(condition)) AS condition, flatten(list_transform(coalesce(evidence_trace, []), lambda x: coalesce(x.source_ids, []))) AS cited, src FROM generation_attempts LEFT JOIN s USING (context_signature) WHERE status = 'ok'),
  v AS (SELECT model_key, sample_id, method, condition, avg(CASE WHEN len(cited) > 0 THEN len(list_filter(cited, lambda x: list_contains(coalesce(src, []), x))) / len(cited) WHEN src IS NULL THEN 1.0 ELSE 0.0 END) AS v FROM c GROUP BY ALL)
  SELECT model_key, count(*) AS n, round(avg(a.v), 9) AS mean_left, round(avg(b.v), 9) AS mean_right, round(avg(a.v) - avg(b.v), 9) AS delta
  FROM v a JOIN v b USING (model_key, sample_id, method) WHERE a.condition = 'full_trimodal' AND b.condition = 'same_only' GROUP BY model_key"""
)
def paired_effect(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generation_attempts").where("status = 'ok'")
    key = ["model_key", "sample_id", "method"]
    v = rows.select("attempt_id", *key, contexts.folded_condition().alias("condition")).join(citations(rows, spark, d), "attempt_id").withColumnRenamed("validity", "v")
    pairs = attempts.paired(v.groupBy(*key, "condition").agg(F.avg("v").alias("v")), "condition", "full_trimodal", "same_only", key, [])
    return selection.paired_effect(pairs, ["model_key"], "v_a", "v_b")


@query(
    """WITH c AS (SELECT vec_id, list_transform(range(0, 8), lambda i: list_sum(list_transform(range(1, 9), lambda j: CASE WHEN embedding[i * 8 + j] > 0 THEN 1 << (j - 1) ELSE 0 END))::INT) AS a,
    list_transform(range(0, 8), lambda i: list_sum(list_transform(range(1, 9), lambda j: CASE WHEN embedding[i * 8 + j] + 0.01 > 0 THEN 1 << (j - 1) ELSE 0 END))::INT) AS b FROM embeddings)
  SELECT count(*) AS rows, round(avg(list_sum(list_transform(range(1, 9), lambda i: (a[i] = b[i])::INT)) / 8.0), 9) AS chunk_rate, round(avg((a = b)::INT), 9) AS sequence_rate FROM c"""
)
def code_agreement(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    shifted = F.transform("embedding", lambda x: x.cast("double") + 0.01)
    return codes.code_agreement(e.select(sign_codes(F.col("embedding"), 8).alias("a"), sign_codes(shifted, 8).alias("b")), "a", "b")


@query("SELECT attempt_id, len(list_filter(string_split(coalesce(prompt, ''), chr(10)), lambda x: regexp_matches(x, '^\\s*(ECG|CXR)\\b'))) AS lines FROM generation_attempts".replace("\\\\", "\\"))
def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generation_attempts").select("attempt_id", F.size(prompts.evidence_lines(F.col("prompt"))).alias("lines"))


@query(
    """WITH b AS (SELECT context_signature, anchor_rank, anchor_row_id, 'Anchor ' || anchor_id || ' (other patient; ' || coalesce(source, 'unknown') || ')' || chr(10) || 'ECG statements: ' || coalesce(nullif(substr(coalesce(machine_diagnosis, ''), 1, 120), ''), 'unavailable') || chr(10) ||
    'Radiograph labels: ' || coalesce(nullif(array_to_string(cxr_labels, ', '), ''), 'none listed') || '. Radiograph report: ' || coalesce(nullif(substr(coalesce(cxr_report, ''), 1, 120), ''), 'unavailable') AS t FROM anchor WHERE anchor_id IS NOT NULL)
  SELECT anchor_row_id, length(t) AS chars, md5(t) AS digest FROM b"""
)
def anchor_blocks(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "anchor").where("anchor_id IS NOT NULL")
    keep = F.array(F.lit("ecg"), F.lit("cxr"))
    t = prompts.anchor_block(F.col("anchor_id"), F.col("source"), F.col("machine_diagnosis"), F.lit(None).cast("string"), F.col("cxr_labels"), F.col("cxr_report"), keep, 120)
    return a.select("anchor_row_id", t.alias("t")).select("anchor_row_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query()
def parse_stages(spark: SparkSession, d: str) -> DataFrame:
    """How each model's raw text is understood; parsing JSON text by stages has no SQL."""
    rows = table(spark, d, "generation_attempts").where("status = 'ok'").select("model_key", parsing.parsed(F.col("generated_report")).alias("p"))
    return rows.groupBy("model_key", F.col("p.stage").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the windowed counts; the streaming form is in the streaming package."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")


@query(
    """WITH o AS (SELECT vec_id AS slot, vec_id % 50 AS owner, row_number() OVER (ORDER BY vec_id % 50, vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings), k AS (SELECT max(c) AS k FROM (SELECT count(*) AS c FROM o GROUP BY owner))
  SELECT a.slot, b.slot AS donor FROM o a, k JOIN o b ON b.i = (a.i + k) % a.n"""
)
def rotation_control(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.pmod("vec_id", F.lit(50)).alias("owner"))
    return controls.rotation_control(e, "vec_id", "owner")


@query(
    """WITH q AS (SELECT doc_id AS query_id, subject_id AS qo, length(text) AS ql FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL), p AS (SELECT doc_id AS id, subject_id AS owner, length(text) AS length FROM documents WHERE text IS NOT NULL),
  r AS (SELECT query_id, id AS cand_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(ql - length), id) AS pick FROM q JOIN p ON qo <> owner)
  SELECT query_id, cand_id, pick FROM r WHERE pick <= 2"""
)
def length_matched_control(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the documents divisible by 50, against all."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("subject_id").alias("owner"), F.length("text").alias("length"))
    return controls.length_matched(rows.where(F.pmod("id", F.lit(50)) == 0), rows)


@query(
    """SELECT query_id, cand_id, query_id = cand_id AS relevant FROM (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY (q.vec_id = c.vec_id)::INT DESC, md5('4101:' || q.vec_id || ':' || c.vec_id), c.vec_id) AS i
    FROM embeddings q JOIN embeddings c ON true WHERE q.vec_id % 50 = 0) WHERE i <= 100"""
)
def sampled_pools(spark: SparkSession, d: str) -> DataFrame:
    """Pools of 100 with one positive each, as drawn; queries are the ids divisible by 50, against all rows."""
    e = table(spark, d, "embeddings")
    q = e.where(F.pmod("vec_id", F.lit(50)) == 0).select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("cand_id"))
    return selection.sampled_pool(q, e.select(F.col("vec_id").alias("cand_id")), 100, "4101")


@query("SELECT DISTINCT sample_id, CASE WHEN b THEN 'bank' ELSE 'deliveries' END AS source FROM (SELECT DISTINCT anchor_id AS sample_id FROM anchor WHERE anchor_id IS NOT NULL) a JOIN (SELECT sample_id, bool_or(b) AS b FROM (SELECT sample_id, true AS b FROM evidence_bank UNION ALL SELECT anchor_id, false FROM anchor) GROUP BY 1) USING (sample_id)")
def source_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Anchors known to the bank come from it; the others fill the gaps."""
    anchors = table(spark, d, "anchor").where("anchor_id IS NOT NULL").select(F.col("anchor_id").alias("sample_id")).distinct()
    bank = table(spark, d, "evidence_bank").select("sample_id").distinct().join(anchors, "sample_id", "left_semi").withColumn("source", F.lit("bank"))
    return attempts.precedence([bank, anchors.withColumn("source", F.lit("deliveries"))], ["sample_id"])


@query(
    """WITH a AS (SELECT DISTINCT sample_id, direction FROM generation_attempts), b AS (SELECT DISTINCT sample_id, direction FROM context_deliveries)
  SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_attempts"""
)
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t).select("sample_id", "direction").distinct() for t in ("generation_attempts", "context_deliveries"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(a.intersect(b), "shared").crossJoin(one(a.union(b).distinct(), "either")).crossJoin(one(a.exceptAll(b), "only_attempts"))


@query("SELECT row_id, split AS recorded, row_number() OVER (PARTITION BY coalesce(subject_id, -1) ORDER BY recorded_at NULLS LAST, row_id) AS rn FROM manifest")
def study_order(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").withColumn("s", F.coalesce("subject_id", F.lit(-1)))
    return partition.ranked_in_order(m, ["s"], [F.col("recorded_at").asc_nulls_last(), F.col("row_id")]).select("row_id", F.col("split").alias("recorded"), "rn")
