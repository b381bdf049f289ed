"""Checked linkage, first rows, salience and context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import parsing, vector
from cohortloom.operators import contexts, linkage
from cohortloom.plans.queries import query
from cohortloom.sources.tables import table


@query(
    """WITH m AS (SELECT hadm_id, min(row_id) AS row_id FROM manifest WHERE hadm_id IS NOT NULL GROUP BY 1 HAVING count(*) = 1), b AS (SELECT hadm_id, min(bank_id) AS bank_id FROM evidence_bank WHERE hadm_id IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
  SELECT hadm_id::BIGINT AS hadm_id, row_id, bank_id FROM m JOIN b USING (hadm_id)"""
)
def one_to_one_admissions(spark: SparkSession, d: str) -> DataFrame:
    """Admissions that the manifest and the bank hold exactly once each."""
    m, b = table(spark, d, "manifest").select("hadm_id", "row_id"), table(spark, d, "evidence_bank").select("hadm_id", "bank_id")
    return linkage.one_to_one(m, b, ["hadm_id"])[0].select("hadm_id", "row_id", "bank_id")


@query(
    """SELECT side, count(*) AS keys, sum(n)::BIGINT AS rows FROM (SELECT 'left' AS side, hadm_id, count(*) AS n FROM manifest WHERE hadm_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'right', hadm_id, count(*) FROM evidence_bank WHERE hadm_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY side"""
)
def one_to_one_problems(spark: SparkSession, d: str) -> DataFrame:
    m, b = table(spark, d, "manifest").select("hadm_id"), table(spark, d, "evidence_bank").select("hadm_id")
    return linkage.one_to_one(m, b, ["hadm_id"])[1].groupBy("side").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"))


_BANK = "(SELECT sample_id, arg_min({subject_id: subject_id, hadm_id: hadm_id, linkage: linkage}, bank_id) AS r FROM evidence_bank WHERE sample_id IS NOT NULL GROUP BY 1)"


@query(
    f"""SELECT a.anchor_row_id, b.r.linkage AS linkage, CASE WHEN b.sample_id IS NULL THEN 'missing' WHEN a.subject_id::BIGINT IS DISTINCT FROM b.r.subject_id::BIGINT OR a.hadm_id::BIGINT IS DISTINCT FROM b.r.hadm_id::BIGINT THEN 'conflict' ELSE 'ok' END AS state
  FROM anchor a LEFT JOIN {_BANK} b ON a.anchor_id = b.sample_id"""
)
def bank_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Anchors with the bank row of their admission, and whether both name the same patient and admission."""
    first = linkage.first_per_key(table(spark, d, "evidence_bank").select("sample_id", "bank_id", "subject_id", "hadm_id", "linkage", "ecg"), "sample_id", "bank_id", "ecg")[0].drop("ecg", "bank_id")
    anchors = table(spark, d, "anchor").select("anchor_row_id", F.col("anchor_id").alias("sample_id"), "subject_id", "hadm_id")
    return linkage.identity_join(anchors, first, ["sample_id"], ["subject_id", "hadm_id"]).select("anchor_row_id", "linkage", "state")


@query(
    r"""WITH p AS (SELECT row_id, nullif(regexp_extract(coalesce(ecg_path, ''), '/s(\d+)/', 1), '') AS e, ecg_study_id::BIGINT::VARCHAR AS es, nullif(regexp_extract(coalesce(cxr_path, ''), '/s(\d+)/', 1), '') AS c, cxr_study_id::BIGINT::VARCHAR AS cs FROM manifest)
  SELECT row_id, CASE WHEN e IS NULL OR es IS NULL THEN 'unknown' WHEN e = es THEN 'agree' ELSE 'conflict' END AS ecg, CASE WHEN c IS NULL OR cs IS NULL THEN 'unknown' WHEN c = cs THEN 'agree' ELSE 'conflict' END AS cxr FROM p"""
)
def path_identity(spark: SparkSession, d: str) -> DataFrame:
    """Whether paths name the study that the manifest names."""
    named = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"/s(\d+)/", 1)
    state = lambda k: linkage.agreement(named(F.col(f"{k}_path")), F.col(f"{k}_study_id").cast("bigint")).alias(k)
    return table(spark, d, "manifest").select("row_id", state("ecg"), state("cxr"))


@query("SELECT anchor_row_id, md5(coalesce(nullif(trim(cxr_report), ''), nullif(concat_ws(' ', nullif(trim(machine_diagnosis), ''), nullif(trim(source), '')), ''))) AS digest FROM anchor")
def report_payload(spark: SparkSession, d: str) -> DataFrame:
    """The first text there is, else the parts joined."""
    text = linkage.first_text([F.col("cxr_report")], [F.col("machine_diagnosis"), F.col("source")])
    return table(spark, d, "anchor").select("anchor_row_id", F.md5(text).alias("digest"))


@query(
    """WITH b AS (SELECT sample_id, bank_id, labs FROM evidence_bank WHERE sample_id IS NOT NULL), f AS (SELECT sample_id, arg_min({v: labs}, bank_id) AS f, count(*) AS rows FROM b GROUP BY 1),
  g AS (SELECT b.sample_id, any_value(f.rows) AS rows, bool_or(CASE WHEN b.labs IS NULL AND f.f.v IS NULL THEN false WHEN b.labs IS NULL OR f.f.v IS NULL OR len(b.labs) <> len(f.f.v) THEN true
    ELSE len(list_filter(range(1, len(b.labs) + 1), lambda i: CASE WHEN b.labs[i] IS NULL AND f.f.v[i] IS NULL THEN false ELSE coalesce(abs(b.labs[i]::DOUBLE - f.f.v[i]::DOUBLE) > 0.00001, true) END)) > 0 END) AS bad FROM b JOIN f USING (sample_id) GROUP BY 1)
  SELECT sample_id, rows FROM g WHERE bad"""
)
def disagreeing_admissions(spark: SparkSession, d: str) -> DataFrame:
    """Admissions loaded again with other numbers than at first."""
    rows = table(spark, d, "evidence_bank").select("sample_id", "bank_id", "labs")
    return linkage.first_per_key(rows, "sample_id", "bank_id", "labs")[1].select("sample_id", "rows")


@query(
    """WITH c AS (SELECT bank_id, unnest(range(0, len(labs))) AS i, unnest(labs)::DOUBLE AS x FROM evidence_bank WHERE labs IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY abs(x) DESC, i) AS n FROM c WHERE NOT isnan(x) AND (x <= -0.15 + 1e-7 OR x >= 0.15 - 1e-7))
  SELECT bank_id, n::INT AS place, i::INT AS i, CASE WHEN x <= -0.15 + 1e-7 THEN 'low' ELSE 'high' END AS direction FROM r WHERE n <= 12"""
)
def lab_salience(spark: SparkSession, d: str) -> DataFrame:
    """The twelve laboratory positions of each record farthest out, beyond fixed limits."""
    rows = table(spark, d, "evidence_bank").select("bank_id", F.posexplode(linkage.salient(F.col("labs"), -0.15, 0.15, 0.0)).alias("place", "s"))
    return rows.select("bank_id", (F.col("place") + 1).alias("place"), "s.i", "s.direction")


@query("SELECT sample_id, count(DISTINCT subject_id) AS versions FROM (SELECT trim(sample_id) AS sample_id, subject_id FROM context_deliveries WHERE sample_id IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT subject_id) > 1")
def varying_query_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "context_deliveries").select(F.trim("sample_id").alias("sample_id"), "subject_id")
    return linkage.varying_identity(rows, "sample_id", ["subject_id"])


@query(
    """SELECT context_signature, count(*) AS versions FROM (SELECT DISTINCT lower(trim(context_signature)) AS context_signature, lower(trim(sample_id)) AS s, lower(trim(condition)) AS c FROM context_deliveries WHERE context_signature IS NOT NULL AND (sample_id IS NOT NULL OR condition IS NOT NULL)) GROUP BY 1 HAVING count(*) > 1"""
)
def signature_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Signatures that stand for several contexts."""
    fold = lambda c: F.lower(F.trim(c)).alias(c)
    rows = table(spark, d, "context_deliveries").select(fold("context_signature"), fold("sample_id"), fold("condition"))
    return linkage.varying_identity(rows, "context_signature", ["sample_id", "condition"])


_CODES = [[float((3 * i + 5 * j) % 7 - 3) + (0.5 if i == j else 0.0) for j in range(8)] for i in range(8)]


@query(
    f"""WITH k AS (SELECT * FROM (VALUES {', '.join(f'({i}, {c}::DOUBLE[])' for i, c in enumerate(_CODES))}) t(code, c)), v AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(0, len(embedding) // 8)) AS chunk FROM embeddings),
  s AS (SELECT vec_id, chunk, code, round(list_dot_product(e[chunk * 8 + 1:chunk * 8 + 8], c) / sqrt(list_dot_product(c, c)), 12) AS s FROM v, k)
  SELECT vec_id, chunk::INT AS chunk, arg_max(code, (s, -code))::INT AS code FROM s GROUP BY 1, 2"""
)
def codebook_codes(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of eight codes for every eight values of each vector."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(vector.nearest_codes(F.col("embedding"), _CODES, 8)).alias("chunk", "code"))
    return rows.select("vec_id", "chunk", "code")


@query(
    """WITH c AS (SELECT delivery_id, direction, condition FROM context_deliveries WHERE delivery_id IS NOT NULL)
  SELECT delivery_id, 'legacy' AS rendering FROM c UNION ALL SELECT delivery_id, 'calibrated' FROM c WHERE direction = 'ecg'"""
)
def rendered_tasks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "context_deliveries").select("delivery_id", "direction")
    return contexts.rendered_tasks(rows, F.col("direction") == "ecg", ["legacy", "calibrated"], "legacy").select("delivery_id", "rendering")


@query(
    """SELECT attempt_id, CASE WHEN trim(t) = '' THEN 'empty_or_hidden' WHEN regexp_matches(trim(t), '^[\\[{]') THEN 'structured' ELSE 'visible' END AS kind FROM (SELECT attempt_id, trim(replace(coalesce(generated_report, ''), chr(10), ' ')) AS t FROM generation_attempts WHERE NOT regexp_matches(coalesce(generated_report, ''), '<|```'))""".replace("\\\\", "\\")
)
def parse_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How texts without control tokens and fences are read: hidden, structured or as visible text."""
    rows = table(spark, d, "generation_attempts").where(~F.coalesce("generated_report", F.lit("")).rlike("<|```"))
    stage = parsing.parsed(F.col("generated_report"))["stage"]
    kind = F.when(F.col("stage").isin("empty_or_hidden", "visible_free_text"), F.when(F.col("stage") == "visible_free_text", "visible").otherwise(F.col("stage"))).when(F.col("stage") == "recovered_report_field", "structured").otherwise("structured")
    return rows.select("attempt_id", stage.alias("stage")).select("attempt_id", kind.alias("kind"))
