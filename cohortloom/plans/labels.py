"""Text, label and review queries on reports and statements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import text as T
from cohortloom.functions.identity import listed_labels, reference_labels
from cohortloom.operators import attempts, contexts, controls, labels, review
from cohortloom.plans.queries import query
from cohortloom.sources.tables import table

ECG, CXR = sorted(T.ECG_RULES), sorted(T.CXR_RULES)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules(rules: Mapping[str, Sequence[str]]) -> str:
    return ", ".join(f"({_q(c)}, {_q(p)})" for c, ps in rules.items() for p in ps)


def _mentions(source: str, rules: Mapping[str, Sequence[str]], name: str = "asserted") -> str:
    """CTEs from ``source`` (key, t) to ``name`` (key, concept, status), by the same windows around each mention."""
    return f"""
  rules_{name}(concept, pattern) AS (VALUES {_rules(rules)}),
  folded_{name} AS (SELECT key, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS t FROM {source} WHERE t IS NOT NULL),
  hit_{name} AS (SELECT key, t, concept, regexp_extract_all(t, '(?s)(.*?)(?:' || pattern || ')', 0) AS w, regexp_extract_all(t, '(?s)(.*?)(?:' || pattern || ')', 1) AS b
    FROM folded_{name} JOIN rules_{name} ON regexp_matches(t, pattern)),
  at_{name} AS (SELECT key, t, concept, i, list_sum(list_transform(w[1:i], lambda x: length(x))) AS stop, coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) + length(b[i]) AS start
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM hit_{name})),
  near_{name} AS (SELECT key, concept, list_extract(string_split_regex(substr(t, (greatest(start - 120, 0) + 1)::BIGINT, least(start, 120)::BIGINT), {_q(T.CLAUSE)}), -1) AS l, substr(t, (stop + 1)::BIGINT, 50) AS r FROM at_{name}),
  {name} AS (SELECT DISTINCT key, concept, CASE WHEN regexp_matches(l, {_q(T.UNCERTAIN_BEFORE)}) OR regexp_matches(r, {_q(T.UNCERTAIN_AFTER)}) THEN 'uncertain'
    WHEN regexp_matches(l, {_q(T.NEGATED_BEFORE)}) OR regexp_matches(r, {_q(T.NEGATED_AFTER)}) THEN 'absent' ELSE 'present' END AS status FROM near_{name})"""


def _asserted(rows: DataFrame, text: str, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """``text, rows, asserted``: each distinct text once, as copies cost one evaluation.

    The number of partitions is the session's own: the texts are few and small, but each costs many patterns, so they
    must not be coalesced by size.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.where(F.col(text).isNotNull()).groupBy(text).agg(F.count(F.lit(1)).alias("rows")).repartition(partitions)
    return texts.withColumn("_value", T.assertion_text(F.col(text))).withColumn("asserted", T.assertions_in(F.col("_value"), rules)).drop("_value")


@query(
    f"""WITH src AS (SELECT anchor_row_id AS key, machine_diagnosis AS t FROM anchor), {_mentions('src', T.ECG_RULES)}
  SELECT key AS anchor_row_id, concept, status FROM asserted"""
)
def assertion_status_ecg(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "anchor").select("anchor_row_id", "machine_diagnosis")
    found = a.join(_asserted(a, "machine_diagnosis", T.ECG_RULES), "machine_diagnosis")
    return found.select("anchor_row_id", F.explode("asserted").alias("x")).select("anchor_row_id", "x.concept", "x.status")


@query(
    f"""WITH src AS (SELECT anchor_row_id AS key, cxr_report AS t FROM anchor), {_mentions('src', T.CXR_RULES)}
  SELECT concept, status, count(*) AS n FROM asserted GROUP BY ALL"""
)
def assertion_counts_cxr(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "anchor").select("anchor_row_id", "cxr_report")
    return _asserted(a, "cxr_report", T.CXR_RULES).select("rows", F.explode("asserted").alias("x")).groupBy("x.concept", "x.status").agg(F.sum("rows").alias("n"))


def _present(name: str, normal: str, out: str) -> str:
    return f"""{out} AS (SELECT key, CASE WHEN len(l) > 1 THEN list_filter(l, lambda x: x <> {_q(normal)}) ELSE l END AS l FROM (SELECT key, list(DISTINCT concept) AS l FROM {name} WHERE status = 'present' GROUP BY key))"""


_NAMES = "(VALUES " + ", ".join(f"({_q(x)})" for x in CXR) + ") names(label)"
_LONG = f"""WITH src AS (SELECT anchor_row_id AS key, cxr_report AS t FROM anchor), {_mentions('src', T.CXR_RULES)}, {_present('asserted', 'No Finding', 'pred')},
  truth AS (SELECT anchor_row_id AS key, query_modality AS g, CASE WHEN len(l) > 1 THEN list_filter(l, lambda x: x <> 'No Finding') ELSE l END AS l
    FROM (SELECT anchor_row_id, query_modality, list_distinct(list_filter(coalesce(cxr_labels, []), lambda x: x IN ({', '.join(map(_q, CXR))}))) AS l FROM anchor WHERE cxr_report IS NOT NULL)),
  long AS (SELECT t.key, t.g, label, CASE WHEN len(t.l) = 0 THEN -1 ELSE list_contains(t.l, label)::INT END AS y, coalesce(list_contains(p.l, label), false)::INT AS p
    FROM truth t LEFT JOIN pred p USING (key), {_NAMES}),
  lab AS (SELECT g, label, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn,
    count(*) FILTER (WHERE y = p AND y >= 0) AS correct, count(*) FILTER (WHERE y >= 0) AS known, count(*) FILTER (WHERE y = 1) AS positive FROM long GROUP BY ALL)"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    """Radiograph labels against the report's assertions; a row without labels is unknown throughout."""
    a = table(spark, d, "anchor").where("cxr_report IS NOT NULL").select("anchor_row_id", F.col("query_modality").alias("g"), "cxr_labels", "cxr_report")
    rows = a.join(_asserted(a, "cxr_report", T.CXR_RULES), "cxr_report")
    truth = reference_labels(F.col("cxr_labels"), CXR)
    known = F.when(F.size(truth) > 0, F.array(*map(F.lit, CXR))).otherwise(F.array().cast("array<string>"))
    return labels.long_form(rows, ["anchor_row_id", "g"], truth, T.present(F.col("asserted"), "No Finding"), CXR, known)


@query(
    _LONG
    + """, r AS (SELECT g, key, min((y = p OR y < 0)::INT) AS exact, max((y = 1)::INT) AS any_true FROM long GROUP BY ALL),
  n AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE any_true = 0) AS empty_reference_n, avg(exact) AS exact FROM r GROUP BY g),
  w AS (SELECT g, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(correct) AS correct, sum(known) AS known, sum(positive) AS positive, avg(2 * tp / greatest(2 * tp + fp + fn, 1)) AS macro FROM lab GROUP BY g)
  SELECT g, n, empty_reference_n, round(tp / greatest(tp + fp, 1), 9) AS micro_precision, round(tp / greatest(tp + fn, 1), 9) AS micro_recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 9) AS micro_f1,
    round(macro, 9) AS macro_f1, round(exact, 9) AS exact_match, round(correct / greatest(known, 1), 9) AS hamming_accuracy, round(1 - positive / greatest(known, 1), 9) AS all_negative_baseline FROM w JOIN n USING (g)"""
)
def multilabel_summary(spark: SparkSession, d: str) -> DataFrame:
    return labels.summary(_long(spark, d), ["g"], ["anchor_row_id"])


@query(
    _LONG
    + """ SELECT g, label, known AS known_n, positive AS positive_n, tp, fp, fn, CASE WHEN known > 0 THEN round(tp / greatest(tp + fp, 1), 9) END AS precision,
    CASE WHEN known > 0 THEN round(tp / greatest(tp + fn, 1), 9) END AS recall, CASE WHEN known > 0 THEN round(2 * tp / greatest(2 * tp + fp + fn, 1), 9) END AS f1 FROM lab"""
)
def per_label_table(spark: SparkSession, d: str) -> DataFrame:
    return labels.per_label(_long(spark, d), ["g"])


@query(
    f"""WITH t AS (SELECT source, count(*) AS n FROM anchor GROUP BY 1), h AS (SELECT source, label, count(*) AS positive FROM (SELECT anchor_row_id, source, unnest(list_distinct(cxr_labels)) AS label FROM anchor) GROUP BY ALL)
  SELECT t.source, names.label, coalesce(positive, 0) AS positive, n, round(coalesce(positive, 0) / n, 9) AS prevalence FROM t CROSS JOIN {_NAMES} LEFT JOIN h ON h.source = t.source AND h.label = names.label"""
)
def label_prevalence(spark: SparkSession, d: str) -> DataFrame:
    return labels.prevalence(table(spark, d, "anchor").select("source", "cxr_labels"), listed_labels(F.col("cxr_labels")), CXR, ["source"])


_ROW = f"""WITH src AS (SELECT anchor_row_id AS key, cxr_report AS t FROM anchor), {_mentions('src', T.CXR_RULES)}, {_present('asserted', 'No Finding', 'pred')},
  truth AS (SELECT anchor_row_id AS key, CASE WHEN len(l) > 1 THEN list_filter(l, lambda x: x <> 'No Finding') ELSE l END AS l
    FROM (SELECT anchor_row_id, list_distinct(list_filter(coalesce(cxr_labels, []), lambda x: x IN ({', '.join(map(_q, CXR))}))) AS l FROM anchor WHERE cxr_report IS NOT NULL)),
  j AS (SELECT key, t.l AS y, coalesce(p.l, []) AS p FROM truth t LEFT JOIN pred p USING (key))"""


@query(
    _ROW
    + """ SELECT key AS anchor_row_id, round(len(list_filter(p, lambda x: NOT list_contains(y, x))) / greatest(len(p), 1), 9) AS discordance,
    round(len(list_filter(y, lambda x: NOT list_contains(p, x))) / greatest(len(y), 1), 9) AS omission FROM j"""
)
def row_rates(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "anchor").where("cxr_report IS NOT NULL").select("anchor_row_id", "cxr_labels", "cxr_report")
    rows = a.join(_asserted(a, "cxr_report", T.CXR_RULES), "cxr_report")
    rates = labels.row_rates(reference_labels(F.col("cxr_labels"), CXR), T.present(F.col("asserted"), "No Finding"))
    return rows.select("anchor_row_id", *(F.round(v, 9).alias(k) for k, v in rates.items()))


@query(
    """WITH s AS (SELECT context_signature, list(DISTINCT anchor_id) AS src FROM anchor WHERE context_signature IS NOT NULL AND anchor_id IS NOT NULL GROUP BY 1),
  c AS (SELECT attempt_id, context_signature, flatten(list_transform(coalesce(evidence_trace, []), lambda x: coalesce(x.source_ids, []))) AS cited FROM generation_attempts WHERE status = 'ok')
  SELECT attempt_id, round(CASE WHEN len(cited) > 0 THEN len(list_filter(cited, lambda x: list_contains(coalesce(src, []), x))) / len(cited) WHEN src IS NULL THEN 1.0 ELSE 0.0 END, 9) AS validity
  FROM c LEFT JOIN s USING (context_signature)"""
)
def citation_validity(spark: SparkSession, d: str) -> DataFrame:
    return citations(table(spark, d, "generation_attempts").where("status = 'ok'"), spark, d).select("attempt_id", F.round("validity", 9).alias("validity"))


def citations(attempts_: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "anchor").select(F.col("context_signature").alias("signature"), F.col("anchor_id").alias("source"))
    cited = F.flatten(F.transform(F.coalesce("evidence_trace", F.expr("array()")), lambda x: F.coalesce(x["source_ids"], F.array().cast("array<string>"))))
    return labels.citations(attempts_, "attempt_id", "context_signature", cited, sources)


@query(
    """SELECT model_key, count(*) AS attempts, count(*) FILTER (WHERE length(trim(coalesce(generated_report, ''))) = 0) AS empty,
    count(*) FILTER (WHERE length(trim(coalesce(generated_report, ''))) > 0 AND len(tk) > 0 AND len(list_filter(tk, lambda x: x NOT IN ('report', 'evidence_trace', 'uncertainties', 'claim', 'source_ids', 'json'))) = 0) AS schema_echo
  FROM (SELECT model_key, generated_report, regexp_extract_all(lower(coalesce(generated_report, '')), '[a-z_]+') AS tk FROM generation_attempts WHERE status = 'ok') GROUP BY 1"""
)
def non_reports(spark: SparkSession, d: str) -> DataFrame:
    kind = attempts.non_report(F.col("generated_report"), ["report", "evidence_trace", "uncertainties", "claim", "source_ids", "json"])
    rows = table(spark, d, "generation_attempts").where("status = 'ok'").select("model_key", kind.alias("kind"))
    return rows.groupBy("model_key").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("kind") == "empty").alias("empty"), F.count_if(F.col("kind") == "schema_echo").alias("schema_echo"))


_EXCERPT = """SELECT doc_id, CASE WHEN t = '' THEN 'unavailable' WHEN length(t) <= 120 THEN t
    ELSE coalesce(nullif(regexp_replace(substr(t, 1, 116), ' [^ ]*$', ''), ''), substr(t, 1, 116)) || ' ...' END AS excerpt
  FROM (SELECT doc_id, trim(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '\\s+', ' ', 'g')) AS t FROM documents)"""


@query(_EXCERPT)
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text"), 120).alias("excerpt"))


@query(
    """WITH RECURSIVE i AS (SELECT attempt_id, list_transform(evidence_trace, lambda x: coalesce(x.claim, '')) AS c FROM generation_attempts WHERE evidence_trace IS NOT NULL),
  b AS (SELECT attempt_id, c, 0 AS k, '' AS t, false AS done FROM i
    UNION ALL SELECT attempt_id, c, k + 1, CASE WHEN NOT done AND length(CASE WHEN t = '' THEN c[k + 1] ELSE t || '; ' || c[k + 1] END) <= 160 THEN CASE WHEN t = '' THEN c[k + 1] ELSE t || '; ' || c[k + 1] END ELSE t END,
      done OR length(CASE WHEN t = '' THEN c[k + 1] ELSE t || '; ' || c[k + 1] END) > 160 FROM b WHERE k < len(c))
  SELECT attempt_id, t AS claims FROM b WHERE k = len(c)"""
)
def claim_budget(spark: SparkSession, d: str) -> DataFrame:
    claims = F.transform("evidence_trace", lambda x: F.coalesce(x["claim"], F.lit("")))
    return table(spark, d, "generation_attempts").where("evidence_trace IS NOT NULL").select("attempt_id", T.within_budget(claims, 160).alias("claims"))


@query()
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    """Every claim's overlap with its report; tested against the textbook table, as SQL would take it row by row."""
    rows = table(spark, d, "generation_attempts").where("status = 'ok'").select("attempt_id", "generated_report", F.posexplode("evidence_trace").alias("place", "x"))
    return rows.select("attempt_id", "place", F.round(T.rouge_l(F.col("generated_report"), F.col("x.claim")), 9).alias("rouge_l"))


@query(
    """WITH t AS (SELECT attempt_id, place, regexp_extract_all(lower(coalesce(generated_report, '')), '[a-z0-9]+(?:[-''][a-z0-9]+)*') AS a, regexp_extract_all(lower(coalesce(claim, '')), '[a-z0-9]+(?:[-''][a-z0-9]+)*') AS b
    FROM (SELECT attempt_id, generated_report, i AS place, evidence_trace[i + 1].claim AS claim FROM (SELECT attempt_id, generated_report, evidence_trace, unnest(range(0, len(evidence_trace)))::INT AS i FROM generation_attempts WHERE status = 'ok'))),
  s AS (SELECT attempt_id, place, len(a) AS la, len(b) AS lb, list_sum(list_transform(list_distinct(list_filter(b, lambda x: list_contains(a, x))), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS o FROM t)
  SELECT attempt_id, place, round(CASE WHEN la = 0 OR lb = 0 THEN 0.0 ELSE 2 * coalesce(o, 0) / (la + lb) END, 9) AS rouge_1 FROM s"""
)
def rouge_1(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generation_attempts").where("status = 'ok'").select("attempt_id", "generated_report", F.posexplode("evidence_trace").alias("place", "x"))
    return rows.select("attempt_id", "place", F.round(T.rouge_n(F.col("generated_report"), F.col("x.claim"), 1), 9).alias("rouge_1"))


@query(
    """WITH p AS (SELECT coalesce('s' || subject_id, '') AS c, sum((status = 1)::INT) AS ok, count(*) AS n FROM evidence_bank GROUP BY subject_id), i AS (SELECT *, row_number() OVER (ORDER BY cc NULLS FIRST) - 1 AS i, count(*) OVER () AS k
    FROM (SELECT subject_id AS cc, sum((status = 1)::INT) AS ok, count(*) AS n FROM evidence_bank GROUP BY 1)),
  dr AS (SELECT b, ('0x' || substr(md5('4408:' || b || ':' || j), 1, 8))::BIGINT % (SELECT max(k) FROM i) AS i FROM range(0, 200) x(b), range(0, (SELECT max(k) FROM i)) y(j)),
  v AS (SELECT b, sum(ok) / sum(n) AS v FROM dr JOIN i USING (i) GROUP BY b)
  SELECT 'ok_share' AS metric, (SELECT round(sum(ok) / sum(n), 9) FROM i) AS observed, round(quantile_cont(v, 0.025), 9) AS ci_low, round(quantile_cont(v, 0.975), 9) AS ci_high FROM v"""
)
def cluster_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "evidence_bank").select("subject_id", (F.coalesce(F.col("status") == 1, F.lit(False))).cast("long").alias("ok"), F.lit(1).alias("n"))
    return controls.cluster_bootstrap(b, "subject_id", ["ok", "n"], {"ok_share": F.col("ok") / F.col("n")})


_FORMS = """WITH f AS (SELECT doc_id, source, CASE WHEN doc_id % 17 = 0 THEN 'NA' WHEN length(text) % 3 = 0 THEN 'Y' WHEN length(text) % 3 = 1 THEN 'N' ELSE 'NI' END AS a,
    CASE WHEN doc_id % 17 = 0 THEN 'NA' WHEN doc_id % 5 = 0 THEN 'Y' WHEN length(text) % 3 = 1 THEN 'N' ELSE 'NI' END AS b FROM documents)"""


def _forms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two reviewers' answers, derived from documents by arithmetic."""
    doc = table(spark, d, "documents").select("doc_id", "source", F.pmod(F.length("text"), F.lit(3)).alias("m"))
    na = F.pmod("doc_id", F.lit(17)) == 0
    a = F.when(na, "NA").when(F.col("m") == 0, "Y").when(F.col("m") == 1, "N").otherwise("NI")
    b = F.when(na, "NA").when(F.pmod("doc_id", F.lit(5)) == 0, "Y").when(F.col("m") == 1, "N").otherwise("NI")
    return doc.select("doc_id", "source", a.alias("rating")), doc.select("doc_id", "source", b.alias("rating"))


@query(_FORMS + " SELECT 'rating' AS field, count(*) AS n, round(avg((a = b)::INT), 9) AS agreement FROM f WHERE a <> 'NA' AND b <> 'NA'")
def reviewer_agreement(spark: SparkSession, d: str) -> DataFrame:
    return review.agreement(*_forms(spark, d), "doc_id", ["rating"])


@query(_FORMS + " SELECT a AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM f WHERE a <> 'NA' GROUP BY a")
def rating_distribution(spark: SparkSession, d: str) -> DataFrame:
    return review.distribution(_forms(spark, d)[0], "rating")


@query(
    _FORMS
    + """ SELECT source, final, how AS source_of, count(*) AS n FROM (SELECT source, CASE WHEN a = b THEN a ELSE CASE WHEN doc_id % 2 = 0 THEN a END END AS final, CASE WHEN a = b THEN 'agreed' WHEN doc_id % 2 = 0 THEN 'third' ELSE 'unresolved' END AS how FROM f) GROUP BY ALL"""
)
def adjudication(spark: SparkSession, d: str) -> DataFrame:
    one, two = _forms(spark, d)
    third = one.where(F.pmod("doc_id", F.lit(2)) == 0)
    done = review.adjudicated(one, two, third, "doc_id", "rating").withColumnRenamed("source", "source_of")
    return done.join(one.select("doc_id", "source"), "doc_id").groupBy("source", "final", "source_of").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('4409:' || doc_id), doc_id) AS i FROM documents)
  SELECT doc_id, source, row_number() OVER (ORDER BY md5('4409:blind:' || doc_id), doc_id) AS review_id FROM r WHERE i <= 5"""
)
def blinded_sample(spark: SparkSession, d: str) -> DataFrame:
    return review.blinded_sample(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id")


@query()
def context_grid(spark: SparkSession, d: str) -> DataFrame:
    """The nested grid of conditions over the retrieved anchors; nested, so compared by tests only."""
    from cohortloom.operators.retrieval import margin, topk
    from cohortloom.plans.retrieval import _sides

    top = topk(*_sides(spark, d), k=2)
    rows = top.join(margin(top), "query_id").select("query_id", F.when(F.pmod("query_id", F.lit(100)) == 0, "ecg").otherwise("cxr").alias("direction"), "margin", "rank", "cand_id")
    return contexts.condition_grid(rows, 0.05)


@query(
    """WITH d AS (SELECT sha256(lower(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g')))) AS h, doc_id FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS group_id FROM d QUALIFY count(*) OVER (PARTITION BY h) > 1"""
)
def text_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Members of the groups of texts that are equal after folding, each with its group: no pairs."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.lower(T.fold(F.col("text"))), 256).alias("h"))
    groups = rows.groupBy("h").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(groups, "h").select("doc_id", "group_id")
