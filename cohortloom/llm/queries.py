"""The llm queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import leakage, mixing, neighbours, pairs, residue, splits, truncation
from cohortloom.sources.tables import table

MODALITIES = ("ecg", "cxr", "labs")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "generation_attempts"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "evidence_bank"), MODALITIES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.conflicting_groups(table(spark, d, "manifest"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "manifest"))


def _texts(spark: SparkSession, d: str) -> list[tuple[DataFrame, str, str, str]]:
    a, b = table(spark, d, "generation_attempts"), table(spark, d, "anchor")
    one = a.select(F.lit("generated_report").alias("kind"), F.col("attempt_id").alias("record_id"), F.col("model_key").alias("source"), F.col("generated_report").alias("text"))
    two = b.select(F.lit("machine_diagnosis").alias("kind"), F.col("anchor_row_id").alias("record_id"), "source", F.col("machine_diagnosis").alias("text"))
    return [(one, truncation.PROSE, "generated_report", "model_key"), (two, truncation.LISTED, "machine_diagnosis", "source")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    one, two = (truncation.cut_records(t, pattern) for t, pattern, _, _ in _texts(spark, d))
    return one.unionByName(two).select(F.col("kind").alias("field"), "record_id")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    one, two = (truncation.cut_rates(t, pattern) for t, pattern, _, _ in _texts(spark, d))
    return one.unionByName(two)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents, and how much of them at most."""
    found = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("held").alias("most_words"))


def p6_reworded(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an item whose numbers, names or units were consistently exchanged."""
    return leakage.reworded_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.clean_documents(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


def p8_validation(spark: SparkSession, d: str) -> DataFrame:
    return residue.validation(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p2_found, p3_found, p3_splits, p5_found, p5_rates, p6_found, p6_items, p6_reworded, p7_mix, p7_shares, p8_found, p8_clean, p8_validation]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """p2 by brute force and p3 by transitive closure; the others have no SQL and are tested against fixtures."""
    modality = """
      SELECT '{m}' AS modality, bank_id, coalesce('s' || subject_id, 'b' || bank_id) AS owner, v::DOUBLE[] AS v
      FROM (SELECT bank_id, subject_id, {m} AS v FROM evidence_bank WHERE status = 1 AND len({m}) = 64)
      WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"""
    p2 = f"""
    WITH usable AS ({" UNION ALL ".join(modality.format(m=m) for m in MODALITIES)}),
    unit AS (SELECT modality, bank_id, owner, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM usable),
    near AS (
      SELECT a.modality, a.bank_id AS x, b.bank_id AS y, list_cosine_similarity(a.v, b.v) AS sim
      FROM unit a JOIN unit b ON a.modality = b.modality AND a.owner <> b.owner
    ),
    best AS (
      SELECT modality, x, y, row_number() OVER (PARTITION BY modality, x ORDER BY round(sim, 12) DESC, y) AS i FROM near WHERE sim >= 0.95
    )
    SELECT DISTINCT modality, least(x, y) AS bank_id_a, greatest(x, y) AS bank_id_b FROM best WHERE i <= 10"""
    p3 = r"""
    WITH RECURSIVE rows AS (
      SELECT row_id, CASE WHEN subject_id >= 1 THEN 's' || subject_id END AS s, CASE WHEN hadm_id >= 1 THEN 'h' || hadm_id END AS h,
             CASE WHEN trim(split) = '' THEN NULL WHEN lower(trim(split)) = 'validation' THEN 'val' ELSE lower(trim(split)) END AS split
      FROM manifest
    ),
    nodes AS (SELECT row_id, coalesce(s, h, 'r' || row_id) AS node FROM rows),
    edges AS (
      SELECT DISTINCT s AS a, h AS b FROM rows WHERE s IS NOT NULL AND h IS NOT NULL
      UNION SELECT DISTINCT h, s FROM rows WHERE s IS NOT NULL AND h IS NOT NULL
    ),
    reach AS (
      SELECT DISTINCT node AS node, node AS root FROM nodes
      UNION SELECT e.b, r.root FROM reach r JOIN edges e ON r.node = e.a
    ),
    comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
    grouped AS (SELECT r.row_id, r.split, c.root FROM rows r JOIN nodes n USING (row_id) JOIN comp c USING (node)),
    bad AS (SELECT root, min(row_id) AS group_id FROM grouped GROUP BY root HAVING count(DISTINCT split) > 1)
    SELECT row_id, group_id FROM grouped JOIN bad USING (root)"""
    return {"p2_found": p2, "p3_found": p3}
