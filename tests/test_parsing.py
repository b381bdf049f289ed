"""Parsing stages, prompt text and selection operators."""

import json

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import parsing, prompts
from cohortloom.operators import selection

FULL = {"report": "Sinus rhythm.", "evidence_trace": [{"claim": "c", "source_ids": ["a"]}], "uncertainties": []}


@pytest.mark.parametrize(
    "raw,stage,report",
    [
        (None, "empty_or_hidden", None),
        ("", "empty_or_hidden", None),
        ("<think>sinus", "empty_or_hidden", None),
        ("<|channel|>analysis<|message|>sinus", "empty_or_hidden", None),
        ("<think>x</think>", "empty_or_hidden", None),
        ("<|eot_id|>", "empty_or_hidden", None),
        (json.dumps(FULL), "strict_json", "Sinus rhythm."),
        ("Here: " + json.dumps(FULL) + " done", "strict_json", "Sinus rhythm."),
        ('```json\n{"impression": " Normal. "}\n```', "normalized_json_report_only", "Normal."),
        ('{"other": 1}', "json_without_report", None),
        ('{"report": "Normal \\"x\\".", "evidence', "recovered_report_field", 'Normal "x".'),
        ('{"repor', "malformed_structured_output", None),
        ("Sinus rhythm.", "visible_free_text", "Sinus rhythm."),
        ("<|channel|>analysis x<|channel|>final<|message|>Sinus.", "visible_free_text", "Sinus."),
    ],
)
def test_stages(raw, stage, report):
    got = parsing.parse_output(raw)
    assert (got["stage"], got["report"]) == (stage, report) and got["compliant"] == (stage == "strict_json")
    assert stage in parsing.STAGES


def test_parsed_column(spark):
    rows = spark.createDataFrame([(json.dumps(FULL),), (None,)], "t string").select(parsing.parsed(F.col("t")).alias("p")).collect()
    assert rows[0].p.trace[0].source_ids == ["a"] and rows[1].p.stage == "empty_or_hidden"
    assert parsing.tolerant_trace([{"statement": " x ", "sources": "a"}, "y", {"claim": ""}, 3, {"claim": "z", "source_ids": ["a", "q"]}], ["a"]) == [
        {"claim": "x", "source_ids": ["a"]},
        {"claim": "y", "source_ids": []},
        {"claim": "z", "source_ids": ["a"]},
    ]
    plain = spark.createDataFrame([("Report: Sinus rhythm.",), ("report evidence_trace",), ("{}",), ("I cannot interpret this.",), (None,)], "t string")
    assert [r.p for r in plain.select(parsing.plain_report(F.col("t"), ["report", "evidence_trace"]).alias("p")).collect()] == ["Sinus rhythm.", None, None, None, None]


def test_prompt_text(spark):
    one = spark.range(1)
    none = F.lit(None).cast("string")
    block = prompts.anchor_block(F.lit("a"), none, F.lit("x" * 50), F.lit("labs"), F.array().cast("array<string>"), none, F.array(F.lit("ecg"), F.lit("cxr")), 10)
    assert one.select(block.alias("b")).first().b == "Anchor a (other patient; unknown)\nECG statements: xxxxxxxxxx\nRadiograph labels: none listed. Radiograph report: unavailable"
    blocks = F.array(F.lit("abc"), F.lit("defg"), F.lit("h"))
    assert one.select(prompts.compact_blocks(blocks, 5).alias("b")).first().b == "abc\nde"
    assert one.select(prompts.joined_blocks(blocks).alias("b")).first().b == "abc\n\ndefg\n\nh"
    assert one.select(prompts.evidence_length(F.lit("ab"), none).alias("b")).first().b == 2
    assert one.select(F.size(prompts.evidence_lines(none)).alias("b")).first().b == 0


def test_pools_and_runs(spark):
    pools = spark.createDataFrame([(g, int(i == g), i / 10) for g in range(2) for i in range(10)], "g int, y int, s double")
    assert selection.pool_problems(pools, "g", "y").isEmpty()
    assert selection.pool_problems(pools.where("s < 0.9"), "g", "y").count() == 2
    assert sorted(tuple(r) for r in selection.pool_ranks(pools, "g", "y", "s").collect()) == [(0, 10), (1, 9)]
    runs = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.5), ("m", 3, float("nan")), ("n", 4, None)], "method string, seed int, score double")
    assert [tuple(r) for r in selection.best_runs(runs, ["method"], "score", ["seed"]).collect()] == [("m", 1, 0.5)]
    s = {r.method: r for r in selection.seed_summary(runs, ["method"], ["score"]).collect()}
    assert s["m"].score_n == 2 and s["n"].score_mean is None


def test_relevance_and_cohort(spark):
    q = spark.createDataFrame([(1, "heart_failure"), (1, "heart_failure"), (2, "edema")], "id long, concept string")
    t = spark.createDataFrame([(7, "edema"), (8, "edema"), (8, "edema"), (9, "cardiomegaly")], "id long, concept string")
    got = sorted(tuple(r) for r in selection.concept_relevance(q, t, selection.compatible(spark)).collect())
    assert got == [(1, "cardiomegaly", 1), (1, "edema", 2), (2, "edema", 2)]
    back = sorted(tuple(r) for r in selection.concept_relevance(t, q, selection.compatible(spark, reverse=True)).collect())
    assert (9, "heart_failure", 1) in back
    rows = spark.createDataFrame([(i, ["common"] if i else ["common", "rare"]) for i in range(30)], "id long, labels array<string>")
    cohort = {r.id: r.reason for r in selection.coverage_first_cohort(rows, "id", "labels", 5, "s").collect()}
    assert len(cohort) == 5 and cohort[0] == "label"
    pool = selection.sampled_pool(spark.createDataFrame([(1, 3)], "query_id long, cand_id long"), spark.range(50).withColumnRenamed("id", "cand_id"), 10, "s")
    assert pool.count() == 10 and [r.cand_id for r in pool.where("relevant").collect()] == [3]


def test_effects_and_gates(spark):
    p = spark.createDataFrame([("g", 1.0, 0.5), ("g", 0.5, 0.5), ("g", None, 1.0)], "k string, a double, b double")
    r = selection.paired_effect(p, ["k"], "a", "b", lower_is_better=True).first()
    assert (r.n, r.delta) == (2, -0.25)
    m = spark.createDataFrame([("x", "full", 0.9), ("x", "same", 0.8), ("y", "full", 0.7)], "k string, condition string, f1 double")
    gate = selection.decision_gate(m, ["k"], "condition", {"better": F.col("full_f1") > F.col("same_f1")})
    assert sorted((r.k, r.passed) for r in gate.collect()) == [("x", True), ("y", False)]
    many = spark.range(100).select(F.lit("x").alias("k"), F.format_string("c%03d", "id").alias("condition"), F.col("id").cast("double").alias("f1"))
    assert selection.decision_gate(many, ["k"], "condition", {"last": F.col("c099_f1") > 98}).first().passed
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([float("nan"), 1.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert tuple(selection.vector_audit(v, "v", 2).first()) == (1, 1, 1, 1, 1)
    assert [tuple(r) for r in selection.column_means(v, "v").orderBy("i").collect()] == [(0, round(2 / 3, 6), 3), (1, 1.0, 3)]


@pytest.mark.parametrize(
    "raw,allowed,stage,report",
    [
        (json.dumps(FULL), ["a"], "strict", "Sinus rhythm."),
        (json.dumps(FULL), ["b"], None, None),
        ('Answer: {"Response": {"Final-Report": " Normal. ", "limitations": "none seen", "evidence": [{"finding": "f", "sources": "a"}]}}', ["a"], "normalized", "Normal."),
        ('{"report": 3} then {"impression": "Flutter."}', [], "normalized", "Flutter."),
        ('{"report": "x", "evidence": ["loose"]}', [], None, None),
        ("no object", ["a"], None, None),
        (None, [], None, None),
    ],
)
def test_rescue(raw, allowed, stage, report):
    got = parsing.rescue_output(raw, allowed)
    assert (got["stage"], got["report"]) == (stage, report)


@pytest.mark.parametrize(
    "raw,stage,report",
    [
        ("Report: Sinus rhythm.\nuncertainties: none", "labelled_plain_report", "Sinus rhythm."),
        ("Sinus rhythm, left axis", "visible_free_text", "Sinus rhythm, left axis"),
        ("report: evidence_trace", "schema_echo", None),
        ("The patient is well.", "non_diagnostic_response", None),
        ("Please describe the rhythm.", "non_diagnostic_response", None),
        ("unable to read the rhythm", "non_diagnostic_response", None),
        ('{"other": 1}', "json_without_report", None),
        (json.dumps(FULL), "strict_json", "Sinus rhythm."),
        (None, "empty_or_hidden", None),
    ],
)
def test_plain_output(raw, stage, report):
    got = parsing.plain_output(raw)
    assert (got["stage"], got["report"]) == (stage, report)


@pytest.mark.parametrize(
    "raw,want",
    [
        ("a <think>b</think> c", "a  c"),
        ("b</think> c </THINK> d", "d"),
        ("a<|eot|></s>b<eos>", "ab"),
        ("a <think>b", "a"),
        ("<|channel|>final<|message|>one<|channel|>final<|message|>two", "two"),
        ("<|channel|>analysis<|message|>x", ""),
        ("```json\n{}\n```", "```json\n{}\n```"),
    ],
)
def test_visible(raw, want):
    assert parsing.visible(raw) == want


def test_rescue_columns(spark):
    rows = spark.createDataFrame([('{"impression": "Flutter."}', None), (None, ["a"])], "t string, a array<string>")
    got = rows.select(parsing.rescued(F.col("t"), F.col("a")).alias("r"), parsing.plain_parsed(F.col("t")).alias("p")).collect()
    assert [(g.r.stage, g.p.stage) for g in got] == [("normalized", "normalized_json_report_only"), (None, "empty_or_hidden")]
