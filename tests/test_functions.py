"""Column functions on literals."""

import math

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import identity as I
from cohortloom.functions import parsing
from cohortloom.functions import text as T
from cohortloom.functions import vector as V


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("value,want", [("007", "7"), (" 12 ", "12"), ("12.0", "12.0"), ("nan", None), ("", None), (None, None), ("<NA>", None), ("-5", "-5"), ("A1 ", "A1")])
def test_uid(spark, value, want):
    assert one(spark, I.uid(F.lit(value).cast("string"))) == (want,)


def test_patient_split_by_hash(spark):
    import hashlib

    rows = spark.range(200).select("id", I.patient_split("id").alias("s")).collect()
    for r in rows:
        b = int(hashlib.sha256(f"{I.SPLIT_SEED}:{r.id}".encode()).hexdigest()[:12], 16) % 100
        assert r.s == ("train" if b < 80 else "val" if b < 90 else "test")
    assert one(spark, I.patient_split(F.lit("none"))) == ("quarantine",)


def test_labels_of_three_states(spark):
    m = F.create_map(F.lit("Edema"), F.lit("-1"), F.lit("Atelectasis"), F.lit("1"), F.lit("Pneumonia"), F.lit("0"))
    assert one(spark, I.positive_labels(m), I.truthy_labels(m)) == (["Atelectasis"], ["Atelectasis", "Edema"])
    known = ["No Finding", "Edema"]
    both = F.array(F.lit("No Finding"), F.lit("Edema"), F.lit("Other"))
    assert one(spark, I.reference_labels(both, known), I.reference_labels(F.lit(None).cast("array<string>"), known)) == (["Edema"], [])


def test_ids_aliases_and_hashes(spark):
    assert one(spark, I.only_id(F.lit("a/p10000001/s5"), r"p(\d{8})"), I.only_id(F.lit("p10000001/p10000002"), r"p(\d{8})"), I.only_id(F.lit(None).cast("string"), "p")) == ("10000001", None, None)
    m = F.create_map(F.lit("Subject-ID"), F.lit(" 7 "), F.lit("x"), F.lit("y"))
    assert one(spark, I.alias_value(m, ["patientid", "subjectid"])) == ("7",)
    a, b = F.array(F.lit("ab"), F.lit("c")), F.array(F.lit("a"), F.lit("bc"))
    x, y = one(spark, I.sequence_hash(a), I.sequence_hash(b))
    assert x != y
    x, y = one(spark, I.signature(F.lit(None).cast("string")), I.signature(F.lit("")))
    assert x != y


@pytest.mark.parametrize(
    "text,rules,normal,want",
    [
        ("No evidence of atrial fibrillation.", T.ECG_RULES, "normal_ecg", []),
        ("Left ventricular hypertrophy.", T.ECG_RULES, "normal_ecg", ["ventricular_hypertrophy"]),
        ("Possible left ventricular hypertrophy.", T.ECG_RULES, "normal_ecg", []),
        ("Ventricular paced rhythm.", T.ECG_RULES, "normal_ecg", ["paced_rhythm"]),
        ("No pleural effusion or pneumothorax.", T.CXR_RULES, "No Finding", []),
        ("Mild bibasilar atelectasis.", T.CXR_RULES, "No Finding", ["Atelectasis"]),
        ("", T.CXR_RULES, "No Finding", []),
        (None, T.CXR_RULES, "No Finding", []),
        ("No edema, but there is pneumonia. Pneumonia is seen.", T.CXR_RULES, "No Finding", ["Pneumonia"]),
    ],
)
def test_assertions(spark, text, rules, normal, want):
    assert one(spark, T.present(T.assertions(F.lit(text).cast("string"), rules), normal)) == (want,)


def test_mention_offsets_and_order_of_rules(spark):
    text = "edema. " * 3 + "possible no edema"
    got = one(spark, T.mentions(F.lit(text), r"\bedema\b"))[0]
    import re

    assert [(r.start, r.stop) for r in got] == [m.span() for m in re.finditer(r"\bedema\b", text)]
    m = got[-1]
    at = (F.lit(m.start), F.lit(m.stop))
    assert one(spark, T.assertion(F.lit(text), *at), T.assertion(F.lit(text), *at, absent_first=True)) == ("uncertain", "absent")


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_length_against_the_table():
    import random

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 30))] for _ in range(2))
        assert T.common_length(a, b) == lcs(a, b)


def test_overlap_scores(spark):
    a, b = F.lit("the heart is large"), F.lit("the heart is not large")
    l, n1, n2, b4 = one(spark, T.rouge_l(a, b), T.rouge_n(a, b, 1), T.rouge_n(a, b, 2), T.bleu(a, a, 4))
    assert l == pytest.approx(8 / 9) and n1 == pytest.approx(8 / 9) and n2 == pytest.approx(4 / 7) and b4 == pytest.approx(1)
    none = F.lit(None).cast("string")
    assert one(spark, T.rouge_l(a, none), T.rouge_n(a, F.lit(""), 1), T.bleu(a, F.lit("zzz"), 2)) == (0.0, 0.0, 0.0)
    long = F.lit("word " * 20000)
    assert one(spark, T.rouge_l(long, long))[0] == pytest.approx(1)


def test_excerpts_and_budgets(spark):
    text = "alpha beta gamma delta"
    assert one(spark, T.excerpt(F.lit(text), 100), T.excerpt(F.lit(text), 16), T.excerpt(F.lit("a" * 30), 10), T.excerpt(F.lit(None).cast("string"), 10)) == (text, "alpha beta ...", "aaaaaa ...", "unavailable")
    items = F.array(*map(F.lit, ("one", "three", "five", "x")))
    assert one(spark, T.within_budget(items, 10), T.within_budget(items, 2), T.within_budget(F.lit(None).cast("array<string>"), 9)) == ("one; three", "", "")


def test_sections_and_visible_text(spark):
    assert one(spark, T.section(F.lit("FINDINGS: a.\nIMPRESSION: b."))) == ("b.",)
    assert one(spark, T.section(F.lit("FINDINGS: a.\nTECHNIQUE: c.")), T.section(F.lit(" plain "))) == ("a.", "plain")
    hidden = ["<think>a", "<think>a</think>", "<|eot|>", "", None]
    assert [parsing.visible(x) for x in hidden] == [""] * 5
    assert parsing.visible("x<|channel|>final<|message|>Done.</s>") == "Done."
    assert one(spark, T.join_statements(F.lit("a"), F.lit(" b  c"), F.lit("a"), F.lit(None).cast("string"))) == ("a | b c",)
    assert one(spark, T.trailing_integer(F.lit("s123")), T.trailing_integer(F.lit("12x"))) == (123, None)


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    bad = F.array(F.lit(float("nan")), F.lit(1.0))
    assert one(spark, V.unit(v), V.unit(bad), V.unit(F.array(F.lit(0.0)))) == ([0.6, 0.8], None, None)
    assert one(spark, V.usable(v, 2), V.usable(v, 3), V.usable(F.lit(None).cast("array<double>"))) == (True, False, False)
    assert one(spark, V.mean_vector(v, v, v))[0] == [3.0, 4.0]
    p, o = F.array(F.lit(0.25), F.lit(0.75)).cast("array<float>"), F.array(F.lit(1), F.lit(0))
    assert one(spark, V.lab_encode(p, o), V.mask_only(V.lab_encode(p, o), 2)) == ([0.25, 0.5, 1.0, 0.0], [0.5, 0.5, 1.0, 0.0])
    edge = [one(spark, V.lab_direction(F.lit(x).cast("float")))[0] for x in (0.1, 0.5, 0.9)]
    assert edge == ["low", "middle", "high"]
    assert one(spark, V.chance_hit(F.lit(10), F.lit(1), F.lit(5)), V.chance_hit(F.lit(10), F.lit(0), F.lit(5)), V.chance_hit(F.lit(3), F.lit(3), F.lit(1))) == (pytest.approx(0.5), 0.0, 1.0)
    assert one(spark, V.sign_codes(F.array(F.lit(1.0), F.lit(-1.0), F.lit(-1.0), F.lit(1.0)), 2))[0] == [1, 2]
    assert one(spark, V.close(F.lit(1.0), F.lit(1.0 + 1e-9)))[0] and math.isfinite(1)
