"""Text functions: folding, assertions with negation and doubt, overlap scores, excerpts and budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Concept patterns of ECG statements.
ECG_RULES: dict[str, list[str]] = {
    "normal_ecg": [r"\bnormal(?:\s+12[- ]lead)?\s+(?:ecg|electrocardiogram)\b", r"\b(?:ecg|electrocardiogram)\s+(?:is\s+)?within normal limits\b"],
    "atrial_fibrillation": [r"\batrial fibrillation\b", r"\ba[- ]?fib(?:rillation)?\b"],
    "atrial_flutter": [r"\batrial flutter\b"],
    "tachycardia": [r"\btachycard(?:ia|ic)\b", r"\b(?:svt|v[- ]?tach)\b"],
    "bradycardia": [r"\bbradycard(?:ia|ic)\b"],
    "conduction_abnormality": [
        r"\bbundle branch block\b",
        r"\b(?:rbbb|lbbb|ivcd)\b",
        r"\b(?:av|atrioventricular|heart) block\b",
        r"\bintraventricular conduction (?:delay|defect)\b",
    ],
    "ventricular_hypertrophy": [r"\b(?:(?:left|right)\s+|bi)ventricular hypertrophy\b", r"\b(?:lvh|rvh)\b"],
    "ischemia": [r"\bischemi\w*\b", r"\bst[- ]t abnormalit\w*\b", r"\bst(?:[- ]segment)?\s+(?:depression|elevation)\b"],
    "infarction": [r"\bmyocardial infarction\b", r"\binfarct(?:ion|ed)?\b", r"\b(?:stemi|nstemi)\b"],
    "paced_rhythm": [r"\b(?:atrial|ventricular|dual[- ]chamber)?\s*paced rhythm\b", r"\bpacing spikes?\b", r"\bpacemaker rhythm\b"],
    "low_voltage": [r"\blow[- ]voltage\b"],
    "qt_abnormality": [r"\b(?:prolonged|long|short)\s+qt(?:c)?(?: interval)?\b", r"\bqt(?:c)? prolongation\b"],
}
# Concept patterns of chest radiograph reports.
CXR_RULES: dict[str, list[str]] = {
    "Atelectasis": [r"\batelecta\w*\b"],
    "Cardiomegaly": [r"\bcardiomegal\w*\b", r"\benlarged cardiac silhouette\b"],
    "Consolidation": [r"\bconsolidat\w*\b"],
    "Edema": [r"\b(?:pulmonary )?edema\b", r"\bvascular congestion\b"],
    "Enlarged Cardiomediastinum": [r"\bwidened mediastinum\b", r"\benlarged cardiomediastin\w*\b"],
    "Fracture": [r"\bfracture\b"],
    "Lung Lesion": [r"\b(?:lung|pulmonary) (?:nodule|mass|lesion)\b"],
    "Lung Opacity": [r"\b(?:lung|pulmonary|airspace) opacit\w*\b", r"\binfiltrate\b"],
    "No Finding": [r"\bno acute cardiopulmonary (?:abnormality|process|finding)\b", r"\bnormal chest\b"],
    "Pleural Effusion": [r"\bpleural effusion\b"],
    "Pleural Other": [r"\bpleural thickening\b", r"\bpleural plaque\b"],
    "Pneumonia": [r"\bpneumonia\b"],
    "Pneumothorax": [r"\bpneumothorax\b"],
    "Support Devices": [r"\b(?:endotracheal|enteric|feeding|ng) tube\b", r"\b(?:central venous|picc) (?:line|catheter)\b", r"\bpacemaker\b", r"\bdefibrillator\b"],
}
# Cues of negation and doubt around a mention, and what ends a clause.
NEGATED_BEFORE = r"(?:\bno\b|\bwithout\b|\bnegative for\b|\babsence of\b|\bfree of\b)(?:\W+\w+){0,8}\W*$"
NEGATED_AFTER = r"^\W*(?:is |are |was |were )?(?:not|absent)(?:\W|$)"
UNCERTAIN_BEFORE = r"(?:\bpossible\b|\bpossibly\b|\bprobable\b|\blikely\b|\bmay\b|\bmight\b|\bcannot exclude\b|\bcannot rule out\b|\bsuspicious for\b)(?:\W+\w+){0,8}\W*$"
UNCERTAIN_AFTER = r"^\W*(?:is |are )?(?:not excluded|cannot be excluded)"
CLAUSE = r"[.;\n]|\b(?:but|however|although|yet)\b"
LEFT, RIGHT = 120, 50
_U = "(?U)"


def fold(text: Column) -> Column:
    """White space as single blanks, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def mentions(text: Column, pattern: str | Column) -> Column:
    """``array<struct<start, stop>>`` of the pattern's matches from the left, counted from 0, in characters.

    Built from the text before each match and the match itself, since no primitive returns offsets. A pattern may be
    a column; it is then used as it stands.
    """
    lazy = F.concat(F.lit("(?s)(.*?)(?:"), pattern, F.lit(")")) if isinstance(pattern, Column) else F.lit(f"{_U}(?s)(.*?)(?:{pattern})")
    whole, before = (F.regexp_extract_all(text, lazy, F.lit(g)) for g in (0, 1))
    parts = F.arrays_zip(F.transform(whole, F.length).alias("w"), F.transform(before, F.length).alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    return F.aggregate(
        parts,
        start,
        lambda acc, x: F.struct((acc["at"] + x["w"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["b"]).alias("start"), (acc["at"] + x["w"]).alias("stop")))).alias("out")),
        lambda acc: acc["out"],
    )


def assertion(text: Column, start: Column, stop: Column, absent_first: bool = False) -> Column:
    """present, absent or uncertain, from the clause before a mention and the words after it.

    Doubt wins over negation; ``absent_first`` is the older order.
    """
    left = F.substring(text, F.greatest(start - LEFT, F.lit(0)) + 1, F.least(start, F.lit(LEFT)))
    left = F.element_at(F.split(left, f"(?i){CLAUSE}", -1), -1)
    right = F.substring(text, stop + 1, F.lit(RIGHT))
    doubt = left.rlike(f"{_U}(?i){UNCERTAIN_BEFORE}") | right.rlike(_U + UNCERTAIN_AFTER)
    denied = left.rlike(f"{_U}(?i){NEGATED_BEFORE}") | right.rlike(f"{_U}(?i){NEGATED_AFTER}")
    if absent_first:
        return F.when(denied, "absent").when(doubt, "uncertain").otherwise("present")
    return F.when(doubt, "uncertain").when(denied, "absent").otherwise("present")


def assertions(text: Column, rules: Mapping[str, Sequence[str]], absent_first: bool = False) -> Column:
    """``array<struct<concept, status>>``, distinct; a concept may have several statuses. Null text has none."""
    return assertions_in(assertion_text(text), rules, absent_first)


def assertion_text(text: Column) -> Column:
    """The folded lower-case text that assertions are read from."""
    return F.lower(fold(F.coalesce(text, F.lit(""))))


def assertions_in(value: Column, rules: Mapping[str, Sequence[str]], absent_first: bool = False) -> Column:
    """:func:`assertions` of a text folded before, as a column of its own: each pattern reads it again.

    The rules are data, an array the expression runs over, so that the plan has one copy of it and not one per pattern.
    """
    table = F.array(*(F.struct(F.lit(c).alias("concept"), F.lit(_U + p).alias("pattern")) for c, ps in rules.items() for p in ps))
    hits = F.filter(table, lambda r: F.rlike(value, r["pattern"]))

    def states(r: Column) -> Column:
        return F.transform(mentions(value, r["pattern"]), lambda m: F.struct(r["concept"].alias("concept"), assertion(value, m["start"], m["stop"], absent_first).alias("status")))

    return F.array_distinct(F.flatten(F.transform(hits, states)))


def present(asserted: Column, normal: str) -> Column:
    """Sorted concepts asserted present; the label for nothing goes where there is another."""
    kept = F.array_sort(F.array_distinct(F.transform(F.filter(asserted, lambda x: x["status"] == "present"), lambda x: x["concept"])))
    return F.when(F.size(kept) > 1, F.array_remove(kept, normal)).otherwise(kept)


def concept_text(asserted: Column) -> Column:
    """``status:concept`` entries in order, or the entry for nothing specific."""
    entries = F.array_sort(F.transform(asserted, lambda x: F.concat(x["status"], F.lit(":"), x["concept"])))
    return F.coalesce(F.nullif(F.array_join(entries, "; "), F.lit("")), F.lit("uncertain:unspecified_clinical_finding"))


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def report_tokens(text: Column) -> Column:
    """Lower-case alphanumeric words with inner hyphens and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+(?:[-'][a-z0-9]+)*"), F.lit(0))


def common_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, bit-parallel: one big integer holds a whole row of the table."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(reference: Column, candidate: Column) -> Column:
    """F1 of the longest common subsequence of the words; 0 where either has none.

    In Arrow batches: the table is quadratic in the words, which nested lambdas take a hundred times longer for.
    """

    @F.pandas_udf("double")
    def score(one: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(one, two, strict=True):
            a, b = (x or "").lower().split(), (y or "").lower().split()
            lcs = common_length(a, b) if a and b else 0
            p, r = (lcs / len(b), lcs / len(a)) if lcs else (0.0, 0.0)
            out.append(2 * p * r / max(p + r, 1e-12))
        return pd.Series(out, dtype="float64")

    return score(reference, candidate)


def ngrams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def overlap(a: Column, b: Column) -> Column:
    """Shared entries of two bags: each entry counts as often as it stands in both."""
    shared = F.array_distinct(F.array_intersect(a, b))
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    return F.aggregate(shared, F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def rouge_n(reference: Column, candidate: Column, n: int) -> Column:
    """F1 of shared n-grams of the report tokens; 0 where either has none."""
    a, b = ngrams(report_tokens(reference), n), ngrams(report_tokens(candidate), n)
    shared = overlap(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * shared / (F.size(a) + F.size(b)))


def bleu(reference: Column, candidate: Column, n: int) -> Column:
    """Sentence BLEU up to n with one added to the counts above unigrams, and the brevity penalty; 0 without a shared word."""
    a, b = report_tokens(reference), report_tokens(candidate)
    logs = F.lit(0.0)
    for k in range(1, n + 1):
        x, y = ngrams(a, k), ngrams(b, k)
        add = 0 if k == 1 else 1
        logs = logs + F.ln((overlap(x, y) + add) / (F.size(y) + add)) / n
    brevity = F.when(F.size(b) >= F.size(a), 1.0).otherwise(F.exp(1 - F.size(a) / F.size(b)))
    return F.when((F.size(b) == 0) | (overlap(a, b) == 0), 0.0).otherwise(brevity * F.exp(logs))


def excerpt(text: Column, cap: int, blank: str = "unavailable") -> Column:
    """At most ``cap`` characters: folded; a longer text loses its last, possibly partial word and ends in an ellipsis."""
    t = fold(F.coalesce(text, F.lit("")))
    cut = F.substring(t, 1, cap - 4)
    back = F.regexp_replace(cut, r" [^ ]*$", "")
    return F.when(t == "", blank).when(F.length(t) <= cap, t).otherwise(F.concat(F.when(back == "", cut).otherwise(back), F.lit(" ...")))


def within_budget(items: Column, budget: int, separator: str = "; ") -> Column:
    """Items in order, joined, as long as the joined length stays within the budget; the first that does not fit ends it."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        joined = F.when(acc["text"] == "", x).otherwise(F.concat(acc["text"], F.lit(separator), x))
        fits = ~acc["full"] & (F.length(joined) <= budget)
        return F.struct(F.when(fits, joined).otherwise(acc["text"]).alias("text"), (~fits).alias("full"))

    return F.aggregate(F.coalesce(items, F.array().cast("array<string>")), start, step, lambda acc: acc["text"])


def section(text: Column) -> Column:
    """The impression or conclusion, else the findings, else all of a report."""
    t = F.coalesce(text, F.lit(""))
    part = lambda names: F.nullif(F.trim(F.regexp_extract(t, rf"(?is)\b(?:{names})\s*:\s*(.*?)(?=\n\s*[A-Z][A-Za-z ]+:|$)", 1)), F.lit(""))
    return F.coalesce(part("impression|conclusion"), part("findings"), F.trim(t))


def join_statements(*columns: Column) -> Column:
    """Distinct non-blank statements in first-seen order."""
    folded = F.filter(F.array(*(fold(c) for c in columns)), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(folded), " | ")


def trailing_integer(text: Column) -> Column:
    """The digits a text ends with, null without them or beyond 18."""
    return F.nullif(F.regexp_extract(F.trim(text.cast("string")), r"(?<!\d)(\d{1,18})$", 1), F.lit("")).cast("bigint")
