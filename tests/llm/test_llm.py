"""The llm operators on small fixtures and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import leakage, mixing, neighbours, pairs, queries, residue, splits, truncation


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, compare, name):
    got, want = compare(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)
    assert got == want


# ---- 1: pairs

PROMPT = "Describe the query ECG in a few plain sentences.\n\nAnchor a1\nECG: Left axis deviation is stable.\n\nState conflicts openly and keep every claim tied to an anchor id."
GOOD = "The tracing shows sinus rhythm. There is no evidence of left axis deviation."


@pytest.mark.parametrize(
    "report,claims,want",
    [
        (GOOD, [], None),
        (GOOD, None, None),
        (GOOD[:-1], [], None),
        (None, [], "empty"),
        ("", [], "empty"),
        ("​ \n", [], "empty"),
        ("```json\n```", [], "empty"),
        ("**Report**\n", [], "empty"),
        ("(no output)", [], "empty"),
        (GOOD, ["", None, "n/a"], "empty"),
        (GOOD, ["", "The rhythm is sinus."], None),
        ("I can't assist with that.", [], "refusal"),
        ("Regrettably, I must decline to describe this image.", [], "refusal"),
        (GOOD, ["The assistant refuses to generate clinical text for this input."], "refusal"),
        ("I cannot exclude edema. We were unable to assess the right base because of infection.", [], None),
        ("Patient was unable to hold still. No report of earlier edema is available.", [], None),
        ("Je ne peux pas fournir ce compte rendu.", [], "refusal"),
        ("Não posso descrever esta imagem.", [], "refusal"),
        ("Non sono in grado di fornire un referto.", [], "refusal"),
        ("Ik kan hierover helaas geen verslag schrijven.", [], "refusal"),
        ("Sorry, that's not something I can do.", [], "refusal"),
        ("Report: describe the query ecg in a few plain sentences.", [], "copied_prompt"),
        ("Left axis deviation is stable. The tracing shows sinus rhythm at a rate of 70 with a long pause.", [], None),
        (GOOD, ["State conflicts openly and keep every claim tied to an anchor id."], "copied_prompt"),
        (GOOD, ["Left axis deviation is stable."], None),
        ("Das Herz ist normal groß und die Lunge zeigt kein Infiltrat.", [], "other_language"),
        (GOOD + ' The patient said "me duele el pecho" twice.', [], None),
        (GOOD, ["El corazón es de tamaño normal y no hay derrame."], "other_language"),
        ('{"report": "The tracing shows', [], "truncated"),
        ("The tracing shows sinus rhythm (rate of 60", [], "truncated"),
        ("Findings in the tracing:\n1. Sinus rhythm.\n2.", [], "truncated"),
    ],
)
def test_pair_defects(report, claims, want):
    assert pairs.pair_defect(PROMPT, report, claims) == want


def test_pushdown_and_tiling():
    assert pairs.left_open("a (b [c] d) “e” ```x``` \"q\" <b>z</b> <br>") == []
    assert pairs.left_open("a (b [c) \"d") == ['"']
    assert pairs.left_open("<div>(") == ["<div>", "("]
    words = [f"w{i}" for i in range(50)]
    assert pairs.tiled_share(words[10:30], words) == 1.0
    assert pairs.tiled_share([], words) == 0.0
    assert pairs.tiled_share(words[:10] + ["x"] * 10, words) == 0.5
    r = random.Random(3)
    for _ in range(100):  # no word of the text is used twice
        p, t = ([r.choice("ab") for _ in range(r.randint(1, 20))] for _ in range(2))
        assert 0 <= pairs.tiled_share(p, t, 2) * len(p) <= min(len(p), max(len(t), 1))


def test_tiling_of_repetitive_texts_is_fast():
    assert pairs.tiled_share(["a"] * 20000, ["a"] * 20000) == 1.0
    assert pairs.tiled_share(["a", "b"] * 9000, ["a", "b", "c"] * 9000) == 0.0


def test_copies_in_short_pieces_and_over_and_over():
    words = [f"w{i}" for i in range(100)]
    pieces = [words[i : i + 4] for i in range(0, 100, 4)][::-1]
    assert pairs.tiled_share(sum(pieces, []), words) == 1.0
    assert pairs.tiled_share([w for p in pieces for w in (*p, "x")], words) == 0.8
    again = "State conflicts openly and keep every claim tied to an anchor id. "
    assert pairs.pair_defect(PROMPT, again * 9, []) == "copied_prompt"
    assert pairs.pair_defect(PROMPT, again * 9 + GOOD, []) == "copied_prompt"
    assert pairs.pair_defect(PROMPT, again + GOOD * 2, []) is None
    assert pairs.pair_defect(PROMPT, GOOD * 9, []) is None


ATTEMPT = "attempt_id long, prompt string, status string, generated_report string, evidence_trace array<struct<claim string, source_ids array<string>>>, text string"


def test_defective_pairs(spark):
    rows = [(i, PROMPT, "ok", f"Sinus rhythm at a rate of {i}. Baseline wander limits review of the inferior leads.", [], "x") for i in range(30)]
    rows += [
        (100, PROMPT, "ok", "Sinus rhythm at a rate of 5. Baseline wander limits rev", [], None),
        (101, PROMPT, "error", None, [], None),
        (102, PROMPT, "ok", None, None, None),
        (103, None, "ok", "Sinus rhythm at a rate of 7.", [("Baseline wander limits review of the", [])], None),
        (104, PROMPT, None, None, [], None),
        (105, PROMPT, "ok", "Sinus rhythm at a rate of 5. Baseline wander limits review of the inferior leads. " * 3000, [], None),
    ]
    df = spark.createDataFrame(rows + [rows[-6]], ATTEMPT)
    assert ids(pairs.defective_pairs(df), "attempt_id", "defect_type") == [(100, "truncated"), (102, "empty"), (103, "truncated")]
    assert pairs.defective_pairs(df.limit(0)).isEmpty()


# ---- 2: neighbours


def bank(spark, vectors, owners=None, status=None):
    rows = [(i, (owners[i] if owners else i), (status[i] if status else 1), None if v is None else [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "bank_id long, subject_id long, status tinyint, ecg array<float>, m int")


def brute(vectors, owners, k, floor):
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)]
    u = {i: np.asarray(vectors[i], np.float32).astype(float) for i in ok}
    u = {i: v / np.linalg.norm(v) for i, v in u.items()}
    out = set()
    for i in ok:
        s = sorted(((-round(float(u[i] @ u[j]), 9), j) for j in ok if j != i and (owners[i] is None or owners[i] != owners[j])))
        out |= {(min(i, j), max(i, j)) for c, j in s[:k] if -c >= floor}
    return out


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((150, 64))
    vectors = [c + 0.12 * r.standard_normal(64) for c in centres for _ in range(4)]
    vectors += [vectors[0]] * 25 + [np.zeros(64), np.full(64, np.nan), r.standard_normal(63), None, 1e30 * vectors[8], np.r_[np.inf, np.ones(63)]]
    owners = [int(x) for x in r.integers(0, 60, len(vectors))]
    owners[3] = owners[7] = None
    got = ids(neighbours.similar_pairs(bank(spark, vectors, owners), ["ecg"], 10, 0.95), "bank_id_a", "bank_id_b")
    want = brute(vectors, owners, 10, 0.95)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.98 * len(want)


def test_neighbours_of_hot_copies_and_edges(spark):
    v, w = np.ones(64), np.r_[np.ones(63), 1.2]
    owners = [0] * 400 + list(range(1, 101)) + [500]
    found = neighbours.neighbours(bank(spark, [v] * 500 + [w], owners), ["ecg"], 10, 0.95)
    per = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first")).collect()
    assert len(per) == 501 and all(r.n == 10 for r in per)
    # an owner's rows pass over their own 400 copies
    assert {r.first for r in per if r.id < 400} == {400} and {r.first for r in per if r.id >= 400} == {0}
    assert neighbours.similar_pairs(bank(spark, [v, v], [1, 1]), ["ecg"]).isEmpty()
    assert neighbours.similar_pairs(bank(spark, [v, v], [1, 2], [1, 0]), ["ecg"]).isEmpty()
    assert ids(neighbours.similar_pairs(bank(spark, [v, v], [None, None]), ["ecg"]), "modality", "bank_id_a", "bank_id_b") == [("ecg", 0, 1)]
    assert neighbours.similar_pairs(bank(spark, [v]).limit(0), ["ecg"]).isEmpty()


def test_large_cells_lose_no_pair(spark, monkeypatch):
    r = np.random.default_rng(9)
    vectors = [np.ones(64) + 0.2 * r.standard_normal(64) for _ in range(60)]
    owners = list(range(60))
    whole = ids(neighbours.similar_pairs(bank(spark, vectors, owners), ["ecg"]), "bank_id_a", "bank_id_b")
    monkeypatch.setattr(neighbours, "PART_ROWS", 16)
    assert ids(neighbours.similar_pairs(bank(spark, vectors, owners), ["ecg"]), "bank_id_a", "bank_id_b") == whole
    assert whole == sorted(brute(vectors, owners, 10, 0.95))


def coordinates(n, spread, seed=3, fine=False):
    r = np.random.default_rng(seed)
    v = r.standard_normal(64) + spread * r.standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    p = np.rint(v * 8 * neighbours.STEPS * (neighbours.FINER if fine else 1)).astype(np.int16 if fine else np.int8)
    assert fine or (neighbours._unpacked(neighbours._packed(np.clip(p, -31, 31))) == np.clip(p, -31, 31)).all()
    return v, p


@pytest.mark.parametrize("members,spread,fine", [(1, 0.1, False), (40, 0.1, False), (23, 0.25, False), (300, 0.02, True), (300, 0.1, True), (300, 0.22, False)])
def test_cell_against_brute_force(members, spread, fine):
    v, p = coordinates(members + 30, spread, fine=fine)
    n = np.arange(len(v))
    owners = 2 * (n % 7)
    part = neighbours.Members(p[:members], n[:members], owners[:members])
    a, b, *_ = neighbours.nearest_in_cell(p, n, owners, part, 3, 0.95, block=16)
    again = set(a[a == b].tolist())  # queries that come out with themselves are met again on finer coordinates
    assert not (fine and again)
    a, b = a[a != b], b[a != b]
    assert np.bincount(a, minlength=1).max(initial=0) <= 6 and (owners[a] != owners[b]).all() and (b < members).all()
    got, exact, want, hit = {}, v @ v.T, 0, 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        got.setdefault(x, []).append(y)
    for i in set(n.tolist()) - again:
        best = [j for j in np.argsort(-exact[i, :members]) if owners[j] != owners[i] and exact[i, j] >= 0.95][:3]
        want, hit = want + len(best), hit + len(set(best) & set(got.get(i, [])))
    assert hit >= 0.98 * want


def test_classes_of_several_owners_keep_links_for_each(spark):
    v, p = coordinates(60, 0.05)
    n = np.arange(60)
    owners = np.where(n < 40, 2, 2 * n)
    owners[59] = 121
    a, b, bo, _ = neighbours.nearest_in_cell(p, n, owners, neighbours.Members(p, n, owners), 5, 0.95)
    a, b, bo = a[a != b], b[a != b], bo[a != b]
    assert (bo[a == 59] == 2).sum() <= 5 and (bo[a == 59] != 2).sum() >= 5


def test_dense_cluster_and_hot_patient(spark):
    r = np.random.default_rng(21)
    near = r.standard_normal(64) + 0.01 * r.standard_normal((400, 64))
    hot = r.standard_normal(64) + 0.1 * r.standard_normal((400, 64))
    vectors, owners = [*near, *hot], [*range(400), *[1000] * 396, *range(1001, 1005)]
    found = neighbours.neighbours(bank(spark, vectors, owners), ["ecg"], 10, 0.95)
    got = {tuple(x) for x in ids(found, "id", "other")}
    assert len(got) <= 10 * len(vectors)
    pairs_found = {(min(x), max(x)) for x in got}
    want = brute(vectors, owners, 10, 0.95)
    assert len(pairs_found & want) >= 0.98 * len(want)


# ---- 3: splits


def union_find(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a, b in rows:
        for key in (("a", a), ("b", b)):
            if key[1] is not None and key[1] >= 1:
                parent[find(("r", i))] = find(key)
    groups = {}
    for i, _, _ in rows:
        groups.setdefault(find(("r", i)), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def manifest(spark, rows):
    return spark.createDataFrame([(i, a, b, s, i) for i, a, b, s in rows], "row_id long, subject_id long, hadm_id long, split string, node long")


def test_groups_and_splits(spark):
    r = random.Random(2)
    rows = []
    for i in range(1, 400):
        a = r.choice([None, 0, -1, r.randint(1, 150), r.randint(1, 150), 7 if i % 3 == 0 else r.randint(1, 150)])
        rows.append((i, a, r.choice([None, 0, r.randint(1, 300), r.randint(1, 300)]), r.choice(["train", " Train", "VAL", "validation", "test", None, " "])))
    want = union_find([x[:3] for x in rows])
    df = manifest(spark, rows)
    assert dict(ids(splits.tied_groups(df), "row_id", "group_id")) == want
    fold = lambda s: {"": None, "validation": "val"}.get(s.strip().lower(), s.strip().lower()) if s else None
    kinds = {}
    for i, _, _, s in rows:
        kinds.setdefault(want[i], set()).add(fold(s))
    bad = sorted((i, g) for i, g in want.items() if len(kinds[g] - {None}) > 1)
    assert ids(splits.conflicting_groups(df), "row_id", "group_id") == bad
    out = splits.assign_splits(df)
    per = out.groupBy("group_id").agg(F.countDistinct("assigned_split").alias("n"), F.count(F.lit(1)).alias("size"))
    assert out.count() == len(rows) and per.where("n > 1").isEmpty()
    for empty in (splits.tied_groups(df.limit(0)), splits.conflicting_groups(df.limit(0)), splits.assign_splits(df.limit(0))):
        assert empty.isEmpty()


def test_long_chain_is_one_group(spark):
    rows = [(i, (i + 1) // 2 + 1, i // 2 + 1, "train" if i else "test") for i in range(120)]
    got = ids(splits.conflicting_groups(manifest(spark, rows)), "row_id", "group_id")
    assert got == [(i, 0) for i in range(120)]


def test_quotas_and_recorded_splits(spark):
    rows = [(i, i + 1, None, ["train"] * 8 + ["val", "test"]) for i in range(1000)]
    df = manifest(spark, [(i, a, b, s[i % 10]) for i, a, b, s in rows])
    out = splits.assign_splits(df).join(df, "row_id")
    assert out.where("assigned_split <> split").isEmpty()
    sizes = dict(ids(splits.assign_splits(manifest(spark, [(i, i // 3 + 1, None, None) for i in range(900)])).groupBy("assigned_split").count(), "assigned_split", "count"))
    assert all(abs(sizes[k] - n) <= 3 for k, n in (("train", 720), ("val", 90), ("test", 90)))


def test_many_bundles_are_allocated_fast():
    r = random.Random(4)
    bundles = [(r.randint(1, 40), r.randint(1, 5), tuple(r.choice([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]))) for _ in range(20_000)]
    whole = splits.allocate(bundles, (0.8, 0.1, 0.1))
    total = sum(s * c for s, c, _ in bundles)
    assert all(sum(w) == c for w, (_, c, _) in zip(whole, bundles, strict=True))
    assert all(abs(sum(w[j] * s for w, (s, _, _) in zip(whole, bundles, strict=True)) - f * total) <= 41 for j, f in enumerate((0.8, 0.1, 0.1)))


def test_allocation_is_whole_and_near_quota():
    r = random.Random(4)
    for _ in range(40):
        bundles = [(r.randint(1, 30), r.randint(1, 50), tuple(r.choice([(s := 1, 0, 0), (0, s, 0), (0, 0, 0)]))) for _ in range(r.randint(1, 12))]
        bundles = [(s, c, tuple(s * x for x in p)) for s, c, p in bundles]
        out = splits.allocate(bundles, (0.8, 0.1, 0.1))
        assert [sum(x) for x in out] == [c for _, c, _ in bundles]
        total, largest = sum(s * c for s, c, _ in bundles), max(s for s, _, _ in bundles)
        for j, f in enumerate((0.8, 0.1, 0.1)):
            assert sum(o[j] * s for o, (s, _, _) in zip(out, bundles)) <= f * total + largest + 1


# ---- 5: truncation


def texts(spark, rows):
    return spark.createDataFrame([("k", i, s, t) for i, s, t in rows], "kind string, record_id long, source string, text string")


def test_cut_records(spark):
    whole = ["Sinus rhythm at a rate of 71 with ST depression. QTc measures 410 ms and left axis deviation is noted.", "Left axis deviation is stable. Sinus rhythm at a rate of 5 with ST depression"]
    rows = [(i, "a", whole[i % 2]) for i in range(40)]
    cut = ["QTc measures 500 ms and left ax", "Sinus rhythm at a rate of 9", "Sinus rhythm at a ra…", "QTc measures 410 ms and left axis devi�", "Left axis deviation is sta...", "QT"]
    rows += [(100 + i, None, t) for i, t in enumerate(cut)]
    rows += [(200, "b", None), (201, "b", ""), (202, "b", " \n"), (203, "b", "Left axis deviation is stable ..."), (204, "b", "Something said once"), (205, "b", whole[0] * 2000)]
    df = texts(spark, rows + [(300, "a", cut[0])] * 2)
    found = [i for _, i in ids(truncation.cut_records(df, truncation.PROSE), "kind", "record_id")]
    assert found == [100, 101, 102, 103, 104, 105, 300, 300]
    rates = {r.source: (r.texts, r.cut) for r in truncation.cut_rates(df, truncation.PROSE).collect()}
    assert rates == {"a": (42, 2), "b": (6, 0), None: (6, 6)}
    assert truncation.cut_records(df.limit(0), truncation.PROSE).isEmpty()


def test_closers_behind_a_stop_close_a_text(spark):
    rows = spark.createDataFrame([(1, 'fine [as before.")])'), (2, "fine [as before)]]]]]"), (3, "so it is!  ;"), (4, None), (5, "")], "record_id long, text string")
    split = truncation.statements(rows.select(F.lit("k").alias("kind"), "record_id", F.lit("s").alias("source"), "text"), truncation.PROSE)
    assert [r.closed for r in split.orderBy("record_id").collect()][:3] == [True, False, True]


def test_cut_lists(spark):
    rows = [(i, "a", "Left bundle branch block - unconfirmed; Sinus rhythm; Normal ECG") for i in range(20)]
    rows += [(50, "a", "Normal ECG; Left bundle bra"), (51, "a", "Normal ECG; Left bundle branch block - unconf"), (52, "a", "Left bundle branch block - unconfirmed"), (53, "a", "Normal ECG;")]
    rows += [(60 + i, "a", "Left bundle branch block; Normal ECG") for i in range(10)]
    assert [i for _, i in ids(truncation.cut_records(texts(spark, rows), truncation.LISTED), "kind", "record_id")] == [50, 51]


# ---- 6: leakage


def naive_held(a, b, least=12):
    """Longest item passage held by any stretch of the document, by plain edit distance over all stretches."""
    best = 0
    for i in range(len(a)):
        for k in range(i + least, len(a) + 1):
            s = k - i
            if s <= best:
                continue
            row = [0] * (len(b) + 1)  # free start in the document
            for x in range(1, s + 1):
                new = [x]
                for y in range(1, len(b) + 1):
                    new.append(min(row[y - 1] + (a[i + x - 1] != b[y - 1]), row[y] + 1, new[-1] + 1))
                row = new
            if 8 * min(row) <= s:
                best = s
    return best


def test_held_words_against_plain_edit_distance():
    r = random.Random(7)
    for _ in range(60):
        a = [f"w{r.randint(0, 60)}" for _ in range(r.randint(10, 26))]
        b = list(a[r.randint(0, 4) :])
        for _ in range(r.randint(0, 4)):
            at, kind = r.randrange(len(b)), r.randint(0, 2)
            b[at : at + (kind != 2)] = [] if kind == 0 else ["zz"]
        b = ["q"] * 3 + b + ["q"]
        held = leakage.held_words(a, b)[0]
        plain = naive_held(a, b)
        # a passage must begin and end on equal words, so at most the edits at its rim are missing
        assert held <= plain and (held > 0 or plain < 12 + 2)


def test_leaks(spark):
    item = "A 69-year-old plumber complains during breakfast with burning pulse after travel. Which murmur mimics isolation, peaked deflections or a calcified pocket?"
    w = item.split()
    docs = [
        (1, "Before. " + item.upper().replace(" ", "\n> ") + " After."),
        (2, " ".join(w[:8]) + " in passing."),
        (3, " ".join(w[3:17])),
        (4, " ".join(["x" if i % 4 == 0 else t for i, t in enumerate(w)])),
        (5, None),
        (6, ""),
        (7, ("filler words here " * 30000) + item.replace("plumber", "baker")),
        (7, item.replace("69", "70")),
        (8, " ".join(reversed(w))),
    ]
    d = spark.createDataFrame([(i, t, i, 0) for i, t in docs], "doc_id long, text string, item_id long, window int")
    q = spark.createDataFrame([(10, item, "x"), (11, None, "x"), (12, "short", "x")], "item_id long, text string, doc_id string")
    # two documents share the id 7, and both hold the item
    assert ids(leakage.leaked_items(d, q), "doc_id", "item_id") == [(1, 10), (3, 10), (7, 10), (7, 10)]
    assert leakage.leaked_items(d.limit(0), q).isEmpty() and leakage.leaked_items(d, q.limit(0)).isEmpty()


def test_number_rows_and_reworded_items(spark):
    numbers = "7 35 40 24 135 4 1 102 88 9 12 250 14 6"
    item = "A 54 year old man named Dr Baker took 40 mg of furosemide for 3 days in Boston. On Monday his potassium fell to 2 while Dr Baker gave 40 mg again and the pulse rose."
    changed = item.replace("54", "61").replace("Baker", "Costello").replace("40", "20").replace("furosemide", "torsemide").replace("Boston", "Denver").replace("Monday", "Friday").replace("to 2 ", "to 4 ").replace("3 days", "9 days")
    mixed_up = changed.replace("20 mg again", "75 mg again").replace("while Dr Costello", "while Dr Wright").replace("fell to 4", "fell to two three four")
    d = spark.createDataFrame([(1, f"Values {numbers} end"), (2, f"See: {changed}"), (3, item), (4, mixed_up), (5, None), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(10, numbers), (11, item), (12, None)], "item_id long, text string")
    assert ids(leakage.leaked_items(d, q), "doc_id", "item_id") == [(1, 10), (3, 11)]
    got = {r.doc_id: r for r in leakage.reworded_items(d, q).collect()}
    assert set(got) == {2, 4} and got[2].edits == 0 and got[2].changed == 10
    assert got[4].held < got[2].held or got[4].edits > 0
    assert leakage.held_words(numbers.split(), numbers.split()) == (14, 0)


def test_slots_must_map_consistently():
    item = "alpha 1 beta 1 gamma 1 delta 1 epsilon 1 zeta 1 eta theta iota kappa lambda".split()
    assert leakage.held_template(item, [w.replace("1", "9") for w in item]) == (17, 0, 6)
    other = [str(i) if w == "1" else w for i, w in enumerate(item)]
    assert leakage.held_template(item, other) == (0, 0, 0)
    assert leakage.held_template(["5"] * 20, ["6"] * 20) == (0, 0, 0)


def test_template_in_the_engine_equals_the_plain_one(spark):
    texts = ["Dr Meyer gave 5mg lisinopril in Rome", "12 x 3 hours on monday", "", "nurse", "enoxaparin apparent 40mgx"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t"), leakage.words(F.col("t")).alias("w"), leakage.template(leakage.words(F.col("t"))).alias("m")).collect()
    assert [r.m for r in rows] == [leakage.template_words(r.w) for r in rows]


# ---- 7: mixing


def test_mix(spark):
    docs = [(i, "Big Source", f"word number {i} stands here") for i in range(400)] + [(1000 + i, "small-source", f"other text {i}") for i in range(20)]
    docs += [(2000, "small_source", "word number 3 stands here"), (2001, "big_source", None), (2002, None, "lost"), (2003, "big_source", ""), (2004, "elsewhere", "not wanted")]
    d = spark.createDataFrame([(i, s, t, 5) for i, s, t in docs], "doc_id long, source string, text string, tokens int")
    t = spark.createDataFrame([("big_source", 0.5, 1), ("small_source", 0.3, 3), ("absent", 0.2, 2)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixed(d, t)
    s = {r.source: r for r in shares.collect()}
    assert s["absent"].used_tokens == 0 and s["small_source"].most_repeats == 3
    assert s["big_source"].used_tokens / s["small_source"].used_tokens == pytest.approx(0.5 / 0.3, rel=0.08)
    rows = mix.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and not {2000, 2001, 2002, 2003, 2004} & {r.doc_id for r in rows}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed(d.repartition(7), t)[0].collect()))
    more = {r.source: r for r in mixing.mixed(d, t, total_tokens=10**7)[1].collect()}
    assert more["big_source"].used_tokens == more["big_source"].available_tokens and more["small_source"].used_tokens == 3 * more["small_source"].available_tokens
    assert mixing.mixed(d.limit(0), t)[0].isEmpty() and mixing.mixed(d, t.limit(0))[0].isEmpty()


def test_buckets_do_not_change_the_cut(spark, monkeypatch):
    d = spark.createDataFrame([(i, "s", f"text {i} " * (i % 7 + 1)) for i in range(300)], "doc_id long, source string, text string")
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    one = ids(mixing.mixed(d, t, total_tokens=1500)[0], "doc_id", "repeats")
    monkeypatch.setattr(mixing, "BUCKET_TEXTS", 11)
    assert ids(mixing.mixed(d, t, total_tokens=1500)[0], "doc_id", "repeats") == one and one


# ---- 8: residue


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ward: {{ward}}", True),
        ("Reader: [INSERT reader HERE]", True),
        ("The tracing <%= view_position %> sinus rhythm.", True),
        ("Et dolore magna nostrud eiusmod amet ut labore.", True),
        ("Filler line without clinical content.", True),
        ("HTTP 504: the file was moved or deleted.", True),
        ("404 - the report you asked for could not be found on this server.", True),
        ("Please enable JavaScript to view this report.", True),
        ("Turn off the script blocker to open the image viewer.", True),
        ("Loading report...", True),
        ("Bitte aktivieren Sie JavaScript, um diesen Befund anzuzeigen.", True),
        ("The prescription script for a transfusion was renewed.", False),
        ("There was an error in lead placement at leads II and aVF.", False),
        ("The viewer relies on JavaScript, but this film was read on paper and shows edema.", False),
        ("Session of physiotherapy expired early because of cough.", False),
        ("Leads {I, II, aVF} show ST depression.", False),
        ("Name ___ , unit ___ , date ___ : minimal haze.", False),
        ("Reading <60 percent and >20 percent were both seen for sodium.", False),
        ("Film number 404 of the series shows edema.", False),
        ("The sodium tube was not found in the lab, so a new sample was drawn.", False),
        ("Placeholder sutures near the right apex are noted.", False),
        ("Please wait for the lateral view before judging both lower lobes.", False),
        ("A 500 ml bolus was given before oral diuretics.", False),
        ("The file was read as [1] and again as [2] with edema.", False),
    ],
)
def test_votes(text, want):
    assert residue.vote(text) == want


def test_classifier_learns_beyond_its_rules():
    good = [f"The {a} is {b} in the {c}." for a in ("heart", "lung", "aorta", "bone") for b in ("clear", "large", "normal", "new") for c in ("base", "apex", "view")]
    bad = [f"{a} could not be {b}." for a in ("page", "server", "report", "file", "record") for b in ("found", "loaded", "shown", "opened")]
    weights, bias = residue.train(good + bad, [False] * len(good) + [True] * len(bad), epochs=20)
    p = residue.probabilities(["document could not be found.", "The spine is clear in the view."], weights, bias)
    assert p[0] > 0.5 > p[1]


def test_residue_documents(spark, sf):
    good = [(i, "a", f"The heart is normal in size at visit {i}. No edema is seen.", None) for i in range(60)]
    bad = [(100, "b", "Ward: {{ward}}\nThe heart is normal in size."), (101, "b", "HTTP 504: this link has expired."), (102, "b", "Please enable JavaScript to view this report.")]
    odd = [(200, None, None), (201, "b", ""), (202, "b", "The heart is normal. " * 20000), (100, "b", "Ward: {{ward}}")]
    d = spark.createDataFrame([x[:3] + ("z",) for x in good + [(*b, None) for b in bad + odd]], "doc_id long, source string, text string, statement string")
    assert ids(residue.residue_documents(d), "doc_id") == [(100,), (101,), (102,)]
    assert residue.clean_documents(d).count() == 63 and residue.clean_documents(d).columns == d.columns
    assert residue.residue_documents(d.limit(0)).isEmpty()
    assert residue.residue_documents(d.where("doc_id < 100")).isEmpty()


def test_validation_counts_all_statements(spark, monkeypatch):
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(i, f"source {'abcdefghijkl'[i % 12]}", f"The {w} is normal.\nNo {w} is seen.\n{w} ward: {{{{ward}}}}") for i, w in enumerate(words)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    fits = []
    monkeypatch.setattr(residue, "train", lambda s, *_: fits.append(len(s)) or (np.zeros(1 << residue.BITS), 1.0))
    monkeypatch.setattr(residue, "MAX_SAMPLE", 15)
    parts = {r.part: r for r in residue.validation(d).collect()}
    assert set(parts) == {"seen", "held_out"} and 0 < fits[0] <= 15
    assert sum(r.statements for r in parts.values()) == 300 and sum(r.voted for r in parts.values()) == 100
    # a bias of 1 takes all statements for residue, one of 0.5 none at the probability asked for
    assert all((r.precision, r.recall) == (pytest.approx(1 / 3), 1) for r in parts.values())
    monkeypatch.setattr(residue, "train", lambda s, *_: (np.zeros(1 << residue.BITS), 0.5))
    assert all((r.precision, r.recall) == (0, 0) for r in residue.validation(d).collect())
    assert residue.validation(d.limit(0)).isEmpty()
    clean = residue.validation(d.selectExpr("doc_id", "source", "substring_index(text, '\n', 1) AS text")).collect()
    assert sum(r.statements for r in clean) == 100 and all((r.voted, r.precision) == (0, 0) for r in clean)


def test_templates_of_seen_sources_are_not_held_out(spark):
    rows = [(i, f"source {'abcdefghijkl'[i % 12]}", f"Film {i} of the ward.\nWARD: {{{{ward}}}} {i}") for i in range(48)]
    parts = residue.validation(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert [r.part for r in parts] == ["seen"]


LONG_TERMS = [f"{a} {b} {c}" for a in ("heart", "lung", "aorta", "bone", "apex") for b in ("clear", "large", "normal", "stable") for c in ("today", "again", "as before", "at rest", "on review")]


def test_pieces_cover_a_long_statement():
    r = np.random.default_rng(2)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    texts = [" ".join(words[:n]) for n in (0, 1, 5, 6, 7, 17, 18, 19, 48, 300)]
    weights = r.standard_normal(1 << residue.BITS)
    coded = residue.Coded(texts)
    score = lambda i, a, b: weights[coded.features(i, a, b)].sum() / np.sqrt(len(coded.features(i, a, b))) + 0.25
    margin, begin, end = coded.margins(weights, 0.25)
    for i, n in enumerate(np.diff(coded.starts).tolist()):
        pieces = [(at, at + s) for s in residue.PIECES for at in range(n - s + 1) if s < n] + [(0, n)] * (n <= residue.PIECES[-1])
        want = max(score(i, a, b) for a, b in pieces)
        assert margin[i] == pytest.approx(want) and score(i, begin[i], end[i]) == pytest.approx(want)


def test_residue_in_one_very_long_line(spark, monkeypatch):
    short = [f"The {t} in view {i}." for i, t in enumerate(LONG_TERMS)] + [f"No {t} is seen." for t in LONG_TERMS] + LONG_TERMS
    short += [" ".join(LONG_TERMS[k : k + n]) for n in range(2, 9) for k in range(0, 90, 13)]
    bad = [f"{t}: {{{{ward}}}}" for t in LONG_TERMS[:40]] + [f"HTTP 504: the {t} page could not be found." for t in LONG_TERMS[:40]]
    fitted = residue.train(short + bad, [False] * len(short) + [True] * len(bad))
    monkeypatch.setattr(residue, "train", lambda *_: fitted)  # long lines are no part of the sample
    r = random.Random(1)
    line = lambda: " ".join(r.choice(LONG_TERMS) for _ in range(3000))
    rows = [(0, line()), (1, f"{line()} ward: {{{{ward}}}} {line()}"), (2, f"{line()} ward: {{{{ward}}}}"), (3, f"HTTP 504: the page could not be found {line()}"), (4, f"{line()} 504: {line()}")]
    found = residue.residue_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("a")))
    assert ids(found, "doc_id") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("first", [None, (0.0, 1.0), (0.0, -3.0)])
def test_residue_beyond_the_sample(spark, monkeypatch, first):
    good = [f"The {t} in view." for t in LONG_TERMS] + [f"No {t} is seen on ward ___." for t in LONG_TERMS] + LONG_TERMS
    bad = [f"{t}: {{{{{t.split()[0]}}}}}" for t in LONG_TERMS[:30]] + ["HTTP 504: this link has expired.", "#reader# left the angle free.", "Loading report...", "Lorem ipsum dolor sit amet."]
    monkeypatch.setattr(residue, "MAX_SAMPLE", 12)
    if first:  # a first fit that takes all for residue, and one that takes nothing
        monkeypatch.setattr(residue, "train", lambda *_: (np.full(1 << residue.BITS, first[0]), first[1]))
    d = spark.createDataFrame([(i, "a", t) for i, t in enumerate(good + bad)], "doc_id long, source string, text string")
    assert ids(residue.residue_documents(d), "doc_id") == [(i,) for i in range(len(good), len(good + bad))]
    assert residue.residue_documents(d.where(f"doc_id < {len(good)}")).isEmpty()


def test_all_statements_teach_the_classifier(spark):
    good = [f"The {t} in view." for t in LONG_TERMS] + LONG_TERMS
    bad = [f"{t}: {{{{ward}}}}" for t in LONG_TERMS]
    found = spark.createDataFrame([(t, t in bad) for t in good + bad], "statement string, voted boolean").repartition(3)
    weights, bias = residue._taught(found, np.zeros(1 << residue.BITS, np.float32), 0.0)
    judged = residue.probabilities(good + bad, weights, bias) >= residue.MIN_PROBABILITY
    assert judged.tolist() == [False] * len(good) + [True] * len(bad)


def test_votes_are_those_of_all_rules():
    texts = [x for t in (p.args[1] for p in test_votes.pytestmark) for x, _ in t]
    texts += ["Contact the webmaster.", "ERR_TIMED_OUT", "a a a", "xxx xxxx 3", "Ticket: 0a1b2c3d", "abc Abc abc", "\u017fomething went wrong", "oops", "Traceback", "It is \u212aey not found"]
    texts += [f(t) for t in texts for f in (str.upper, str.lower, str.title)]
    for t in texts:
        assert residue.vote(t) == any(r.search(t) for r in residue.RULES), t
    for rule, cues in zip(residue.PLAIN, residue._CUES):
        assert cues is None or all(any(c in t.lower() for c in cues) for t in texts if t.isascii() and rule.search(t))
