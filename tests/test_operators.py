"""Operators on small fixtures: ties, nulls, empty tables, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import attempts, codes, contexts, controls, delivery, labels, partition, retrieval, review


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


DELIVERY = "delivery_id long, at timestamp, a string, b string, _n int, count int"


def deliveries(spark, rows):
    return spark.createDataFrame(rows, "delivery_id long, at string, a string, b string, n int, count int").withColumn("at", F.to_timestamp("at"))


def test_copies(spark):
    df = deliveries(
        spark,
        [
            (1, "2024-01-02", "X", "y", 0, 0),
            (2, "2024-01-01", " x\n", "Y ", 0, 0),
            (3, "2024-01-01", "x", "y", 0, 0),
            (4, "2024-01-01", None, "y", 0, 0),
            (5, "2024-01-01", None, "y", 0, 0),
            (6, None, "x", "y", 0, 0),
            (7, "2024-01-01", "z", "y", 0, 0),
        ],
    )
    kept, surplus = delivery.split_copies(df, ["a", "b"], ["at", "delivery_id"])
    assert [x for (x,) in ids(surplus, "delivery_id")] == [1, 3, 6]
    assert [x for (x,) in ids(kept, "delivery_id")] == [2, 4, 5, 7]
    assert kept.columns == df.columns
    assert delivery.surplus_ids(df.limit(0), ["a", "b"], ["at", "delivery_id"], "delivery_id").isEmpty()
    merged = delivery.merge_new(df.where("delivery_id = 2"), df.where("delivery_id in (1, 7)"), ["a", "b"], ["at", "delivery_id"])
    assert [x for (x,) in ids(merged, "delivery_id")] == [2, 7]


def test_hot_identifier(spark):
    df = spark.range(3000).select(F.col("id").alias("delivery_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("a"))
    assert delivery.surplus_ids(df, ["a"], ["delivery_id"], "delivery_id").count() == 999


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, owner long, v array<double>")


def test_topk_exclusion_and_ties(spark):
    bank = vectors(spark, [(0, 1, [1.0, 0.0]), (1, 2, [0.9, 0.0]), (2, 3, [0.8, 0.0]), (3, 4, [float("nan"), 0.0]), (4, None, [0.0, 0.0]), (5, 6, None)])
    query = vectors(spark, [(9, 1, [1.0, 0.0])])
    assert ids(retrieval.topk(query, bank, 2), "cand_id", "rank") == [(1, 1), (2, 2)]
    assert retrieval.topk(query.limit(0), bank, 2).isEmpty()
    assert retrieval.topk(query, bank.limit(0), 2).isEmpty()
    m = retrieval.margin(retrieval.topk(query, bank.where("id = 1"), 2)).first()
    assert (m.top1, m.margin) == (1.0, None)


def test_rank_policies(spark):
    s = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.9)], "query_id long, cand_id long, score double")
    assert ids(retrieval.ranks(s, "mid"), "cand_id", "rank") == [(1, 3.0), (2, 3.0), (3, 3.0), (4, 1.0)]
    assert ids(retrieval.ranks(s, "optimistic"), "cand_id", "rank") == [(1, 2), (2, 2), (3, 2), (4, 1)]
    assert ids(retrieval.ranks(s, "stable"), "cand_id", "rank") == [(1, 2), (2, 3), (3, 4), (4, 1)]
    assert sorted(r for _, r in ids(retrieval.ranks(s, "random"), "cand_id", "rank")) == [1, 2, 3, 4]


def test_ranking_metrics(spark):
    r = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)], "query_id long, rank int, relevant boolean")
    m = {x.query_id: x for x in retrieval.metrics_at(r, (1, 5)).collect()}
    assert m[1].p1 == 1 and m[1].r1 == 0.5 and m[1].ap5 == pytest.approx((1 + 2 / 3) / 2) and m[2].ndcg5 == 0
    s = spark.createDataFrame([(1, 0.9, True), (1, 0.5, False), (1, 0.5, True), (2, 1.0, True)], "query_id long, score double, relevant boolean")
    assert ids(retrieval.auroc(s), "query_id", "auroc") == [(1, 0.75), (2, None)]
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, cand_id long, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "query_id long, cand_id long, rank int")
    assert [c for c, _ in sorted(ids(retrieval.rank_fusion([a, b]), "cand_id", "rank"), key=lambda x: x[1])] == [8, 7, 9]


def test_partition_operators(spark):
    rows = spark.createDataFrame([(1, "7", "a"), (2, " 07", "b"), (3, None, "a"), (4, "8", "a")], "id long, subject string, partition string")
    held = spark.createDataFrame([("7",), ("7",), (None,)], "who string")
    out = partition.protected_partition(rows.drop("partition"), "subject", held, "s")
    parts = dict(ids(out, "id", "partition"))
    assert parts[1] == parts[2] == "removed" and parts[3] == "quarantine" and parts[4] in ("train", "val", "test")
    assert ids(partition.split_leakage(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "b")], "s long, p string"), F.col("s"), F.col("p")), "subject", "n_splits") == [(1, 2)]
    ladder = partition.identity_ladder(rows, [("x", F.lit(None).cast("string")), ("y", F.col("subject"))])
    assert ids(ladder, "id", "identity", "identity_provenance")[2] == (3, None, "rejected")
    kept = partition.first_per_identity(spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None)], "id long, k string"), [F.col("k")], [F.col("id")])
    assert ids(kept.where("kept"), "id") == [(1,), (3,), (4,)]
    assert ids(partition.identity_conflicts(spark.createDataFrame([("k", 1), ("k", 2), ("j", 1)], "k string, o long"), "k", "o"), "identity", "owners") == [("k", 2)]
    study = spark.createDataFrame([(5, "n")], "key long, id string")
    linked = partition.linked(spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id long, key long"), [("s", study, "key", ["id"])])
    assert ids(linked, "id", "s_id", "has_s") == [(1, "n", True), (2, None, False), (3, None, False)]
    assert partition.multiset_difference(rows, rows).isEmpty()
    assert ids(partition.merged(rows, rows.where("id = 1").withColumn("partition", F.lit("z")), ["id"]), "id", "partition")[0] == (1, "z")
    assert partition.contract(rows.unionByName(rows), ["subject"], ["id"]).first().asDict() == {"rows": 8, "null_subject": 2, "duplicate_keys": 4}


def test_label_metrics_with_unknown(spark):
    rows = spark.createDataFrame([(1, ["a"], ["a", "b"], ["a", "b"]), (2, [], ["a"], []), (3, ["b"], [], ["b"])], "k long, t array<string>, p array<string>, known array<string>")
    long = labels.long_form(rows, ["k"], F.col("t"), F.col("p"), ["a", "b"], F.col("known")).withColumn("g", F.lit("x"))
    s = labels.summary(long, ["g"], ["k"]).first()
    assert (s.n, s.empty_reference_n, s.micro_f1, s.hamming_accuracy) == (3, 1, pytest.approx(0.5), pytest.approx(1 / 3))
    per = {r.label: r for r in labels.per_label(long, ["g"]).collect()}
    assert per["b"].fp == 1 and per["b"].fn == 1 and per["a"].known_n == 1
    assert labels.summary(long.limit(0), ["g"], ["k"]).isEmpty()
    v = spark.range(1).select(
        labels.citation_validity(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("a"),
        labels.citation_validity(F.array().cast("array<string>"), F.array(F.lit("s"))).alias("b"),
        labels.citation_validity(F.array(F.lit("s"), F.lit("t")), F.array(F.lit("s"))).alias("c"),
    ).first()
    assert tuple(v) == (1.0, 0.0, 0.5)


def log(spark):
    return spark.createDataFrame([("k", 1, "error"), ("k", 2, "ok"), ("k", 3, "ok"), ("j", 1, "error"), ("j", 2, None)], "key string, line int, status string")


def test_attempts(spark):
    good, order = F.col("status") == "ok", [F.col("line")]
    chosen = attempts.selected_attempts(log(spark), ["key"], good, order)
    assert ids(chosen, "key", "line", "attempts", "good_attempts") == [("j", 2, 2, 0), ("k", 2, 3, 2)]
    expected = spark.createDataFrame([("k", "g"), ("j", "g"), ("m", "g"), ("m", "g")], "key string, grp string")
    c = attempts.coverage(expected, log(spark), ["key"], ["grp"], good, order).first()
    assert (c.expected, c.successful, c.failed, c.pending, c.attempts, c.duplicates) == (3, 1, 1, 1, 5, 3)
    assert ids(attempts.pending(expected.distinct(), log(spark), ["key"]), "key") == [("m",)]
    assert ids(attempts.pending(expected.distinct(), log(spark), ["key"], retry=F.col("status") == "error"), "key") == [("m",)]
    assert dict(ids(attempts.mismatch(expected, log(spark), ["key"]), "side", "cells")) == {"missing": 1, "unexpected": 0}
    base, rescue = spark.createDataFrame([("a", 1)], "key string, v int"), spark.createDataFrame([("a", 2), ("b", 2)], "key string, v int")
    assert ids(attempts.precedence([base, rescue], ["key"]), "key", "v") == [("a", 1), ("b", 2)]
    rows = spark.createDataFrame([(i, "abcd"[i % 4] if i % 5 else None) for i in range(20)], "id long, s string")
    pilot = attempts.round_robin(rows, ["s"], [F.col("id")], 5)
    assert pilot.select("s").distinct().count() == 5
    pairs = attempts.paired(spark.createDataFrame([("q", "x", 1), ("q", "y", 1), ("r", "x", None), ("r", "y", None)], "q string, c string, p int"), "c", "x", "y", ["q"], ["p"])
    assert ids(pairs, "q", "ok") == [("q", True), ("r", False)]
    kinds = spark.createDataFrame([(None,), (" ",), ('{"report": []}',), ("Report text",)], "t string").select(attempts.non_report(F.col("t"), ["report"]).alias("k"))
    assert [r.k for r in kinds.collect()] == ["empty", "empty", "schema_echo", None]


def test_bootstrap(spark):
    stats = spark.createDataFrame([(i % 3, 1, 1) for i in range(9)], "p long, hit int, n int")
    r = controls.cluster_bootstrap(stats, "p", ["hit", "n"], {"rate": F.col("hit") / F.col("n")}, replicates=20).first()
    assert (r.observed, r.ci_low, r.ci_high) == (1.0, 1.0, 1.0)
    r = controls.cluster_bootstrap(stats.where("p = 0"), "p", ["hit", "n"], {"rate": F.col("hit") / F.col("n")}, replicates=5).first()
    assert r.ci_low is None


def test_broken_linkage_keeps_the_multiset(spark):
    slots = spark.createDataFrame([(i, i % 3, i * 2 % 5) for i in range(9)], "slot long, owner long, length int")
    out = controls.broken_linkage(slots, "slot", "owner").collect()
    assert sorted(r.donor_slot for r in out) == list(range(9))
    assert all(r.slot % 3 != r.donor_slot % 3 for r in out)
    assert controls.broken_linkage(slots.where("owner = 0"), "slot", "owner").isEmpty()
    moved = controls.rotation_control(slots, "slot", "owner").collect()
    assert sorted(r.donor for r in moved) == list(range(9)) and all(r.slot % 3 != r.donor % 3 for r in moved)


def test_gate(spark):
    cases = spark.createDataFrame([(i / 40, int(i >= 20)) for i in range(40)], "s double, g int")
    g = controls.gate_threshold(cases, "s", "g").first()
    assert g.f1 == 1.0 and g.coverage == 0.5
    assert controls.gate_threshold(cases.where("g = 1"), "s", "g").isEmpty()


def test_samples_are_stable(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(50)], "id long, s long")
    a = ids(controls.hashed_sample(rows, ["s"], "id", 3, "x"), "id")
    assert a == ids(controls.hashed_sample(rows.repartition(7), ["s"], "id", 3, "x"), "id") and len(a) == 6
    q = spark.createDataFrame([(1, 1, 10)], "id long, owner long, length int")
    pool = spark.createDataFrame([(5, 1, 10), (6, 2, 12), (7, 3, 9), (8, 4, 30)], "id long, owner long, length int")
    assert ids(controls.length_matched(q, pool), "cand_id", "pick") == [(6, 2), (7, 1)]


def test_codes(spark):
    rows = spark.createDataFrame([([0, 1], True), ([0, -1], False), ([1, 1], False)], "c array<int>, side boolean")
    use = {r.chunk: r for r in codes.code_usage(rows, "c", 4).collect()}
    assert use[0].used == 2 and use[1].used == 1 and use[1].perplexity == 1.0
    assert ids(codes.code_divergence(rows, "c", "side"), "chunk", "js")[1] == (1, 0.0)
    assert codes.unique_sequences(rows, "c").first().unique_fraction == 1.0
    two = rows.withColumn("d", F.array(F.lit(0), F.lit(1)))
    assert codes.code_agreement(two, "c", "d").first().sequence_rate == pytest.approx(1 / 3)


def test_contexts(spark):
    c = spark.createDataFrame([(1, 9, ["a", "a", "z"])], "delivery_id long, subject_id long, e array<string>")
    c = c.withColumn("evidence", F.transform("e", lambda x: F.struct(x.alias("anchor_id"))))
    bank = spark.createDataFrame([("a", 9)], "sample_id string, subject_id long")
    assert [p for _, p in ids(contexts.evidence_problems(c, bank), "delivery_id", "problem")] == ["own_subject", "repeated_anchor", "unknown_anchor"]


def test_review(spark):
    a = spark.createDataFrame([(1, "Y"), (2, "NA"), (3, "N")], "id long, f string")
    b = spark.createDataFrame([(1, "Y"), (2, "Y"), (3, "Y")], "id long, f string")
    r = review.agreement(a, b, "id", ["f"]).first()
    assert (r.n, r.agreement) == (2, 0.5)
    c = spark.createDataFrame([(3, "N")], "id long, f string")
    assert ids(review.adjudicated(a, b, c, "id", "f"), "id", "final", "source") == [(1, "Y", "agreed"), (2, None, "unresolved"), (3, "N", "third")]
    assert ids(review.domain_violations(a, {"f": ["Y", "N"]}), "field", "value", "n") == [("f", "NA", 1)]
    s = review.blinded_sample(spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, s long"), ["s"], "id", 3)
    assert sorted(r.review_id for r in s.collect()) == list(range(1, 7))


def test_same_row_delivered_again(spark):
    again = (1, "2024-01-01", "x", "y", 0, 0)
    df = deliveries(spark, [again, again, again, (2, "2024-01-01", None, "y", 0, 0), (2, "2024-01-01", None, "y", 0, 0), (3, "2024-01-01", "q", "y", 0, 0), (3, "2024-01-01", "q", "y", 9, 0)])
    kept, surplus = delivery.split_copies(df, ["a", "b"], ["at", "delivery_id"])
    assert [x for (x,) in ids(kept, "delivery_id")] == [1, 2, 2, 3]
    assert [x for (x,) in ids(surplus, "delivery_id")] == [1, 1, 3]
    assert delivery.merge_new(df.where("delivery_id = 1").limit(1), df.where("delivery_id = 1"), ["a", "b"], ["at", "delivery_id"]).count() == 1


def test_written_tables_are_released(spark):
    import os

    from cohortloom.session import materialise, release

    release(spark)
    kept = materialise(spark.range(3), "kept")
    path = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and kept.count() == 3
    assert release(spark) == 1 and not os.path.exists(path) and release(spark) == 0
