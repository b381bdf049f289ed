"""Checked linkage and statistics on small fixtures."""

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import identity as I
from cohortloom.functions import vector as V
from cohortloom.operators import contexts, linkage, statistics


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n"), (3, "w")], "k long, a string")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r"), (3, "s"), (None, "t")], "k long, b string")
    joined, problems = linkage.one_to_one(a, b, ["k"])
    assert rows(joined, "k", "a", "b") == [(1, "x", "p")]
    assert rows(problems, "side", "k", "n") == [("left", 2, 2), ("right", 3, 2)]
    assert linkage.one_to_one(a.limit(0), b, ["k"])[0].isEmpty()


def test_identity_join(spark):
    a = spark.createDataFrame([(1, "7", 1), (2, "8", 1), (3, None, 1), (4, None, None), (None, "1", 1)], "k long, who string, n int")
    b = spark.createDataFrame([(1, 7, 1, "v"), (2, 9, 1, "v"), (3, 5, 1, "v"), (4, None, None, "v")], "k long, who long, n int, extra string")
    got = {r.k: r.state for r in linkage.identity_join(a, b, ["k"], ["who", "n"]).collect()}
    assert got == {1: "ok", 2: "conflict", 3: "conflict", 4: "ok", None: "missing"}


def test_states_and_texts(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    s = lambda x: F.lit(x).cast("string")
    assert one(linkage.agreement(s("1"), s("1 "), s(None)), linkage.agreement(s("1"), s("2")), linkage.agreement(s(""), s("2"))) == ("agree", "conflict", "unknown")
    assert one(linkage.first_text([s(" "), s("a ")]), linkage.first_text([s(None)], [s("b"), s(""), s("c")]), linkage.first_text([s(None)], [s("")])) == ("a", "b c", None)
    labels = ['["b", "a"]', "b; a|c\n a", " ", None, "[broken"]
    assert [one(I.label_texts(s(x)))[0] for x in labels] == [["a", "b"], ["a", "b", "c"], [], [], ["[broken"]]
    assert one(I.path_safe(s("a-b_1")), I.path_safe(s("-a")), I.path_safe(s("a" * 81)), I.path_safe(s(None)), I.path_safe(s("a\n"))) == (True, False, False, False, False)
    assert len(one(I.group_hash(s("a"), s(None)))[0]) == 15
    with pytest.raises(Exception, match="not finite"):
        one(I.strict_signature(F.lit(float("nan"))))
    assert one(V.nearest_codes(F.array(*map(F.lit, (2.0, 0.1, -1.0, -1.0, 5.0))), [[1.0, 0.0], [0.0, 1.0], [-1.0, -1.0]], 2))[0] == [0, 2]


def test_identities_signatures_and_order(spark):
    r = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 1), ("b", 2), (None, 3)], "k string, who long")
    assert rows(linkage.varying_identity(r, "k", ["who"]), "k", "versions") == [("b", 2)]
    signed = r.withColumn("s", I.signature("k", "who")).withColumn("s", F.when(F.col("who") == 2, "old").when(F.col("who") == 3, None).otherwise(F.col("s")))
    assert [x.state for x in linkage.signature_state(signed, ["k", "who"], "s").orderBy("k", "who").collect()] == ["missing", "ok", "ok", "ok", "ok", "changed"]
    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "i int, k string")
    assert rows(linkage.order_problems(a, a, "i", "k"), "i") == []
    assert [x[0] for x in rows(linkage.order_problems(a, a.where("i < 2").replace("y", "q"), "i", "k"), "i")] == [1, 2]


def test_first_rows_and_salience(spark):
    v = [("a", 2, [1.0, 2.0]), ("a", 1, [1.0, 2.000001]), ("b", 3, [1.0]), ("b", 4, [1.5]), ("c", 5, None), ("c", 6, None), ("d", 7, [1.0]), ("d", 8, [1.0, 2.0]), (None, 9, [1.0])]
    first, bad = linkage.first_per_key(spark.createDataFrame(v, "k string, i long, v array<double>"), "k", "i", "v")
    assert rows(first, "k", "i") == [("a", 1), ("b", 3), ("c", 5), ("d", 7)] and rows(bad, "k") == [("b",), ("d",)]
    x = F.array(*(F.lit(y).cast("double") for y in (0.5, 0.1, 0.95, None, float("nan"), 0.9, 0.0)))
    got = spark.range(1).select(linkage.salient(x, 0.1, 0.9, 0.5, 3).alias("s")).first().s
    assert [(s.i, s.direction) for s in got] == [(6, "low"), (2, "high"), (1, "low")]
    cells = spark.createDataFrame([(1, [0.5, 0.2, None, 0.7], [0, 1, 1, 2]), (2, [0.4, 0.1, 0.1, 0.1], [0, 1, 1, 1])], "k long, x array<double>, o array<int>")
    means = spark.createDataFrame([(i, 0.5) for i in range(4)], "i int, mean double")
    assert rows(linkage.imputation_problems(cells, "k", "x", "o", means), "k", "i", "problem") == [(1, 2, "observed"), (1, 3, "mask"), (2, 0, "imputed")]


def test_paired_bootstrap(spark):
    data = [("c", f"p{i % 6}", i, float(i % 3), 1.0, 1) for i in range(30)] + [("d", "p", 1, 2.0, 1.0, 1)]
    pairs = spark.createDataFrame(data, "g string, who string, i long, x_a double, x_b double, n_a long").withColumn("n_b", F.col("n_a"))
    got = {(r.g, r.metric): r for r in statistics.paired_bootstrap(pairs, ["g"], "who", ["x", "n"], {"mean": F.col("x") / F.col("n"), "loss": F.col("x") / F.col("n")}, ["loss"], 50).collect()}
    assert got["c", "mean"].difference == 0.0 and got["d", "mean"].difference == 1.0 and got["d", "loss"].difference == -1.0
    assert got["d", "mean"].ci_low is None and got["d", "mean"].positive is None
    assert got["c", "mean"].ci_low == -got["c", "loss"].ci_high and got["c", "mean"].ci_low <= 0 <= got["c", "mean"].ci_high
    # rows as their own clusters
    rowwise = statistics.paired_bootstrap(pairs.where("g = 'c'"), ["g"], "i", ["x", "n"], {"mean": F.col("x") / F.col("n")}, (), 50).first()
    assert (rowwise.clusters, rowwise.pairs) == (30, 30)
    assert statistics.paired_bootstrap(pairs.limit(0), ["g"], "who", ["x", "n"], {"mean": F.col("x")}, (), 5).isEmpty()


def test_contrasts_abstentions_and_homogeneity(spark):
    r = spark.createDataFrame([("full", "m", 1, 2.0, "s"), ("same", "m", 1, 1.0, "s"), ("same", "m", 2, 1.0, "s"), ("full", "m", 2, 1.0, None)], "condition string, model string, case long, x double, sig string")
    registry = statistics.contrasts(spark, {"effect": ("full", "same")})
    assert rows(statistics.contrast_pairs(r, registry, "condition", ["model"], "case"), "case", "x_a", "x_b") == [(1, 2.0, 1.0), (2, 1.0, 1.0)]
    assert rows(statistics.contrast_pairs(r, registry, "condition", ["model"], "case", ["sig"]), "case") == [(1,)]
    both = statistics.with_abstentions(r, r.where("case = 2").select("model", "case"), {"x": F.lit(0)})
    assert rows(both.where("abstained"), "model", "case", "x", "sig") == [("m", 2, 0.0, None)] * 2
    assert rows(statistics.homogeneity(r, ["model"], "sig"), "versions", "unknown", "homogeneous") == [(1, 1, False)]
    shuffled = statistics.shuffled(spark.range(40), "id", "s").collect()
    assert sorted(x.donor for x in shuffled) == list(range(40)) and [x.id for x in shuffled] != [x.donor for x in shuffled]


def test_grids_arms_and_tasks(spark):
    a = spark.createDataFrame([(1, "ecg", 0.5, 1, 10), (1, "ecg", 0.5, 2, 11), (2, "cxr", 0.1, 1, 12)], "query_id long, direction string, margin double, rank int, cand_id long")
    own = a.select("query_id", "rank", (F.col("cand_id") + 100).alias("cand_id"))
    grid = {(r.query_id, r.condition): r for r in contexts.full_grid(a, 0.3, {"full_random": own, "full_shuffled": own.where("query_id = 1")}).collect()}
    assert grid[1, "full_random"].anchor_ids == [110, 111] and grid[2, "full_random"].components == ["cxr", "labs", "ecg"]
    assert (2, "full_shuffled") not in grid and grid[1, "full_trimodal"].anchor_ids == [10, 11]
    ranked = a.select("query_id", "rank", "cand_id")
    donors = own.select("query_id", "rank", F.col("cand_id").alias("donor_id"))
    arms = {(r.query_id, r.condition): r for r in contexts.review_arms(spark.range(1, 4).withColumnRenamed("id", "query_id"), ranked, ranked, ranked, donors).collect()}
    assert len(arms) == 21 and arms[1, "trimodal_broken"].donor_ids == [110, 111] and arms[1, "raw_ecg_same"].components == ["ecg"]
    assert arms[3, "trimodal_full"].anchor_ids == [] and arms[1, "zero_shot"].anchor_ids == []
    tasks = contexts.rendered_tasks(spark.createDataFrame([(1, True), (2, False), (3, None)], "i long, sub boolean"), F.col("sub"), ["legacy", "calibrated"], "legacy")
    assert rows(tasks, "i", "rendering") == [(1, "calibrated"), (1, "legacy"), (2, "legacy"), (3, "legacy")]
