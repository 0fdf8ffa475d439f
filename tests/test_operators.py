"""Relational, profile, retrieval, feature, score and fill operators on small tables."""

import pytest
from pyspark.sql import functions as F
from tessera.operators import evaluation as E
from tessera.operators import features as M
from tessera.operators import fill as L
from tessera.operators import modeling as G
from tessera.operators import profile as P
from tessera.operators import relational as R
from tessera.operators import retrieval as S


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_resolve(spark):
    df = spark.createDataFrame([("a", 1)], "NCT_ID string, x int")
    got = R.resolve(df, {"study": ["study_id", "nct_id"], "x": [], "gone": ["y"]})
    assert got.columns == ["study", "x"]


def test_merge_and_reduce(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    many = spark.createDataFrame([(1, 1, None, 2.0), (1, 2, "y", 4.0), (3, 1, "z", 1.0)], "id int, i int, v string, n double")
    reduced = R.reduce_to_key(many, ["id"], ["i"])
    assert rows(reduced.select("id", "v", "n"), "id") == [(1, "y", 3.0), (3, "z", 1.0)]
    merged = R.merge_left(base, {"many": reduced}, ["id"])
    assert merged.columns == ["id", "v", "i", "v_many", "n"] and merged.count() == 2


def test_unions(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    b = spark.createDataFrame([(2, "c", 5), (3, "d", 6)], "id int, v string, n int")
    assert rows(R.diagonal_union([a, b]), "id", "v") == [(1, "a", None), (2, "b", None), (2, "c", 5), (3, "d", 6)]
    assert rows(R.priority_union([a, b.drop("n")], ["id"], ["v"]), "id") == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(R.complete_ids([a, b], "id")) == [(2,)]


def test_nested_and_marked(spark):
    base = spark.createDataFrame([(1,), (2,)], "id int")
    kids = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, None)], "id int, v string")
    got = {r.id: [x.v for x in r.kids] for r in R.nested_records(base, {"kids": (kids, ["v"])}, "id").collect()}
    assert got == {1: ["a", "b"], 2: []}
    assert rows(R.marked(base, "id", kids.select("id"), "has"), "id") == [(1, True), (2, False)]
    assert R.filter_ids(base, "id", base.limit(0)).count() == 2 and R.filter_ids(base, "id", kids.select("id")).count() == 1
    assert rows(R.supplement(base, kids.limit(1), ["id"], ["v"]).select("id"), "id") == [(1,), (2,)]
    assert R.supplement(base, kids, ["zz"], ["v"]).columns == ["id", "v"]


def test_match_or_first(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x"), (2, 2, "z")], "k int, i int, v string")
    assert rows(R.match_or_first(df, "k", F.col("v") == "y", [F.col("i")]), "k") == [(1, 2, "y"), (2, 1, "x")]
    assert R.several_valued(df, "k") == ["i", "v"]


def test_phases(spark):
    df = spark.createDataFrame([("Phase 1/Phase 2",), ("Early Phase 1",), ("Phase 2",), ("phase 12",), (None,)], "p string")
    got = df.where(R.phase_matches(F.col("p"), ["Phase 1"])).collect()
    assert [r.p for r in got] == ["Phase 1/Phase 2", "Early Phase 1"]
    assert [r.p for r in df.where(R.phase_matches(F.col("p"), ["PHASE X", "phase 2"])).collect()] == ["Phase 1/Phase 2", "Phase 2"]


def test_graph(spark):
    edges = R.symmetric_edges(spark.createDataFrame([("study:1", "drug:a"), ("study:2", "drug:a"), ("study:2", "drug:b"), ("study:3", "drug:b")], "src string, dst string"))
    start = spark.createDataFrame([("study:1", "study:1")], "query string, node string")
    assert rows(S.related(edges, start, "study:", 5, 4).select("node", "hop", "score"), "node") == [("study:2", 2, 0.5), ("study:3", 4, 0.25)]


def test_profiles(spark):
    df = spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "a"), (3, 30.0, "n/a"), (4, 40.0, "")], "id int, x double, s string")
    assert rows(P.nearest_rank(df.withColumn("g", F.lit(1)), ["g"], "x", [0.25, 0.5])) == [(1, 4, 20.0, 30.0)]
    got = P.text_profile(df, ["s"]).first()
    assert (got.n_missing, got.n_pseudo, got.n_unique) == (1, 2, 3)
    one = P.numeric_profile(df.limit(1), ["x"]).first()
    assert one.sd == 0.0
    assert rows(P.top_values(df, ["s"], 1)) == [("s", "a", 2, 1)]
    assert rows(P.duplicate_keys(df, ["s"])) == [(4, 3, 2)]
    assert rows(P.variable_stats(df.withColumn("c", F.lit(1)), ["c"], ["s"]).select("column", "missing_ratio", "constant")) == [("c", 0.0, True), ("s", 0.25, False)]


def test_simhash_pairs(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e f g i"), (4, "zz yy xx"), (5, "a b c d e f g h")], "id int, t string")
    got = rows(S.simhash_pairs(S.simhash(df, "id", F.col("t")), 64))
    assert (1, 2, 0) in got and (1, 5, 0) in got and (2, 5, 0) not in got


def test_lookup(spark):
    names = spark.createDataFrame([(1, "azacitidine"), (2, "x azacitidine long name"), (1, "azacitidine salt")], "id int, name string")
    assert [(r.id, r.score) for r in S.name_lookup(names, "Azaciti").collect()] == [(1, 1.01), (2, 0.64)]


def test_tiers(spark):
    meta = spark.createDataFrame([(i, p, t, c, d, e) for i, p, t, c, d, e in [(1, "Phase 2", "x", "lung cancer", "drug a", "os"), (2, "phase 2", "x", "lung", "a", "zz"), (3, "phase 1", "x", "cancer", "b", "zz"), (4, "", "y", "lung cancer", "q", "z"), (5, "phase 2", "x", "heart", "q", "os")]], "id int, phase string, type string, c string, d string, e string")
    index = S.token_index(meta, "id", {"condition": F.col("c"), "drug": F.col("d"), "endpoint": F.col("e")})
    q = spark.createDataFrame([(1, 1)], "query int, id int")
    got = S.tiered(index, S.token_counts(index), meta.select("id", "phase", "type"), q, k=5)
    assert [(r.id, r.tier) for r in got.orderBy("rank").collect()] == [(2, 1), (3, 4), (4, 5), (5, 6)]


def test_cascade_and_rules(spark):
    none, some = spark.range(0), spark.range(2)
    assert S.cascade(none, none, some, spark.range(5)).count() == 2 and S.cascade(none, some, None, none, relation_only=True).count() == 0
    current = spark.createDataFrame([(1, False, True, 0.9, "pfs")], "id int, randomized boolean, control boolean, strictness double, endpoint string")
    peers = spark.createDataFrame([(1, 0.2, "os"), (1, 0.3, "os"), (1, 0.1, "")], "query int, strictness double, endpoint string")
    assert [r.action for r in S.recommend(current, peers).collect()] == ["randomize", "loosen_criteria", "align_endpoint"]


def test_features(spark):
    df = spark.createDataFrame([(1, 1.0, "b", 0), (2, None, "a", 1), (3, 3.0, None, 1), (4, 8.0, "b", 0)], "id int, x double, s string, y int")
    assert [r.x for r in M.impute_numeric(df, ["x"]).orderBy("id").collect()] == [1.0, 3.0, 3.0, 8.0]
    assert [r.x for r in M.impute_numeric(df, ["x"], "zero").orderBy("id").collect()][1] == 0.0
    assert [r.s for r in M.impute_mode(df, ["s"]).orderBy("id").collect()] == ["b", "a", "b", "b"]
    assert [r.code for r in M.label_codes(df, "s", "code").orderBy("id").collect()] == [2, 1, 0, 2]
    assert M.one_hot(df, "s").columns == ["id", "x", "y", "s_a", "s_b"]
    scaled = [r.x for r in M.standard_scale(df, ["x"]).orderBy("id").collect()]
    assert scaled[1] is None and scaled[0] == pytest.approx(-1.0190, abs=1e-3)
    assert M.dense_columns(df, ["x", "s", "y"], 0.2) == ["y"] and M.wide_columns(df, ["s"], 1) == ["s"]
    assert {r.split for r in M.time_split(df, F.col("id"), "id", 0.25).where("id = 4").collect()} == {"test"}
    assert sorted(r.fold for r in M.folds(df, "y", "id", 5).collect()) == [0, 0, 1, 1]
    assert M.feature_types(df, ["id"]) == {"x": "numeric", "s": "categorical", "y": "numeric"}


def test_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6)], "y int, p double")
    c = E.confusion(df, "y", "p").first()
    assert (c.tp, c.fp, c.fn, c.precision, c.recall, c.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert E.roc_auc(df, "y", "p").first()[0] == 0.5
    assert E.average_precision(df, "y", "p").first()[0] == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)
    assert E.best_threshold(E.threshold_sweep(df, "y", "p")).first().f1 == pytest.approx(0.8)
    ci = E.bootstrap(df.withColumn("id", F.monotonically_increasing_id()), "y", "p", "id", times=200).first()
    assert ci.low <= ci["mean"] <= ci.high and ci.resamples < 200


def test_models(spark):
    df = spark.range(60).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + (F.col("id") % 7) / 20).alias("a"), (F.col("id") % 3 == 0).cast("int").alias("b"))
    oof = G.out_of_fold(df, ["a", "b"], "y", "id", "logistic", 3)
    assert oof.count() == 60 and E.roc_auc(oof, "y", "p").first()[0] > 0.95
    model = G.ZOO["rf"](numTrees=5).fit(G.assembled(df, ["a", "b"], "y"))
    assert {r.column: r.importance for r in G.importances(model, ["a", "b"], df).collect()}["a"] > 0.5
    best = G.what_if(G.ZOO["logistic"]().fit(G.assembled(df, ["a", "b"], "y")), df, ["a", "b"], "id", df.where("y = 0").limit(3))
    assert {r.column for r in best.where("rank = 1").collect()} == {"a"}


def test_fill(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "keep", " ")], "id int, a string, b string")
    assert rows(L.missing_fields(df, "id", ["b", "a"])) == [(1, ["a"]), (2, ["b"])]
    answers = spark.createDataFrame([(1, "a", "v", "the source"), (2, "b", "w", "not there"), (2, "a", "other", "text")], "id int, field string, value string, evidence string")
    sources = spark.createDataFrame([(1, "in the source text"), (2, "some text")], "id int, source string")
    assert rows(L.write_back(df, "id", answers, sources, ["a", "b"]), "id") == [(1, "v", "x"), (2, "keep", " ")]
    log = spark.createDataFrame([(1, 1, None), (1, 2, "v"), (1, 3, "w"), (2, 1, None)], "k int, i int, f string")
    assert rows(L.fill_from_first(log, ["k"], ["i"], ["f"]), "k", "i") == [(1, 1, "v"), (1, 2, "v"), (1, 3, "w"), (2, 1, None)]
    done = L.completeness({"a": df, "b": df.where("id = 1")}, "id", df.where("id = 9"))
    assert rows(done) == [(1, "complete_clean"), (2, "partial")]
