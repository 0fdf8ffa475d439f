"""Queries of the catalog over small tables: they answer the whole set that they state."""

import pytest
from pyspark.sql import functions as F
from tessera.operators import retrieval as S
from tessera.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    part = [(i, f"red part {i % 7}", f"Brand#{i % 2}", f"TYPE {i % 3}", i % 5 + 1, 1.0) for i in range(1, 121)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    vectors = [(i, [float(i % 11), float(i % 13) + 1], i % 4) for i in range(120)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(i, i % 3) for i in range(1, 121)], "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(i, i % 3) for i in range(1, 10)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(i, 0) for i in range(3)], "n_nationkey int, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    item = "".join(f"{i:03d} " for i in range(90))
    spark.createDataFrame([(0, item), (1, "short item"), (2, "x" * 240 + " | y"), (3, ""), (4, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = [(0, f"a {item}b", "en", "src0"), (1, item, "de", "src1"), (2, item[:300], "en", "src0"), (3, "one short item", "de", "src2"), (4, "z" * 700 + "\n \nzz  z", "fr", "src0"), (5, None, "fr", "src0"), (6, "x" * 240 + " | y", "es", "src3"), (7, "x" * 240, "es", "src3")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def asked(spark, tables, name):
    return {r["query"] for r in catalog.queries()[name](spark, tables).collect()}


def test_searches_take_every_fiftieth_record(spark, tables):
    assert asked(spark, tables, "structured_tiered_topk") == {50, 100}
    assert asked(spark, tables, "vector_topk") == asked(spark, tables, "vector_topk_grouped") == {0, 50, 100}
    assert asked(spark, tables, "khop_related") == {"customer:50", "customer:100"}


def test_combined_score_scan(spark, tables):
    name, sizes = (lambda i: {"red", "part", str(i % 7)}), (lambda i: i % 5)
    tokens = lambda i: name(i) | {"type", str(i % 3), "brand", str(i % 2)}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    want = []
    for q in (50, 100):
        scores = [(-round(jaccard(tokens(q), tokens(i)) + 0.15 * (sizes(i) == sizes(q)) + 0.4 * jaccard(name(q), name(i)) + 0.2 * (i % 3 == q % 3) + 0.25 * (i % 2 == q % 2), 6), i) for i in range(1, 121) if i != q]
        want += [(q, i, -s) for s, i in sorted(scores)[:10]]
    got = [tuple(r) for r in catalog.queries()["combined_score_scan"](spark, tables).collect()]
    assert sorted(got) == sorted(want)


def test_recommend_rules_take_every_part(spark, tables):
    got = {r["action"]: r["n"] for r in catalog.queries()["recommend_rules"](spark, tables).collect()}
    assert got["randomize"] == sum((i % 5 + 1) % 2 == 1 for i in range(1, 121)) and got["add_control"] == sum((i % 5 + 1) % 3 != 0 for i in range(1, 121))


def test_evidence_is_whole_items_in_all_documents(spark, tables):
    got = {tuple(r) for r in catalog.queries()["evidence_validate"](spark, tables).collect()}
    assert got == {(0, 2), (1, 1), (2, 1)}


def test_focus_lengths_measure_whole_lines(spark, tables):
    got = {r["lang"]: tuple(r)[1:] for r in catalog.queries()["focus_lengths"](spark, tables).collect()}
    assert got["fr"] == (2, 4, 700, 352.0)


def test_searches_by_kind_rank_as_all_pairs(spark, tmp_path):
    """Copies, parts without a size and names of one kind: what is ranked by kinds is what all pairs give, ids breaking ties."""
    part = [(i, f"{'red' if i % 4 else 'hot'} ring {i % 3}", f"Brand#{i % 2}", "RED" if i % 5 else "HOT", None if i % 7 == 0 else i % 3) for i in range(0, 300)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = spark.read.parquet(f"{tmp_path}/part.parquet")
    index = S.token_index(rows, "p_partkey", {"condition": F.col("p_name"), "drug": F.col("p_type"), "biomarker": F.col("p_brand")})
    meta = rows.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("phase"), F.lit("").alias("type"))
    queries = rows.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), F.col("p_partkey").alias("id"))
    want = S.tiered(index, S.token_counts(index), meta, queries, k=5).select("query", "rank", "tier", "id", F.round("score", 6).alias("score"))
    got = catalog.queries()["structured_tiered_topk"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 30
    # Records of a kind are not paired one by one: a query's kind meets each kind once.
    words, n = S.set_words(rows.select(F.split("p_name", " ").alias("name")), ["name"])
    assert n == 1 and words.select(F.max(F.bit_count("name_0"))).first()[0] == 3 and S.set_words(rows.select(F.array("p_name").alias("name")), ["name"], 2)[1] == 0
