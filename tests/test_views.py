"""Blobs, snippets, defaults, actions, bracket scans and reranked hits against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F
from tessera.operators import views as V

TOOLS = ["search", "lookup"]
END = "array<struct<primary_endpoint:string,primary_endpoint_domain:string,primary_endpoint_subdomain:string>>"
OUT = "array<struct<outcome_type:string,why_terminated:string,overall_status:string>>"


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('so {"type": "tool", "tool": "x"} ok', ("tool", "x")),
        ('{"type": "tool"}', ("tool", "")),
        ('{"type": "final", "final": {}}', ("final", "")),
        ('{"type": "lookup"}', ("tool", "lookup")),
        ('{"type": "other", "action": "search"}', ("tool", "search")),
        ('{"type": "other"}', ("invalid", "")),
        ('{"answer": 1}', ("final", "")),
        ("{ }", ("invalid", "")),
        ("none", ("invalid", "")),
        (None, ("invalid", "")),
    ],
)
def test_action(spark, answer, want):
    assert tuple(spark.createDataFrame([(answer,)], "c string").select(V.action(F.col("c"), TOOLS).alias("a")).select("a.*").first()) == want


def brute_balanced(text):
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        ch = text[i]
        if quoted:
            quoted, skip = (quoted if skip or ch != '"' else False), ch == "\\" and not skip
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def test_balanced(spark):
    texts = ['a "{" b', 'x {"a": "}\\"]", "b": [1, {"c": 2}]} y }', "[1, 2", "", "none", '"q" [["]"]] {', json.dumps({"k": "\\"}) + "}", "é😀{1}😀"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").select(V.balanced(F.col("c")), "i").orderBy("i").collect()]
    assert got == [brute_balanced(t) for t in texts] and got[1] == texts[1][2:-4]


def test_snippet_and_blob(spark):
    rows = [
        ([("", "dom", "sub")], "inc", "", "", "t", [], ""),
        ([(None, "", None)], "inc", "", "", "", [], ""),
        ([], "", "exc", "a", "t", [], ""),
        (None, None, None, None, "t", None, None),
        ([], "", "", "", "", [("", "why", "s")], "p"),
        (None, None, None, None, None, None, "p"),
    ]
    df = spark.createDataFrame(rows, f"e {END}, i string, x string, a string, t string, o {OUT}, p string")
    assert [r[0] for r in df.select(V.pick_snippet(*(F.col(c) for c in "eixatop"))).collect()] == ["dom", "", "exc", "t", "why", "p"]
    blob = df.select(V.search_blob(V.field_text(F.col("e"), "primary_endpoint_domain"), F.col("x"), V.criteria_text(F.col("i"), F.col("x"), 4)))
    assert [r[0] for r in blob.collect()][:4] == ["dom\n\ninc\n", "\n\ninc\n", "\nexc\n\nexc", "\n\n\n"]


def test_defaults_and_start(spark):
    df = spark.createDataFrame([(1, None, None), (2, ("a", None), [1])], "id int, s struct<x:string,y:int>, l array<int>")
    got = V.with_defaults(df, {"s.x": "-", "s.y": 0, "l": []}).orderBy("id").collect()
    assert [(tuple(r["s"]), r["l"]) for r in got] == [(("-", 0), []), (("a", 0), [1])]
    dates = spark.createDataFrame([(1, "2001"), (1, "2000"), (2, None), (None, "1999")], "id int, day string")
    assert sorted(map(tuple, V.with_start(df.select("id"), dates, "id", "day").collect())) == [(1, "2000"), (2, None)]


def test_rates_errors_and_lists(spark):
    df = spark.createDataFrame([("a", None), (" ", "x"), ("b", None)], "p string, q string")
    assert [tuple(r) for r in V.missing_rates(df, ["p", "q"]).orderBy("rank").collect()] == [("q", 0.666667, 1), ("p", 0.333333, 2)]
    lines = [("f", '{"error": "x"}'), ("f", '{"error": ""}'), ("f", "bad"), ("f", " "), ("f", None), ("f", '{"error": null}'), ("g", '{"error": {"m": 1}}')]
    assert sorted(map(tuple, V.response_status(spark.createDataFrame(lines, "f string, l string"), ["f"], "l").collect())) == [("f", 4, 1), ("g", 1, 1)]
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c"), (3, 1, None)], "k int, o int, v string")
    assert sorted(map(tuple, V.one_or_list(rows, ["k"], "v", "o").collect())) == [(1, 2, '["a","b"]'), (2, 1, "c")]
    pair = "array<struct<group:string,n:int>>"
    df = spark.createDataFrame([("a", [("a", 3)], [("a", 9)]), ("a", [("b", 3)], [("a", 9)]), ("a", None, None)], f"g string, m {pair}, o {pair}")
    assert [r[0] for r in df.select(V.analysed(F.col("m"), F.col("o"), F.col("g"))).collect()] == [3, 9, None]


def test_simhash_hits_are_overfetched_and_reranked(spark):
    sigs = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, -1), (5, 0x0101010101010101)], "id long, sig long")
    asked = sigs.where("id = 1").withColumnRenamed("id", "query")
    found = V.simhash_top(sigs, asked, 5)
    assert [(r["id"], r["distance"], r["score"]) for r in found.orderBy("rank").collect()] == [(2, 1, 0.5), (3, 2, 1 / 3)]
    scores = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.9), (1, 4, 1.0)], "query long, id long, score double")
    assert [r["id"] for r in V.reranked(found, scores, 2).orderBy("rank").collect()] == [3, 2]
    assert [r["id"] for r in V.reranked(found, scores, 2, spark.createDataFrame([(2,)], "id long")).collect()] == [2]
