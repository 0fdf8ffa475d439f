"""The pipeline's stages on a small table, each against what brute force makes of its own input, and the queries' SQL on it."""

import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_llm_operators import SCHEMA, brute_components, brute_decontaminate, brute_targets

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tessera.llm import oracles, registry  # noqa: E402

TABLES = "/root/testdata/sf0.001"
NAMES = ["language_id", "near_dedup", "decontaminate", "mix", "token_ids"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into and come out of each stage, in order."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "src0", 0), (10_002, "", None, None, 0), (10_003, "12 34 !!", "en", "src1", 8)], docs.schema)
    docs, out = docs.unionByName(extra), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, TABLES).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert all(columns == ["doc_id", "text", "lang", "source", "n_chars"] for *_, columns in stages[:4])


def test_language(stages):
    before, after, _ = stages[0]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {10_001, 10_002, 10_003} <= gone and len(gone) <= 3 + 0.02 * len(before)


def test_near_copies(stages):
    before, after, _ = stages[1]
    want = {i for i, _, _, kept in brute_components([(r.doc_id, r.text) for r in before], n=5) if kept}
    assert {r.doc_id for r in after} == want


def test_leaks(spark, stages):
    before, after, _ = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").select("item_id", "text").collect()]
    want = {r[0] for r in brute_decontaminate([(r.doc_id, r.text) for r in before], items) if not r[5]}
    assert {r.doc_id for r in after} == want


def test_mix(stages):
    before, after, _ = stages[3]
    size, made = {}, {}
    for r in before:
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    for r in after:
        made[r.source] = made.get(r.source, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    for s, t in brute_targets(size).items():
        assert abs(made.get(s, 0) - t) <= 96


def test_tokens(stages):
    from tokenizers import Tokenizer

    before, after, _ = stages[4]
    tok, at = Tokenizer.from_file(registry.tokenizer_path()), 0
    left = sorted((r.doc_id, zlib.crc32(np.array(tok.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes())) for r in before)
    for r in sorted(after, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id, r.ids_crc32) for r in after) == left


def test_queries_and_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    found = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    for name in ("op1_decontamination", "op9_chat_collapse", "op10_substring_dedup"):
        want = con.execute(registry.oracle_sql()[name]).df()
        got = found[name](spark, TABLES).toPandas()[list(want.columns)]
        assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, want.itertuples(index=False))), name
    assert "documents" in oracles.near_dedup() and SCHEMA
