"""Encoding by pieces: the library's ids for texts of any kind, and no piece given to the model again."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import registry, tokens

CHARS = [*" \t\n\x0b\x0c\r\x1c\x1f\x00\x7f\x85\xa0 　", *"abcXYZ019.,!-_'\"<|>/w", *"äÖßÿÀ×÷µªº«ŸſıİΣσς", *"ȩ́가中文😀﻿", "'s", "'LL", "<|endoftext|>", "</w>", "word", "Word", "naïve", "  "]


def ids_of(encoder: tokens.Encoder, texts: pa.Array) -> list[list[int]]:
    coded, stops = encoder.texts(texts, np.array([1], encoder.dtype).tobytes())
    raw = bytes(coded)
    assert len(raw) == stops[-1]
    return [np.frombuffer(raw[s:e], encoder.dtype).tolist() for s, e in zip([0, *stops[:-1]], stops, strict=True)]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("cache", [None, 3_000])
def test_any_text_has_the_ids_of_the_library(kind, cache, monkeypatch):
    if cache:
        monkeypatch.setattr(tokens, "CACHE_BYTES", cache)
    draw = random.Random(5)
    texts = ["".join(draw.choices(CHARS, k=draw.randint(0, 30))) for _ in range(1_500)]
    made = tokens.Encoder(registry.tokenizer_path(), "<u4")
    right = [made.whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    all_texts = pa.array(texts, kind)
    assert [x for i in range(0, len(texts), 100) for x in ids_of(made, all_texts[i : i + 100])] == right
    made.known = False
    assert ids_of(made, all_texts) == right


def test_texts_without_words():
    made = tokens.Encoder(registry.tokenizer_path(), "<u2")
    for texts in ([None], [""], [" \n"], [None, "", " "]):
        assert ids_of(made, pa.array(texts, pa.string())) == [[1]] * len(texts)
        assert made.texts(pa.array(texts, pa.string()))[1].tolist() == [0] * len(texts)


def test_a_piece_goes_to_the_model_once_for_all_tasks_of_a_worker(monkeypatch):
    path, given, learn = registry.tokenizer_path(), [], tokens.Encoder.learn
    monkeypatch.setattr(tokens.Encoder, "learn", lambda self, new: (given.extend(new), learn(self, new))[1])
    tokens.encoder_of.cache_clear()
    tokens.encoder(path, "<u2").texts(pa.array(["Word word, WORD. word", "word.word it's"]))
    assert sorted(given) == [",", ".", "it's", "word"]
    tokens.encoder(path, "<u2").texts(pa.array(["it's a word,word"]))
    assert sorted(given) == [",", ".", "a", "it's", "word"]


def test_two_tasks_of_a_worker_load_the_tokenizer_once(spark, tmp_path, monkeypatch):
    made, init, rows = [], tokens.Encoder.__init__, []
    monkeypatch.setattr(tokens.Encoder, "__init__", lambda self, *a: (made.append(a), init(self, *a))[1])

    class Done(list):
        collect = lambda self: self

    def tasks(df, run, schema):
        for n in range(2):
            batch = pa.record_batch({"doc_id": pa.array([n]), "text": pa.array(["some words"]), "shard": pa.array([n], pa.int32())})
            rows.extend(r for b in run(iter([batch])) for r in b.to_pylist())
        return Done()

    monkeypatch.setattr(tokens, "mapped", tasks)
    tokens.write_shards(spark.createDataFrame([(0, "")], "doc_id long, text string"), f"file://{tmp_path}/set", registry.tokenizer_path(), 2, 16)
    assert [(r["shard"], r["docs"]) for r in rows] == [(0, 1), (1, 1)]
    assert len(made) <= 1


def test_another_tokenizer_file_at_the_same_path_is_loaded(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    file = tmp_path / "t.json"
    for n in (2, 3):
        made = Tokenizer(models.WordLevel({"?": 0, "a": n}, "?"))
        made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        made.save(str(tmp_path / f"{n}.json"))
        (tmp_path / f"{n}.json").rename(file)
        assert ids_of(tokens.encoder(str(file), "<u2"), pa.array(["a a"])) == [[n, n, 1]]


def test_runs_of_texts(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 10)
    texts = pa.array(["aaaa", None, "bbbbbb", "c" * 50, "", "d"])
    assert [p.to_pylist() for p in tokens.parts_of(texts)] == [["aaaa", None, "bbbbbb"], ["c" * 50], ["", "d"]]
    some = [pa.record_batch({"x": [t]}) for t in ("a", "b" * 20, "c")]
    assert [b.column(0).to_pylist() for b in tokens.gathered(iter(some))] == [["a", "b" * 20], ["c"]]


def test_what_is_kept_is_bounded_by_bytes_of_ids_too(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    made = tokens.Encoder(registry.tokenizer_path(), "<u4")
    for i in range(40):  # words without white space, of which each has more bytes of ids than characters
        made.texts(pa.array([chr(0x4E00 + i) * 300]))
    assert sum(len(p) + len(v) for p, v in (made.kept | made.older).items()) < 2 * 20_000 + 300 * 13
