"""What the language network learns from: every language, and pieces of the whole sampled text."""

from tessera.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def trained_on(monkeypatch, docs, **bounds):
    seen = []
    monkeypatch.setattr(langid.Network, "train", lambda self, runs, y: seen.append((self.langs, runs, y)))
    langid.learn(docs, **bounds)
    return seen[0]


def test_every_language_is_learned(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 130}", f"l{i % 130:03d}") for i in range(1300)], SCHEMA)
    langs, _, y = trained_on(monkeypatch, docs)
    assert langs == [f"l{i:03d}" for i in range(130)] and set(y) == set(range(130))


def test_pieces_come_from_the_whole_text_within_named_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x " * 350 + "y " * 350, "en") for i in range(40)], SCHEMA)
    _, runs, _ = trained_on(monkeypatch, docs)
    assert 0.4 < sum(b"y" in x for x in runs) / len(runs) < 0.6
    _, runs, _ = trained_on(monkeypatch, docs, doc_pieces=10, pieces=25)
    assert len(runs) == 25
