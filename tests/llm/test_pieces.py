import random

import pytest

from lodestar.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def enc():
    return pieces.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_against_the_library(enc, library):
    random.seed(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "é", "梦", "😀", "\t", "▁", "er", "in", "   ", "1", "xxx", "\x00", "un", "able", "tion", "　"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(2000)]
    texts += [" " * k for k in range(60)] + ["a" * k for k in range(40)] + ["ab" * 400, "😀" * 50]
    got = enc.encode(texts)
    assert [g.tolist() for g in got] == library.encode(texts)
    assert all(enc.decode(g.tolist()) == t.replace("▁", " ") for g, t in zip(got, texts))
    assert [enc.decode(g.tolist()) for g in got] == [library.decode(g.tolist()) for g in got]


def test_without_memory_and_in_small_blocks(enc, library, monkeypatch):
    texts = ["some words to index in small blocks", "and more of them", None, "", "some words"] * 3
    want = [None if t is None else library.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "INDEX", 8)
    monkeypatch.setattr(pieces, "MEMO", 0)
    monkeypatch.setattr(pieces, "TEXTS", 20)
    assert [None if g is None else g.tolist() for g in enc.encode(texts)] == want


def test_order_of_merges_falls_back(enc, library, monkeypatch):
    monkeypatch.setattr(enc, "ordered", False)
    enc.forget()
    enc.slots = None
    text = "The quick brown fox jumps over the lazy dog, again and again."
    assert enc.encode([text])[0].tolist() == library.encode(text)
    enc.slots = None


def test_documents(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pieces.encode(docs)
    for r in got.collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids) and r.round_trip
    assert {r.doc_id: r.text for r in pieces.decode(got).collect()} == texts


def test_edges(spark, edge, none):
    got = pieces.encode(edge).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r for r in got}
    assert by[2].ids is None and by[2].n_pieces is None and by[1].ids == [] and by[1].round_trip
    assert all(r.round_trip for r in got if r.ids is not None)
    assert pieces.encode(none).count() == 0


def test_round_trip_compares_the_text_itself(enc):
    texts = ["a b", "a▁b", "▁", "▁a", " a", "a  b▁", "", "梦 😀", None]
    got = list(enc.encode_checked(texts))
    assert [same for _, same in got] == [None if t is None else enc.decode(ids.tolist()) == t for t, (ids, _) in zip(texts, got)]
    assert not got[1][1] and got[0][1]
