import random

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import awkward, by_id, clashing, documents
from pixloom.llm.pieces import BLANK, MODEL, Model, decode, encode, op9_sentencepiece
from pixloom.llm.text import joined

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return Model()


def ids_of(model, texts):
    flat, counts = model.ready().encode(*joined(pa.array(texts, pa.string())))
    out, at = [], 0
    for n in counts.tolist():
        out.append(flat[at : at + n].tolist())
        at += n
    return out


@given(st.lists(st.text(alphabet="abcdeinorstuTh E.,\n\t!éß日\U0001f600\x00  ", max_size=40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_as_the_library(model, texts):
    assert ids_of(model, texts) == LIBRARY.encode(texts)


def test_runs_of_blanks_and_long_words(model):
    rng = random.Random(1)
    texts = [" " * k + w for k in range(70) for w in ("", "word", "日", "\n")]
    texts += ["".join(rng.choice("aeinorst") for _ in range(n)) for n in (1, 50, 700)] + ["x" * 3000, "ab" * 900, "=" * 500]
    assert ids_of(model, texts) == LIBRARY.encode(texts)


def test_forgetting_changes_nothing(model, monkeypatch):
    from pixloom.llm import pieces

    monkeypatch.setattr(pieces, "MOST_KNOWN", 40)
    texts = [t for t in awkward() if t]
    for _ in range(2):
        for k in range(0, len(texts), 3):
            assert ids_of(model, texts[k : k + 3]) == LIBRARY.encode(texts[k : k + 3])


def test_round_trip(spark, model):
    texts = awkward() + [f"a{BLANK}b", "  two  blanks ", "\n"]
    docs = clashing(documents(spark, texts), "IDS", "decoded")
    rows = by_id(decode(encode(docs, model), model))
    for i, text in enumerate(texts):
        if text is None:
            assert rows[i].ids is None and rows[i].decoded is None
        else:
            assert rows[i].ids == LIBRARY.encode(text) and rows[i].decoded == text.replace(BLANK, " ")
    assert decode(encode(docs.limit(0), model), model).count() == 0
    odd = spark.createDataFrame([(1, [3 + 0xC3]), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode(odd, model).collect()} == {1: "�", 2: ""}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = by_id(op9_sentencepiece(spark, sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for d, ids in zip(docs, LIBRARY.encode([d.text for d in docs]), strict=True):
        assert rows[d.doc_id].n_pieces == len(ids) and rows[d.doc_id].same
