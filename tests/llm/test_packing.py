import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cases import awkward, clashing, documents, prose
from pixloom.llm import tokens
from pixloom.llm.packing import LINEAR, WIDTH, assign, op12_balanced_packing, pack_documents, rooms, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = tokens.Encoder(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def same_ids(texts):
    ids, offsets = ENCODER.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library(text), repr(text)


def test_ids_are_the_library_s(spark):
    same_ids(awkward())
    same_ids(["it's we'll 'tis ''s 's9 90's they'RE 'd'd 'llama x'", "'", "s", "'re", " 's", "a  b", "a \n b", "a\n\nb\n", "\t\tx", "  ", "  x", "\x1c y\x85z"])
    same_ids(["<|endoftext|> and <|endoftext|>", "plain", None])
    same_ids([r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])
    same_ids([])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("'sdrevmlt aA1!.\n\t é中²́\U0001f600 ")), max_size=6))
def test_ids_of_odd_texts(texts):
    same_ids(texts)


def test_long_text_is_cut_between_words_and_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 500)
    monkeypatch.setattr(tokens, "CACHED", 300)
    same_ids([prose(3000, 1, vocabulary=3000), "x" * 4000 + " y", " ".join("'s  é9 \n b" for _ in range(700))])


def cost(lengths):
    return sum(n * (LINEAR + n) for n in lengths)


def test_assignment_fills_every_place_and_balances():
    rng = np.random.default_rng(4)
    for lengths in ([1], [2048], [2049], [1] * 5000, [5000, 1, 3], rng.integers(1, 3000, 900), rng.integers(1, 90, 400)):
        lengths = np.asarray(lengths)
        rows = assign(lengths)
        seen = [np.zeros(n, int) for n in lengths]
        by = defaultdict(list)
        for doc, start, n, sequence, offset in rows.tolist():
            seen[doc][start : start + n] += 1
            by[sequence].append((offset, n))
        assert all((s == 1).all() for s in seen)
        total = []
        for parts in by.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()
            total.append(sum(n for _, n in parts))
        assert sorted(total, reverse=True) == sorted([WIDTH] * int((lengths // WIDTH).sum()) + rooms(int((lengths % WIDTH).sum()), WIDTH).tolist(), reverse=True)
        assert all(n & (n - 1) == 0 for n in total)
    many = rng.integers(1, 400, 3000)
    rows = assign(many)
    by = defaultdict(list)
    for _, _, n, sequence, _ in rows.tolist():
        by[sequence].append(n)
    costs = [cost(x) for x in by.values() if sum(x) == WIDTH]
    assert max(costs) < 1.06 * min(costs)
    assert len(rows) < 1.1 * len(many)


def brute_assign(lengths):
    """The rule word by word: descending, to the lowest cost with room, else cut."""
    size = rooms(sum(lengths), WIDTH).tolist()
    have = [[] for _ in size]
    out = {}
    for n, doc in sorted((-n, d) for d, n in enumerate(lengths)):
        n, start = -n, 0
        while n:
            free = [s - sum(h) for s, h in zip(size, have, strict=True)]
            fit = [i for i, f in enumerate(free) if f >= n] or [i for i, f in enumerate(free) if f]
            to = min(fit, key=lambda i: (cost(have[i]), i))
            part = min(n, free[to])
            out[doc, start] = (part, to, sum(have[to]))
            have[to].append(part)
            n, start = n - part, start + part
    return out


def test_assignment_against_brute_force():
    rng = np.random.default_rng(5)
    for most in (30, 700, 2047):
        lengths = rng.integers(1, most, 60)
        assert {(d, s): (n, q, o) for d, s, n, q, o in assign(lengths).tolist()} == brute_assign(lengths.tolist())


def verify(rows, texts):
    """texts: (doc_id, text) of every row."""
    by, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= WIDTH and at & (at - 1) == 0
    want = defaultdict(list)
    for d, t in texts:
        want[d].append([*library(t), 1])
    assert set(want) == set(pieces)
    for d, docs in want.items():
        assert sum(r.length for r in pieces[d]) == sum(map(len, docs))
        if len(docs) == 1:
            for r in pieces[d]:
                ids = docs[0][r.start : r.start + r.length]
                assert r.doc_tokens == len(docs[0]) and len(ids) == r.length
                if "ids_crc32" in r:
                    assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
                if "ids" in r:
                    assert r.ids == ids
            assert sorted(x for r in pieces[d] for x in range(r.start, r.start + r.length)) == list(range(len(docs[0])))


def test_awkward_documents(spark):
    texts = awkward()
    ids = [*range(len(texts) - 3), 3, 3, None]
    docs = clashing(documents(spark, texts, ids=ids), "start", "ids", "offset", "sequence_id")
    rows = pack_documents(docs, block=4096, outputs=("ids", "ids_crc32")).collect()
    verify(rows, list(zip(ids, texts, strict=True)))
    assert pack_documents(docs.limit(0)).count() == 0
    packed = sequences(pack_documents(docs, block=4096)).collect()
    assert sum(len(r.ids) for r in packed) == sum(r.length for r in rows) and all(sum(r.lengths) == len(r.ids) for r in packed)
    with pytest.raises(ValueError):
        pack_documents(docs, width=1000)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    verify(op12_balanced_packing(spark, sf).collect(), docs)
