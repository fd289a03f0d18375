import hashlib
import re

import numpy as np
import pytest

from cases import awkward, by_id, clashing, documents, prose
from pixloom.llm import runs
from pixloom.llm.window_dedup import count_windows, op5_window_dedup, remove_windows
from pixloom.llm.text import BLANK_SPLIT, Words, joined
from pixloom.llm.window_dedup import anchors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = WORD.findall(text or "")
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[i : i + window]), (doc, i)) != (doc, i):
                gone[i : i + window] = True
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check(df, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    want = brute(list(zip(ids, texts, strict=True)))
    for r in df.collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id


def more():
    texts = awkward()
    line = " ".join(f"common{i}" for i in range(9))
    shared = prose(30, 77).replace("\n", " ")
    texts += [f"{prose(25, 300 + i)} {line} {prose(25, 400 + i)}" for i in range(40)]
    texts += [f"{prose(12, 500 + i)}\n{shared}\t{prose(12, 600 + i)}" for i in range(20)]
    return texts + [prose(90, 700)] * 9 + [prose(90, 701) + str(i) for i in range(9)] + ["a b c " * 30, "x " * 60]


@pytest.mark.parametrize(("seen", "cells"), [(64, None), (2, 1 << 16), (64, 1 << 16)])
def test_against_brute_force(spark, monkeypatch, seen, cells):
    monkeypatch.setattr(runs, "HEAVY_SEEN", seen)
    monkeypatch.setattr(runs, "SAMPLE", 1)
    texts = more()
    docs = clashing(documents(spark, texts, partitions=6), "N_words", "kept_sha256", "key", "doc", "block")
    check(remove_windows(docs, digest=True, cells=cells), texts)


def test_sketch_never_underestimates(spark):
    texts = more()
    docs = documents(spark, texts).select("doc_id", "text")
    sketch = count_windows(docs, 1 << 16, 20, 6)
    data, offsets = joined(docs.toArrow()["text"])
    found, counts = np.unique(anchors(Words(data, offsets, BLANK_SPLIT), 20, 6), return_counts=True)
    assert sketch.repeated(found[counts > 1]).all()
    assert sketch.repeated(found[counts == 1]).mean() < 0.5


def test_real_output_repeats_and_empty_table(spark):
    texts = ["a b c d a b c d", "z a b c", None, "", " a\tb  c\nd "]
    rows = by_id(remove_windows(documents(spark, texts), window=3, gram=2))
    want = brute(list(enumerate(texts)), 3)
    for i, r in rows.items():
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == want[i]
        flat = np.array(r.removed).reshape(-1, 2)
        assert (flat[:, 1] - flat[:, 0]).sum() == r.n_removed
    text = prose(60, 1)
    docs = documents(spark, [text, text, text, "x " + text], ids=[4, 4, None, 9])
    got = {(r.doc_id, r.n_removed > 0) for r in remove_windows(docs, digest=True).collect()}
    assert got == {(4, True), (None, False), (9, True)}
    assert remove_windows(docs.limit(0), digest=True).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check(op5_window_dedup(spark, sf), [d.text for d in docs], [d.doc_id for d in docs])
