import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import awkward, by_id, clashing, documents, prose
from pixloom.llm import runs
from pixloom.llm.suffix_dedup import longest_previous_factor, op2_suffix_dedup, remove_repeats


def brute(rows, window=100):
    """rows: (doc_id, bytes), one for each id."""
    seen, out = {}, {}
    for doc, data in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - window + 1):
            if seen.setdefault(data[i : i + window], (doc, i)) != (doc, i):
                gone[i : i + window] = True
        spans = np.sum(np.diff(gone.astype(int), prepend=0) == 1)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[doc] = (len(data), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest())
    return out


def check(df, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    want = brute([(i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)])
    for r in df.collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def more():
    texts = awkward()
    line = "This one line of boiler plate stands in very many of the texts at hand. "
    shared = prose(25, 77)
    texts += [prose(20, 300 + i) + line + prose(20, 400 + i) for i in range(40)]
    texts += [prose(12, 500 + i) + shared + prose(12, 600 + i) for i in range(20)]
    texts += [prose(60, 700)] * 9 + [prose(60, 701) + str(i) for i in range(9)] + ["ab" * 400, "abc" * 300, "x" * 150]
    return texts


@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([1, 2, 3, 5, 8, 12]))
@settings(max_examples=150, deadline=None)
def test_longest_previous_factor(seq, cap):
    got = longest_previous_factor(np.array(seq, np.int64), cap)
    for i in range(len(seq)):
        best = 0
        for j in range(i):
            k = 0
            while i + k < len(seq) and seq[i + k] == seq[j + k] and k < cap:
                k += 1
            best = max(best, k)
        assert got[i] == best


@pytest.mark.parametrize("seen", [64, 2])
def test_against_brute_force(spark, monkeypatch, seen):
    monkeypatch.setattr(runs, "HEAVY_SEEN", seen)  # 2: most anchors are split
    monkeypatch.setattr(runs, "SAMPLE", 1)
    texts = more()
    docs = clashing(documents(spark, texts, partitions=6), "N_bytes", "kept_sha256", "key", "doc", "lo")
    check(remove_repeats(docs, digest=True), texts)


def test_small_windows_and_real_output(spark):
    texts = ["abcabcabc", "zabcaz", None, "", "abcabcabc"]
    rows = by_id(remove_repeats(documents(spark, texts), window=4, gram=2))
    want = brute([(i, (t or "").encode()) for i, t in enumerate(texts)], 4)
    for i, r in rows.items():
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) == want[i]
        flat = np.array(r.removed).reshape(-1, 2)
        assert (flat[:, 1] - flat[:, 0]).sum() == r.n_removed


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = prose(60, 1)
    docs = documents(spark, [text, text, text, "x" + text], ids=[4, 4, None, 9])
    got = {(r.doc_id, r.n_removed > 0) for r in remove_repeats(docs, digest=True).collect()}
    assert got == {(4, True), (None, False), (9, True)}
    alone = remove_repeats(documents(spark, [text, text], ids=[4, 4]), digest=True).collect()
    assert [r.n_removed for r in alone] == [0, 0]
    assert remove_repeats(docs.limit(0), digest=True).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check(op2_suffix_dedup(spark, sf), [d.text for d in docs], [d.doc_id for d in docs])
