import random
import re

import numpy as np
import pytest

from cases import awkward, by_id, clashing, documents, prose
from pixloom.llm import jaccard
from pixloom.llm.connect import components
from pixloom.llm.frame import saved
from pixloom.llm.jaccard import bands, differing, jaccard_components, keep_one, op7_jaccard_join, parity, shingle_sets, signatures
from pixloom.llm.text import joined

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4, percent=85):
    """rows: (doc_id, text) -> doc_id: (size, component)."""
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for d, s in sets.items():
        for e in s:
            by.setdefault(e, []).append(d)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in text.split())


def more():
    texts = awkward()
    for n, seed in ((8, 1), (14, 2), (25, 3), (60, 4), (200, 5), (900, 6)):
        base = prose(n, 1000 + seed)
        texts += [base] + [edited(base, share, 10 * seed + k) for k, share in enumerate((0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05) * 2)]
        texts += [" ".join(base.split()[: int(n * c)]) for c in (0.95, 0.9, 0.86, 0.84)]
    chain = prose(300, 5000).split()
    texts += [" ".join(chain[i * 12 : i * 12 + 150]) for i in range(8)]
    return texts


def test_against_brute_force(spark):
    texts = more()
    random.Random(1).shuffle(texts)
    docs = clashing(documents(spark, texts, partitions=5), "N_shingles", "component_id", "key", "n", "doc", "bits")
    want = brute(list(enumerate(texts)))
    got = by_id(jaccard_components(docs))
    assert len(got) == len(texts)
    for i, r in got.items():
        assert (r.n_shingles, r.component_id) == want[i]
    assert sum(c != i for i, (_, c) in want.items()) > 30
    kept = {r.doc_id for r in keep_one(docs).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 9, 12, 13, 20, 33, 47, 80, 150, 400])
def test_no_similar_pair_is_missed_by_the_index(n):
    rng = np.random.default_rng(n)
    for _ in range(300 if n < 100 else 40):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        keep = int(rng.integers(-(-n * 85 // 100), n + 1))
        new = int(rng.integers(0, max(1, n // 5)))
        b = np.concatenate([a[:keep], rng.integers(0, 1 << 62, new).astype(np.uint64)])
        if len(b) and 100 * keep >= 85 * (n + new):
            keys, owner = signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
        differ = n - keep + new
        assert differing(parity(a, n), parity(b, len(b))) <= differ


def test_bands_are_sound():
    for low, high, segments, slack in bands(85, 5000):
        most = max(15 * (r + s) // 185 for r in (low, high) for s in (r, r * 100 // 85))
        assert segments - slack == most + 1


def test_sets():
    texts = ["a b c d e", "A b", None, "", "x " * 40]
    values, sizes = shingle_sets(*joined(__import__("pyarrow").array(texts)))
    assert sizes.tolist() == [2, 1, 0, 0, 1] and len(values) == 4


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(45)] + [(7, 7), (3, 2), (3, 2)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if x != 7 and (root(x) != x or any(root(y) == x for y in parent if y != x))}


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = prose(60, 1)
    docs = documents(spark, [text, text, text, "x " + text, None], ids=[4, 4, None, 9, 2])
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(docs).collect()), key=str)
    assert got == [(2, 2), (4, 4), (4, 4), (9, 4), (None, None)]
    assert jaccard_components(docs.limit(0)).count() == 0
    assert keep_one(docs).count() == 4


@pytest.mark.parametrize("third", [20, 5, 1])
def test_equal_sets_in_descending_order_beside_a_similar_one(spark, third):
    text, other = prose(60, 1), prose(60, 2)
    rows = [(7, text), (3, text), (third, "x " + text), (40, other), (30, other), (31, other + " x"), (30, text + " y z")]
    docs = spark.createDataFrame(rows[:-1], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == {d: c for d, (_, c) in brute(rows[:-1]).items()}
    assert {r.doc_id for r in keep_one(docs).collect()} == {min(3, third), 30}
    # a repeated id joins both groups
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in jaccard_components(docs).collect()} == {min(3, third)}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    got = by_id(op7_jaccard_join(spark, sf))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want


def test_segments_of_the_same_sets_become_one(spark, monkeypatch):
    """Texts that share most segments and do not link are compared once, not once a segment."""
    words = prose(600, 21, vocabulary=100_000).split()
    texts = [" ".join([*words[:500], *(f"other{i}x{k}" for k in range(100))]) for i in range(2)]
    written = {}

    def counted(df, name):
        out = saved(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "saved", counted)
    rows = jaccard.jaccard_components(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(0, 0), (1, 1)]
    assert 0 < written["index"] <= 2 and written["members"] <= 2
