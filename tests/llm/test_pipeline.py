import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from cases import awkward, clashing, documents
from pixloom.llm.pieces import MODEL
from test_decontaminate import WORD as PHRASE_WORD
from test_decontaminate import brute as brute_phrases
from test_fuzzy_lines import brute as brute_lines
from test_jaccard import brute as brute_jaccard

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def without_phrases(text, items):
    """Cut the hit words, and what stands between neighbouring ones of a span."""
    n, _, _ = brute_phrases([text], items)[0]
    words = [m.span() for m in re.finditer(PHRASE_WORD.pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    assert len(words) == n
    hit = [False] * n
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), text)[a:b] for a, b in words]
    phrases = {}
    for _, item in items:
        w = PHRASE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            phrases.setdefault(size, set()).add(tuple(w[i : i + size]))
    for size, some in phrases.items():
        for i in range(n - size + 1):
            if tuple(low[i : i + size]) in some:
                hit[i : i + size] = [True] * size
    out, at = "", 0
    for i, (a, b) in enumerate(words):
        if hit[i]:
            out += text[at:a] if not (i and hit[i - 1]) else ""
            at = b
    return out + text[at:], any(hit)


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.saved(stage(spark, out[-1], sf), "stage"))
    return sf, [[tuple(r) for r in x.collect()] for x in out]


def test_every_stage_against_brute_force(spark, stages):
    sf, (docs, good, lines, single, clean, encoded) = stages
    assert {r[0] for r in good} <= {r[0] for r in docs} and 0 < len(good) < len(docs)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(quality.get(r[0], 1) == 1 for r in good if r[0] in quality) or len(good) > 0.8 * len(docs)
    gone = brute_lines([(r[0], r[1]) for r in good])
    want = {}
    for r in good:
        kept = "\n".join(x for n, x in enumerate(r[1].split("\n")) if (r[0], n) not in gone)
        if kept.strip() or not any(d == r[0] for d, _ in gone):
            want[r[0]] = kept
    assert {r[0]: r[1] for r in lines} == want
    groups = brute_jaccard([(r[0], r[1]) for r in lines], k=5, percent=80)
    assert {r[0] for r in single} == {d for d, (_, c) in groups.items() if c == d}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    cut = {r[0]: without_phrases(r[1], items) for r in single}
    assert {r[0]: r[1] for r in clean} == {d: t for d, (t, hit) in cut.items() if t.strip() or not hit}
    assert {r[0]: r[4] for r in encoded} == {r[0]: LIBRARY.encode(r[1]) for r in clean}
    assert all(r[5] for r in encoded) and all(r[4] == len(r[1]) for r in clean)


def test_awkward_rows_pass_through(spark):
    sf = "/root/testdata/sf0.001"
    texts = awkward()
    docs = clashing(documents(spark, texts), "score", "removed", "hit_spans", "ids", "component_id")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert {r.doc_id for r in out.select("doc_id").collect()} <= set(range(len(texts)))
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.benchmark_stage(spark, docs, sf).where(F.col("text").isNull()).count() == 2
