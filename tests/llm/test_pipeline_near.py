import corpus_pipeline
from cases import documents, prose
from test_jaccard import shingles


def test_a_copy_with_a_tenth_replaced_in_one_passage_goes(spark):
    words = prose(400, 11, vocabulary=100_000).split()
    copy = [*words[:200], *(f"other{i}" for i in range(39)), *words[239:]]
    a, b = (shingles(" ".join(w), 5) for w in (words, copy))
    assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
    docs = documents(spark, [" ".join(words), " ".join(copy), prose(400, 12)])
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {0, 2}
