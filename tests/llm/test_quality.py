import zlib

import numpy as np
import pytest

from cases import awkward, by_id, clashing, documents, prose
from pixloom.llm import quality
from pixloom.llm.quality import features, op1_quality_classifier, quality_score, train_shard


def dense(rows, epochs):
    """The same updates coordinate by coordinate."""
    z, n, w = {}, {}, {}
    for _ in range(epochs):
        for slots, y in rows:
            x = {int(s): quality.GAIN * np.sum(slots == s) / len(slots) for s in set(slots.tolist())} | {quality.SLOTS: 1.0}
            for k in x:
                zk = z.get(k, 0.0)
                w[k] = 0.0 if abs(zk) <= quality.L1 else -(zk - np.sign(zk) * quality.L1) / ((quality.BETA + n.get(k, 0.0) ** 0.5) / quality.ALPHA + quality.L2)
            p = 1 / (1 + np.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                s = ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / quality.ALPHA
                z[k] = z.get(k, 0.0) + g - s * w[k]
                n[k] = n.get(k, 0.0) + g * g
    out = {}
    for k, zk in z.items():
        out[k] = 0.0 if abs(zk) <= quality.L1 else -(zk - np.sign(zk) * quality.L1) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + quality.L2)
    return out


def test_updates():
    rng = np.random.default_rng(0)
    rows = [(rng.integers(0, 40, 12), float(rng.random() < 0.5)) for _ in range(20)]
    got, want = train_shard(rows, 2), dense(rows, 2)
    assert np.flatnonzero(got).tolist() == sorted(k for k, v in want.items() if v)
    assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_features_do_not_cross_texts():
    one = np.frombuffer(b"ab cd", np.uint8)
    both = np.frombuffer(b"ab cdab cd", np.uint8)
    slots, bounds = features(one, np.array([0, 5]))
    twice, at = features(both, np.array([0, 5, 5, 10]))
    assert at.tolist() == [0, 4, 4, 8] and bounds.tolist() == [0, 4]
    assert twice[:4].tolist() == slots.tolist() == twice[4:].tolist()


def test_separates_and_survives(spark):
    clean = [prose(40 + i, i) for i in range(60)]
    junk = [" ".join(w + "!!" for w in prose(40 + i, 200 + i).split()) for i in range(60)]
    texts = clean + junk + awkward()
    docs = clashing(documents(spark, texts), "Score", "predicted", "label", "shard", "order_key")
    labels = spark.createDataFrame(
        [(i, int(i < 60)) for i in range(120)] + [(3, None), (None, 1), (5, 1), (10**9, 0)], "doc_id long, quality int"
    )
    got = by_id(quality_score(docs, labels))
    assert all(got[i].predicted == int(i < 60) for i in range(120) if got[i].held_out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert got[120].score == got[121].score
    same = by_id(quality_score(docs.repartition(7), labels.repartition(2)))
    assert {i: r.score for i, r in same.items()} == {i: r.score for i, r in got.items()}
    assert quality_score(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_score(docs, labels.limit(0)).collect()} == {0.5}


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    clean = [r for r in rows if r.quality == 1]
    assert np.mean([r.predicted for r in clean]) > 0.99
