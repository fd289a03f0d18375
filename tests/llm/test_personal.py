import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import awkward, by_id, clashing, documents, prose
from pixloom.llm.personal import KINDS, base_spans, expectation_maximisation, find_personal, luhn, op10_personal_data, train_spans

PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda m, d: True,
                "ip": lambda m, d: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda m, d: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda m, d: 10 <= len(d) <= 15,
            }[kind](m, d)
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@given(st.text(alphabet="0123459 -.+()@ab_%\né١", max_size=60))
@settings(max_examples=600, deadline=None)
def test_base_patterns(text):
    assert base_spans(text) == brute(text)


@given(st.text(alphabet="ab@.", max_size=30))
@settings(max_examples=400, deadline=None)
def test_emails(text):
    assert base_spans(text) == brute(text)


def test_long_runs_take_no_time():
    for text in ("a" * 300_000, "a@" * 100_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 200_000, "+1" * 100_000):
        base_spans(text)


PRIVATE = "mail a.b@c.example.org now, host 10.0.0.255 or 10.0.0.256, card 4111 1111 1111 1111 and 4111 1111 1111 1112, call +1 (017) 555-7713!"


def test_spans_and_classifier(spark):
    texts = awkward() + [PRIVATE, PRIVATE] + [f'{prose(5, i)} token = "{hashlib.sha1(bytes([i])).hexdigest()}" end' for i in range(20)]
    texts += [f"{prose(5, i)} Mr. Peter Smith {i}" for i in range(10)] + ["Licensed version 123456789012 here"] * 10 + ["é" * 10 + PRIVATE]
    got = by_id(find_personal(clashing(documents(spark, texts), "N_email", "spans", "kind", "n")))
    for i, text in enumerate(texts):
        base = brute(text)
        r = got[i]
        want = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_spans == ",".join(want)
        assert [r[f"n_{k}"] for k in KINDS[:4]] == [sum(b[1] == k for b in base) for k in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        places = [(int(s.split(":")[1]), KINDS.index(s.split(":")[0])) for s in spans]
        assert places == sorted(places)
    n = len(awkward())
    assert all("secret:" in got[n + 2 + i].spans for i in range(20))
    assert all("name:" in got[n + 22 + i].spans for i in range(10))
    assert not any(got[n + 32 + i].spans for i in range(10))
    assert find_personal(documents(spark, texts).limit(0)).count() == 0


def test_reliability_is_recovered():
    rng = np.random.default_rng(0)
    accuracy, counts = [0.9, 0.8, 0.7, 0.65, 0.6], {}
    for _ in range(20000):
        true = rng.random() < 0.6
        code = 0
        for a in accuracy:
            right = rng.random() < a
            code = code * 3 + (2 if right == true else 0)
        counts[4, code] = counts.get((4, code), 0) + 1
    reliable, share, _ = expectation_maximisation(counts)
    assert np.abs(reliable - accuracy).max() < 0.05 and abs(share[4] - 0.6) < 0.05
    assert train_spans([]).tolist() == [0.0] * len(train_spans([]))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = by_id(op10_personal_data(spark, sf))
    seen = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = brute(d.text)
        seen += len(base)
        text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert seen > 10
