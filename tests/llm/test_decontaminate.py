import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from cases import awkward, by_id, clashing, documents, prose
from pixloom.llm.decontaminate import FmIndex, find_benchmark, op6_decontaminate, remove_spans, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=10):
    phrases = {}
    for item, text in items:
        w = words_of(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if w else 0):
            phrases.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for text in texts:
        w, hit, found = words_of(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (p := tuple(w[i : i + size])) in phrases:
                    hit |= set(range(i, i + size))
                    found |= phrases[p]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def cases():
    items = [(i, prose(40, 100 + i)) for i in range(12)]
    items += [(20, "Tiny Item"), (21, None), (22, ""), (23, "É"), (24, items[0][1]), (0, items[0][1]), (25, items[3][1][:60])]
    texts = awkward() + [
        prose(30, 50) + " " + items[2][1] + " " + prose(30, 51), items[4][1].upper(), "so tiny, item!", items[5][1] * 30,
        " ".join(items[6][1].split()[5:17]), " ".join(items[7][1].split()[5:13]),
    ]
    return texts, items


def check(df, texts, items, ids):
    got = by_id(df)
    want = brute(texts, items)
    for i, text in zip(ids, texts, strict=True):
        r = got[i]
        hit = sum(e - s for s, e in r.hit_spans)
        assert (r.n_words, hit, sorted(set(r.hit_items))) == want[i], text
        assert len(set(r.hit_items)) == len(r.hit_items)


def test_against_brute_force_in_one_and_many_blocks(spark):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts)
    for options in ({}, {"block_words": 60}, {"shard_words": 50}):
        check(find_benchmark(docs, bench, **options), texts, items, range(len(texts)))


def test_clashes_empty_tables_and_removal(spark):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = clashing(documents(spark, texts), "N_words", "hit_items", "item")
    found = find_benchmark(docs, bench)
    check(found.select("doc_id", "n_words", "hit_spans", "hit_items"), texts, items, range(len(texts)))
    assert find_benchmark(docs.limit(0), bench).count() == 0
    none = find_benchmark(docs, bench.limit(0))
    assert none.where(F.size("hit_items") + F.size("hit_spans") > 0).count() == 0
    cut = by_id(remove_spans(found))
    assert cut[0].text is None and cut[1].text == ""
    left = brute([cut[24].text], items)[0]
    assert left[1] == 0 and left[0] == by_id(found)[24].n_words - len(words_of(items[2][1]))


def test_index_against_plain_search():
    rng = np.random.default_rng(3)
    for n, alphabet in ((1, 3), (50, 3), (400, 5), (300, 40)):
        seq = rng.integers(1, alphabet, n)
        full = np.append(seq, 0)
        order = suffix_order(full)
        assert [tuple(full[i:]) for i in order] == sorted(tuple(full[i:]) for i in range(n + 1))
        index = FmIndex(seq, alphabet, 4)
        for size in (1, 2, 5):
            phrases = rng.integers(1, alphabet, (30, size))
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                want = [i for i in range(n - size + 1) if (seq[i : i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = by_id(op6_decontaminate(spark, sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute([d.text for d in docs], items)
    for d, (n, hit, found) in zip(docs, want, strict=True):
        sha = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert tuple(rows[d.doc_id]) == (d.doc_id, n, hit, len(found), sha, hit > 0)
    assert random.Random(0).random() and any(w[1] for w in want)
