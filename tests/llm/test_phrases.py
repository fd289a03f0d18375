import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import awkward, clashing, documents
from pixloom.llm import phrases as module
from pixloom.llm.phrases import SQL, Prefixes, mine_phrases, op11_phrase_mining
from pixloom.llm.text import Lookup, U

FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least=30, top=2000):
    """rows: (lang, text)"""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        covered = set()
        for g, n in cand.items():
            for m in range(2, len(g)):
                covered |= {g[i : i + m] for i in range(len(g) - m + 1) if 100 * n >= 80 * f[g[i : i + m]]}
        best = []
        for g, a in cand.items():
            if g not in covered:
                score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def got(df):
    assert tuple(df.columns) == FIELDS
    return sorted(tuple(r) for r in df.collect())


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["The", "the", "of", "É", "a", "b", "c\x00", "new", "york", "city", "日本", "x" * 40]
    out = []
    for _ in range(n):
        line = []
        while len(line) < 60:
            line += rng.choice((["New", "York", "city"], ["of", "the"], [rng.choice(words)], ["a", "a", "a"]))
        out.append("".join(w + rng.choice((" ", " ", " ", "\t", "  ", ". ", "\n", ",")) for w in line))
    return out


def with_langs(docs):
    lang = F.element_at(F.array(F.lit("en"), F.lit(None), F.lit("und"), F.lit("de")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return docs.withColumn("lang", lang)


@pytest.mark.parametrize(("least", "top", "group"), [(30, 2000, None), (5, 40, 50), (2, 7, 8)])
def test_against_brute_force(spark, monkeypatch, least, top, group):
    monkeypatch.setattr(module, "CHUNK", 700)  # long texts are cut
    rows = texts(least) + awkward() + ["tail " * 3000]
    docs = clashing(with_langs(documents(spark, rows)), "words", "word", "w1", "f", "id")
    want = brute([(r.lang, r.text) for r in docs.select("lang", "text").collect()], least, top)
    assert got(mine_phrases(docs, least=least, top=top, group=group, cells=1 << 16)) == want and len(want) > 20


def test_equal_hashes_take_another_seed(spark, monkeypatch):
    weak = module.Corpus.__init__

    def init(self, data, offsets, languages, seed):
        weak(self, data, offsets, languages, seed)
        if seed == 0:
            self.ids = self.ids & U(7) | U(8)

    monkeypatch.setattr(module.Corpus, "__init__", init)
    docs = documents(spark, texts(9, 12))
    assert got(mine_phrases(docs, least=4)) == brute([("en", t) for t in texts(9, 12)], 4)


def test_heavy_prefixes_deal_by_more_words():
    a, b, c, d = (np.full(400, i, U) for i in (11, 12, 13, 14))
    rng = np.random.default_rng(1)
    last = rng.integers(100, 200, 400).astype(U)
    prefixes = Prefixes(64)
    assert len(set(prefixes.group([a, b, c, last]).tolist())) == 1
    hashes = prefixes.hashes([a, b, c, last])
    prefixes.heavy = [Lookup(hashes[0][:1]), Lookup(hashes[1][:1]), Lookup(hashes[2][:1])]
    assert len(set(prefixes.group([a, b, c, last]).tolist())) > 30
    assert len(set(prefixes.group([a, b, d, last]).tolist())) == 1
    short = prefixes.group([a, b, np.zeros(400, U), np.zeros(400, U)])
    assert len(set(short.tolist())) == 1


def test_every_heavy_prefix_is_found(spark, monkeypatch):
    monkeypatch.setattr(module, "SEGMENT", 300)
    rng = random.Random(4)
    lines = [" ".join(rng.choice("aaaabcd") for _ in range(40)) for _ in range(60)]
    docs = documents(spark, lines, partitions=5).select("lang", "text")
    words = module.vocabulary(docs, 0)
    ids = {r.word: np.array([r.id], np.int64).view(U) for r in words.collect()}
    for group in (60, 200, 600):
        prefixes = module.heavy_prefixes(docs, words, module.Pairs(8), 2400, group, 0)
        for size in range(1, 4):
            counts = Counter(tuple(w[i : i + size]) for w in map(str.split, lines) for i in range(len(w) - size + 1))
            for g, n in counts.items():
                heavy = bool(prefixes.is_heavy(size - 1, prefixes.hashes([ids[x] for x in g])[-1])[0])
                assert heavy or n <= group
                assert not heavy or n > group // 2


def test_empty_table_and_repeated_rows(spark):
    docs = documents(spark, ["q r s\nq r"] * 20, ids=[1] * 20)
    assert got(mine_phrases(docs)) == brute([("en", "q r s\nq r")] * 20)
    assert mine_phrases(docs.limit(0)).count() == 0
    assert mine_phrases(documents(spark, [None, "", " .\n"])).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(SQL).fetchall())
    assert got(op11_phrase_mining(spark, sf)) == want and len(want) > 100
