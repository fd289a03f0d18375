import re
from collections import Counter

import numpy as np

from cases import awkward, by_id, clashing, documents, prose
from pixloom.llm import divergence
from pixloom.llm.divergence import COMMON, distance, judge, op3_divergence_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    numbers = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))
    return numbers, len(words) < 10 or 100 * len(hit) > 20 * len(words)


def english(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(COMMON["en"]) if rng.random() < 0.4 else f"w{rng.integers(9999)}x".replace("0", "a").replace("1", "b") for _ in range(n))


def junk(n, seed):
    return " ".join(w.upper() + "!!$$" for w in english(n, seed).split())


def test_base_numbers(spark):
    texts = awkward() + [english(200, 1), "a b\nc\na b\n\n\na b \n#$ |", "é\n" * 12, prose(50, 9) + "\n" + prose(50, 9)]
    got = by_id(judge(documents(spark, texts)))
    for i, text in enumerate(texts):
        numbers, bad = base(text)
        assert tuple(got[i][n] for n in divergence.NUMBERS) == numbers, text
        assert got[i].base_failed == bad and (not bad or not got[i].kept)


def test_junk_goes_clean_and_short_stay(spark):
    texts = [english(150, s) for s in range(30)] + [junk(150, 99), english(30, 50), "the " * 3 + english(20, 51)]
    got = by_id(judge(clashing(documents(spark, texts), "KEPT", "n_words", "bin", "total")))
    assert all(got[i].kept for i in range(30))
    assert not got[30].kept and not got[30].base_failed and got[30].char_distance > divergence.MAX_CHAR_DISTANCE
    assert got[31].kept and got[31].char_distance is None


def test_no_reference(spark):
    docs = documents(spark, [english(150, 1), junk(150, 2), None])
    assert judge(docs.limit(0)).count() == 0
    unknown = by_id(judge(docs.withColumn("lang", docs.lang.substr(9, 1))))
    assert unknown[0].kept and unknown[1].kept and not unknown[2].kept and unknown[1].char_distance is None


def test_distance_is_a_metric_of_shares():
    a, b = np.array([[1.0, 0]]), np.array([[0, 1.0]])
    assert distance(a, b)[0] == 1 and distance(a, a)[0] == 0
    assert distance(a, np.concatenate([b, a]))[0] == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = by_id(op3_divergence_rules(spark, sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        numbers, bad = base(d.text)
        r = rows[d.doc_id]
        assert (tuple(r[n] for n in divergence.NUMBERS), r.base_failed) == (numbers, bad)
