import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom.llm import prefix_trie as module
from pixloom.llm.prefix_trie import conversation_trie, numbered_turns, op13_prefix_trie, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def brute_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    """Rows as of the operator, from every prefix of every conversation."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        kids = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        ends = sorted(c for c in who if len(convs[c]) == len(node))
        out.append(
            (
                min(who),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(who),
                len(kids),
                len(leaves),
                sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed, convs=30, most=9):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.choice((1, 2, 3, most))):
            turn = None if rng.random() < 0.1 else t
            rows.append((c + 3 * (c > 20), turn, rng.choice(("user", None, "")), rng.choice(("é", "b", None, "", "long " * 9))))
    rng.shuffle(rows)
    return rows


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in ("place", "depth", "c", "k1")}).repartition(3)

    return make


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(frame, seed, monkeypatch):
    monkeypatch.setattr(module, "IDS", 2)
    rows = random_rows(seed)
    convs = ordered(rows)
    assert got(conversation_trie(frame(rows))) == brute(convs)
    assert got(prefix_trie(*rebuilt(numbered_turns(frame(rows))))) == brute(brute_rebuilt(convs))


def test_long_chains_copies_and_blocks(frame, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 4)
    base = [("user", f"turn {i} " * (i % 3)) for i in range(40)]
    convs = {c: base for c in range(12)}  # copies
    convs |= {20: base[:17], 21: base[:39], 22: base[:39] + [("user", "other")], 23: base[:18] + [("x", "")] * 9, 24: [("x", "")] * 14}
    rows = [(c, i, *t) for c, ts in convs.items() for i, t in enumerate(ts)] + [(None, 1, "user", "no conversation")]
    assert got(conversation_trie(frame(rows))) == brute(convs)


def test_repeated_rows_very_long_text_single_turn_and_empty_table(frame):
    rows = [(-7, 1, "a", "x" * 300_000), (-7, 1, "a", "x" * 300_000), (5, None, None, None), (6, 0, "", ""), (2**40, 3, "a", "b")]
    assert got(conversation_trie(frame(rows))) == brute(ordered(rows))
    out = conversation_trie(frame(rows).limit(0))
    assert out.count() == 0 and out.schema["ends_sha256"].dataType == T.StringType()


def test_turnless_conversations_end_at_the_root(frame):
    rows = [(c, 0, "user", "only") for c in range(40)]  # those without a base and h > 0 lose their turn
    rows = [r for r in rows if r[0] % 5]
    want = brute(brute_rebuilt(ordered(rows)))
    assert got(prefix_trie(*rebuilt(numbered_turns(frame(rows))))) == want
    assert len({len(t) for t in brute_rebuilt(ordered(rows)).values()}) == 2


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert got(op13_prefix_trie(spark, sf)) == brute(brute_rebuilt(ordered(rows)))
