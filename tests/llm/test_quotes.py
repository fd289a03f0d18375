import hashlib
import re

from cases import clashing
from pixloom.llm.quotes import link_quotes, op8_quotation_linking


def parse(text):
    out = []
    for line in re.split("\r?\n", text or ""):
        m = re.match(r"(?:[ \t]{0,3}>)*", line)[0]
        body = line[len(m) :]
        out.append((m.count(">"), body[1:] if body[:1] == " " else body))
    return out


def norm(text):
    return re.sub(r"\s+", " ", text.lower()).strip(" ")


def brute(rows):
    """rows: (id, scope, place, text) -> id: (root, parent, depth)."""
    sources, quotes, places = {}, {}, {}
    for i, scope, place, text in rows:
        if None in (i, scope, place):
            continue
        places[i] = place
        lines = parse(text)
        own = [b for n, b in lines if n == 0]
        parts = {norm(" ".join(own))} | {norm(p) for p in re.split(r"\n\s*\n", "\n".join(own))}
        for p in parts - {""}:
            sources[scope, p] = min(sources.get((scope, p), (place, i)), (place, i))
        runs = "\n".join(b if n == 1 else "\x01" for n, b in lines).split("\x01")
        quotes.setdefault(i, set()).update((scope, norm(r)) for r in runs if norm(r))
    parent = {}
    for i, parts in quotes.items():
        found = [sources[p] for p in parts if p in sources and sources[p][0] < places[i]]
        parent[i] = max(found)[1] if found else None

    def up(i):
        depth, root = 0, i
        while parent[root] is not None:
            root, depth = parent[root], depth + 1
        return root, parent[i], depth

    return {i: up(i) for i in parent}


MESSAGES = [
    (1, "Hello all.\n\nShall we meet?"), (2, "> Hello all.\n>\n> Shall we meet?\nYes."), (3, ">> Hello all.\n> Yes.\n\nWhen?"),
    (4, "> Shall we\n>   MEET?\nno"), (5, "> > Yes.\n> When?\nat noon"), (6, "> unknown words\nstray"), (7, None), (8, ""),
    (9, "> at noon\nfine\n> Yes.\nboth"), (10, "Hello all.\n\nShall we meet?"), (11, "> Hello all. Shall we meet?\nagain"),
    (12, ">"), (13, "> fine both\n> "), (None, "> Yes.\nno id"), (14, "> at the end\nself"), (15, "at the end"),
] + [(100 + i, (f"> word {i - 1}\n" if i else "") + f"word {i}") for i in range(40)]


def test_against_brute_force(spark):
    df = spark.createDataFrame(MESSAGES, "message_id long, text string").repartition(4)
    got = {r.message_id: r for r in link_quotes(clashing(df, "Root", "depth", "part", "scope", "lines")).collect()}
    want = brute([(i, 0, i, t) for i, t in MESSAGES])
    for i, _ in MESSAGES:
        r = got[i]
        assert (r.root, r.reply_to, r.depth) == (want[i] if i is not None else (None, None, None)), i
    assert got[2].own_text == "Yes." and got[9].own_text == "fine\nboth" and got[7].own_text is None
    assert want[139] == (100, 138, 39) and want[11][1] == 1


def test_scope_repeats_and_empty_table(spark):
    rows = [("a1", "a", 1, "same words"), ("b1", "b", 1, "same words"), ("a2", "a", 2, "> same words\nx"), ("b2", "b", 2, "> same words\nx")]
    rows += [rows[2], ("c1", None, 1, "same words"), ("a0", "a", None, "> same words")]
    df = spark.createDataFrame(rows, "message_id string, s string, n int, text string")
    got = sorted((r.message_id, str(r.root), str(r.reply_to)) for r in link_quotes(df, scope="s", order="n").collect())
    want = brute(rows)
    assert got == sorted((r[0], *(str(x) for x in want.get(r[0], (None, None))[:2])) for r in rows)
    assert link_quotes(df.limit(0), scope="s", order="n").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = op8_quotation_linking(spark, sf).collect()
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    assert len(rows) == len(turns)
    mail = []
    for (c, t), text in turns.items():
        quote = "".join(f"{m} {x}\n" for k, m in ((2, ">>"), (1, ">")) if (y := turns.get((c, t - k))) is not None for x in y.split("\n"))
        mail.append((f"{c}:{t}", c, t, f"{quote}\n{text or ''}"))
    want = brute(mail)
    for r in rows:
        assert (r.root, r.reply_to, r.depth) == want[f"{r.conv_id}:{r.turn}"]
        own = turns[r.conv_id, r.turn]
        assert r.own_sha256 == hashlib.sha256(own.strip(" \t\r\n").encode()).hexdigest()
    assert sum(r.depth for r in rows) > len(rows) / 2
