"""Personal data by weak supervision.

Fixed patterns give the base spans. Looser patterns add candidates; on each candidate a few
labelers vote for, against or not at all: the pattern's own checks, a checksum, gazetteers and the
words around. Expectation-maximisation over the counts of all vote patterns estimates how reliable
each labeler is and how common true spans of each kind are; a logistic span classifier is trained
on the resulting probabilities and decides which candidates are added. Base spans always stay.

All that is gathered are counts of vote patterns and span shapes, whose number is fixed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom.llm.frame import append_columns
from pixloom.llm.registry import query, table
from pixloom.llm.text import ALNUM, Lookup, Words, chunks, joined, per_text, word_hashes

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account", "local_phone", "name")
EMAIL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = (
    (4, re.compile(r"(?<![0-9A-Za-z])[0-9A-Za-z]{24,}")),
    (5, re.compile(r"(?<![0-9])[0-9]{9,}")),
    (6, re.compile(r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (7, re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Monsieur|Señor|Señora)\.? ([A-Z][a-zà-ÿ]+(?: [A-Z][a-zà-ÿ]+)?)")),
)
# Words that speak for a kind when they stand before it, and words that speak against any.
CUES = (
    "mail email contact write address an kontakt correo courriel".split(),
    "ip host server from address client login adresse servidor".split(),
    "card visa credit number payment karte carte tarjeta".split(),
    "call phone tel fax mobile number telefon téléphone teléfono".split(),
    "token key secret password api auth bearer passwort clave".split(),
    "account acct iban number customer konto compte cuenta".split(),
    "call phone tel fax mobile number telefon téléphone teléfono".split(),
    "name dear signed by von par señor".split(),
)
AGAINST = frozenset("version license licensed page chapter section isbn sha commit checksum hash copyright".split())
TITLES = "Mr Mrs Ms Dr Herr Frau Mme Monsieur Señor Señora".split()
GIVEN_NAMES = frozenset(
    "James Mary John Anna Peter Maria Thomas Julia Michael Laura Hans Klaus Jürgen Sabine Pierre Marie Jean Luc"
    " Claire Carlos José Luis Carmen Pablo Elena David Sarah Daniel Paul Emma".split()
)
LABELERS = ("shape", "checksum", "cue", "against", "gazetteer")
FIRST_GUESS = (0.7, 0.8, 0.8, 0.9, 0.85)  # reliabilities from which estimation starts

_titles = Lookup(word_hashes(TITLES))
_gate = np.zeros(256, bool)
_gate[[*range(0x30, 0x3A), 0x40]] = True  # digits and @; the other base pattern has a digit as well

FIELDS = [
    *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS),
    T.StructField("base_spans", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of name@domain, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdecimal() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def votes_of(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    """The labelers' votes as a base-3 number, and the span's shape."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    before = re.findall(r"\w+", text[max(0, start - 32) : start].lower())[-3:]
    votes = [0] * len(LABELERS)
    if kind == 4:
        votes[0] = 1 if 4 <= len(digits) < len(span) else -1
        votes[1] = 1 if len(set(span)) >= 10 else -1
    elif kind == 7:
        votes[0] = 1 if len(span) > 2 else -1
    else:
        # any run of digits looks like an account: only one of no possible length is voted on
        votes[0] = 1 if kind in (0, 1, 2, 3, 6) else (0 if len(digits) <= 19 else -1)
        if kind in (2, 5) and len(digits) >= 13:
            votes[1] = 1 if luhn(digits) else -1
    votes[2] = int(any(w in CUES[kind] for w in before))
    votes[3] = -1 if any(w in AGAINST for w in before) else 0
    if kind == 7:
        votes[4] = 1 if GIVEN_NAMES & set(span.split()) else 0
    elif kind == 0:
        votes[4] = 1 if span.rsplit(".", 1)[-1].lower() in ("com", "org", "net", "de", "fr", "es") else 0
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    left, right = text[start - 1 : start], text[end : end + 1]
    size = min(3, len(span).bit_length() // 2)
    shape = size + 4 * (left in ("", " ", "\n", "\t", '"', "'")) + 8 * (right in ("", " ", "\n", "\t", ".", ",", '"', "'"))
    shape += 16 * any(c.isupper() for c in span) + 32 * (span.isdecimal())
    return code, shape


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loose spans that meet no base span and no earlier one, in order."""
    found = []
    for kind, pattern in LOOSE:
        found += [(*m.span(pattern.groups), kind) for m in pattern.finditer(text)]
    taken = sorted((s, e) for s, _, e in base)
    out, last, k = [], 0, 0
    for start, end, kind in sorted(found):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start >= last and not (k < len(taken) and taken[k][0] < end):
            out.append((start, kind, end))
            last = end
    return out


def worth_a_look(column) -> np.ndarray:
    """Rows that can hold a span: those with a digit, an @ or a title."""
    data, offsets = joined(column)
    out = np.zeros(len(offsets) - 1, bool)
    for a, b in chunks(offsets):
        piece, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words = Words(piece, at, ALNUM)
        title = np.bincount(words.text[_titles(words.hash) >= 0], minlength=b - a)
        out[a:b] = (per_text(_gate[piece], at) > 0) | (title > 0)
    return np.flatnonzero(out)


def expectation_maximisation(counts: dict[tuple[int, int], int], rounds: int = 50):
    """Reliability of each labeler, share of true spans of each kind, and P(true) of each (kind, votes)."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kind = np.array([k for k, _ in keys], np.int64)
    code = np.array([c for _, c in keys], np.int64)
    votes = np.stack([code // 3 ** (len(LABELERS) - 1 - j) % 3 - 1 for j in range(len(LABELERS))], axis=1)
    reliable, share = np.array(FIRST_GUESS), np.full(len(KINDS), 0.4)
    p = np.full(len(keys), 0.5)
    for _ in range(rounds):
        log_odds = np.log(share / (1 - share))[kind] + votes @ np.log(reliable / (1 - reliable))
        p = 1 / (1 + np.exp(-log_odds))
        p = np.where(kind < len(BASE_KINDS), 1.0, p)  # base spans are given
        for j in range(len(LABELERS)):
            right = n * np.where(votes[:, j] > 0, p, 1 - p) * (votes[:, j] != 0)
            given = n * (votes[:, j] != 0)
            reliable[j] = np.clip((right.sum() + 3) / (given.sum() + 4), 0.55, 0.98)
        for k in range(len(KINDS)):
            at = kind == k
            share[k] = np.clip(((n * p)[at].sum() + 1) / (n[at].sum() + 2), 0.05, 0.95)
    return reliable, share, dict(zip(keys, p.tolist(), strict=True))


def span_features(kind: int, code: int, shape: int) -> list[int]:
    """One-hot places: kind, each labeler's vote, size and flags of the shape."""
    out = [kind]
    for j in range(len(LABELERS)):
        out.append(len(KINDS) + 3 * j + code // 3 ** (len(LABELERS) - 1 - j) % 3)
    first = len(KINDS) + 3 * len(LABELERS)
    out.append(first + shape % 4)
    out += [first + 4 + b for b in range(4) if shape >> (2 + b) & 1]
    return out


N_FEATURES = len(KINDS) + 3 * len(LABELERS) + 8


def train_spans(rows: list[tuple[int, int, int, int]], rounds: int = 300) -> np.ndarray:
    """Logistic weights from counts of (kind, votes, shape, n) and the probabilities of the votes."""
    counts: dict[tuple[int, int], int] = {}
    for kind, code, _, n in rows:
        counts[kind, code] = counts.get((kind, code), 0) + n
    w = np.zeros(N_FEATURES)
    if not rows:
        return w
    _, _, p = expectation_maximisation(counts)
    x = np.zeros((len(rows), N_FEATURES))
    for i, (kind, code, shape, _) in enumerate(rows):
        x[i, span_features(kind, code, shape)] = 1
    y = np.array([p[kind, code] for kind, code, _, _ in rows])
    n = np.log1p(np.array([n for *_, n in rows], float))  # the many spans of one pattern do not drown the others
    for _ in range(rounds):
        g = x.T @ (n * (1 / (1 + np.exp(-(x @ w))) - y)) / n.sum() + 1e-4 * w
        w -= 2.0 * g
    return w


def gather(df: DataFrame, text: str = "text") -> list[tuple[int, int, int, int]]:
    """Counts of (kind, votes, shape) over all spans and candidates: bounded by their possible values."""

    def count(batches):
        total: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for value in batch.column(0).take(pa.array(worth_a_look(batch.column(0)))).to_pylist():
                base = base_spans(value)
                for start, kind, end in base + candidates(value, base):
                    key = (kind, *votes_of(value, kind, start, end))
                    total[key] = total.get(key, 0) + 1
        if total:
            columns = [*zip(*total, strict=True), total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in map(list, columns)], names=["kind", "code", "shape", "n"])

    counted = df.select(F.col(text).alias("text")).mapInArrow(count, "kind long, code long, shape long, n long")
    rows = counted.groupBy("kind", "code", "shape").agg(F.sum("n").alias("n")).collect()
    return sorted(tuple(r) for r in rows)


def written(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_personal(
    df: DataFrame, *, text: str = "text", weights: np.ndarray | None = None, drop: tuple[str, ...] = ()
) -> DataFrame:
    """Add counts of the base kinds, ``base_spans`` and ``spans`` (kind:start:end, ...) to each text.

    Positions are code points, the end exclusive; order is by start, then kind. The classifier is
    trained on all texts of ``df`` unless its weights are given. Null and empty texts have no spans;
    repeated rows have equal ones; columns with the names of the results are replaced.
    """
    w = train_spans(gather(df, text)) if weights is None else weights

    def make(batch):
        column = batch.column(text)
        n = len(column)
        counts = np.zeros((len(BASE_KINDS), n), np.int64)
        base_text, all_text = [""] * n, [""] * n
        look = worth_a_look(column)
        for i, value in zip(look.tolist(), column.take(pa.array(look)).to_pylist(), strict=True):
            base = base_spans(value)
            for _, kind, _ in base:
                counts[kind, i] += 1
            added = [
                c for c in candidates(value, base)
                if w[span_features(c[1], *votes_of(value, c[1], c[0], c[2]))].sum() > 0
            ]
            base_text[i], all_text[i] = written(base), written(sorted(base + added))
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(base_text), pa.array(all_text)]

    return append_columns(df, FIELDS, make, drop)


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")
