"""Quality rules: divergence of a text's histograms from those of the languages.

Each text has two histograms, of character classes and of common words. The references are the mean
histograms of each language over all texts that pass the base rules and are long enough. A text is
dropped when the Jensen-Shannon distance to every language is too large in either histogram; texts
shorter than the guards are judged by the base rules alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom.llm.frame import append_columns, without
from pixloom.llm.registry import query, table
from pixloom.llm.text import (
    ALNUM, BLANK_SPLIT, LOWER_VALUES, Lookup, U, Words, chunks, covered, earlier, joined, mix, per_text, repeated, word_hashes,
)

# Frequent function words of each language.
COMMON = {
    "en": "the of and to in a is that it for on with as was be by this are from at or an not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
SYMBOLS = b"#*$%&|<>"
# Character classes: lower, upper, beyond ASCII, digit, white space, punctuation, symbol, other.
CLASSES = np.full(256, 7, np.int64)
CLASSES[0x61:0x7B], CLASSES[0x41:0x5B], CLASSES[0xC0:], CLASSES[0x30:0x3A] = 0, 1, 2, 3
CLASSES[[0x20, 9, 10, 11, 12, 13]], CLASSES[list(b".,;:'\"-?!()")], CLASSES[list(SYMBOLS)] = 4, 5, 6
N_CLASSES = 8
STARTS = np.ones(256, bool)  # first bytes of characters
STARTS[0x80:0xC0] = False
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True

MIN_WORDS, MAX_REPEATED = 10, 20
MIN_CHARS, MIN_COMMON = 400, 60  # guards: characters, words
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.36
SCALE = 1 << 30  # references are sums of whole numbers, so that their order does not matter

WORDS = sorted({w for words in COMMON.values() for w in words})
_bins = Lookup(word_hashes(WORDS, LOWER_VALUES))

NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = [T.StructField(n, T.LongType()) for n in NUMBERS] + [
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("char_distance", T.DoubleType()),
    T.StructField("word_distance", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def base_numbers(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five counts of each text of a chunk."""
    words = Words(data, offsets, BLANK_SPLIT)
    n = len(offsets) - 1
    inside = BLANK_SPLIT[data]
    # lines: every text begins one, and every line feed
    feed = np.flatnonzero(data == 10)
    start = np.concatenate([offsets[:-1], feed + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, feed, "right") - 1])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    last = np.ones(len(start), bool)
    last[:-1] = owner[1:] != owner[:-1]
    end = np.where(last, offsets[owner + 1], np.append(start[1:], 0) - 1)
    filled = np.concatenate([[0], np.cumsum(inside)])
    full = filled[end] > filled[start]
    start, end, owner = start[full], end[full], owner[full]
    line = mix(words.bytes.of(start, end) + mix(owner.astype(U)) + (end - start).astype(U))
    copies = earlier(line)
    hashes, same, _ = words.windows(5)
    at = np.flatnonzero(same)
    again = at[repeated(mix(hashes[at] + mix(words.text[at].astype(U))))]
    return [
        words.counts,
        per_text(inside & STARTS[data], offsets),
        per_text(IS_SYMBOL[data], offsets),
        np.bincount(owner[copies], minlength=n),
        per_text(covered(again, again + 5, len(words.start)), words.bounds),
    ]


def histograms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shares of character classes and of common words in each text, and the two totals."""
    n = len(offsets) - 1
    first = np.flatnonzero(STARTS[data])
    owner = np.searchsorted(offsets, first, "right") - 1
    chars = np.bincount(owner * N_CLASSES + CLASSES[data[first]], minlength=n * N_CLASSES).reshape(n, -1)
    words = Words(data, offsets, ALNUM, LOWER_VALUES)
    width = len(WORDS) + 1  # the first is any other word
    common = np.bincount(words.text * width + _bins(words.hash) + 1, minlength=n * width).reshape(n, -1)
    share = lambda x: x / np.maximum(1, x.sum(axis=1, keepdims=True))
    return share(chars), share(common), chars.sum(axis=1), words.counts


def distance(shares: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Least Jensen-Shannon distance (base 2) of each row to a reference."""

    def part(a, b):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / b), 0.0).sum(axis=-1)

    out = np.ones(len(shares))
    for reference in references:
        middle = (shares + reference) / 2
        out = np.minimum(out, np.sqrt(np.maximum(0, part(shares, middle) + part(reference, middle)) / 2))
    return out


def failed(numbers: list[np.ndarray]) -> np.ndarray:
    return (numbers[0] < MIN_WORDS) | (100 * numbers[4] > MAX_REPEATED * numbers[0])


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[np.ndarray, np.ndarray]:
    """Mean histograms of each language: one pass, a few hundred numbers in all."""
    names = list(COMMON)
    width = N_CLASSES + len(WORDS) + 1

    def sums(batches):
        total = np.zeros((len(names), width), np.int64)
        count = np.zeros(len(names), np.int64)
        for batch in batches:
            data, offsets = joined(batch.column(0))
            of = np.array([names.index(x) if x in COMMON else -1 for x in batch.column(1).to_pylist()], np.int64)
            for a, b in chunks(offsets):
                piece, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                chars, common, n_chars, n_common = histograms(piece, at)
                good = (of[a:b] >= 0) & (n_chars >= MIN_CHARS) & (n_common >= MIN_COMMON) & ~failed(base_numbers(piece, at))
                rows = np.rint(np.concatenate([chars, common], axis=1)[good] * SCALE).astype(np.int64)
                np.add.at(total, of[a:b][good], rows)
                count += np.bincount(of[a:b][good], minlength=len(names))
        where, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(where, np.arange(len(names)))), pa.array(np.append(k, np.full(len(names), -1))), pa.array(np.append(total[where, k], count))],
            names=["lang", "bin", "total"],
        )

    # decimals: sums of 10**12 texts times SCALE pass 64 bits
    rows = (
        df.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .mapInArrow(sums, "lang long, bin long, total long")
        .groupBy("lang", "bin")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        .collect()
    )
    table_ = np.zeros((len(names), width))
    count = np.zeros(len(names))
    for r in rows:
        if r.bin < 0:
            count[r.lang] = float(r.total)
        else:
            table_[r.lang, r.bin] = float(r.total) / SCALE
    seen = table_[count > 0] / count[count > 0, None]
    chars, common = seen[:, :N_CLASSES], seen[:, N_CLASSES:]
    return chars / chars.sum(axis=1, keepdims=True), common / common.sum(axis=1, keepdims=True)


def judge(
    df: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add the base numbers, the two distances and ``kept`` to each text.

    Distances are to the nearest of the languages of COMMON that occur, so a wrong or missing
    language name costs nothing. They are NULL where a guard holds them back: fewer than MIN_CHARS
    characters or MIN_COMMON words, or no reference at all (an empty table, no known language).
    Null and empty texts have no words and fail the base rule; repeated rows are judged alike;
    columns with the names of the results are replaced.
    """
    df = without(df, [f.name for f in FIELDS])
    char_reference, word_reference = references(df, text, lang)

    def make(batch):
        data, offsets = joined(batch.column(text))
        out: list[list[np.ndarray]] = []
        for a, b in chunks(offsets):
            piece, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            numbers = base_numbers(piece, at)
            chars, common, n_chars, n_common = histograms(piece, at)
            out.append([*numbers, distance(chars, char_reference), distance(common, word_reference), n_chars, n_common])
        *numbers, by_char, by_word, n_chars, n_common = (np.concatenate(x) for x in zip(*out, strict=True))
        bad = failed(numbers)
        short = ((n_chars < MIN_CHARS) | (n_common < MIN_COMMON)) | (len(char_reference) == 0)
        far = ~short & ((by_char > max_char_distance) | (by_word > max_word_distance))
        return [
            *(pa.array(x, pa.int64()) for x in numbers), pa.array(bad), pa.array(by_char, mask=short),
            pa.array(by_word, mask=short), pa.array(~bad & ~far),
        ]

    return append_columns(df, FIELDS, make, drop)


@query("op3_divergence_rules")
def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(documents, drop=("text", "lang"))
