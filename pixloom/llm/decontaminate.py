"""Benchmark decontamination with an FM-index over each shard of the training texts.

The words of a test block are numbered. A shard keeps only those stretches of training words that
could hold a whole test phrase (known words, as long as the shortest phrase), is indexed by its
Burrows-Wheeler transform in a wavelet matrix, and is searched backwards for all phrases at once.
Occurrences are located through sampled suffix positions and their spans merged for each text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom.llm.frame import append_columns, lists
from pixloom.llm.registry import query, table
from pixloom.llm.text import ALNUM, LOWER_VALUES, Words, chunks, covered, joined, ragged

WINDOW = 10
SAMPLE_RATE = 16
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 50_000
SEPARATOR = 1  # ends each kept stretch; 0 ends the shard, words count from 2

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence whose last symbol is its unique least, by doubling."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    rank = np.zeros(n, np.int64)
    key = seq.astype(np.int64)
    width = 1
    while True:
        ordered = key[order]
        step = np.zeros(n, np.int64)
        step[1:] = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(step)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        width *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane for each bit of the alphabet."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        self.bits = range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1)
        self.ones, self.zeros = [], []
        for bit in self.bits:
            on = (seq >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(on, dtype=np.int64)]))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[~on], seq[on]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros(len(at), np.int64)
        for bit, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            on = (symbol >> bit & 1).astype(bool)
            low = np.where(on, zeros + ones[low], low - ones[low])
            at = np.where(on, zeros + ones[at], at - ones[at])
        return at - low

    def at(self, position: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        symbol = np.zeros(len(position), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            on = ones[position + 1] > ones[position]
            symbol = symbol * 2 + on
            position = np.where(on, zeros + ones[position], position - ones[position])
        return symbol


class FmIndex:
    """Backward search over one shard; ``seq`` holds symbols from 1 on."""

    def __init__(self, seq: np.ndarray, alphabet: int, rate: int = SAMPLE_RATE):
        seq = np.append(seq, 0)
        order = suffix_order(seq)
        self.n = len(seq)
        self.tree = WaveletMatrix(seq[order - 1], alphabet)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=alphabet))])
        kept = order % rate == 0
        self.marked = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each phrase (rows of one length)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, column]
            low = self.before[c] + self.tree.rank(c, low)
            high = self.before[c] + self.tree.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: walk back to a sampled one."""
        found = np.zeros(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            at = rows[left]
            done = self.marked[at + 1] > self.marked[at]
            found[left[done]] = self.sampled[self.marked[at[done]]] + steps
            left, at = left[~done], at[~done]
            c = self.tree.at(at)
            rows[left] = self.before[c] + self.tree.rank(c, at)
            steps += 1
        return found


class Phrases:
    """Windows of a block of test items: numbered words, distinct phrases by length, their items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data, offsets = joined(pa.array([text for _, text in items], pa.string()))
        words = Words(data, offsets, ALNUM, LOWER_VALUES)
        code: dict[str, int] = {}
        of_item = np.array([code.setdefault(item, len(code)) for item, _ in items], np.int64)
        self.ids = list(code)
        self.vocabulary, numbers = np.unique(words.hash, return_inverse=True)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.alphabet = len(self.vocabulary) + 2
        length = np.minimum(words.counts, window)
        self.by_length = []  # phrases, then for each phrase the items that hold it
        for size in np.unique(length[length > 0]):
            which = np.flatnonzero(length == size)
            n = words.counts[which] - size + 1
            start = ragged(words.bounds[which], n)
            item = np.repeat(of_item[which], n)
            rows = numbers[start[:, None] + np.arange(size)] + 2
            distinct, of = np.unique(rows, axis=0, return_inverse=True)
            pair = np.unique(np.stack([of.ravel(), item]), axis=1)
            counts = np.bincount(pair[0], minlength=len(distinct))
            self.by_length.append((distinct, np.cumsum(counts) - counts, counts, pair[1]))
        self.shortest = int(min((p[0].shape[1] for p in self.by_length), default=0))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, 0 where no test item has it."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            likely = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.searchsorted(self.vocabulary, hashes[likely])
            at[at == len(self.vocabulary)] = 0
            same = self.vocabulary[at] == hashes[likely]
            out[likely[same]] = at[same] + 2
        return out


def stretches(numbers: np.ndarray, text: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of known words of one text, of that length at least."""
    known = numbers > 0
    start, end = known.copy(), known.copy()
    start[1:] &= ~known[:-1] | (text[1:] != text[:-1])
    end[:-1] &= ~known[1:] | (text[1:] != text[:-1])
    first = np.flatnonzero(start)
    length = np.flatnonzero(end) + 1 - first
    keep = length >= shortest
    return first[keep], length[keep]


def searched(phrases: Phrases, column, shard_words: int):
    """For each text of a batch: words, occurrences (start, end in words) and the items that occur."""
    data, offsets = joined(column)
    n = len(offsets) - 1
    counts = np.zeros(n, np.int64)
    pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    texts, starts, ends, hit = [], [], [], []

    def search():
        seq, text, word = (np.concatenate(x) for x in zip(*pending, strict=True))
        index = FmIndex(seq, phrases.alphabet)
        for rows, at, size, items in phrases.by_length:
            low, high = index.search(rows)
            found = high - low
            which = np.repeat(np.arange(len(rows)), found)
            position = index.locate(ragged(low, found))
            texts.append(text[position])
            starts.append(word[position])
            ends.append(word[position] + rows.shape[1])
            pair = np.unique(np.stack([text[position], which]), axis=1)
            hit.append(np.stack([np.repeat(pair[0], size[pair[1]]), items[ragged(at[pair[1]], size[pair[1]])]]))

    for first, last in chunks(offsets):
        base = offsets[first]
        words = Words(data[base : offsets[last]], offsets[first : last + 1] - base, ALNUM, LOWER_VALUES)
        counts[first:last] = words.counts
        if not phrases.shortest:
            continue
        numbers = phrases.number(words.hash)
        begin, length = stretches(numbers, words.text, phrases.shortest)
        if len(begin):
            at = ragged(begin, length + 1)
            stop = np.cumsum(length + 1) - 1
            at[stop] -= 1  # any position: a separator stands there
            seq = numbers[at]
            seq[stop] = SEPARATOR
            pending.append((seq, words.text[at] + first, at - words.bounds[words.text[at]]))
            held += len(seq)
            if held >= shard_words:
                search()
                pending.clear()
                held = 0
    if pending:
        search()
    empty = [np.zeros(0, np.int64)]
    pairs = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *hit], axis=1), axis=1)
    return counts, *(np.concatenate(empty + x) for x in (texts, starts, ends)), pairs


def merged(text, start, end, counts):
    """Maximal covered spans: their texts, starts and ends."""
    base = np.cumsum(counts + 1) - counts - 1  # one word between texts, so that spans do not meet
    total = int((counts + 1).sum())
    on = covered(base[text] + start, base[text] + end, total)
    edge = np.diff(on.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(base, first, "right") - 1
    return owner, first - base[owner], last - base[owner]


def find_benchmark(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``n_words``, ``hit_spans`` ([start, end) in words, maximal) and ``hit_items`` to each text.

    Words are runs of ASCII letters and digits (lower-cased) and of all other characters beyond
    ASCII. An item of fewer words than ``window`` is one phrase. Null and empty texts or items have
    no words and no spans; an item without id is not reported, but its words are hit; repeated items
    count once; columns of the three names are replaced. Test items go to the tasks in blocks of
    about ``block_words`` words, one pass over the texts for each, so what a task gets is bounded
    however large the benchmark is. Nothing is shuffled.
    """
    items = benchmark.select(
        F.col(item).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")
    ).distinct()
    n = items.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    blocks = max(1, -int(-n // (block_words * 3)))
    out = documents.withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "hit_spans": F.array().cast("array<array<bigint>>"),
            "hit_items": F.array().cast("array<string>"),
        }
    )
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        phrases = Phrases([tuple(r) for r in rows], window)

        def make(batch, phrases=phrases):
            counts, owner, start, end, pairs = searched(phrases, batch.column(text), shard_words)
            names = phrases.ids
            had = [batch.column("hit_spans"), batch.column("hit_items")]
            known = np.array([names[i] is not None for i in pairs[1]], bool)
            pairs = pairs[:, known]
            if len(had[0].flatten()):  # spans of earlier blocks
                was = had[0].to_pylist()
                before = np.array([[i, s, e] for i, x in enumerate(was) for s, e in x], np.int64).reshape(-1, 3).T
                owner, start, end = (np.concatenate(x) for x in zip(before, (owner, start, end), strict=True))
            owner, start, end = merged(owner, start, end, counts)
            flat = lists(np.stack([start, end], axis=1).ravel(), np.full(len(start), 2), pa.int64())
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))])
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            found = lists([names[i] for i in pairs[1]], np.bincount(pairs[0], minlength=len(counts)), pa.string())
            if len(had[1].flatten()):
                found = pa.array([sorted({*a, *b}) for a, b in zip(had[1].to_pylist(), found.to_pylist(), strict=True)], pa.list_(pa.string()))
            return [pa.array(counts, pa.int64()), spans, found]

        out = append_with_own(out, make, drop if block == blocks - 1 else ())
    return out


def append_with_own(df: DataFrame, make, drop) -> DataFrame:
    """append_columns that may read the columns it replaces."""
    names = [c for c in df.columns if c not in {f.name for f in FIELDS} and c not in drop]
    schema = T.StructType([df.schema[c] for c in names] + FIELDS)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + make(batch), names=schema.names)

    return df.mapInArrow(run, schema)


def remove_spans(df: DataFrame, *, text: str = "text", kind=ALNUM) -> DataFrame:
    """Cut the words of ``hit_spans`` from the texts, with what stands between them."""

    def make(batch):
        data, offsets = joined(batch.column(text))
        spans = batch.column("hit_spans").to_pylist()
        out = []
        for i, (value, cuts) in enumerate(zip(batch.column(text).to_pylist(), spans, strict=True)):
            if cuts:
                raw = data[offsets[i] : offsets[i + 1]]
                words = Words(raw, np.array([0, len(raw)]), kind, None)
                starts = words.start[[s for s, _ in cuts]]
                stops = words.end[[e - 1 for _, e in cuts]]
                value = raw[~covered(starts, stops, len(raw))].tobytes().decode()
            out.append(value)
        return [pa.array(out, pa.string())]

    cut = append_columns(df, [T.StructField("__kept", T.StringType())], make, drop=(text,))
    return cut.withColumnRenamed("__kept", text).select(df.columns)


@query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(documents, table(spark, sf_dir, "benchmark"), drop=("text",))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
