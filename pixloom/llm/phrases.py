"""Mining of phrases whose words stand together far more often than apart.

Counting follows the vertical partitioning of disk-based suffix trees. Every place of the texts has a
suffix of up to four words. Suffixes are dealt out by their prefix: the first word or, where more
suffixes begin with it than a group may hold, the first two, three or four; the heavy prefixes are
counted level by level, each level reading only what the one before left too large. A group is a
number of prefixes; its suffixes are sorted and form a subtree, whose nodes have the sums of their
leaves as counts. Suffixes end before a pair of words that a sketch of all pairs shows to be rarer
than the least count wanted: a sketch never shows too little, so no wanted phrase is cut.

Words are known by 64-bit hashes with their language; that all are distinct is verified, and another
seed is taken if not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixloom.llm.frame import saved
from pixloom.llm.registry import query, table
from pixloom.llm.text import CHUNK, LOWER, LOWER_VALUES, Lookup, Stretch, U, Words, joined, mix, seeded

LONGEST = 4
LEAST = 30  # occurrences of a phrase
SUBSUMED = 80  # percent of a phrase's occurrences that lie in a longer one
TOP = 2000
SCALE = 2_000_000
GROUP = 1 << 17  # suffixes of a group, at least
GROUPS = 1 << 20  # at most so many groups, so that the heavy prefixes stay few; beyond, groups grow
SEGMENT = 1 << 22  # words counted together
BLOCK_CELLS = 1 << 16
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 27  # a byte each in a task that counts, a bit each in one that asks
BREAKS = b".,;:!?\n\x0b\x0c\r"
BREAK = np.zeros(256, bool)
BREAK[list(BREAKS)] = True
KIND = ~BREAK
KIND[[0x20, 0x09]] = False
IDS = [f"w{i}" for i in range(1, LONGEST + 1)]
UNKNOWN = "und"


class Corpus:
    """Words of one stretch of texts: ``ids``, and ``left``: how many words of its piece come from each word on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: np.ndarray, seed: int):
        self.data = LOWER[data]
        self.words = Words(self.data, offsets, KIND, LOWER_VALUES if seed == 0 else seeded(100 + seed))
        self.language = languages[self.words.text]
        self.ids = np.maximum(mix(self.words.hash ^ self.language), U(1)) if len(self.words.text) else np.zeros(0, U)
        n = len(self.ids)
        ends = np.zeros(len(data) + 1, np.int64)
        np.cumsum(BREAK[data], out=ends[1:])
        last = np.ones(n, bool)
        last[:-1] = (ends[self.words.start[1:]] != ends[self.words.start[:-1]]) | (self.words.text[1:] != self.words.text[:-1])
        at = np.flatnonzero(last)
        self.left = at[np.searchsorted(at, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, np.int64)

    def shifted(self, k: int) -> np.ndarray:
        """The word k places further on; 0 behind the end."""
        return np.concatenate([self.ids[k:], np.zeros(min(k, len(self.ids)), U)])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0x9E3779B97F4A7C15) + b)


def language_hash(name: str) -> int:
    data = np.frombuffer(name.encode(), np.uint8)
    return int(mix(Stretch(seeded(7)[data]).of(np.array([0]), np.array([len(data)])) + U(len(data)))[0])


def stretches(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[Corpus, list[str]]]:
    """A batch (lang, text) in stretches of about CHUNK bytes; a longer text is cut where a piece ends."""
    names = batch.column(0).fill_null(UNKNOWN).to_pylist()
    hashes = {n: language_hash(n) for n in set(names)}
    languages = np.array([hashes[n] for n in names], U)
    data, offsets = joined(batch.column(1))
    cuts, owner = [offsets[:-1]], [np.arange(len(names))]
    for i in np.flatnonzero(np.diff(offsets) > CHUNK):
        ends = np.flatnonzero(BREAK[data[offsets[i] : offsets[i + 1]]]) + offsets[i] + 1
        wanted = np.arange(offsets[i] + CHUNK, offsets[i + 1], CHUNK)
        cut = np.unique(ends[np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)]) if len(ends) else ends
        cut = cut[cut < offsets[i + 1]]
        cuts.append(cut)
        owner.append(np.full(len(cut), i))
    starts, owner = np.concatenate(cuts), np.concatenate(owner)
    order = np.lexsort((owner, starts))
    starts, owner = np.append(starts[order], offsets[-1:]), owner[order]
    first = 0
    while first < len(owner):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK, "right")) - 1)
        last = min(last, len(owner))
        inside = starts[first : last + 1] - starts[first]
        yield Corpus(data[starts[first] : starts[last]], inside, languages[owner[first:last]], seed), [names[i] for i in owner[first:last]]
        first = last


def vocabulary(texts: DataFrame, seed: int) -> DataFrame:
    """Rows (id, lang, word, f) of all words."""

    def count(batches):
        for batch in batches:
            for part, names in stretches(batch, seed):
                ids, first, counts = np.unique(part.ids, return_index=True, return_counts=True)
                start, end, text = part.words.start[first], part.words.end[first], part.words.text[first]
                raw = part.data.tobytes()
                words = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                columns = (pa.array(ids.view(np.int64)), pa.array([names[t] for t in text.tolist()], pa.string()), pa.array(words, pa.string()), pa.array(counts))
                yield pa.RecordBatch.from_arrays(list(columns), names=["id", "lang", "word", "f"])

    rows = texts.mapInArrow(count, "id long, lang string, word string, f long")
    return rows.groupBy("id", "lang", "word").agg(F.sum("f").alias("f"))


class Pairs:
    """Bits of the cells that counted enough pairs; without bits every pair passes."""

    def __init__(self, cells: int, bits: np.ndarray | None = None):
        self.cells, self.bits = cells, bits

    def place(self, part: Corpus) -> np.ndarray:
        return (mix(pair_hash(part.ids, part.shifted(1)) + U(3)) & U(self.cells - 1)).astype(np.int64)

    def often(self, part: Corpus) -> np.ndarray:
        """For each word whether it and the next make a pair that may occur often."""
        out = part.left >= 2
        if self.bits is not None:
            at = self.place(part)
            out &= (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)
        return out


def sketch_pairs(texts: DataFrame, cells: int, least: int, seed: int) -> Pairs:
    """Counts of all pairs by cells: one sketch per task, its blocks added with those of the others."""
    if least > 255:
        raise ValueError("cells count to 255")
    pairs = Pairs(cells)

    def fill(batches):
        total = np.zeros(cells, np.uint8)
        for batch in batches:
            for part, _ in stretches(batch, seed):
                at, counts = np.unique(pairs.place(part)[part.left >= 2], return_counts=True)
                total[at] = np.minimum(255, total[at] + np.minimum(255, counts)).astype(np.uint8)
        for block in range(0, cells, BLOCK_CELLS):
            part = total[block : block + BLOCK_CELLS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block // BLOCK_CELLS]), pa.array([zlib.compress(part.tobytes(), 1)])], names=["block", "cells"])

    def add(batches):
        block, total = None, None

        def done():
            bits = np.packbits(total >= least, bitorder="little")
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bits.tobytes()])], names=["block", "cells"])

        for batch in batches:
            for k, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != block:
                    if block is not None:
                        yield done()
                    block, total = k, np.zeros(BLOCK_CELLS, np.uint32)
                total += np.frombuffer(zlib.decompress(cell), np.uint8)
        if block is not None:
            yield done()

    schema = "block long, cells binary"
    merged = texts.mapInArrow(fill, schema).repartition("block").sortWithinPartitions("block").mapInArrow(add, schema)
    bits = np.zeros(cells // 8, np.uint8)
    for r in merged.toLocalIterator():  # a bit for each cell: 16 MB at most
        bits[r.block * BLOCK_CELLS // 8 :][: BLOCK_CELLS // 8] = np.frombuffer(r.cells, np.uint8)
    return Pairs(cells, bits)


class Prefixes:
    """The prefixes of one word, two words, ... that begin more suffixes than a group may hold."""

    def __init__(self, groups: int):
        self.groups, self.heavy = groups, []

    def hashes(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """Hash of the first word, of the first two, ..."""
        out = [words[0]]
        for w in words[1:]:
            out.append(pair_hash(out[-1], w))
        return out

    def is_heavy(self, level: int, hashes: np.ndarray) -> np.ndarray:
        return self.heavy[level](hashes) >= 0 if level < len(self.heavy) else np.zeros(len(hashes), bool)

    def group(self, words: list[np.ndarray]) -> np.ndarray:
        """Group of each suffix: by its shortest prefix that is not heavy, at most the whole."""
        hashes = self.hashes(words)
        key, open_ = hashes[0].copy(), self.is_heavy(0, hashes[0])
        for level in range(1, len(words)):
            open_ &= words[level] != 0
            key[open_] = hashes[level][open_]
            open_ &= self.is_heavy(level, hashes[level])
        return (mix(key + U(5)) % U(self.groups)).astype(np.int64)


def suffixes(part: Corpus, pairs: Pairs) -> list[np.ndarray]:
    """Words of the suffixes of at least two words, a column for each place; 0 where one has ended."""
    often = pairs.often(part)
    at = np.flatnonzero(often)
    columns, on = [part.ids[at], part.shifted(1)[at]], np.ones(len(at), bool)
    for k in range(1, LONGEST - 1):
        on = on & np.concatenate([often[k:], np.zeros(min(k, len(often)), bool)])[at]
        columns.append(np.where(on, part.shifted(k + 1)[at], U(0)))
    return columns


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows once, in order, with the sums of their counts."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def heavy_prefixes(texts: DataFrame, words: DataFrame, pairs: Pairs, total: int, group: int, seed: int) -> Prefixes:
    """Find the prefixes of more than ``group`` suffixes level by level, longer ones only where the shorter are heavy.

    A stretch of SEGMENT words reports a prefix only if it holds the share of it that half a group has of
    all words. What goes unreported is less than half a group in sum, so every prefix of more than a group
    is reported more than half a group of times, and a stretch reports at most 2 * total / group of them.
    """
    prefixes = Prefixes(max(1, -(-total // group)))
    # at most total / group of a level (2 * total / group of later ones), which is bounded by GROUPS
    top = np.array([r.id for r in words.where(F.col("f") > group).select("id").collect()], np.int64).view(U)
    while len(top) and len(prefixes.heavy) < LONGEST - 1:
        prefixes.heavy.append(Lookup(top))
        if len(prefixes.heavy) == LONGEST - 1:
            break
        level = len(prefixes.heavy)

        def count(batches, level=level):
            held, seen = [(np.zeros(0, U), np.zeros(0, np.int64))], 0

            def merged():
                ids, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                return ids, np.bincount(at, np.concatenate([h[1] for h in held]), len(ids)).astype(np.int64)

            def report():
                ids, counts = merged()
                most = counts * (2 * total) >= group * seen
                return pa.RecordBatch.from_arrays([pa.array(ids[most].view(np.int64)), pa.array(counts[most])], names=["id", "f"])

            for batch in batches:
                for part, _ in stretches(batch, seed):
                    hashes = prefixes.hashes(columns := suffixes(part, pairs))
                    found = hashes[level][prefixes.is_heavy(level - 1, hashes[level - 1]) & (columns[level] != 0)]
                    held.append(np.unique(found, return_counts=True))
                    if len(held) > 16:
                        held = [merged()]
                    seen += len(part.ids)
                    if seen >= SEGMENT:
                        yield report()
                        held, seen = [(np.zeros(0, U), np.zeros(0, np.int64))], 0
            if seen:
                yield report()

        counted = texts.mapInArrow(count, "id long, f long").groupBy("id").agg(F.sum("f").alias("f"))
        top = np.array([r.id for r in counted.where(F.col("f") * 2 > group).select("id").collect()], np.int64).view(U)
    return prefixes


def phrase_counts(texts: DataFrame, pairs: Pairs, prefixes: Prefixes, least: int, seed: int) -> DataFrame:
    """Rows (w1, .., w4, f) of the phrases of two words and more with at least ``least`` occurrences; 0 for no word."""
    names = ["group", *IDS, "f"]
    held = 1 << 20

    def deal(batches):
        kept, size = [], 0

        def out():
            columns, counts = summed([np.concatenate(c) for c in zip(*kept, strict=True)][:-1], np.concatenate([k[-1] for k in kept]))
            made = [pa.array(prefixes.group(columns)), *(pa.array(c.view(np.int64)) for c in columns), pa.array(counts)]
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            for part, _ in stretches(batch, seed):
                columns = suffixes(part, pairs)
                kept.append([*columns, np.ones(len(columns[0]), np.int64)])
                size += len(columns[0])
                if size >= held:
                    yield out()
                    kept, size = [], 0
        if kept:
            yield out()

    def subtree(rows: pa.Table) -> pa.Table:
        columns = [rows[n].to_numpy().view(U) for n in IDS]
        leaves, counts = summed(columns, rows["f"].to_numpy())
        hashes = prefixes.hashes(leaves)
        changed = np.ones(len(counts), bool)
        changed[1:] = leaves[0][1:] != leaves[0][:-1]
        nodes = []
        for depth in range(2, LONGEST + 1):
            changed[1:] |= leaves[depth - 1][1:] != leaves[depth - 1][:-1]
            at = np.flatnonzero(changed)
            f = np.add.reduceat(counts, at)
            # below a heavy prefix this group has only a part of the suffixes
            want = (leaves[depth - 1][at] != 0) & ((f >= least) | prefixes.is_heavy(depth - 1, hashes[depth - 1][at]))
            at = at[want]
            nodes.append([leaves[k][at] if k < depth else np.zeros(len(at), U) for k in range(LONGEST)] + [f[want]])
        columns = [np.concatenate(c) for c in zip(*nodes, strict=True)]
        return pa.Table.from_arrays([*(pa.array(c.view(np.int64)) for c in columns[:-1]), pa.array(columns[-1])], names=[*IDS, "f"])

    fields = ", ".join(f"{n} long" for n in names)
    dealt = texts.mapInArrow(deal, fields)
    nodes = dealt.groupBy("group").applyInArrow(subtree, fields.split(", ", 1)[1])
    return nodes.groupBy(*IDS).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _words(values: Column, first: Column | int, count: Column | int) -> list[Column]:
    """Words of a phrase from place ``first``, as the columns of a phrase."""
    part = F.slice(values, first, count)
    return [F.coalesce(F.get(part, F.lit(i)), F.lit(0)).cast("long").alias(n) for i, n in enumerate(IDS)]


def mine_phrases(
    df: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    subsumed: int = SUBSUMED,
    top: int | None = TOP,
    group: int | None = None,
    cells: int | None = None,
) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the phrases of two to four words of each language, best first.

    A-Z are lower-cased, pieces end at BREAKS, words at blanks and tabs. a, l, r: occurrences of the phrase
    and of the two parts of its lowest-scoring cut, n: words of the language; score: SCALE * a / (l + r),
    rounded down. Phrases inside a longer one with at least ``subsumed`` percent of their occurrences are
    left out. ``top`` is how many a language gets, None for all. Null texts are empty, a null language is
    ``und``; repeated rows count each; ties go to the phrase that comes first as UTF-8 bytes. Very long texts
    are cut between pieces. No other column is read, and an empty table has no phrases.
    """
    texts = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    for seed in range(8):
        words = saved(vocabulary(texts, seed), "words")
        if words.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("words with equal hashes under every seed")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.agg(F.sum("f")).first()[0] or 0
    cells = cells or min(MOST_CELLS, max(LEAST_CELLS, 1 << (total // 8).bit_length()))
    pairs = sketch_pairs(texts, cells, least, seed)
    prefixes = heavy_prefixes(texts, words, pairs, total, group or max(GROUP, total // GROUPS), seed)
    phrases = saved(phrase_counts(texts, pairs, prefixes, least, seed), "phrases")
    often = words.where(F.col("f") >= least)
    all_words = F.filter(F.array(*IDS), lambda w: w != 0)
    found = phrases.withColumn("words", all_words).withColumn("size", F.size("words"))
    # a phrase of up to three words by its parts; every part of a phrase occurs as often at least
    none = [F.lit(0).cast("long").alias(n) for n in IDS[1:]]
    counted = phrases.where(F.col(IDS[-1]) == 0).unionByName(often.select(F.col("id").alias("w1"), *none, "f"))
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))

    def counts_of(name: str, first, count) -> DataFrame:
        parts = cut.select("words", "k", *_words(F.col("words"), first, count))
        return parts.join(counted, IDS).select("words", "k", F.col("f").alias(name))

    both = counts_of("l", F.lit(1), F.col("k")).join(counts_of("r", F.col("k") + 1, F.col("size") - F.col("k")), ["words", "k"])
    exact = f"cast({SCALE} as decimal(10,0)) * cast(f as decimal(19,0)) div cast(l + r as decimal(19,0))"
    scored = both.join(found.select("words", "f"), "words").select("words", "f", F.struct(F.expr(exact).alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("words").agg(F.min("f").alias("a"), F.min("cut").alias("cut"))
    inner = found.where("size > 2").select(
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), F.col("size") - 1),
                    lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.slice("words", i, m)),
                )
            )
        ).alias("words"),
        "f",
    )
    longer = inner.groupBy("words").agg(F.max("f").alias("longer"))
    kept = best.join(longer, "words", "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * subsumed, F.lit(True)))
    kept = kept.select("words", F.get("words", F.lit(0)).alias("id"), "a", "cut.l", "cut.r", "cut.score")
    kept = kept.join(often.select("id", "lang"), "id").drop("id")
    by = [F.desc("score"), F.desc("a")]
    if top is not None:
        kept = kept.withColumn("rank", F.rank().over(W.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top).drop("rank")
    spelt = kept.select("words", F.posexplode("words").alias("at", "id")).join(often.select("id", "word"), "id")
    spelt = spelt.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    named = kept.join(spelt, "words").withColumn("phrase", F.array_join("spelt.word", " "))
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by, "phrase")).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS m),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])) AS g
  FROM words, sizes WHERE len(ws) >= m),
counts AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang),
cuts AS (SELECT lang, m, g, f, unnest(range(1, m)) AS k FROM counts WHERE m > 1),
scored AS (
  SELECT c.lang, c.m, c.g, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1:c.m]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
spans AS (SELECT lang, g, m, f, unnest(range(2, m)) AS size FROM counts WHERE m > 2),
inner_phrases AS (SELECT lang, unnest(list_transform(range(1, m - size + 2), lambda i: g[i:i + size - 1])) AS g, f FROM spans),
longer AS (SELECT lang, g, max(f) AS f FROM inner_phrases GROUP BY ALL),
kept AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score
  FROM best b LEFT JOIN longer USING (lang, g) WHERE longer.f IS NULL OR 100 * longer.f < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op11_phrase_mining", SQL)
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))
