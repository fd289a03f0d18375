"""Jaccard join of word n-gram sets by partitioning the universe.

Sets are cut into segments by the hash of their elements; how many depends on the band of sizes.
Two sets as similar as asked for differ in at most H elements (the bound of the band), so of
H + 1 + slack segments at least slack + 1 agree, and each set is indexed under every segment that is
not empty. A set with more empty segments than the slack could agree in empty ones only: it is
indexed under the one-deletion neighbourhood of its segments too, each of which makes up for one
empty segment, and, should those not suffice, under its least elements. The slack of a band is
allocated by cost: indexed segments against the expected number of neighbourhoods. Candidates are
verified on the texts.

Segments shared by the same sets become one. Sets that share a segment are first compared with one of
them only, the set with most shared segments; what that leaves in different components is compared in
a second pass. Equal sets of one batch stand for each other.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.llm.connect import components
from pixloom.llm.frame import saved, without
from pixloom.llm.registry import query, table
from pixloom.llm.text import BLANK_SPLIT, LOWER_VALUES, Stretch, U, Words, chunks, joined, mix, ragged
from pixloom.llm.window_dedup import LEAST_CELLS, MOST_CELLS, Sketch, merge_counts

SHINGLE, PERCENT = 4, 85
BAND_RATIO = 1.4
PARITY = tuple(f"p{i}" for i in range(8))  # 512 parities in eight whole numbers
INFO = "doc long, n long, s1 long, s2 long, bits binary, " + ", ".join(f"{p} long" for p in PARITY)


@lru_cache(maxsize=None)
def bands(percent: int, upto: int) -> list[tuple[int, int, int, int]]:
    """Bands of set sizes: least, most, segments, slack; as far as ``upto``."""
    out, low = [], 1
    while low <= upto or not out:
        high = max(low, int(low * BAND_RATIO))
        # |A| + |B| is at most this where the smaller lies in the band; I >= p/(100+p) of it
        both = high + high * 100 // percent
        differ = (100 - percent) * both // (100 + percent)
        out.append((low, high, *allocate(differ, (low + high) / 2)))
        low = high + 1
    return out


def allocate(differ: int, size: float) -> tuple[int, int]:
    """Segments and slack of least cost: rows for the segments, and neighbourhoods where too many are empty."""
    if differ == 0:
        return 1, 0
    best = (math.inf, 0, 0)
    for slack in range(differ + 3):
        m = differ + 1 + slack
        empty = m * math.exp(-size / m)
        enough, term = 0.0, math.exp(-empty)
        for k in range(slack + 1):
            enough += term
            term *= empty / (k + 1)
        cost = m - empty + max(0.0, 1 - enough) * 2 * size
        best = min(best, (cost, m, slack))
    return best[1:]


def by_row(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """The order by row, then by value; equal ones may stand in any order."""
    if rows > 1 << 16:
        return np.lexsort((value, row))
    order = np.argsort(value)
    return order[np.argsort(row[order].astype(np.uint16), kind="stable")]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of consecutive texts, and how many each text has."""
    words = Words(data, offsets, BLANK_SPLIT, LOWER_VALUES)
    hashes, inside, seq = words.windows(shingle)
    at = np.flatnonzero(inside)
    few = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    short = seq.of(words.bounds[few], words.bounds[few + 1]) if len(few) else np.zeros(0, U)
    text = np.concatenate([words.text[at], few])
    value = np.concatenate([hashes[at], short])
    order = by_row(text, value, len(offsets) - 1)
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(text[new], minlength=len(offsets) - 1)


def identity(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    ends = np.cumsum(sizes)
    out = []
    for seed in (1, 2):
        sums = np.concatenate([[U(0)], np.cumsum(mix(values + U(seed)), dtype=U)])
        out.append(mix(sums[ends] - sums[ends - sizes] + sizes.astype(U)))
    return out[0], out[1]


def signatures(values: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of consecutive sets and the set of each."""
    table_ = bands(percent, int(sizes.max(initial=1)))
    low, high, segments, slack = (np.array(x, np.int64) for x in zip(*table_, strict=True))
    own = np.searchsorted(low, np.maximum(1, sizes), "right") - 1
    least = np.searchsorted(high, -(-sizes * percent // 100), "left")  # the lowest band of a smaller partner
    count = np.where(sizes > 0, own - least + 1, 0)
    who = np.repeat(np.arange(len(sizes)), count)
    band = ragged(least, count)
    m = segments[band]
    # partners of this band's sizes differ in less than its bound allows: fewer segments are enough
    partner = np.minimum(high[band], sizes[who]) + np.where(sizes[who] > high[band], sizes[who], sizes[who] * 100 // percent)
    need = np.minimum(m, (100 - percent) * partner // (100 + percent) + 1 + slack[band])
    base = np.cumsum(m) - m
    begin = np.cumsum(sizes) - sizes
    element = values[ragged(begin[who], sizes[who])]
    entry = np.repeat(np.arange(len(who)), sizes[who])
    spread = mix(element + U(99))
    segment = (spread % m[entry].astype(U)).astype(np.int64)
    at = base[entry] + segment
    used = np.flatnonzero(segment < need[entry])
    order = used[np.argsort(at[used])]
    ordered = at[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    filled, held = ordered[first], np.diff(np.append(first, len(ordered)))
    strong = mix(element + U(7))[order]
    sums = np.add.reduceat(strong, first) if len(first) else np.zeros(0, U)
    of = np.searchsorted(base, filled, "right") - 1
    place = mix((filled - base[of]).astype(U) * U(0x2545F4914F6CDD1D) + mix(band[of].astype(U) + U(1)))
    keys, owner = [mix(sums + place)], [who[of]]
    empty = need - np.bincount(of, minlength=len(who))
    sparse = empty > slack[band]
    if sparse.any():
        some = sparse[of]
        each = ragged(first[some], held[some])
        less = np.repeat(sums[some], held[some]) - strong[each]
        keys.append(mix(less + np.repeat(place[some], held[some])))
        owner.append(np.repeat(who[of[some]], held[some]))
        for i in np.unique(who[sparse]):
            mine = np.sort(mix(values[begin[i] : begin[i] + sizes[i]] + U(99)))
            prefix = mine[: int(sizes[i] - -(-sizes[i] * percent // 100) + 1)]
            keys.append(mix(prefix + U(0xABCDEF)))
            owner.append(np.full(len(prefix), i))
    return np.concatenate(keys), np.concatenate(owner)


def parity(values: np.ndarray, size: int) -> bytes:
    """Parities of a set's hashes: bits in which two differ are at most their differing elements."""
    cells = 1 << max(6, int(2 * size - 1).bit_length()) if size else 64
    counts = np.bincount((mix(values + U(3)) & U(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def short_parity(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parities of each set, as rows of as many whole numbers as PARITY has."""
    row, cells = np.repeat(np.arange(len(sizes)), sizes), 64 * len(PARITY)
    cell = (mix(values + U(5)) & U(cells - 1)).astype(np.int64)
    odd = np.bincount(row * cells + cell, minlength=len(sizes) * cells).reshape(-1, cells) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def differing(a: bytes, b: bytes) -> int:
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    size = len(a) * 8
    while size > len(b) * 8:
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def similar(texts_a, texts_b, shingle: int, percent: int) -> np.ndarray:
    """Whether the sets of two text columns reach the similarity, row by row."""
    da, oa = joined(texts_a)
    db, ob = joined(texts_b)
    out = np.zeros(len(oa) - 1, bool)
    for a, b in chunks(oa + ob):
        va, na = shingle_sets(da[oa[a] : oa[b]], oa[a : b + 1] - oa[a], shingle)
        vb, nb = shingle_sets(db[ob[a] : ob[b]], ob[a : b + 1] - ob[a], shingle)
        row = np.concatenate([np.repeat(np.arange(b - a), na), np.repeat(np.arange(b - a), nb)])
        value = np.concatenate([va, vb])
        order = by_row(row, value, b - a)
        row, value = row[order], value[order]
        twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
        shared = np.bincount(row[1:][twice], minlength=b - a)
        out[a:b] = (shared > 0) & (100 * shared >= percent * (na + nb - shared))
    return out


def jaccard_components(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of all rows of ``df``.

    Two texts link when 100 * shared >= percent * united of their sets of distinct ``shingle``-word
    sequences (ASCII letters lower-cased; a text of fewer words is one sequence). The component is
    the least doc_id reachable. Null, empty and blank texts have no set and link with nothing; rows
    without doc_id are counted but not linked (component NULL); rows that repeat a doc_id are one
    document whose links are those of all of them.
    """
    texts = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))

    def describe(batches):
        for batch in batches:
            data, offsets = joined(batch.column(1))
            parts, bits = [], []
            for a, b in chunks(offsets):
                values, sizes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                ends = np.cumsum(sizes)
                parts.append((sizes, *identity(values, sizes), short_parity(values, sizes)))
                bits += [parity(values[e - n : e], n) for e, n in zip(ends, sizes, strict=True)]
            n, s1, s2, short = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(bits, pa.binary()), *(pa.array(np.ascontiguousarray(c)) for c in short.T)],
                names=["doc", "n", "s1", "s2", "bits", *PARITY],
            )

    info = saved(texts.mapInArrow(describe, INFO), "sets")
    known = info.where("doc IS NOT NULL AND n > 0")
    one = known.groupBy("doc").agg(F.max(F.struct("n", "bits", *PARITY)).alias("x")).select("doc", "x.*")
    links = pairs_of(texts.where("doc IS NOT NULL"), info, one, shingle, percent)
    # equal sets are one class, of which only some documents were linked: what a class or a repeated id
    # holds together is joined once more, so that all classes of a root get the least document
    linked = known.select("doc", "s1", "s2").join(links.select(F.col("node").alias("doc"), "root"), "doc", "left")
    held = saved(linked.select("s1", "s2", F.coalesce("root", "doc").alias("id")).distinct(), "held")
    classes = held.groupBy("s1", "s2").agg(F.min("id").alias("low"))
    ties = held.join(classes, ["s1", "s2"]).where("id > low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    least = components(ties).select(F.col("node").alias("low"), F.col("root").alias("component"))
    classes = classes.join(least, "low", "left").select("s1", "s2", F.coalesce("component", "low").alias("component"))
    labelled = info.join(classes, ["s1", "s2"], "left")
    return labelled.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc"))).alias("component_id"),
    )


def index_rows(texts: DataFrame, shingle: int, percent: int, cells: int) -> DataFrame:
    """Rows (key, doc) under which sets are indexed, less those a sketch shows to be met only once."""

    def entries(batch):
        doc, (data, offsets) = batch.column(0).to_numpy(), joined(batch.column(1))
        seen: set[tuple[int, int]] = set()
        for a, b in chunks(offsets):
            values, sizes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
            s1, s2 = identity(values, sizes)
            keep = np.zeros(b - a, bool)
            for i, x in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                if sizes[i] and x not in seen:
                    seen.add(x)
                    keep[i] = True
            keys, owner = signatures(values[np.repeat(keep, sizes)], sizes[keep], percent)
            yield keys, doc[a:b][keep][owner]

    sketch = Sketch(cells)

    def count(batches):
        total = np.zeros(cells, np.uint8)
        for batch in batches:
            for keys, _ in entries(batch):
                sketch.add_to(total, keys)
        yield from sketch.blocks(total)

    sketch = merge_counts(texts.mapInArrow(count, "block long, cells binary"), cells)

    def index(batches):
        for batch in batches:
            for keys, doc in entries(batch):
                often = sketch.repeated(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(doc[often])], names=["key", "doc"])

    return texts.mapInArrow(index, "key long, doc long")


def pairs_of(texts: DataFrame, info: DataFrame, one: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Components (node, root) of the linked documents."""
    total = info.agg(F.sum("n")).first()[0] or 0
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << int(total).bit_length() - 1 if total else 0))
    rows = saved(index_rows(texts, shingle, percent, cells), "rows")
    # keys of the same documents become one, named by these; should two names be equal, more is compared in vain
    same = F.bit_xor(F.xxhash64("doc")).alias("same")
    often = rows.groupBy("key").agg(F.count("*").alias("met"), F.min("doc").alias("low"), F.max("doc").alias("high"), same)
    often = often.where("low < high").select("key", "met", F.xxhash64("met", "low", "high", "same").alias("group"))
    shared = saved(rows.join(often, "key").select(F.col("group").alias("key"), "doc", "met").distinct(), "index")
    weight = shared.groupBy("doc").agg(F.sum("met").alias("weight"))
    members = saved(shared.select("key", "doc").join(weight.join(one.select("doc", "n"), "doc"), "doc"), "members")
    # texts of the sets that share a segment with another
    some = saved(texts.join(members.select("doc").distinct(), "doc", "left_semi"), "texts")

    def fits(a: str, b: str):
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    hub = members.groupBy("key").agg(F.max(F.struct("weight", -F.col("doc"), "n")).alias("h"))
    first = (
        members.join(hub.select("key", (-F.col("h.col2")).alias("hub"), F.col("h.n").alias("hub_n")), "key")
        .where((F.col("hub") != F.col("doc")) & fits("n", "hub_n"))
        .select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b"))
        .distinct()
    )
    first = saved(first, "pairs")
    links = saved(verified(first, one, some, shingle, percent), "links")
    roots = saved(components(links), "roots")
    # what the first pass left in different components, though a segment is shared
    placed = members.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    left = placed.join(mixed, "key", "left_semi").select("key", "doc", "root")
    left = saved(left.join(one.select("doc", "n", *PARITY), "doc"), "left")
    x, y = (left.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "root", *PARITY))) for s in "xy")
    # parities that differ too often rule a pair out inside the join
    differ = sum((F.bit_count(F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y"))) for p in PARITY), F.lit(0))
    second = (
        x.join(y, "key")
        .where((F.col("root_x") < F.col("root_y")) & fits("n_x", "n_y"))
        .where(differ * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent))
        .select(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    more = saved(verified(second, one, some, shingle, percent), "links")
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def verified(pairs: DataFrame, one: DataFrame, some: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that do link: parities first, then the texts."""

    def likely(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            most = (100 - percent) * (na + nb) // (100 + percent)
            differ = [differing(p, q) for p, q in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)]
            keep = pa.array(np.array(differ, np.int64) <= most)
            yield batch.select(["a", "b"]).filter(keep)

    def exact(batches):
        for batch in batches:
            keep = similar(batch.column("ta"), batch.column("tb"), shingle, percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    a = one.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("bits").alias("pa"))
    b = one.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("pb"))
    near = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(likely, "a long, b long")
    ta = some.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    tb = some.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    return near.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long").distinct()


def keep_one(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` whose doc_id is the least of their component, or that have no words or id."""
    found = jaccard_components(df, **options)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return without(df, []).join(gone, "doc_id", "left_anti")


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
