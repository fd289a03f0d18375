"""Removal of word windows that stand earlier in the corpus, behind a count-min prefilter.

The sketch counts, for each gram of words, the places where it is the anchor of a window: every
occurrence of a window has its anchor at a place of its own, so the least of its cells is never
below the window's count. Sketches of the tasks are added block by block, and only windows estimated
to be repeated go on to the exact pass (``runs``), which groups them by anchor and content, and
where contents differ by the hash of each window. Cells saturate at two.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom.llm.frame import lists, without
from pixloom.llm.registry import query, table
from pixloom.llm.runs import ROWS, Runs, doc_key, heavy_keys, list_columns, local_rows, merge_ranges, per_document, resolve
from pixloom.llm.suffix_dedup import with_lists, with_spans
from pixloom.llm.text import BLANK_SPLIT, Stretch, U, Words, chunks, joined, mix, ragged

WINDOW, GRAM = 20, 6
BLOCK_CELLS = 1 << 16
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 28  # of both rows; a task gets a bit for each, 32 MB at most
DEPTH = 2


class Sketch:
    """Count-min cells, two rows; ``repeated`` is what the tasks get: one bit for a count of two."""

    def __init__(self, cells: int, bits: np.ndarray | None = None):
        self.cells, self.bits = cells, bits

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        half = U(self.cells // DEPTH)
        return [(mix(hashes + U(row * 0x9E37 + 11)) % half + U(row) * half).astype(np.int64) for row in range(DEPTH)]

    def add_to(self, total: np.ndarray, hashes: np.ndarray) -> None:
        """Count into a task's cells, saturating at two."""
        for at in self.places(hashes):
            at, count = np.unique(at, return_counts=True)
            total[at] = np.minimum(2, total[at] + np.minimum(2, count)).astype(np.uint8)

    @staticmethod
    def blocks(total: np.ndarray):
        """A task's cells, block by block, as bits of at least one and of at least two."""
        for block in range(0, len(total), BLOCK_CELLS):
            part = total[block : block + BLOCK_CELLS]
            if part.any():
                both = np.concatenate([np.packbits(part > k, bitorder="little") for k in (0, 1)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block // BLOCK_CELLS], pa.int64()), pa.array([both.tobytes()], pa.binary())], names=["block", "cells"]
                )

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            out &= (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)
        return out


def anchors(words: Words, window: int, gram: int) -> np.ndarray:
    """Gram hash at each place that is the anchor of a window of one text."""
    runs = Runs(words.hash, words.bounds, window, gram)
    width = window - gram + 1
    grams = runs.seq.every(gram)
    # per run, the places inside it that hold its anchor
    size = runs.hi + width - runs.lo
    at = ragged(runs.lo, size)
    at = np.unique(at[grams[at] == np.repeat(runs.anchor, size)])
    return grams[at]


def merge_counts(parts: DataFrame, cells: int) -> Sketch:
    """Add the tasks' sketches (block, cells), equal blocks together, one at a time in each task."""

    def add(batches):
        block, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([twice.tobytes()], pa.binary())], names=["block", "cells"]
            )

        for batch in batches:
            for k, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one, two = np.frombuffer(cell.as_buffer(), np.uint8).reshape(2, -1)
                if k != block:
                    if block is not None:
                        yield done()
                    block, once, twice = k, one.copy(), two.copy()
                else:
                    twice |= two | (once & one)
                    once |= one
        if block is not None:
            yield done()

    blocks = parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, cells binary")
    bits = np.zeros(cells // 8, np.uint8)
    for r in blocks.toLocalIterator():  # one bit a cell: 32 MB at most
        bits[r.block * BLOCK_CELLS // 8 : (r.block + 1) * BLOCK_CELLS // 8] = np.frombuffer(r.cells, np.uint8)
    return Sketch(cells, bits)


def count_windows(texts: DataFrame, cells: int, window: int, gram: int) -> Sketch:
    """Sketch of all texts: one per task, cut into blocks, equal blocks added."""
    sketch = Sketch(cells)

    def fill(batches):
        total = np.zeros(cells, np.uint8)
        for batch in batches:
            data, offsets = joined(batch.column(1))
            for a, b in chunks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BLANK_SPLIT)
                sketch.add_to(total, anchors(words, window, gram))
        yield from sketch.blocks(total)

    return merge_counts(texts.mapInArrow(fill, "block long, cells binary"), cells)


def size_of(texts: DataFrame) -> int:
    """Cells: about four for each anchor, between the two bounds."""
    n = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << int(n // 50 * 4).bit_length()))


def removed_windows(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, cells: int | None = None
) -> DataFrame:
    """Rows (doc, lo, hi): ranges of starts of windows whose words also start earlier."""
    texts = df.select(doc_key(doc_id).alias("doc"), F.col(text).alias("text"))
    sketch = count_windows(texts, cells or size_of(texts), window, gram)

    def rows_with(heavy):
        def rows(batches):
            for batch in batches:
                doc, (data, offsets) = batch.column(0).to_numpy(), joined(batch.column(1))
                parts = []
                for a, b in chunks(offsets):
                    words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BLANK_SPLIT)
                    r = Runs(words.hash, words.bounds, window, gram, wanted=sketch.repeated, heavy=heavy)
                    base = words.bounds[:-1][r.text]
                    parts.append((r.anchor, r.content, doc[a:b][r.text], r.lo - base, r.hi - base, r.inner))
                yield local_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))

        return rows

    heavy = heavy_keys(texts, rows_with(None), "doc")
    found = per_document(resolve(texts.mapInArrow(rows_with(heavy), ROWS)))

    def windows(batches):
        """Copies found by content as ranges, the other windows one by one under their own hash."""
        for batch in batches:
            doc, (data, offsets) = batch.column("__doc").to_numpy(), joined(batch.column(text))
            lengths, f = list_columns(batch.column("__found"))
            begin = np.cumsum(lengths) - lengths
            single, copies = [], []
            for a, b in chunks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BLANK_SPLIT)
                first, second = Stretch(words.hash), Stretch(mix(words.hash + U(1)))
                mine = slice(begin[a], begin[b - 1] + lengths[b - 1])
                owner = np.repeat(np.arange(b - a), lengths[a:b])
                lo, hi, copy = (f[c][mine] for c in ("lo", "hi", "copy"))
                one = ~copy
                size = (hi - lo + 1)[one].astype(np.int64)
                start = ragged(lo[one].astype(np.int64), size)
                which = np.repeat(owner[one], size)
                at = start + words.bounds[which]
                ok = at + window <= words.bounds[which + 1]  # always, where an id names one text
                start, which, at = start[ok], which[ok], at[ok]
                single.append((first.of(at, at + window), second.of(at, at + window), doc[a:b][which], start, start, np.zeros(len(at), bool)))
                for i in np.unique(owner[copy]):
                    its = copy & (owner == i)
                    x, y = merge_ranges(lo[its].astype(np.int64), hi[its].astype(np.int64))
                    copies.append((np.full(len(x), doc[a + i]), x, y))
            # a window common to many texts is sent on once a batch
            yield local_rows(*(np.concatenate(x) for x in zip(*single, strict=True)))
            if copies:
                docs, lo, hi = (np.concatenate(x) for x in zip(*copies, strict=True))
                key = pa.array(mix(docs.view(U) + lo.astype(U)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [key, key, pa.array(docs), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()),
                     pa.array(np.zeros(len(docs), bool)), pa.array(np.ones(len(docs), bool))],
                    names=["key", "content", "doc", "lo", "hi", "inner", "copy"],
                )

    single = with_lists(df, found, doc_id).mapInArrow(windows, ROWS)
    return resolve(single, finest=True).select("doc", "lo", "hi")


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("removed", T.ArrayType(T.LongType())),
    T.StructField("kept_text", T.StringType()),
]


def remove_windows(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
    cells: int | None = None, digest: bool = False,
) -> DataFrame:
    """Add word counts, the removed word ranges (start, end, ...) and the words that stay, one space apart.

    A word goes if a window of ``window`` words that covers it also starts earlier (smaller doc_id,
    or an earlier start in the same text); the input decides. Words are runs of anything but ASCII
    white space. Null texts have no words; null ids come first and form one document; rows that
    repeat a doc_id are one document, each keeping what its first occurrence keeps, so an id must
    name one text. Columns with the names of the results are replaced. ``digest`` gives
    ``kept_sha256`` in place of text, ranges and words.
    """
    df = without(df, [f.name for f in FIELDS] + ["kept_sha256", "__doc", "__found", "__spans"])
    spans = removed_windows(df, doc_id=doc_id, text=text, window=window, gram=gram, cells=cells)
    both = with_spans(df, spans, doc_id)
    names = [c for c in df.columns if not (digest and c == text)]
    fields = FIELDS[:2] + [T.StructField("kept_sha256", T.StringType())] if digest else FIELDS
    schema = T.StructType([df.schema[c] for c in names] + fields)

    def run(batches):
        for batch in batches:
            data, offsets = joined(batch.column(text))
            lengths, f = list_columns(batch.column("__spans"))
            begin = np.cumsum(lengths) - lengths
            count, total, ranges, left = [], [], [], []
            for a, b in chunks(offsets):
                piece = data[offsets[a] : offsets[b]]
                words = Words(piece, offsets[a : b + 1] - offsets[a], BLANK_SPLIT, None)
                padded = np.concatenate([piece, np.full(1, 32, np.uint8)])
                for i in range(a, b):
                    first, n = words.bounds[i - a], int(words.counts[i - a])
                    lo, hi = merge_ranges(*(f[c][begin[i] : begin[i] + lengths[i]].astype(np.int64) for c in ("lo", "hi")))
                    lo, hi = merge_ranges(lo, np.minimum(hi + window, n) - 1)
                    keep = np.ones(n, bool)
                    keep[ragged(lo, hi - lo + 1)] = False
                    at = np.flatnonzero(keep) + first
                    start, size = words.start[at], words.end[at] - words.start[at] + 1
                    raw = padded[ragged(start, size)]  # each word and what follows it: a space instead
                    raw[np.cumsum(size) - 1] = 32
                    raw = raw[:-1].tobytes()
                    count.append(n)
                    total.append(n - len(at))
                    ranges.append(np.stack([lo, hi + 1], axis=1).ravel())
                    left.append(hashlib.sha256(raw).hexdigest() if digest else raw.decode())
            out = [pa.array(count, pa.int64()), pa.array(total, pa.int64())]
            if not digest:
                flat = np.concatenate(ranges) if ranges else np.zeros(0, np.int64)
                out.append(lists(flat, [len(r) for r in ranges], pa.int64()))
            out.append(pa.array(left, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + out, names=schema.names)

    return both.mapInArrow(run, schema)


@query("op5_window_dedup")
def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
