"""Removal of byte strings that stand earlier in the corpus, by longest-previous-factor arrays.

Anchored runs (``runs``) leave the stretches of text whose windows may have an earlier match. These
are dealt out by anchor and, in each task, joined in corpus order and sorted as suffixes by
doubling. The previous and the next entry in suffix order that stand earlier in the text give the
longest earlier match of every position; where it reaches the window, the window's bytes go.
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
from pixloom.llm.runs import ROWS, Runs, doc_key, heavy_keys, list_columns, local_rows, merge_ranges, per_document, resolve, whole_groups
from pixloom.llm.text import BYTE_VALUES, CHUNK, chunks, joined, ragged

WINDOW, GRAM = 100, 32
PIECES = "key long, doc long, lo int, hi int, piece binary"
SPANS = "doc long, lo int, hi int"


def ranks(seq: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of all stretches of 1, 2, 4, ... symbols, up to more than half of ``depth``."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    out, width = [rank.astype(np.int64)], 1
    while width * 2 <= depth:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = out[-1][width:] + 1
        key = out[-1] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        out.append(rank)
        width *= 2
    return out


def smaller_before(position: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before it with a smaller value, or -1; by pointer jumping."""
    n = len(position)
    at = np.arange(-1, n - 1)
    value = np.append(position, -1)  # entry -1
    at = np.append(at, -1)
    left = np.flatnonzero(value[at[:n]] > position)
    while len(left):
        at[left] = at[at[left]]
        left = left[value[at[left]] > position[left]]
    return at[:n]


def longest_previous_factor(seq: np.ndarray, cap: int) -> np.ndarray:
    """Length, up to ``cap``, of the longest match of each suffix with one that starts earlier."""
    n = len(seq)
    if not n:
        return np.zeros(0, np.int64)
    levels = ranks(seq, cap)
    width = 1 << (len(levels) - 1)
    tail = np.zeros(n, np.int64)
    if cap > width:
        tail[: max(0, n - cap + width)] = levels[-1][cap - width :] + 1
    order = np.argsort(levels[-1] * (n + 1) + tail, kind="stable")  # equal heads: in text order

    def common(a, b):
        """Common prefix of the suffixes at a and b, capped; b may be absent (-1)."""
        length = np.zeros(len(a), np.int64)
        live = b >= 0
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + length, b + length
            ok = live & (x < n) & (y < n)
            same = np.zeros(len(a), bool)
            same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
            length += np.where(same, 1 << k, 0)
        return length

    out = np.zeros(n, np.int64)
    before = smaller_before(order)
    after = smaller_before(order[::-1])[::-1]
    after = np.where(after < 0, -1, n - 1 - after)
    for near in (before, after):
        other = np.where(near < 0, -1, order[near])
        out[order] = np.maximum(out[order], common(order, other))
    return np.minimum(out, cap)


def earlier_windows(docs, lo, hi, pieces: list[bytes], window: int):
    """Ranges of window starts of the pieces that match an earlier one of them."""
    order = np.lexsort((lo, docs))
    keep = np.ones(len(order), bool)
    keep[1:] = (docs[order[1:]] != docs[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]])
    order = order[keep]
    docs, lo, hi = docs[order], lo[order], hi[order]
    sizes = np.array([len(pieces[i]) for i in order], np.int64)
    end = np.cumsum(sizes + 1)
    seq = np.frombuffer(b"".join(x for i in order for x in (pieces[i], b"\0")), np.uint8).astype(np.int64)
    seq[end - 1] = 256 + np.arange(len(end))  # a stop of its own for each piece
    found = longest_previous_factor(seq, window) >= window
    edge = np.diff(found.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    owner = np.searchsorted(end, first, "right")
    shift = lo[owner] - (end - sizes - 1)[owner]
    return docs[owner], first + shift, last + shift


def removed_spans(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows (doc, lo, hi): ranges of starts of ``window``-byte strings that also start earlier."""
    texts = df.select(doc_key(doc_id).alias("doc"), F.col(text).alias("text"))

    def rows_with(heavy):
        def rows(batches):
            for batch in batches:
                doc, (data, offsets) = batch.column(0).to_numpy(), joined(batch.column(1))
                parts = []
                for a, b in chunks(offsets):
                    # a long text in slices, each with the windows that start in it
                    for at in range(0, max(1, offsets[b] - offsets[a]), CHUNK) if b == a + 1 else [0]:
                        end = min(offsets[b], offsets[a] + at + CHUNK + window - 1) if b == a + 1 else offsets[b]
                        piece = data[offsets[a] + at : end]
                        bounds = np.array([0, len(piece)]) if b == a + 1 else offsets[a : b + 1] - offsets[a]
                        r = Runs(BYTE_VALUES[piece], bounds, window, gram, heavy=heavy)
                        base = bounds[:-1][r.text] - at
                        parts.append((r.anchor, r.content, doc[a:b][r.text], r.lo - base, r.hi - base, r.inner))
                yield local_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))

        return rows

    heavy = heavy_keys(texts, rows_with(None), "doc")
    found = per_document(resolve(texts.mapInArrow(rows_with(heavy), ROWS)))

    def pieces(batches):
        for batch in batches:
            doc, (data, offsets) = batch.column("__doc").to_numpy(), joined(batch.column(text))
            lengths, f = list_columns(batch.column("__found"))
            owner = np.repeat(np.arange(len(doc)), lengths)
            one = ~f["copy"]
            start, stop = offsets[owner[one]] + f["lo"][one], np.minimum(offsets[owner[one] + 1], offsets[owner[one]] + f["hi"][one] + window)
            out = [(f["key"][one], doc[owner[one]], f["lo"][one], f["hi"][one], [data[s:e].tobytes() for s, e in zip(start, stop, strict=True)])]
            begin = np.cumsum(lengths) - lengths
            for i in range(len(doc)):
                mine = slice(begin[i], begin[i] + lengths[i])
                lo, hi = merge_ranges(f["lo"][mine][f["copy"][mine]], f["hi"][mine][f["copy"][mine]])
                if len(lo):
                    out.append((np.full(len(lo), doc[i]), np.full(len(lo), doc[i]), lo, hi, [None] * len(lo)))
            key, docs, lo, hi, cut = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x), t) for x, t in ((key, pa.int64()), (docs, pa.int64()), (lo, pa.int32()), (hi, pa.int32()))]
                + [pa.array([x for c in cut for x in c], pa.binary())],
                names=["key", "doc", "lo", "hi", "piece"],
            )

    def compare(batches):
        for t in whole_groups(batches, 8_000):
            done = t["piece"].is_null().to_numpy()
            doc, lo, hi = (t[c].to_numpy() for c in ("doc", "lo", "hi"))
            parts = [(doc[done], lo[done], hi[done])]
            if not done.all():
                bytes_ = t["piece"].drop_null().to_pylist()
                parts.append(earlier_windows(doc[~done], lo[~done].astype(np.int64), hi[~done].astype(np.int64), bytes_, window))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x), k) for x, k in zip(zip(*parts, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)],
                names=["doc", "lo", "hi"],
            )

    cut = with_lists(df, found, doc_id).mapInArrow(pieces, PIECES)
    return cut.repartition("key").sortWithinPartitions("key").mapInArrow(compare, SPANS)


def with_lists(df: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """Rows that have a list ``__found``. All columns stay, so that ``with_spans`` can use the same shuffle of ``df``."""
    lists_ = found.select(F.col("doc").alias("__doc"), F.col("found").alias("__found"))
    return df.withColumn("__doc", doc_key(doc_id)).join(lists_, "__doc")


def with_spans(df: DataFrame, spans: DataFrame, doc_id: str) -> DataFrame:
    """Each row with the ranges of its document as a list ``__spans`` (null: none)."""
    ranges = spans.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("lo", "hi")).alias("__spans"))
    return df.withColumn("__doc", doc_key(doc_id)).join(ranges, "__doc", "left").drop("__doc")


FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("removed", T.ArrayType(T.LongType())),
    T.StructField("kept_bytes", T.BinaryType()),
]


def remove_repeats(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, digest: bool = False
) -> DataFrame:
    """Add byte counts, the removed ranges (start, end, start, end, ...) and the bytes that stay.

    Every byte covered by a ``window``-byte string that also starts earlier (smaller doc_id, or an
    earlier start in the same text) is removed; the input decides, not what is left. Null texts are
    empty; null ids come first and form one document; rows that repeat a doc_id are one document,
    each keeping what its first occurrence keeps, so an id must name one text. Columns with the names
    of the results are replaced. ``digest`` gives ``kept_sha256`` in place of text and bytes.
    """
    df = without(df, [f.name for f in FIELDS] + ["kept_sha256", "__doc", "__found", "__spans"])
    spans = removed_spans(df, doc_id=doc_id, text=text, window=window, gram=gram)
    both = with_spans(df, spans, doc_id)
    names = [c for c in df.columns if not (digest and c == text)]
    fields = FIELDS[:3] + [T.StructField("kept_sha256", T.StringType())] if digest else FIELDS
    schema = T.StructType([df.schema[c] for c in names] + fields)

    def run(batches):
        for batch in batches:
            data, offsets = joined(batch.column(text))
            lengths, f = list_columns(batch.column("__spans"))
            begin = np.cumsum(lengths) - lengths
            total, runs, ranges, left = [], [], [], []
            for i, n in enumerate(lengths):
                raw = data[offsets[i] : offsets[i + 1]]
                lo, hi = merge_ranges(*(f[c][begin[i] : begin[i] + n].astype(np.int64) for c in ("lo", "hi")))
                lo, hi = merge_ranges(lo, np.minimum(hi + window, len(raw)) - 1)
                if len(lo):
                    gone = np.zeros(len(raw), bool)
                    gone[ragged(lo, hi - lo + 1)] = True
                    raw = raw[~gone]
                total.append(offsets[i + 1] - offsets[i] - len(raw))
                runs.append(len(lo))
                ranges.append(np.stack([lo, hi + 1], axis=1).ravel())
                left.append(hashlib.sha256(raw.tobytes()).hexdigest() if digest else raw.tobytes())
            out = [pa.array(np.diff(offsets), pa.int64()), pa.array(total, pa.int64()), pa.array(runs, pa.int64())]
            if digest:
                out.append(pa.array(left, pa.string()))
            else:
                flat = np.concatenate(ranges) if ranges else np.zeros(0, np.int64)
                out += [lists(flat, [len(r) for r in ranges], pa.int64()), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + out, names=schema.names)

    return both.mapInArrow(run, schema)


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
