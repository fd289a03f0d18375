"""Repeated windows by way of anchored runs, shared by the byte and the word deduplication.

The anchor of a window is the least hash of the grams in it, so equal windows have equal anchors
wherever they stand. Consecutive windows of one anchor form a run; runs are grouped by anchor:

* a run whose whole content also stands earlier is a copy in all its windows: nothing to compare;
* an anchor met once needs no look at all;
* the first runs of an anchor with several contents (or one that repeats inside) are compared
  window by window, from the text.

Within a batch only the first run of each content is sent on, so an exact copy in a third of all
texts costs one row a batch. Anchors that a sample finds most often are split: their windows are
grouped by their own hash. A text is known by its doc_id: null ids form one document, and rows of
one id count as one text, so that repeated rows do not remove each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom.llm.text import Stretch, U, mix, sliding_min

NO_ID = -(1 << 63)
ROWS = "key long, content long, doc long, lo int, hi int, inner boolean, copy boolean"
FOUND = "key long, doc long, lo int, hi int, copy boolean"
SAMPLE, HEAVY_SEEN, HEAVY_KEYS = 32, 64, 20_000


def doc_key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


class Runs:
    """Runs over a sequence of symbols; ``bounds`` are the starts of the texts and the end."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int, wanted=None, heavy=None):
        seq = Stretch(symbols)
        grams = seq.every(gram)
        width = window - gram + 1
        least = sliding_min(grams, width)
        n = len(least)
        self.window, self.seq = window, seq
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
        valid = np.arange(n) + window <= bounds[1:][text] if n else np.zeros(0, bool)
        if wanted is not None:
            valid &= wanted(least)
        first, last = valid.copy(), valid.copy()
        if n > 1:
            change = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            first[1:] &= change | ~valid[:-1]
            last[:-1] &= change | ~valid[1:]
        self.lo, self.hi = np.flatnonzero(first), np.flatnonzero(last)
        self.anchor, self.text = least[self.lo], text[self.lo]
        self.content = seq.of(self.lo, self.hi + window) ^ mix((self.hi - self.lo).astype(U))
        # positions that are the anchor of a window; two of one run may hide a repeat inside it
        chosen = np.flatnonzero(self.chosen(grams, least, width))
        near = chosen[:-1][(grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) <= width)]
        steps = np.zeros(len(grams) + 1, np.int64)
        np.cumsum(np.bincount(near, minlength=len(grams)), out=steps[1:])
        upto = np.minimum(self.hi + width, len(grams))
        self.inner = steps[upto] > steps[self.lo]
        if heavy is not None and len(heavy) and len(self.lo):
            self.split(heavy)

    @staticmethod
    def chosen(grams: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
        n = len(least)
        if not n:
            return np.zeros(len(grams), bool)
        pad = np.zeros(width - 1, U)
        most = ~sliding_min(~np.concatenate([pad, least, pad]), width)
        return grams == most[: len(grams)]

    def split(self, heavy: np.ndarray) -> None:
        """Turn the runs of these anchors into single windows under their own hash."""
        at = np.minimum(np.searchsorted(heavy, self.anchor), len(heavy) - 1)
        hot = heavy[at] == self.anchor
        if not hot.any():
            return
        lengths = (self.hi - self.lo + 1)[hot]
        begin = np.cumsum(lengths) - lengths
        start = np.arange(lengths.sum()) + np.repeat(self.lo[hot] - begin, lengths)
        whole = self.seq.of(start, start + self.window)
        for name, more in (
            ("text", np.repeat(self.text[hot], lengths)), ("lo", start), ("hi", start), ("anchor", mix(whole + U(5))),
            ("content", whole), ("inner", np.zeros(len(start), bool)),
        ):
            setattr(self, name, np.concatenate([getattr(self, name)[~hot], more]))


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def local_rows(key, content, doc, lo, hi, inner) -> pa.RecordBatch:
    """Runs of one batch: the first of each content as it is, the others as copies known already."""
    order = np.lexsort((lo, doc))
    key, content, doc, lo, hi, inner = (x[order] for x in (key, content, doc, lo, hi, inner))
    both = mix(key ^ mix(content))
    by = np.argsort(both, kind="stable")
    head = np.ones(len(by), bool)
    head[1:] = both[by[1:]] != both[by[:-1]]
    first = np.empty(len(by), np.int64)
    first[by] = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
    same_place = (doc == doc[first]) & (lo == lo[first])
    keep = (first == np.arange(len(by))) | ~same_place
    copy = ~same_place
    key = np.where(copy, mix(doc.view(U) + lo.astype(U)), key)
    out = [signed(key[keep]), signed(content[keep]), pa.array(doc[keep])]
    out += [pa.array(lo[keep], pa.int32()), pa.array(hi[keep], pa.int32()), pa.array(inner[keep]), pa.array(copy[keep])]
    return pa.RecordBatch.from_arrays(out, names=["key", "content", "doc", "lo", "hi", "inner", "copy"])


def heavy_keys(df: DataFrame, rows_of, doc: str) -> np.ndarray:
    """Anchors met most often in every SAMPLE-th text, sorted: HEAVY_KEYS at most.

    They only choose how rows are dealt out; every key is treated, heavy or not.
    """
    sample = df.where(F.pmod(F.xxhash64(F.col(doc)), F.lit(SAMPLE)) == 0)
    top = (
        sample.mapInArrow(rows_of, ROWS)
        .where("NOT copy")
        .groupBy("key")
        .count()
        .where(F.col("count") >= HEAVY_SEEN)
        .orderBy(F.desc("count"), "key")
        .limit(HEAVY_KEYS)
        .collect()
    )
    return np.sort(np.array([r.key for r in top], np.int64).view(U))


def whole_groups(batches, sizes: int):
    """Join sorted batches into larger ones that never cut a key."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < sizes:
            continue
        table = pa.Table.from_batches(held)
        keys = table["key"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut)
            held, rows = table.slice(cut).to_batches(), len(keys) - cut
        else:
            sizes = max(sizes, 2 * rows)  # one long group: look again when it has doubled
    if rows:
        yield pa.Table.from_batches(held)


def resolve(rows: DataFrame, finest: bool = False) -> DataFrame:
    """Copies by whole content, and the runs still to be compared (none if windows are the contents)."""

    def run(batches):
        for t in whole_groups(batches, 50_000):
            key, content, doc, lo, hi, inner, copy = (t[i].to_numpy() for i in range(7))
            n = len(key)
            head = np.ones(n, bool)
            head[1:] = key[1:] != key[:-1]
            kind = head.copy()
            kind[1:] |= content[1:] != content[:-1]
            first = np.maximum.accumulate(np.where(kind, np.arange(n), 0))
            later = (doc != doc[first]) | (lo != lo[first])
            group = np.cumsum(head) - 1
            kinds = np.bincount(group[kind & ~copy], minlength=group[-1] + 1)
            compare = kind & ~copy & ((kinds[group] > 1) | inner)
            removed = copy | later
            keep = removed | (compare & (not finest))
            out = [key, doc, lo, hi, removed]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in out], names=["key", "doc", "lo", "hi", "copy"]
            )

    dealt = rows.repartition("key").sortWithinPartitions("key", "content", "doc", "lo")
    return dealt.mapInArrow(run, FOUND)


def merge_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of whole numbers, of closed ranges of one text in any order."""
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > top[:-1] + 1
    first = np.flatnonzero(new)
    return lo[first], top[np.append(first[1:], len(lo)) - 1] if len(lo) else top


def per_document(found: DataFrame) -> DataFrame:
    """All rows of a document in one list: no longer than its text."""
    return found.groupBy("doc").agg(F.collect_list(F.struct("key", "lo", "hi", "copy")).alias("found"))


def list_columns(column) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Lengths and flat fields of a list-of-struct column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return lengths, {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}
