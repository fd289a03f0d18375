"""Cost-balanced packing of token sequences for training.

The cost of a piece of n tokens is n * (``linear`` + n): what grows with the tokens, and attention
within the piece. A task packs its documents in blocks of about ``BLOCK`` tokens, so nothing is
shuffled and a task holds one block. Whole windows of a long document fill sequences of their own.
The other pieces go, in descending order, each to the sequence of the lowest cost that has room for
it. A block has just as many places as tokens: full sequences, and for the rest one sequence for
each binary digit of its length, as a power of two needs no padding. So what fits nowhere whole is
cut, and no place stays empty.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom.llm.frame import SLICE_BYTES, lists
from pixloom.llm.registry import query, table
from pixloom.llm.tokens import Encoder

WIDTH = 2048  # tokens of a sequence, a power of two
END = 1  # the id behind each document
LINEAR = 4096  # so many tokens cost as much in attention as in all else
BLOCK = 1 << 22  # tokens packed together
VOCABULARY = "byte_bpe_50k.json"
PIECE = "start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def rooms(tokens: int, width: int) -> np.ndarray:
    """Sizes of sequences that hold just so many tokens: full ones, then ever smaller powers of two."""
    rest = [1 << i for i in reversed(range(width.bit_length())) if tokens % width >> i & 1]
    return np.array([width] * (tokens // width) + rest, np.int64)


def assign(lengths: np.ndarray, width: int = WIDTH, linear: int = LINEAR) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) for documents of these lengths, in order."""
    whole, rest = lengths // width, lengths % width
    windows = np.repeat(np.arange(len(lengths)), whole)
    number = np.arange(len(windows)) - np.repeat(np.cumsum(whole) - whole, whole)
    full = np.stack([windows, number * width, np.full(len(windows), width), np.arange(len(windows)), np.zeros(len(windows), np.int64)], 1)
    size = rooms(int(rest.sum()), width)
    room, cost = size.copy(), np.zeros(len(size))
    out = []
    for doc in np.lexsort((np.arange(len(rest)), -rest))[: np.count_nonzero(rest)].tolist():
        start, left = int(whole[doc]) * width, int(rest[doc])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            to = int(fits.argmin())
            if fits[to] == np.inf:
                to = int(np.where(room > 0, cost, np.inf).argmin())
            n = min(left, int(room[to]))
            out.append((doc, start, n, len(windows) + to, int(size[to] - room[to])))
            room[to] -= n
            cost[to] += n * (linear + n)
            start, left = start + n, left - n
    return np.concatenate([full, np.array(out, np.int64).reshape(-1, 5)])


def pack_documents(
    df: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    width: int = WIDTH,
    linear: int = LINEAR,
    block: int = BLOCK,
    outputs: tuple[str, ...] = ("ids",),
) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, sequence_id, offset) and ``outputs``: one per piece.

    A document is its text's ids and END, so null and empty texts give one piece of one token. A very
    long text gives a full piece for each window of it. Every row is packed, also rows that repeat an
    id or have a null one; equal lengths keep the order of the rows. Sequences never span blocks or
    tasks; sequence_id has the task's partition in its upper bits. Other columns, whatever their
    names, are not read, and an empty table gives no rows. ``outputs`` may name ids (the piece's ids)
    and ids_crc32 (checksum of them as little-endian unsigned 32-bit numbers).
    """
    if width & (width - 1) or block < width:
        raise ValueError("width has to be a power of two, block no smaller")
    path = path or public_tokenizers.path(VOCABULARY)
    kinds = T.StructType.fromDDL(PIECE)
    names = [n for n in kinds.names if n not in ("ids", "ids_crc32") or n in outputs]
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), *(kinds[n] for n in names)])

    def run(batches):
        encode = encoder(path).encode
        task = TaskContext.get().partitionId() << 40
        sequences = 0

        def packed(docs: list, ids: list):
            nonlocal sequences
            lengths = np.array([len(x) for x in ids], np.int64)
            rows = assign(lengths, width, linear)
            rows = rows[np.lexsort((rows[:, 4], rows[:, 3]))]
            column = pa.concat_arrays(docs)
            step = max(1, 4 * SLICE_BYTES // (4 * width))
            for first in range(0, len(rows), step):
                doc, start, length, sequence, offset = rows[first : first + step].T
                parts = [ids[d][s : s + n] for d, s, n in zip(doc, start, length, strict=True)]
                made = {
                    "start": start,
                    "length": length,
                    "doc_tokens": lengths[doc],
                    "sequence_id": task + sequences + sequence,
                    "offset": offset,
                }
                if "ids" in outputs:
                    made["ids"] = lists(np.concatenate(parts), length, pa.int32())
                if "ids_crc32" in outputs:
                    made["ids_crc32"] = pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())
                yield pa.RecordBatch.from_arrays([column.take(pa.array(doc)), *(pa.array(made[n]) for n in names)], names=schema.names)
            sequences += int(rows[:, 3].max()) + 1

        docs, ids, held = [], [], 0
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                flat, offsets = encode(part.column(text))
                docs.append(part.column(doc_id))
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    ids.append(np.append(flat[a:b], np.int32(END)))
                held += len(flat) + part.num_rows
                if held >= block:
                    yield from packed(docs, ids)
                    docs, ids, held = [], [], 0
        if ids:
            yield from packed(docs, ids)

    return df.select(doc_id, text).mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, lengths): the tokens of each sequence and of its pieces, in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # at most WIDTH tokens
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths"))


@query("op12_balanced_packing")
def op12_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), outputs=("ids_crc32",))
