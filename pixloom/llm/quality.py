"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Tokens are runs of letters and digits, or of punctuation. Uni- and bigrams are hashed to SLOTS
slots; a bigram of one token with itself is a single feature, so that repetition is seen whatever
the word. A text is the mean of its features, so length does not count, and its score a sparse dot
product. Training follows the regularised leader in a few shards, whose weights are averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixloom.llm.frame import append_columns, without
from pixloom.llm.registry import query, table
from pixloom.llm.text import ALNUM, BYTE_VALUES, Stretch, U, chunks, joined, mix, per_text

SLOTS = 1 << 18
TRAIN_ROWS = 12_000  # bound of the labelled sample
SHARDS = 6
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-3, 1e-4
GAIN = 16.0  # of a text's mean feature vector
KIND = np.where(ALNUM, 1, 2).astype(np.int8)
KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_TWICE = U(0x5851F42D4C957F2D)

FIELDS = [
    T.StructField("score", T.DoubleType()),
    T.StructField("predicted", T.IntegerType()),
]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of consecutive texts, and where those of each text begin."""
    kind = KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    cut = np.flatnonzero(edge)
    end = np.append(cut[1:], len(data))
    word = kind[cut] > 0
    start, end = cut[word], end[word]
    token = Stretch(BYTE_VALUES[data]).of(start, end)
    bounds = np.searchsorted(start, offsets)
    pair = np.zeros(len(token), U)  # of a token and the one before; at a text's first the token alone
    pair[1:] = mix(token[1:] + token[:-1] * U(3))
    pair[1:][token[1:] == token[:-1]] = _TWICE
    first = bounds[:-1][bounds[1:] > bounds[:-1]]
    pair[first] = mix(token[first] + U(1))
    both = np.stack([mix(token + U(7)), pair], axis=1).ravel()
    return (both % U(SLOTS)).astype(np.int64), bounds * 2


def train_shard(rows: list[tuple[np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after some epochs of FTRL-proximal over sparse rows of slots and labels; the last is the bias."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(0, np.abs(z[at]) - L1)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    sparse = []
    for slots, label in rows:
        at, count = np.unique(slots, return_counts=True)
        sparse.append((np.append(at, SLOTS), np.append(count * (GAIN / max(1, len(slots))), 1.0), label))
    for _ in range(epochs):
        for at, x, label in sparse:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(SLOTS + 1))


def fit(
    labelled: DataFrame, *, text: str = "text", label: str = "label", order: str = "order_key", shards: int = SHARDS
) -> np.ndarray:
    """Average weights of the shards. ``labelled`` is a bounded sample: each shard's features fit in a task."""
    rows = labelled.select(
        F.col(text).alias("text"),
        F.col(label).cast("double").alias("label"),
        F.col(order).cast("long").alias("order_key"),
        F.pmod(F.col(order).cast("long"), F.lit(shards)).alias("shard"),
    ).where("label IS NOT NULL")

    def train(batches):
        kept = []
        for batch in batches:
            data, offsets = joined(batch.column(0))
            labels, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in chunks(offsets):
                slots, bounds = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                kept += [
                    (keys[i], labels[i], slots[bounds[i - a] : bounds[i - a + 1]].astype(np.int32)) for i in range(a, b)
                ]
        if kept:
            kept.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
            w = train_shard([(slots, y) for _, y, slots in kept])
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array([at.astype(np.int64).tobytes()], pa.binary()), pa.array([w[at].tobytes()], pa.binary())],
                names=["slots", "weights"],
            )

    # at most SHARDS rows of at most SLOTS + 1 weights
    parts = rows.repartition(shards, "shard").drop("shard").mapInArrow(train, "slots binary, weights binary").collect()
    total = np.zeros(SLOTS + 1)
    for p in sorted(parts, key=lambda p: bytes(p.weights)):
        total[np.frombuffer(p.slots, np.int64)] += np.frombuffer(p.weights)
    return (total / max(1, len(parts))).astype(np.float32)


def score(df: DataFrame, weights: np.ndarray, *, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5). Texts without a token get the bias alone."""
    weights = np.asarray(weights, np.float32)

    def make(batch):
        data, offsets = joined(batch.column(text))
        out = np.zeros(len(offsets) - 1)
        for a, b in chunks(offsets):
            slots, bounds = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            # fixed point, so that a text's sum does not depend on its neighbours
            total = per_text(np.rint(weights[slots].astype(np.float64) * (1 << 32)).astype(np.int64), bounds)
            out[a:b] = total / (1 << 32) / np.maximum(1, np.diff(bounds)) * GAIN
        p = 1 / (1 + np.exp(-np.clip(out + float(weights[-1]), -35, 35)))
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return append_columns(df, FIELDS, make, drop)


def held_out(doc_id: str = "doc_id"):
    """Rows never trained on: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def quality_score(
    documents: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, drop: tuple[str, ...] = ()
) -> DataFrame:
    """Train on labelled rows that are not held out, score every text; adds ``held_out`` too.

    The sample has at most ``train_rows`` labelled documents, those of the least hash of doc_id; of
    several labels of one document the least counts, null labels none. Without labels every score is
    0.5. Null texts are empty and empty texts get the bias; repeated rows score alike; columns with
    the names of the results are replaced.
    """
    documents = without(documents, ["held_out", "score", "predicted"])
    key = F.xxhash64(F.col("doc_id").cast("long"))
    picked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("__label"))
        .orderBy(key, "doc_id")
        .limit(train_rows)
    )
    # bounded by train_rows ids and labels
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    weights = fit(rows.withColumn("__order", key), label="__label", order="__order")
    return score(documents.withColumn("held_out", held_out()), weights, drop=drop)


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_score(documents, table(spark, sf_dir, "labels"), drop=("text",))
