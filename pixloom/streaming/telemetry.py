"""Training telemetry as Structured Streaming, with batch forms of the same results.

Telemetry rows: run_id, ts, kind, error, absolute_performance, observation_delta, and seq, which
orders rows of one time.
``kind`` is observation, or a control event: reset (clear history) or stop.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pixloom.operators.scale import blocked_rank
from pixloom.session import remove, scratch_path

TELEMETRY_SCHEMA = (
    "run_id string, ts timestamp, kind string, error double,"
    " absolute_performance double, observation_delta bigint, seq bigint"
)
_OUT = "run_id string, kind string, emission bigint, value double, observation bigint"
_ITEM = ["run_id", "emission", "value", "observation"]
FILE_ROWS = 1 << 21  # of a file that is one micro-batch
LISTERS = 16  # tasks that look up the files of a micro-batch
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Feed:
    """What a run has so far: observations, those due until the next emission, emissions, and whether it ended.

    ``take`` goes through rows in order. A reset forgets the buffered items and the observations, a stop
    ends the run for good. An emission comes as soon as ``limit`` observations have arrived since the last.
    """

    def __init__(self, limit: int, first_only: bool, counters=None, values=(), positions=()):
        self.limit, self.first_only = limit, first_only
        self.total, self.due, self.emission, self.ended = counters or (0, limit, 0, False)
        self.values, self.positions = list(values), list(positions)

    def counters(self) -> tuple:
        return self.total, self.due, self.emission, self.ended

    def take(self, kinds: np.ndarray, values: np.ndarray, deltas: np.ndarray) -> Iterator[tuple]:
        """(kind, emission, values, positions) of every emission and control event."""
        controls = np.flatnonzero(kinds != "observation")
        start = 0
        for at in [*controls.tolist(), len(kinds)]:
            if self.ended:
                return
            yield from self._observed(values[start:at], deltas[start:at])
            if at < len(kinds):
                self.total, self.due, self.values, self.positions = 0, self.limit, [], []
                self.ended = kinds[at] == "stop"
                yield kinds[at], self.emission, [], []
            start = at + 1

    def _observed(self, values: np.ndarray, deltas: np.ndarray) -> Iterator[tuple]:
        reached = np.cumsum(deltas)
        start, before = 0, 0
        while start < len(values):
            end = int(np.searchsorted(reached, before + self.due)) + 1
            done, end = end <= len(values), min(end, len(values))
            kept = end if not self.first_only else min(end, start + (not self.values))
            self.values += values[start:kept].tolist()
            self.positions += (self.total + reached[start:kept] - before).tolist()
            gone = int(reached[end - 1]) - before
            self.total, self.due, before, start = self.total + gone, self.due - gone, int(reached[end - 1]), end
            if done:
                yield "item", self.emission, self.values, self.positions
                self.due, self.values, self.positions, self.emission = self.limit, [], [], self.emission + 1


def _columns(frame: pd.DataFrame, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = frame["kind"].to_numpy(dtype=object)
    return kinds, frame[value].to_numpy(dtype=float), frame["observation_delta"].fillna(0).to_numpy(dtype=np.int64)


def _frame(run: str, held: list[tuple]) -> pd.DataFrame:
    """Emissions and control events as one frame; an event without items is a row without a value."""
    sizes = [len(values) or 1 for _, _, values, _ in held]
    values = np.array([v for e in held for v in (e[2] or [np.nan])], dtype=float)
    positions = np.array([p for e in held for p in (e[3] or [-1])], dtype=np.int64)
    lacking = np.repeat([not e[2] for e in held], sizes)
    return pd.DataFrame(
        {
            "run_id": run,
            "kind": np.repeat(np.array([e[0] for e in held], dtype=object), sizes),
            "emission": np.repeat(np.array([e[1] for e in held], dtype=np.int64), sizes),
            "value": pd.arrays.FloatingArray(values, np.isnan(values)),
            "observation": pd.arrays.IntegerArray(positions, lacking),
        }
    )


def _rows(run: str, emitted: Iterator[tuple], size: int = 1 << 15) -> Iterator[pd.DataFrame]:
    """Frames of about ``size`` rows, however small an emission is."""
    held, n = [], 0
    for event in emitted:
        held.append(event)
        n += len(event[2]) or 1
        if n >= size:
            yield _frame(run, held)
            held, n = [], 0
    if held:
        yield _frame(run, held)


class RollupProcessor(StatefulProcessor):
    """Keeps the counters of a run as a value and its buffered items as a list, of less than ``limit`` observations."""

    def __init__(self, limit: int, value: str, first_only: bool):
        self.limit, self.value, self.first_only = limit, value, first_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "total bigint, due bigint, emission bigint, ended boolean")
        self.items = handle.getListState("items", "value double, position bigint")

    def handleInputRows(self, key, rows, timerValues):
        buffered = list(self.items.get()) if self.items.exists() else []
        counters = self.counters.get() if self.counters.exists() else None
        feed = Feed(self.limit, self.first_only, counters, (v for v, _ in buffered), (p for _, p in buffered))
        # frames come in any order, as the shuffle delivers them; a micro-batch is bounded by its files
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        yield from _rows(key[0], feed.take(*_columns(frame, self.value)))
        self.counters.update(feed.counters())
        if feed.values:
            self.items.put(list(zip(feed.values, feed.positions, strict=True)))
        else:
            self.items.clear()

    def close(self) -> None:
        pass


def rollup(stream: DataFrame, limit: int, value: str, first_only: bool = False) -> DataFrame:
    """Emitted items (``kind`` item) and the control events that were met (reset, stop), per run.

    A micro-batch's rows of a run are put in order by time and seq, wherever they come from; micro-batches
    are taken as they come, so a source that is larger than one should hold its rows in that order
    (``write_in_order``). What a task holds is its run's rows of one micro-batch and the buffered items.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    needed = stream.select("run_id", "ts", "seq", "kind", value, "observation_delta")
    return needed.groupBy("run_id").transformWithStateInPandas(
        RollupProcessor(limit, value, first_only), _OUT, outputMode="Append", timeMode="None"
    )


def _items(rolled: DataFrame) -> DataFrame:
    return rolled.where("kind = 'item'").select(*_ITEM)


def error_rollup(stream: DataFrame, limit: int) -> DataFrame:
    """Emit the buffered (error, cumulative observation) once ``limit`` observations arrived."""
    return _items(rollup(stream, limit, "error"))


def performance_rollup(stream: DataFrame, limit: int) -> DataFrame:
    """The same for throughput."""
    return _items(rollup(stream, limit, "absolute_performance"))


def snapshot_sample(stream: DataFrame, limit: int, value: str = "error") -> DataFrame:
    """The first item of every ``limit`` observations."""
    return _items(rollup(stream, limit, value, True))


def rollup_batch(events: DataFrame, limit: int, value: str, first_only: bool = False) -> DataFrame:
    """The same results from a table: deltas, resets and stops count as in the stream.

    Where an emission ends depends on where the one before did, so a run passes through one task, sorted
    by Spark and frame by frame; an emission that is not complete at the end is not shown.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, feed = None, None
        for frame in frames:
            for name, rows in frame.groupby("run_id", sort=False):
                if feed is None or name != last:
                    last, feed = name, Feed(limit, first_only)
                yield from _rows(name, feed.take(*_columns(rows, value)))

    columns = events.select("run_id", "ts", "seq", "kind", value, "observation_delta").where("run_id is not null")
    dealt = columns.repartition("run_id").sortWithinPartitions("run_id", "ts", "seq")
    return _items(dealt.mapInPandas(run, _OUT))


def write_in_order(rows: DataFrame, path: str, least: int = 1, size: int = FILE_ROWS) -> None:
    """Append rows to a stream's folder, as files of about ``size`` rows that follow each other in time.

    The files are cut at quantiles of the time and written one after the other, as a stream reads files by
    their age; there are at least ``least``, unless the rows have fewer times. Rows of one time share a file.
    """
    at = F.unix_micros("ts")
    parts = max(least, -(-rows.count() // size))
    cuts, last = rows.agg(
        F.percentile_approx(at, [k / parts for k in range(1, parts + 1)], F.lit(10000)), F.max(at)
    ).first()
    cuts = sorted({c for c in cuts or [] if c < last})
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    part = F.when(at.isNull(), len(cuts)).otherwise(F.size(F.filter(bounds, lambda c: c < at)))
    dealt, folder = rows.withColumn("__part", part), scratch_path(rows.sparkSession, "ordered")
    dealt.write.partitionBy("__part").parquet(folder)
    staged = rows.sparkSession.read.schema(dealt.schema).parquet(folder)
    for k in range(len(cuts) + 1):
        staged.where(F.col("__part") == k).drop("__part").coalesce(1).write.mode("append").parquet(path)
    remove(rows.sparkSession, folder)


def run_until_stop(
    rolled: DataFrame, path: str, checkpoint: str, control: str, poll: float = 0.2
) -> StreamingQuery:
    """Write a roll-up batch by batch until a stop event of the run ``control`` has come, then end the query.

    Each batch replaces its own folder, so one that is retried is not counted twice. Batches behind the
    one with the stop event are left unhandled.
    """
    ended = threading.Event()

    def handle(batch: DataFrame, batch_id: int) -> None:
        if ended.is_set():
            return
        folder = f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        met = batch.sparkSession.read.schema(batch.schema).parquet(folder)
        if not met.where((F.col("kind") == "stop") & (F.col("run_id") == control)).isEmpty():
            ended.set()

    query = (
        rolled.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    while query.isActive and not ended.is_set():
        try:
            query.awaitTermination(poll)
        except StreamingQueryException:  # a batch behind the stop event is refused for being left unhandled
            if not ended.is_set():
                raise
    if ended.is_set():
        query.stop()
    elif query.exception() is not None:
        raise query.exception()
    return query


def throughput(events: DataFrame, seconds: int = 5, watermark: str | None = "1 minute"):
    """Observations and rate per run and tumbling window; works on streams and batches."""
    source = events
    if watermark and events.isStreaming:
        source = events.withWatermark("ts", watermark)
    grouped = source.where("kind = 'observation'").groupBy(
        "run_id", F.window("ts", f"{seconds} seconds").alias("w")
    )
    return grouped.agg(
        F.sum("observation_delta").alias("observations"),
        F.max_by("error", "ts").alias("last_error"),
    ).select(
        "run_id",
        F.col("w.start").alias("window_start"),
        "observations",
        (F.col("observations") / seconds).alias("rate"),
        "last_error",
    )


def progress(events: DataFrame, total: int) -> DataFrame:
    """Per run: observations, rate since the first, percent done, seconds left."""
    runs = events.where("kind = 'observation'").groupBy("run_id").agg(
        F.sum("observation_delta").alias("observations"),
        F.min("ts").alias("t0"),
        F.max("ts").alias("t1"),
    )
    elapsed = F.unix_micros("t1") - F.unix_micros("t0")
    rate = F.when(elapsed > 0, F.col("observations") / (elapsed / 1e6)).otherwise(0.0)
    return runs.select(
        "run_id",
        "observations",
        rate.alias("rate"),
        (F.col("observations") * 100.0 / total).alias("percent"),
        (F.greatest(total - F.col("observations"), F.lit(0)) / F.greatest(rate, F.lit(1.0))).alias(
            "eta_seconds"
        ),
    )


def recent_throughput(rates: DataFrame, n: int, block: int = 1 << 16) -> DataFrame:
    """Mean of the last ``n`` rates of each configuration at every point.

    ``rates``: (config, seq, rate). A block of the sequence also receives the
    last ``n - 1`` rows before it, so no task sees a whole configuration.
    """
    numbered = blocked_rank(
        rates, ["config"], [("b", F.floor(F.col("seq") / block))], ["seq"], "place"
    )
    home = F.floor((F.col("place") - 1) / block)
    reach = F.floor((F.col("place") + (n - 2)) / block)
    spread = numbered.withColumn("__home", home).withColumn(
        "__b", F.explode(F.sequence(home, F.greatest(home, reach)))
    )
    frame = W.partitionBy("config", "__b").orderBy("place").rowsBetween(-(n - 1), 0)
    return (
        spread.withColumn("recent", F.avg("rate").over(frame))
        .where(F.col("__b") == F.col("__home"))
        .drop("__b", "__home", "place")
    )


def best_batch_size(rates: DataFrame, n: int) -> DataFrame:
    """Per size the mean of its last ``n`` rates, and whether it is the best one."""
    recent = recent_throughput(rates, n)
    last = recent.groupBy("config").agg(F.max_by("recent", "seq").alias("mean_rate"))
    best = last.agg(F.max_by("config", F.struct("mean_rate", -F.col("config"))))
    return last.withColumn("is_best", F.col("config") == best.scalar())


HANDLERS = ("image", "error", "performance")


def reporters(handlers: Mapping[str, Callable[[DataFrame, int], None]]):
    """``foreachBatch`` function that hands each batch to every registered reporter.

    Keys choose the columns a reporter needs: image, error or performance.
    """
    unknown = set(handlers) - set(HANDLERS)
    if unknown:
        raise ValueError(f"unknown reporters: {sorted(unknown)}")
    needs = {"image": "snapshot", "error": "error", "performance": "absolute_performance"}

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, handler in handlers.items():
                column = needs[name]
                if column in batch.columns:
                    handler(batch.where(F.col(column).isNotNull()), batch_id)
        finally:
            batch.unpersist()

    return handle


def fan_out(
    stream: DataFrame,
    handlers: Mapping[str, Callable[[DataFrame, int], None]],
    checkpoint: str,
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(reporters(handlers))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is available into Parquet and return it as a table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def ingest_stream(spark: SparkSession, root: str, ext: str = "png", per_trigger: int = 64):
    """New image files, each once: the query's checkpoint remembers the files it has seen,
    so no growing deduplication state is kept. Spark looks up a batch's files in tasks, by default one for each,
    whose reports to the driver are larger than what they found; a few tasks take them together."""
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTERS)
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{ext}")
        .option("maxFilesPerTrigger", per_trigger)
        .load(root)
    )
