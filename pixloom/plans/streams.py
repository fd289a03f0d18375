"""Registered queries: telemetry streams replayed from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixloom.plans import proxies as X
from pixloom.plans.registry import query, rnd, rounded
from pixloom.session import scratch_path
from pixloom.streaming import telemetry as T


def _stream(spark, sf):
    """The events file as a stream of observations."""
    schema = X.table(spark, sf, "events").schema
    source = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )
    return X.telemetry(source)


def _ordered(spark, rows, *more):
    """Telemetry as a stream of files in the order of time, those of ``more`` behind them."""
    path = scratch_path(spark, "telemetry")
    T.write_in_order(rows, path, least=3)
    for later in more:
        T.write_in_order(later, path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _observations(spark, sf):
    return _ordered(spark, X.telemetry(X.table(spark, sf, "events")))


def _drain(spark, stream, name):
    path = scratch_path(spark, name)
    return T.run_to_table(stream, f"{path}/out", f"{path}/state")


def _rollup_sql(value: str, limit: int) -> str:
    return f"""WITH o AS (SELECT event_type AS run_id, {value} AS value, row_number() OVER
      (PARTITION BY event_type ORDER BY ts, event_id) AS observation,
      count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT run_id, ((observation - 1) // {limit})::BIGINT AS emission, {rnd('value')} AS value, observation FROM o
    WHERE ((observation - 1) // {limit} + 1) * {limit} <= n"""


@query("error_rollup", _rollup_sql("value", 64))
def error_rollup(spark, sf):
    return rounded(_drain(spark, T.error_rollup(_observations(spark, sf), 64), "error"))


@query("performance_rollup", _rollup_sql("value * 10.0", 100))
def performance_rollup(spark, sf):
    return rounded(_drain(spark, T.performance_rollup(_observations(spark, sf), 100), "performance"))


@query(
    "snapshot_sample",
    f"SELECT run_id, emission, value, observation FROM ({_rollup_sql('value', 50)})"
    " WHERE (observation - 1) % 50 = 0",
)
def snapshot_sample(spark, sf):
    return rounded(_drain(spark, T.snapshot_sample(_observations(spark, sf), 50), "snapshot"))


@query("error_rollup_batch", _rollup_sql("value", 64))
def error_rollup_batch(spark, sf):
    events = X.telemetry(X.table(spark, sf, "events"))
    return rounded(T.rollup_batch(events, 64, "error"))


_CHUNKS = 4
_CONTROLLED = f"""WITH n AS (SELECT count(*) AS total FROM events),
    e AS (SELECT event_type AS run_id, value, ts, event_id,
      CASE WHEN event_id % 211 = 0 THEN 'reset' WHEN event_id = total * 5 // 8 THEN 'stop' ELSE 'observation' END AS kind,
      event_id * {_CHUNKS} // total AS chunk FROM events, n),
    here AS (SELECT *, sum((kind = 'stop')::INT) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS ended,
      sum((kind = 'reset')::INT) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS epoch FROM e WHERE chunk <= 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY run_id, epoch ORDER BY ts, event_id) AS i,
      count(*) OVER (PARTITION BY run_id, epoch) AS m FROM here WHERE kind = 'observation' AND ended = 0),
    per AS (SELECT run_id, epoch, max(m) // 6 AS k FROM o GROUP BY ALL),
    done AS (SELECT run_id, epoch, coalesce(sum(k) OVER (PARTITION BY run_id ORDER BY epoch
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k0 FROM per)
    SELECT run_id, (k0 + (i - 1) // 6)::BIGINT AS emission, {rnd('value')} AS value, i * 3 AS observation
    FROM o JOIN done USING (run_id, epoch) WHERE ((i - 1) // 6 + 1) * 6 <= m"""


def _controlled(spark, sf):
    """Events as observations of delta 3, some turned into resets, one into the stop of its run, in chunks.

    A run named control, read with the last rows of the third chunk, asks the query as a whole to stop.
    """
    events = X.table(spark, sf, "events")
    total = events.count()
    kind = F.when(F.col("seq") % 211 == 0, "reset").when(F.col("seq") == total * 5 // 8, "stop").otherwise("observation")
    rows = X.telemetry(events).withColumn("kind", kind).withColumn("observation_delta", F.lit(3).cast("long"))
    rows = rows.withColumn("chunk", F.floor(F.col("seq") * _CHUNKS / total))
    control = rows.where("chunk <= 2").groupBy().agg(F.max("ts").alias("ts"), F.max("seq").alias("seq"))
    control = control.select(
        F.lit("control").alias("run_id"), "ts", F.lit("stop").alias("kind"),
        F.lit(0.0).alias("error"), F.lit(0.0).alias("absolute_performance"), F.lit(0).cast("long").alias("observation_delta"),
        "seq", F.lit(2).cast("long").alias("chunk"),
    )
    return rows.unionByName(control)


@query("controlled_rollup", _CONTROLLED)
def controlled_rollup(spark, sf):
    """Resets and stops over several micro-batches; the fourth chunk, behind them, is never handled."""
    rows, path = _controlled(spark, sf), scratch_path(spark, "controlled")
    handled, rest = rows.where("chunk <= 2").drop("chunk"), rows.where("chunk > 2").drop("chunk")
    stream = _ordered(spark, handled, rest)
    T.run_until_stop(T.rollup(stream, 17, "error"), f"{path}/out", f"{path}/state", "control")
    out = spark.read.parquet(f"{path}/out").where("kind = 'item'")
    return rounded(out.select("run_id", "emission", "value", "observation"))


@query("controlled_rollup_batch", _CONTROLLED)
def controlled_rollup_batch(spark, sf):
    """The batch form over what the stream has handled."""
    rows = _controlled(spark, sf).where("chunk <= 2")
    return rounded(T.rollup_batch(rows, 17, "error"))


_RATE = """SELECT event_type AS run_id, to_timestamp(floor(epoch(ts) / {s}) * {s})::TIMESTAMP AS window_start,
    count(*)::BIGINT AS observations, {rate} AS rate, {last} AS last_error FROM events GROUP BY 1, 2"""


@query(
    "throughput",
    _RATE.format(s=3600, rate=rnd("count(*) / 3600.0"), last=rnd("arg_max(value, ts)")),
)
def throughput(spark, sf):
    return rounded(T.throughput(X.telemetry(X.table(spark, sf, "events")), 3600))


@query(
    "throughput_stream",
    f"""WITH w AS ({_RATE.format(s=3600, rate='0', last='0')}) SELECT run_id, window_start, observations
    FROM w WHERE window_start + INTERVAL 3600 SECOND <=
      (SELECT max(ts) FROM events) - INTERVAL 60 SECOND""",
)
def throughput_stream(spark, sf):
    """Streaming form: windows appear once the watermark has passed their end."""
    out = _drain(spark, T.throughput(_stream(spark, sf), 3600, "1 minute"), "throughput")
    return out.select("run_id", "window_start", "observations")


@query(
    "progress",
    f"""WITH p AS (SELECT event_type AS run_id, count(*) AS n,
      epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY 1)
    SELECT run_id, n::BIGINT AS observations, {rnd('n / (us / 1e6)')} AS rate,
    {rnd('n * 100.0 / 50000')} AS percent,
    {rnd('greatest(50000 - n, 0) / greatest(n / (us / 1e6), 1.0)')} AS eta_seconds FROM p""",
)
def progress(spark, sf):
    return rounded(T.progress(X.telemetry(X.table(spark, sf, "events")), 50000))


_RECENT = """n AS (SELECT p_size AS config, p_partkey AS seq, p_retailprice AS rate FROM part),
r AS (SELECT *, avg(rate) OVER (PARTITION BY config ORDER BY seq ROWS 4 PRECEDING) AS recent FROM n)"""


def _rates(spark, sf):
    return X.table(spark, sf, "part").select(
        F.col("p_size").alias("config"), F.col("p_partkey").alias("seq"),
        F.col("p_retailprice").alias("rate"),
    )


@query(
    "recent_throughput",
    f"WITH {_RECENT} SELECT config, seq, {rnd('rate')} AS rate, {rnd('recent')} AS recent FROM r",
)
def recent_throughput(spark, sf):
    return rounded(T.recent_throughput(_rates(spark, sf), 5, block=16))


@query(
    "best_batch_size",
    f"""WITH {_RECENT}, l AS (SELECT config, arg_max(recent, seq) AS mean_rate FROM r GROUP BY 1)
    SELECT config, {rnd('mean_rate')} AS mean_rate,
    config = (SELECT arg_max(config, (mean_rate, -config)) FROM l) AS is_best FROM l""",
)
def best_batch_size(spark, sf):
    return rounded(T.best_batch_size(_rates(spark, sf), 5))


@query(
    "fan_out",
    f"""SELECT 'error' AS reporter, count(*) AS n, {rnd('sum(value)')} AS total FROM events UNION ALL
    SELECT 'performance', count(*), {rnd('sum(value * 10.0)')} FROM events""",
)
def fan_out(spark, sf):
    """One stream, two reporters, each with its own table."""
    path = scratch_path(spark, "fan")

    def save(name, column):
        def handler(batch, batch_id):
            # a folder for each batch: one that is retried replaces itself
            out = batch.select(F.col(column).alias("v"))
            out.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

        return handler

    handlers = {
        "error": save("error", "error"),
        "performance": save("performance", "absolute_performance"),
    }
    T.fan_out(_stream(spark, sf), handlers, f"{path}/state").awaitTermination()
    parts = [
        spark.read.parquet(f"{path}/{n}").agg(
            F.lit(n).alias("reporter"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")
        )
        for n in handlers
    ]
    return rounded(parts[0].unionByName(parts[1]))
