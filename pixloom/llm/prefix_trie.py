"""Prefix trie of conversations by truncation peeling.

The deepest conversations come first: those that end at a depth meet the nodes that survived there,
are grouped with them, lose what stands above the group's next fork and wait there to be grouped
again, so one descent both discovers the nodes and adds up what lies below them. Where nothing forks
or ends, a truncation takes all those turns at once, and what a single conversation has for itself
needs no grouping: a round is run for each depth at which shared prefixes fork or end.

A node is known by its depth and two 64-bit hashes of its turns; the hash of a prefix is the
exclusive or of its turns' hashes, each made with its place, so a turn is also taken away by it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixloom.llm.frame import saved
from pixloom.llm.registry import query, table
from pixloom.operators.scale import blocked_rank
from pixloom.session import scratch_path

BLOCK = 1024  # turns of a conversation that one window goes through
IDS = 12  # bits of the ids hashed together
KEY = ["depth", "k1", "k2"]
COMBINE = {
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
    "sum": (F.sum, lambda a, b: a + b, 0),
    "min": (F.min, lambda a, b: F.least(a, b), None),
}


def running(df: DataFrame, key: str, order: str, columns: dict[str, tuple[str, Column]], *, descending: bool = False) -> DataFrame:
    """Add running combinations within ``key`` by ``order``: blocks of rows, then what the blocks before have."""
    df = df.withColumn("__b", F.shiftright(order, BLOCK.bit_length() - 1))
    way = lambda c: F.desc(c) if descending else F.asc(c)
    inner = W.partitionBy(key, "__b").orderBy(way(order)).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(key).orderBy(way("__b")).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(key, "__b").agg(*(COMBINE[how][0](value).alias(n) for n, (how, value) in columns.items()), F.count("*").alias("__n"))
    offsets = totals.select(
        key, "__b", F.sum("__n").over(before).alias("__n"), *(COMBINE[how][0](n).over(before).alias(f"__{n}") for n, (how, _) in columns.items())
    ).where("__n is not null")
    own = df.withColumns({n: COMBINE[how][0](value).over(inner) for n, (how, value) in columns.items()})
    both = own.join(offsets.drop("__n"), [key, "__b"], "left")
    for n, (how, _) in columns.items():
        _, combine, nothing = COMBINE[how]
        both = both.withColumn(n, combine(F.col(n), F.coalesce(F.col(f"__{n}"), F.lit(nothing).cast("long"))))
    return both.drop("__b", *(f"__{n}" for n in columns))


def numbered_turns(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, place, h1, h2, bytes): turns from 1, hashed; ``bytes`` of the text.

    Turns are ordered by ``turn`` (null first), role and text; repeated rows are turns of their own.
    Null roles and texts are empty, rows without a conv_id belong to none.
    """
    turns = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ranked = blocked_rank(turns, ["conv_id"], [("part", F.floor(F.col("turn") / BLOCK))], ["turn", "role", "text"], "place")
    return ranked.select(
        "conv_id",
        "place",
        F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(1), "role", "text").alias("h2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )


def _paths(turns: DataFrame) -> DataFrame:
    """Rows (c, depth, k1, k2, p1, p2, bytes, sum): each prefix, its parent's hashes, bytes up to it."""
    own = turns.select(
        F.col("conv_id").alias("c"),
        F.col("place").alias("depth"),
        F.xxhash64("h1", "place").alias("x1"),
        F.xxhash64("h2", "place").alias("x2"),
        "bytes",
    )
    keyed = running(own, "c", "depth", {"k1": ("xor", F.col("x1")), "k2": ("xor", F.col("x2")), "sum": ("sum", F.col("bytes"))})
    return keyed.select(
        "c", *KEY, F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "bytes", "sum"
    )


def _forks(paths: DataFrame) -> DataFrame:
    """Keys of shared prefixes that do not merely pass all their conversations on to one child."""
    nodes = paths.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    below = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("kids"), F.sum("n").alias("passed")
    )
    both = nodes.where("n > 1").select(*KEY, "n").join(below, KEY, "left")
    return both.where("kids is null or kids > 1 or passed < n").select(*KEY)


def _hashed(ends: DataFrame) -> DataFrame:
    """Per key the SHA-256 of its ids c in order, from blocks of ids; one block at a time is held."""
    blocks = ends.groupBy(*KEY, F.shiftright("c", IDS).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("c")).cast("array<string>"), ",").alias("part")
    )

    def run(batches):
        last, digest = None, None
        for batch in batches:
            out = []
            for *key, part in zip(*(batch.column(n).to_pylist() for n in (*KEY, "part")), strict=True):
                if key != last:
                    if last is not None:
                        out.append((*last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256(part.encode())
                else:
                    digest.update(b"," + part.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*KEY, "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, digest.hexdigest())], names=[*KEY, "ends_sha256"])

    dealt = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "part")
    return dealt.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def _peel(stops: DataFrame) -> list[str]:
    """Group, add up and truncate from the deepest stop to the root; paths of the rounds' nodes."""
    spark, done = stops.sparkSession, []
    # at most one row for each depth, and to have n of them takes n * n / 2 turns
    for (depth,) in stops.select("depth").distinct().orderBy(F.desc("depth")).collect():
        here = stops.where(F.col("depth") == depth)
        ended = F.col("length") == depth
        arrived = here.where("final").select(
            "k1",
            "k2",
            "c",
            F.lit(1).cast("long").alias("n"),
            F.when(ended, 0).otherwise(1).cast("long").alias("kids"),
            F.when(ended, 0).otherwise(1).cast("long").alias("leaves"),
            F.lit(0).cast("long").alias("saved"),
        )
        if done:
            survivors = spark.read.parquet(*done).where(F.col("up_depth") == depth)
            arrived = arrived.unionByName(
                survivors.select(
                    F.col("up1").alias("k1"),
                    F.col("up2").alias("k2"),
                    "c",
                    "n",
                    F.lit(1).cast("long").alias("kids"),
                    "leaves",
                    (F.col("saved") + (F.col("n") - 1) * (F.col("above") - F.col("up_sum"))).alias("saved"),
                )
            )
        merged = arrived.groupBy("k1", "k2").agg(
            F.min("c").alias("c"), F.sum("n").alias("n"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        node = merged.join(here.select("c", "bytes", "above", "up_depth", "up1", "up2", "up_sum"), "c").select(
            F.lit(depth).cast("long").alias("depth"),
            "k1",
            "k2",
            "c",
            "n",
            "kids",
            F.greatest("leaves", F.lit(1)).alias("leaves"),
            (F.col("saved") + (F.col("n") - 1) * F.col("bytes")).alias("saved"),
            "above",
            "up_depth",
            "up1",
            "up2",
            "up_sum",
        )
        path = scratch_path(spark, f"depth-{depth}")
        node.write.parquet(path)
        done.append(path)
    return done


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` as from ``numbered_turns`` (places 1, 2, ... without gaps), ``lengths`` has (conv_id, length) of
    every conversation, also of those without turns. conv_id is the smallest member; saved_tokens counts
    bytes of texts, once for every further member, over the subtree. Without any conversation there is no
    row, not even the root.
    """
    lengths = lengths.select(F.col("conv_id").alias("c"), F.col("length").cast("long").alias("length"))
    paths = saved(_paths(turns), "paths")
    forks = saved(_forks(paths), "forks")
    zero = F.lit(0).cast("long")
    roots = lengths.select("c", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("bytes"), zero.alias("sum"))
    shared = paths.join(forks, KEY).select("c", *KEY, "bytes", "sum").unionByName(roots)
    by = W.partitionBy("c").orderBy("depth")
    stops = saved(
        shared.join(lengths, "c").select(
            "c",
            *KEY,
            "bytes",
            "length",
            (F.col("sum") - F.col("bytes")).alias("above"),
            F.lag("depth").over(by).alias("up_depth"),
            F.lag("k1").over(by).alias("up1"),
            F.lag("k2").over(by).alias("up2"),
            F.lag("sum").over(by).alias("up_sum"),
            F.lead("depth").over(by).isNull().alias("final"),
        ),
        "stops",
    )
    done = _peel(stops)
    if not done:
        return _empty(turns.sparkSession)
    ends = _hashed(stops.where("final and length = depth").select(*KEY, "c"))
    nodes = saved(turns.sparkSession.read.parquet(*done).join(ends, KEY, "left"), "nodes")
    # the stop that each turn is truncated with: the next one below it; none for what only one conversation has
    marked = paths.join(forks.withColumn("fork", F.col("depth")), KEY, "left")
    placed = running(marked, "c", "depth", {"stop": ("min", F.col("fork"))}, descending=True)
    at = nodes.select(F.col("depth").alias("stop"), "c", "n", "kids", "leaves", "saved", "above", "ends_sha256")
    chains = placed.where("stop is not null").join(at, ["c", "stop"])
    top = F.col("depth") == F.col("stop")
    known = chains.select(
        "c",
        "depth",
        "p1",
        "p2",
        "n",
        F.when(top, F.col("kids")).otherwise(1).alias("kids"),
        "leaves",
        (F.col("saved") + F.when(top, 0).otherwise((F.col("n") - 1) * (F.col("above") - F.col("sum") + F.col("bytes")))).alias("saved"),
        F.when(top, F.col("ends_sha256")).alias("ends_sha256"),
    )
    last = F.col("depth") == F.col("length")
    one = F.lit(1).cast("long")
    alone = placed.where("stop is null").join(lengths, "c").select(
        "c",
        "depth",
        "p1",
        "p2",
        one.alias("n"),
        F.when(last, 0).otherwise(1).alias("kids"),
        one.alias("leaves"),
        zero.alias("saved"),
        F.when(last, F.sha2(F.col("c").cast("string"), 256)).alias("ends_sha256"),
    )
    # a parent that is a fork may have a smaller member; any other parent has the same members
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("c").alias("parent"))
    below = known.unionByName(alone).join(parents, ["depth", "p1", "p2"], "left").withColumn("parent", F.coalesce("parent", "c"))
    root = nodes.where("depth = 0").select(*(c for c in below.columns if c not in ("p1", "p2", "parent"))).withColumn("parent", F.lit(None).cast("long"))
    return below.drop("p1", "p2").unionByName(root).select(
        F.col("c").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [],
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string",
    )


def conversation_trie(df: DataFrame, **columns: str) -> DataFrame:
    """The trie of the conversations as they are; see ``numbered_turns`` and ``prefix_trie``."""
    turns = saved(numbered_turns(df, **columns), "turns")
    return prefix_trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("length")))


def rebuilt(turns: DataFrame, *, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that begin like the first of their group of ids.

    Conversation c gets the first h turns of conversation c - c % group (all if fewer), h the crc32 of
    its id modulo ``most``, before its own turns after the first h.
    """
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    step = F.pmod("conv_id", F.lit(group))
    convs = counts.select("conv_id", "own", head.alias("head"), (F.col("conv_id") - step).alias("base"))
    bases = counts.where(step == 0).select(F.col("conv_id").alias("base"), F.least(F.col("own"), F.lit(most - 1)).alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("given", F.least("head", F.coalesce("there", F.lit(0))))
    lengths = convs.select("conv_id", (F.col("given") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))
    # at most most - 1 turns of each base for the group - 1 others
    taken = turns.where((step == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    first = convs.where(step != 0).select("conv_id", "base", "given").join(taken, "base").where("place <= given").select(turns.columns)
    kept = turns.join(convs.select("conv_id", "head", "given"), "conv_id")
    whole = kept.where(step == 0).select(turns.columns)
    rest = kept.where((step != 0) & (F.col("place") > F.col("head"))).withColumn("place", F.col("place") - F.col("head") + F.col("given"))
    own = F.col("conv_id") % group == 0
    lengths = lengths.join(counts, "conv_id").select("conv_id", F.when(own, F.col("own")).otherwise(F.col("length")).alias("length"))
    return whole.unionByName(first).unionByName(rest.select(turns.columns)), lengths


@query("op13_prefix_trie")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = saved(numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(*rebuilt(turns))
