"""Ordered statistics without putting a whole key into one task.

A key may own a large part of all rows, so nothing here sorts or collects a
key's rows in a single task: ranks and running sums work block by block with
small per-block offsets, and percentiles narrow the bracket of each rank by
mergeable counts and gather only what is left.
Joins carry no broadcast hints; AQE broadcasts a side when its measured size
is below the threshold and shuffles (with skew splitting) otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixloom.session import remove, written

BLOCK = 4096
BRACKET = 1 << 15  # values of a key that are gathered for one rank
DIGITS = 4096  # parts that a larger bracket is cut into


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality on all keys where NULL matches NULL."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"):
    """Equi-join that also matches NULL keys and keeps one copy of them."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"__{k}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def blocked_cumsum(
    df: DataFrame,
    value: Column,
    order: str,
    keys: Sequence[str] = (),
    out: str = "cum",
    block: int = BLOCK,
) -> DataFrame:
    """Running sum of ``value`` by the integer column ``order`` within ``keys``.

    Rows are summed inside blocks of ``block`` consecutive order values; one
    offset per block, itself summed in super-blocks, is added. Only the short
    list of super-blocks of a key is ever ordered as a whole.
    """
    keys = list(keys)
    df = df.withColumn("__v", value.cast("double")).withColumn(
        "__b", F.floor(F.col(order) / block).cast("long")
    )
    totals = df.groupBy(*keys, "__b").agg(F.sum("__v").alias("__t"))
    totals = totals.withColumn("__s", F.floor(F.col("__b") / block).cast("long"))
    supers = totals.groupBy(*keys, "__s").agg(F.sum("__t").alias("__st"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    supers = supers.withColumn(
        "__so",
        F.coalesce(F.sum("__st").over(whole.orderBy("__s").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0.0)),
    ).drop("__st")
    offsets = totals.withColumn(
        "__o",
        F.coalesce(
            F.sum("__t").over(
                W.partitionBy(*keys, "__s").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0.0),
        ),
    )
    offsets = join_on(offsets, supers, [*keys, "__s"]).select(
        *keys, "__b", (F.col("__o") + F.col("__so")).alias("__off")
    )
    inner = W.partitionBy(*keys, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    running = df.withColumn("__run", F.sum("__v").over(inner))
    joined = join_on(running, offsets, [*keys, "__b"])
    return joined.withColumn(out, F.col("__run") + F.col("__off")).drop(
        "__v", "__b", "__run", "__off"
    )


def blocked_rank(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[tuple[str, Column]],
    order: Sequence[str],
    out: str = "rank",
    descending: bool = False,
) -> DataFrame:
    """``row_number`` of ``order`` within ``keys``.

    ``bucket`` names expressions that are monotone in the order (for example
    the date, then the id divided by 2**16). Rows are numbered inside their
    bucket; the numbers of rows in earlier buckets are added.
    """
    keys = list(keys)
    names = [f"__{n}" for n, _ in bucket]
    for (_, expr), name in zip(bucket, names, strict=True):
        df = df.withColumn(name, expr)

    def ordered(columns):
        return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]

    counts = df.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    offsets = counts.select(
        *keys,
        *names,
        F.coalesce(
            F.sum("__n").over(whole.orderBy(*ordered(names)).rowsBetween(
                W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("__off"),
    )
    inner = W.partitionBy(*keys, *names).orderBy(*ordered(order))
    numbered = df.withColumn("__rn", F.row_number().over(inner))
    joined = join_on(numbered, offsets, [*keys, *names])
    return joined.withColumn(out, (F.col("__rn") + F.col("__off")).cast("long")).drop(
        "__rn", "__off", *names
    )


def uniform_rank(df: DataFrame, draw: str, ties: Sequence[str], out: str = "place", rows: int = 1 << 16) -> DataFrame:
    """``row_number`` of a uniform draw in [0, 1), then of ``ties``, over the whole table.

    There is a bucket for every ``rows`` rows, so buckets stay the same size whatever the table has.
    """
    buckets = max(1, -(-df.count() // rows))
    df = df.withColumn("__u", F.least(F.floor(F.col(draw) * buckets), F.lit(buckets - 1)))
    counts = df.groupBy("__u").agg(F.count(F.lit(1)).alias("__n"))
    offsets = blocked_cumsum(counts, F.col("__n"), "__u").select("__u", (F.col("cum") - F.col("__n")).cast("long").alias("__before"))
    inner = W.partitionBy("__u").orderBy(draw, *ties)
    numbered = df.withColumn("__r", F.row_number().over(inner)).join(offsets, "__u")
    return numbered.withColumn(out, F.col("__before") + F.col("__r")).drop("__u", "__before", "__r")


def _narrowed(df: DataFrame, keys: list[str], slots, summary: DataFrame, limit: int, digits: int) -> DataFrame:
    """Cut the brackets of more than ``limit`` values into ``digits`` parts and keep those with the rank.

    One pass over the rows counts all such brackets of all keys; the counts merge before the shuffle, so a
    key sends at most ``digits`` + 2 rows a rank from each task, and no task ever holds or orders a bracket.
    """
    at = range(len(slots))
    wide = summary.where(F.greatest(*[F.col(f"__in_{i}") for i in at], F.lit(0)) > limit)
    entry = [
        F.when(
            F.col(f"__in_{i}") > limit,
            F.struct(
                F.lit(i).alias("__slot"),
                F.col(v).alias("__v"),
                F.col(f"__lo_{i}").alias("__lo"),
                F.col(f"__hi_{i}").alias("__hi"),
                F.floor((F.col(f"n_{v}") - 1) * p).alias("__k"),
            ),
        )
        for i, (v, _, p) in enumerate(slots)
    ]
    entries = F.filter(F.array(*entry), lambda e: e.isNotNull() & e["__v"].isNotNull())
    rows = join_on(df, wide, keys).select(*keys, F.explode(entries).alias("__e")).select(*keys, "__e.*")
    v, lo, hi, part = (F.col(f"__{c}") for c in ("v", "lo", "hi", "part"))
    inside = F.least(F.floor((v - lo) / (hi - lo) * digits), F.lit(digits - 1))
    counts = (
        rows.withColumn("__part", F.when(v < lo, -1).when(v > hi, digits).otherwise(inside).cast("int"))
        .groupBy(*keys, "__slot", "__k", "__part")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    )
    by = W.partitionBy(*keys, "__slot").orderBy("__part").rowsBetween(W.unboundedPreceding, 0)  # at most digits + 2 rows
    cum = counts.withColumn("__cum", F.sum("__n").over(by))
    before = F.col("__cum") - F.col("__n")
    first, second = ((F.col("__cum") > rank) & (before <= rank) for rank in (F.col("__k"), F.col("__k") + 1))
    found = cum.groupBy(*keys, "__slot").agg(
        *[F.max(F.when(first, F.col(c))).alias(a) for c, a in (("__part", "p1"), ("__least", "a1"), ("__most", "b1"), ("__n", "n1"))],
        *[F.max(F.when(second, F.col(c))).alias(a) for c, a in (("__part", "p2"), ("__least", "a2"))],
        F.max(F.when(first, before)).alias("below"),
    )
    # ranks in two parts are the last value of one and the first of the other, and so is a part of one value
    apart = F.coalesce(F.col("p1") != F.col("p2"), F.lit(False))
    found = found.select(
        *keys,
        "__slot",
        F.when(apart, F.col("b1")).otherwise(F.col("a1")).alias("lo"),
        F.when(apart, F.col("a2")).otherwise(F.col("b1")).alias("hi"),
        F.when(apart | (F.col("a1") == F.col("b1")), 0).otherwise(F.col("n1")).cast("long").alias("in"),
        "below",
    )
    parts = ("lo", "hi", "below", "in")
    wanted = [F.max(F.when(F.col("__slot") == i, F.col(c))).alias(f"__f{c}_{i}") for i in at for c in parts]
    joined = join_on(summary, found.groupBy(*keys).agg(*wanted), keys, "left")
    joined = joined.withColumns({f"__{c}_{i}": F.coalesce(F.col(f"__f{c}_{i}"), F.col(f"__{c}_{i}")) for i in at for c in parts})
    return joined.select(*summary.columns)


def _read(e: Column) -> Column:
    """Value at ``position`` of a slot: from the sorted ``values`` after ``below`` others, else between ``lo`` and ``hi``."""
    k = F.floor(e["position"])
    low = F.coalesce(F.get(e["values"], (k - e["below"]).cast("int")), e["lo"])
    high = F.coalesce(F.get(e["values"], (k + 1 - e["below"]).cast("int")), e["hi"])
    return F.when(e["position"] > k, low + (high - low) * (e["position"] - k)).otherwise(low)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, Sequence[tuple[str, float]]],
    aggregates: Mapping[str, Column] | None = None,
    limit: int = BRACKET,
    digits: int = DIGITS,
) -> DataFrame:
    """Exact linearly interpolated percentiles, several columns and ranks at once, by radix selection.

    ``columns`` maps a value column to ``[(output name, p), ...]``; NULL values are ignored, values are
    finite. ``aggregates`` adds ordinary aggregates of the same groups. One row per key, with
    ``n_<column>`` counts. A first scan, which reads the keys only, counts the rows of every key. Where no key
    has more than ``limit``, the second gathers their values. Else the rank of a larger key is bracketed, at first by its least
    and greatest value: scan by scan a bracket is cut into ``digits`` parts that are only counted, until the part
    with the rank has at most ``limit`` values, which the last scan gathers.
    """
    keys, extras = list(keys), [expr.alias(name) for name, expr in (aggregates or {}).items()]
    slots = [(v, name, p) for v, outs in columns.items() for name, p in outs]
    grouped = keys or ["__all"]
    source = df if keys else df.withColumn("__all", F.lit(0))
    sizes = [F.count(v).alias(f"n_{v}") for v in columns]
    names = [f"n_{v}" for v in columns]
    most = source.groupBy(*grouped).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0
    double = {v: F.col(v).cast("double") for v in columns}
    if most <= limit:
        lists = [F.array_sort(F.collect_list(double[v])).alias(f"__values_{v}") for v in columns]
        both = source.groupBy(*grouped).agg(*sizes, *lists, *extras)
        values = {i: F.col(f"__values_{v}") for i, (v, _, _) in enumerate(slots)}
        below = {i: F.lit(0).cast("long") for i in range(len(slots))}
        lo = hi = {i: F.lit(None).cast("double") for i in range(len(slots))}
    else:
        ends = [f(double[v]).alias(f"__{n}_{v}") for v in columns for n, f in (("min", F.min), ("max", F.max))]
        bracket = {}
        for i, (v, _, _) in enumerate(slots):
            least, greatest = F.col(f"__min_{v}"), F.col(f"__max_{v}")
            bracket |= {f"__lo_{i}": least, f"__hi_{i}": greatest, f"__below_{i}": F.lit(0).cast("long")}
            bracket[f"__in_{i}"] = F.when(least < greatest, F.col(f"n_{v}")).otherwise(0).cast("long")
        summary = source.groupBy(*grouped).agg(*sizes, *ends, *extras).withColumns(bracket)
        summary, old = written(summary.select(*grouped, *names, *(aggregates or {}), *bracket), "ranks")
        df = source.select(*grouped, *[c.alias(v) for v, c in double.items()])
        widest = F.max(F.greatest(*[F.col(f"__in_{i}") for i in range(len(slots))], F.lit(0)))
        while (summary.agg(widest).first()[0] or 0) > limit:
            summary, new = written(_narrowed(df, grouped, slots, summary, limit, digits), "ranks")
            remove(df.sparkSession, old)
            old = new
        lists = []
        for i, (v, _, _) in enumerate(slots):
            held = F.col(v).between(F.col(f"__lo_{i}"), F.col(f"__hi_{i}")) & (F.col(f"__in_{i}") > 0)
            lists.append(F.array_sort(F.collect_list(F.when(held, F.col(v)))).alias(f"__values_{i}"))
        wanted = summary.select(*grouped, *[f"__{c}_{i}" for i in range(len(slots)) for c in ("lo", "hi", "in")])
        gathered = join_on(df, wanted, grouped).groupBy(*grouped).agg(*lists)
        both = join_on(summary, gathered, grouped, "left")
        values, below, lo, hi = ({i: F.col(f"__{c}_{i}") for i in range(len(slots))} for c in ("values", "below", "lo", "hi"))
    # one expression over an array of slots, as code for each slot would grow too large to compile
    slot = [
        F.struct(
            values[i].alias("values"),
            below[i].alias("below"),
            lo[i].alias("lo"),
            hi[i].alias("hi"),
            ((F.col(f"n_{v}") - 1) * p).alias("position"),
        )
        for i, (v, _, p) in enumerate(slots)
    ]
    both = both.withColumn("__read", F.transform(F.array(*slot), _read))
    outputs = [F.get("__read", F.lit(i)).alias(name) for i, (_, name, _) in enumerate(slots)]
    return both.select(*keys, *names, *(aggregates or {}), *outputs)


def exact_medians(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str],
    aggregates: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Median of each column; ``columns`` maps value column to output name."""
    return exact_percentiles(
        df, keys, {c: [(out, 0.5)] for c, out in columns.items()}, aggregates
    )
