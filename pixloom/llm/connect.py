"""Connected components of an edge table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixloom.llm.frame import saved

SMALL = 8  # nodes of a key that are paired in full at once


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
            F.sum(F.hash("b", "a").cast("long")),
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes of the edges (a, b): root is the least node of the component.

    Alternates two steps until nothing changes: every neighbour above a node is hung on the node's
    least neighbour, then every neighbour below. Least neighbours are pre-aggregated before each
    shuffle and the join on a node with very many neighbours can be split, as one side has it once.
    Each round is written to the shared folder, so the plan stays short and survives lost executors.
    The number of rounds grows with the logarithm of the longest chain.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = saved(small.union(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _state(new)
        edges = new
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _several(df: DataFrame, by: str) -> DataFrame:
    """The rows of keys with two or more values of ``by``, with the least and the most."""
    group = Window.partitionBy("key")
    return df.withColumn("least", F.min(by).over(group)).withColumn("most", F.max(by).over(group)).where("least < most")


def key_groups(keyed: DataFrame, near) -> DataFrame:
    """Rows (key, node, least, size) of the keys that several nodes share, written; of two the greater only.

    Keys of one node alone are dropped where the rows lie after the one shuffle by key, as are those of two
    that are not ``near``, and keys with the same nodes become one, so that only what is shared is written,
    and once.
    """
    group = Window.partitionBy("key")
    shared = _several(keyed.select("node", "key"), "node").distinct()
    # a key becomes a hash of its nodes; should two hashes be equal, their nodes are only compared in vain
    named = shared.withColumn("same", F.bit_xor(F.xxhash64("node")).over(group)).withColumn("size", F.count("*").over(group))
    named = named.where((F.col("size") > 2) | near(F.col("least"), F.col("most")) & (F.col("least") < F.col("node")))
    return saved(named.select(F.col("same").alias("key"), "node", "least", "size").distinct(), "members")


def link_groups(members: DataFrame, nodes: DataFrame, near, fits, accept) -> DataFrame:
    """Components (node, root) of the links among the nodes that share a key.

    ``members`` comes from ``key_groups``, ``nodes`` has each node once with the columns that ``fits`` reads
    with the suffixes _x and _y: parities p0.., given by name, and others. ``near`` tells of two nodes by
    themselves whether they may fit. ``accept`` turns pairs (a, b), a < b, that fit into the links among them.
    The nodes of keys of at most SMALL are paired in full. Of a larger key first each node is paired with the
    hub, the least node, so a group of n gives n - 1 pairs. Only keys left with nodes of several components
    are then paired in full across components, so no link is lost and nodes already joined are not paired
    again; parities rule pairs out inside that join.
    """
    parities = [c for c in nodes.columns if c.startswith("p")]

    def suffixed(node: str, s: str) -> DataFrame:
        return nodes.select(F.col("node").alias(node), *(F.col(c).alias(f"{c}_{s}") for c in nodes.columns if c != "node"))

    def sides(df: DataFrame) -> list[DataFrame]:
        return [df.select("key", *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "key")) for s in "xy"]

    ordered = [F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")]
    hubs = members.where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    x, y = sides(members.where((F.col("size") > 2) & (F.col("size") <= SMALL) & (F.col("least") < F.col("node"))).select("key", "node"))
    some = x.join(y, "key").where((F.col("node_x") < F.col("node_y")) & near(F.col("node_x"), F.col("node_y")))
    first = hubs.where(near(F.col("a"), F.col("b"))).union(some.select(*ordered)).distinct()
    both = first.join(suffixed("a", "x"), "a").join(suffixed("b", "y"), "b")
    first = saved(both.where(fits(parities)).select("a", "b"), "pairs")
    roots = saved(components(accept(first)), "roots")
    large = members.where(F.col("size") > SMALL).select("key", "node")
    placed = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = saved(_several(placed, "root").drop("least", "most").join(nodes, "node"), "left")
    x, y = sides(left)
    second = x.join(y, "key").where((F.col("root_x") < F.col("root_y")) & near(F.col("node_x"), F.col("node_y")) & fits(parities))
    pairs = saved(second.select(*ordered).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    if pairs.isEmpty():
        return roots
    more = saved(accept(pairs), "links")
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
