"""Connected groups of things that share a key and pass a test, without forming all pairs of a large group.

``linked_groups`` takes postings (key, node) and compares, in every key, all nodes with one pivot: the one
of most weight. What links is merged, and a key whose nodes are one group is done. Where groups remain, the
pivot leaves its key (all its pairs are settled) and the next one is tried; after ``pivot_rounds`` all pairs
of a key that are still in different groups are compared. So no pair that could join two groups is left
out, and a family of n near copies costs about n comparisons.

Pairs of unrelated things that share a key grow faster than the things do, so what a test joins to them is
joined to some of them at a time (``by_portions``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.scratch import stored, stored_at


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _with_lowest(edges: DataFrame) -> DataFrame:
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("low")), "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node that links reach.

    Large-star and small-star steps by turns until the edges are stars. A hub is met by a grouped minimum
    and a join, never by a list of its neighbours. No link gives an empty result.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_lowest(both).where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct())
        small = _with_lowest(large)
        edges = stored(small.select(F.explode(F.array(
            F.struct(F.col("u"), F.col("low").alias("v")),
            F.struct(F.when(F.col("v") != F.col("low"), F.col("v")).otherwise(F.col("u")).alias("u"),
                     F.col("low").alias("v")))).alias("e")).select("e.*").distinct(), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def by_portions(pairs: DataFrame, most: int, test: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What ``test`` returns of the stored pairs (a, b), stored; it gets some ``most`` of them at a time, by hash.

    The shuffles of a portion are freed before the next one, so that their room does not follow the number of pairs.
    """
    portions = max(1, -(-pairs.count() // most))
    portion = F.pmod(F.xxhash64("a", "b"), F.lit(portions))
    return reduce(DataFrame.unionByName, [
        stored(test(pairs.where(portion == k) if portions > 1 else pairs), label) for k in range(portions)])


def linked_groups(postings: DataFrame, nodes: DataFrame, payload: list[str], near: Callable[[str, str], Column],
                  prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], pivot_rounds: int = 2,
                  release: Callable[[], None] = lambda: None,
                  own: tuple[str, ...] = ()) -> DataFrame:
    """(node, component) of the nodes that have a link.

    ``postings`` (key, node) are distinct; ``nodes`` has node, weight and the payload columns, one row a node.
    ``near(p, q)`` is a cheap test on payload columns prefixed by p and q, the same in both orders.
    ``prepare`` gets the nodes (node) that share a key with another and returns the full test: a function of
    distinct pairs (a, b), a < b, that returns those which link. ``release`` is called once the postings have
    been read for good. ``own`` names columns of the postings that ``near`` may use too; then it has to hold under
    one of the keys that two linking nodes share, and is asked under each. (A key that two nodes of different
    groups share is still there in the last turn, unless one of them was its pivot, and then ``near`` has been asked
    for the two under it.)
    """
    columns = ["node", "weight", *payload, *own]
    several = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members, drop_members = stored_at(postings.join(several, "key").select("key", "node", *own), "shared-keys")
    release()
    verified = prepare(members.select("node").distinct())
    members = members.join(nodes.select("node", "weight", *payload), "node")
    groups = None
    for turn in range(pivot_rounds + 1):
        labelled = members.withColumn("component", F.col("node"))
        if groups is not None:
            labelled = members.join(groups, "node", "left").withColumn(
                "component", F.coalesce("component", "node"))
        labelled, drop_labelled = stored_at(labelled, "labelled")
        drop_members()
        best = F.struct("weight", "node", "component", *payload, *own)
        mixed = (labelled.groupBy("key").agg(F.max(best).alias("pivot"), F.min("component").alias("lo"),
                                             F.max("component").alias("hi")).where("lo <> hi"))
        if turn < pivot_rounds:
            members, drop_members = stored_at(
                labelled.join(mixed.select("key", "pivot"), "key").where(F.col("node") != F.col("pivot.node"))
                .withColumn("candidate", (F.col("component") != F.col("pivot.component")) & near("", "pivot.")),
                "members")
            found = members.where("candidate").select(F.least("node", "pivot.node").alias("a"),
                                                      F.greatest("node", "pivot.node").alias("b"))
            members = members.select("key", *columns)
        else:
            left = labelled.join(mixed.select("key"), "key", "left_semi").select("key", F.struct(
                "component", *columns).alias("l"))
            right = left.withColumnRenamed("l", "r")
            found = left.join(right, "key").where((F.col("l.component") < F.col("r.component")) & near("l.", "r."))
            found = found.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
        pairs = stored(found.distinct(), "pairs")
        drop_labelled()
        if not pairs.isEmpty():
            fresh = stored(verified(pairs).select("a", "b"), "links")
            known = fresh if groups is None else fresh.unionByName(
                groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
            groups = components(known)
        elif turn < pivot_rounds and members.isEmpty():
            break
    if groups is None:
        return nodes.select("node", F.col("node").alias("component")).limit(0)
    return groups
