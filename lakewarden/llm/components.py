"""Connected components of a table of links, by alternating large-star and small-star steps.

First every task joins the links of its block, at most ``BLOCK`` of them, and keeps a forest. If there is one block, that is
the result. Otherwise steps follow that are each one grouping with map-side combined minima and one join, written to the
shared folder; the driver sees a count and a checksum per round. The number of rounds grows with the logarithm of the longest
path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import Scratch

#: More rounds than any real graph takes; beyond them something is wrong.
MOST_ROUNDS = 60
#: Links that one task joins in memory.
BLOCK = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the task's links with the smallest node that they reach."""
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                parent.setdefault(min(x, y), min(x, y))
    nodes = [x for x in parent if find(x) != x]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["hi", "lo"])


def _with_roots(edges: DataFrame) -> DataFrame:
    found = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return found.union(found.select("root", "root").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, scratch: Scratch, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node that has a link to another one.

    The direction, repeats and loops of the links don't matter. The result reads a table of ``scratch``.
    """
    a, b = F.col(left), F.col(right)
    pairs = links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    blocks = max(1, ceil(pairs.count() / BLOCK))
    kind = pairs.schema["hi"].dataType.simpleString()
    forest = scratch.keep(pairs.repartition(blocks).mapInArrow(_forest, f"hi {kind}, lo {kind}"), "edges")
    if blocks == 1:
        return _with_roots(forest)
    edges, state = forest, _state(forest)
    for _ in range(MOST_ROUNDS):
        # every node joins its greater neighbours to the least one
        ways = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # every node joins its smaller neighbours, and itself, to the least one
        best = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(best, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(best.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        after = scratch.keep(small, "edges", light=True)
        scratch.drop(edges)
        edges, before, state = after, state, _state(after)
        if state == before:
            return _with_roots(edges)
    raise RuntimeError("the components did not settle")


def shared_keys(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``key``, ``node`` whose key several nodes have, each once, as a table. Keys are counted before they are joined,
    so that a key with very many rows can be split in the join; nothing but keys and nodes is shuffled.

    Similar nodes share many keys, and keys with the same nodes make the same pairs, so one of those stands for all of
    them. They are told by the number of their nodes and two 64-bit sums of node hashes, so no list of nodes is made."""
    keyed = scratch.keep(keyed, "keyed")
    bounds = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    several = scratch.keep(bounds.where("lo < hi").select("key"), "several", light=True)
    member = scratch.keep(keyed.join(several, "key").distinct(), "members", light=True)
    scratch.drop(keyed, several)
    hashes = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    alike = member.groupBy("key").agg(F.count("*").alias("n"), *hashes)
    one = alike.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    single = scratch.keep(member.join(one, "key", "left_semi"), "single-members", light=True)
    scratch.drop(member)
    return single


#: Rounds in which open nodes are compared with leaders of their keys, at most. They end early when the pairs across components
#: are at most ``FEW`` times the rows of open keys, or when fewer than one in ``RARE`` of the compared pairs were links.
ROUNDS, FEW, RARE = 6, 8, 20
#: Keys of a node, the least ones, by which a pair that shares several is told to have met before.
SEEN = 4


def grouped(
    member: DataFrame,
    facts: DataFrame,
    near: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
) -> DataFrame:
    """``node`` and ``root`` of the components under ``verify``, for nodes that share keys.

    ``member`` has ``key`` and ``node``, each pair once; ``facts`` has one row per node with what ``near`` needs to rule out
    a pair; ``verify`` keeps the linked ones of the pairs ``a``, ``b``.

    A key is open while its nodes lie in several components. In every round each node of an open key is compared with at most
    two leaders, nodes of another component that a hash of the node and the round picks for each key, and the links found are
    contracted. From the second round on only keys of more than ``2 * FEW`` rows take part, since the pairs of the others are at most ``FEW``
    times their rows. Rounds end when little is open or hardly a link was found. Then the nodes that still share a key with another
    component are compared across components, every pair once, as far as ``near`` allows. A pair within a component
    needs no comparison, so no key is expanded into all of its pairs, and no link between two components is lost.
    """

    def close(pairs: DataFrame) -> DataFrame:
        one, two = facts.withColumnRenamed("node", "a").alias("one"), facts.withColumnRenamed("node", "b").alias("two")
        return pairs.join(one, "a").join(two, "b").where(near("one", "two")).select("a", "b")

    links, rare, rest = None, False, None
    roots = member.select("node", F.col("node").alias("root")).limit(0)
    open_ = scratch.keep(member.withColumn("root", F.col("node")), "open", light=True)  # in the beginning every key is open
    for turn in range(ROUNDS + 1):
        if turn:
            rooted = open_.select("key", "node").join(roots, "node", "left")
            rooted = scratch.keep(rooted.select("key", "node", F.coalesce("root", "node").alias("root")), "rooted", light=True)
            lots = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
            lots = lots.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"), F.count("*").alias("roots"))
            lots = scratch.keep(lots.where("roots > 1"), "open-keys", light=True)
            scratch.drop(open_)
            open_ = scratch.keep(rooted.join(lots.select("key"), "key"), "open", light=True)
            pairs = F.sum((F.col("n").cast("double") * F.col("n") - F.col("inside")) / 2)
            rows, pairs = (x or 0 for x in lots.agg(F.sum("n").alias("rows"), pairs.alias("pairs")).first())
            scratch.drop(rooted)
            if not rows and rest is None:
                return roots
            over = rare or turn == ROUNDS or pairs <= FEW * rows
            if not over and rest is None:  # small keys wait for the end
                whole, many = open_, lots.where(F.col("n") > 2 * FEW).select("key")
                rest = scratch.keep(whole.join(many, "key", "left_anti"), "rest", light=True)
                open_ = scratch.keep(whole.join(many, "key", "left_semi"), "open", light=True)
                scratch.drop(whole)
            scratch.drop(lots)
            if over:
                break
        rank = F.struct(F.xxhash64("node", F.lit(turn)), "node", "root")
        leaders = open_.groupBy("key").agg(F.min(rank).alias("x"), F.max(rank).alias("y"))
        led = open_.join(leaders, "key").select("node", "root", F.explode(F.array("x", "y")).alias("to"))
        led = led.where(F.col("root") != F.col("to.root")).groupBy("node").agg(F.min("to").alias("x"), F.max("to").alias("y"))
        led = led.select(F.col("node").alias("a"), F.explode(F.array("x.node", "y.node")).alias("b")).distinct()
        led = scratch.keep(close(led), "led", light=True)
        found = scratch.keep(verify(led), "links")
        hits = found.count()
        rare = hits * RARE < led.count()
        scratch.drop(led)
        if not hits and not turn:  # every key is still open, and no pair within a component is among them
            break
        if hits:
            links = found if links is None else links.union(found)
            roots = components(links, scratch)
    if rest is not None:
        late = rest.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        open_, big = scratch.keep(open_.union(late), "open", light=True), open_
        scratch.drop(big, rest)
    own = open_.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("key")), 1, SEEN).alias("least"))
    nodes = scratch.keep(own.join(facts, "node"), "open-nodes", light=True)
    held = scratch.keep(open_.join(nodes, "node"), "held", light=True)
    x, y = held.alias("x"), held.alias("y")
    # of the keys that both have among their least ones the pair counts at the first only
    met = F.array_min(F.array_intersect("x.least", "y.least"))
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & near("x", "y")
    crossing = x.join(y, apart & (F.coalesce(met, F.col("x.key")) == F.col("x.key")))
    crossing = crossing.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    found = scratch.keep(verify(crossing), "links")
    if found.take(1):
        roots = components(found if links is None else links.union(found), scratch)
    scratch.drop(held, nodes, open_)
    return roots
