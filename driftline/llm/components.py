"""Connected components of a graph of links, on Spark throughout.

Each round, every node takes the smallest of itself and its neighbours, and the
links are drawn anew between these; nodes fall by a constant factor a round when
their order is random, as that of hashes is.  Before each round, union-find inside
the partitions cuts the links to a forest.  Each round's tables are written to the
shared folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import written

#: Links that one union-find holds in memory at a time.
FOREST_LINKS = 200_000


def union_find(links) -> dict:
    """Smallest node reachable from each node of some (a, b) links."""
    parent: dict = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _forests(links: DataFrame) -> DataFrame:
    """Fewer links with the same components."""

    def run(batches):
        held: list = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= FOREST_LINKS:
                yield forest(held)
                held = []
        yield forest(held)

    def forest(held):
        found = [(b, a) for a, b in union_find(held).items() if a != b]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in range(2)], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b) links over binary node names; the root is the smallest node it reaches."""
    links = written(_forests(links.where(F.col("a") != F.col("b"))).distinct(), "links")
    rounds = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("to")), "step")
        rounds.append(step)
        moved = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        moved = moved.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links = written(_forests(moved).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[-1]
    for step in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = step.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    return found.select("node", F.col("to").alias("root"))
