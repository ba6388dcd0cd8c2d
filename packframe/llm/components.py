"""Connected components of a table of links, without gathering links or components anywhere.

Each task first reduces its links to a forest.  Then, in rounds, every node takes the least of its neighbours (if
less than itself) as its parent, parents are followed to their roots by doubling, and the links between roots are
what is left; each round at least halves the nodes that still have links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packframe.llm.common import map_batches, stored

#: Links that a task reduces at a time.
_AT_ONCE = 500_000


def forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Each node but the roots, with its root: the least node that a-b links reach."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top:
            up[x], x = top, p
        return top

    for x, y in zip(a, b, strict=True):
        up.setdefault(x, x)
        up.setdefault(y, y)
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    nodes = [x for x in up if root(x) != x]
    return nodes, [root(x) for x in nodes]


def _reduced(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= _AT_ONCE:
                yield one(held)
                held = []
        if held:
            yield one(held)

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]).tolist() for i in (0, 1))
        nodes, roots = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

    return map_batches(links, run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of links(a long, b long)."""
    nodes = None
    left = stored(_reduced(links.select("a", "b").filter("a <> b")), "links")
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a").toDF("a", "b"))
        up = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "parents")
        while True:
            to = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            up = stored(up.join(to, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "parents")
            moved = not up.filter("moved").isEmpty()
            up = up.select("node", "root")
            if not moved:
                break
        to = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        if nodes is None:
            nodes = up
        else:
            nodes = stored(nodes.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "nodes")
        a, b = (up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
        linked = left.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).filter("a <> b").distinct()
        left = stored(_reduced(linked), "links")
    return nodes if nodes is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
