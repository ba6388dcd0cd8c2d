"""Operator 10, approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are one node, which names the k + 1 smallest of their ids: no query can return more of them.  Nodes are
dealt by a hash of the vector to shards of about SHARD nodes, or of GROWTH times the square root of all nodes if that is
more (but of SHARD_BYTES at most), so that shards become larger as well as more.  A shard's graph has levels of geometrically falling
size; on each level a node is linked with up to `m` (twice as many on the lowest) near nodes of different directions,
both ways.  Link candidates come from a blocked exact search inside the shard, so the graph doesn't depend on any
order of insertion.  It is stored as flat arrays: vectors, and for each level its nodes and a table of neighbours.

A search enters at the top, follows a beam down, and keeps the best `beam` nodes on the lowest level.  Queries with
equal vectors are searched once.  Each is sent to every shard of its dimension, in chunks of QUERIES, and the shards'
results are merged.  Scores are cosines of the original vectors in double precision; vectors are scaled by a power of
two first, which changes no score but keeps squares of very large and very small components finite.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors are
compared with those of the same dimension; equal scores go to the smaller id; a query never returns its own id; a
null id is no query and no candidate; repeated rows of an id are one candidate (the best of them); other columns are
ignored, whatever their names; an empty table has no results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packframe.llm.common import join_common, map_batches, small, stored, table
from packframe.llm.shingles import mix64

SHARD, GROWTH, SHARD_BYTES = 8192, 8, 64 << 20
#: Queries that one task sends through a shard.
QUERIES = 1 << 16
LINKS = 16
CANDIDATES = 64
BEAM = 192
_AT_ONCE = 256

_INDEX = "dim int, shard int, ids array<array<bigint>>, vectors binary, levels array<binary>, neighbours array<binary>"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is from 0.5 to 1."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    even = scaled(vectors)
    return (even / np.linalg.norm(even, axis=1, keepdims=True)).astype(np.float32)


def _nearest(unit: np.ndarray, count: int) -> np.ndarray:
    """For each row the `count` nearest other rows, nearest first; -1 where there are fewer."""
    n = len(unit)
    keep = min(count, n - 1)
    out = np.full((n, count), -1, np.int32)
    for s in range(0, n, 1024):
        sims = unit[s : s + 1024] @ unit.T
        sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -np.inf
        if keep:
            top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep] if keep < n - 1 else np.argsort(-sims, axis=1)[:, :keep]
            order = np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable")
            out[s : s + 1024, :keep] = np.take_along_axis(top, order, 1)
    return out


def _linked(unit: np.ndarray, m: int, most: int) -> np.ndarray:
    """A table of up to `most` neighbours of each row: up to m diverse ones, then links from those that chose it."""
    n = len(unit)
    near = _nearest(unit, min(CANDIDATES, max(1, n - 1)))
    kept = np.full((n, m), -1, np.int32)
    size = np.zeros(n, np.int64)
    own = np.arange(n)
    for r in range(near.shape[1]):
        c = near[:, r]
        closeness = np.einsum("ij,ij->i", unit, unit[c])
        good = (c >= 0) & (size < m)
        for j in range(m):
            held = good & (j < size)
            if not held.any():
                break
            good[held] &= np.einsum("ij,ij->i", unit[c[held]], unit[kept[held, j]]) <= closeness[held]
        kept[own[good], size[good]] = c[good]
        size[good] += 1
    for r in range(near.shape[1]):  # fill with the nearest that were passed over
        c = near[:, r]
        free = (size < m) & (c >= 0) & ~(kept == c[:, None]).any(1)
        kept[own[free], size[free]] = c[free]
        size[free] += 1
    source, target = np.repeat(own, m), kept.ravel()
    source, target = source[target >= 0], target[target >= 0]
    pairs = np.unique(np.concatenate((source * n + target, target.astype(np.int64) * n + source)))
    a, b = pairs // n, pairs % n
    chosen = (kept[a] == b[:, None]).any(1)
    order = np.lexsort((-np.einsum("ij,ij->i", unit[a], unit[b]), ~chosen, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, most), -1, np.int32)
    fits = place < most
    out[a[fits], place[fits]] = b[fits]
    return out


def build(vectors: np.ndarray, m: int = LINKS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Levels from the lowest up: the nodes of each, and their neighbours (nodes; -1: none)."""
    n = len(vectors)
    unit = _unit(vectors)
    seed = mix64(np.ascontiguousarray(vectors).view(np.uint8).reshape(n, -1).astype(np.uint64) @ (np.arange(vectors.shape[1] * vectors.itemsize, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    height = np.floor(-np.log((seed.astype(np.float64) + 1) / 2.0**64) / math.log(m)).astype(int)
    levels, neighbours = [], []
    level = 0
    while True:
        nodes = np.flatnonzero(height >= level).astype(np.int32)
        if level and (len(nodes) == 0 or len(nodes) == len(levels[-1])):
            break
        table = _linked(unit[nodes], m, 2 * m if level == 0 else m)
        levels.append(nodes)
        neighbours.append(np.where(table >= 0, nodes[table], -1).astype(np.int32))
        if len(nodes) <= m:
            break
        level += 1
    return levels, neighbours


class Graph:
    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray], neighbours: list[np.ndarray]):
        self.vectors = scaled(vectors)
        self.unit = _unit(vectors)
        self.levels, self.neighbours = levels, neighbours

    def _level(self, q: np.ndarray, start: np.ndarray, level: int, beam: int) -> np.ndarray:
        """Beam search of all queries on one level; a row of the best nodes (-1: none) for each, best first."""
        nodes, links = self.levels[level], self.neighbours[level]
        place = np.zeros(len(self.vectors), np.int32)
        place[nodes] = np.arange(len(nodes))
        n, step = len(q), 4
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.vectors) + 1), bool)
        best = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        new = start
        while new.shape[1]:
            new = np.where(np.take_along_axis(seen, new, 1) | (new < 0), -1, new)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            seen[rows, new] = True  # column -1 takes the gaps
            s = np.where(new >= 0, np.einsum("ijk,ik->ij", self.unit[new], q), -np.inf).astype(np.float32)
            sims, best, open_ = np.concatenate((sims, s), 1), np.concatenate((best, new), 1), np.concatenate((open_, new >= 0), 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            sims, best, open_ = (np.take_along_axis(x, order, 1) for x in (sims, best, open_))
            turn = np.argsort(~open_, axis=1, kind="stable")[:, :step]
            going = np.take_along_axis(open_, turn, 1)
            if not going.any():
                break
            np.put_along_axis(open_, turn, False, 1)
            picked = np.where(going, np.take_along_axis(best, turn, 1), -1)
            new = np.where(picked[:, :, None] >= 0, links[place[picked]], -1).reshape(n, -1).astype(np.int64)
        return best

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The best nodes of each query (rows), nearest first; -1: none."""
        q = _unit(queries)
        start = np.tile(self.levels[-1].astype(np.int64), (len(q), 1))
        for level in range(len(self.levels) - 1, -1, -1):
            start = self._level(q, start, level, beam if level == 0 else max(8, beam // 8))
        return start


def sound(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part, and dim."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size(v))


def build_index(rows: DataFrame, k: int = 5, shard_nodes: int | None = None) -> DataFrame:
    """The shards of sound() rows, a row of flat arrays each.  shard_nodes: nodes of a shard, by default what fits their
    number and dimension."""
    same = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.dropDuplicates(["vec_id", "vector"]).withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    nodes = stored(few.groupBy("vector", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-nodes")
    count = F.count(F.lit(1))
    each = F.lit(shard_nodes) if shard_nodes else F.least(F.greatest(F.lit(SHARD), F.ceil(GROWTH * F.sqrt(count))), F.greatest(F.lit(1024), F.floor(SHARD_BYTES / (8 * F.col("dim")))))
    sizes = nodes.groupBy("dim").agg(F.ceil(count / each).cast("int").alias("shards"))
    dealt = nodes.join(small(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        v = got["vector"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
        order = np.lexsort(v.T[::-1])  # whatever order the rows came in
        v = np.ascontiguousarray(v[order])
        levels, neighbours = build(v)
        yield pa.RecordBatch.from_arrays(
            [
                got["dim"].combine_chunks().slice(0, 1), got["shard"].combine_chunks().slice(0, 1), pa.array([got["ids"].take(pa.array(order)).to_pylist()], pa.list_(pa.list_(pa.int64()))),
                pa.array([v.tobytes()], pa.binary()), pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())), pa.array([[x.tobytes() for x in neighbours]], pa.list_(pa.binary())),
            ],
            ["dim", "shard", "ids", "vectors", "levels", "neighbours"],
        )

    return dealt.select("dim", "shard", "ids", "vector").groupBy("dim", "shard").applyInArrow(lambda t: pa.Table.from_batches(list(shard(iter(t.to_batches())))), _INDEX)


def search(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM, at_most: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query (a sound() row)."""
    key = ["h1", "h2"]  # 128 bits of the vector
    own = queries.dropDuplicates(["vec_id", "vector"]).select("dim", "vector", F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit("2")).alias("h2"))
    asked = stored(own.groupBy("dim", *key).agg(F.first("vector").alias("vector")), "ann-queries")
    chunks = max(1, -(-asked.count() // at_most))
    shards = small(index.groupBy("dim").agg((F.max("shard")).alias("last")))
    nothing = {c: F.lit(None).cast(t) for c, t in (("ids", "array<array<bigint>>"), ("vectors", "binary"), ("levels", "array<binary>"), ("neighbours", "array<binary>"))}
    sent = asked.join(shards, "dim").select("dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), F.pmod("h2", F.lit(chunks)).cast("int").alias("chunk"), *key, "vector").withColumns(nothing)
    copies = index.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))), "h1": F.lit(None).cast("long"), "h2": F.lit(None).cast("long"), "vector": F.lit(None).cast("array<double>")})
    both = copies.unionByName(sent).repartition("dim", "shard", "chunk").sortWithinPartitions("dim", "shard", "chunk", F.col("vectors").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, ids = None, None
        for batch in batches:
            x = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            heads = [i for i in range(batch.num_rows) if x["vectors"][i].is_valid]
            for at, stop in zip([0, *heads], [*heads, batch.num_rows], strict=True):
                if at < stop and x["vectors"][at].is_valid:
                    v = np.frombuffer(x["vectors"][at].as_py(), np.float64).reshape(-1, x["dim"][at].as_py())
                    levels = [np.frombuffer(b, np.int32) for b in x["levels"][at].as_py()]
                    graph = Graph(v, levels, [np.frombuffer(b, np.int32).reshape(len(n), -1) for b, n in zip(x["neighbours"][at].as_py(), levels, strict=True)])
                    ids = x["ids"][at].as_py()
                    at += 1
                for s in range(at, stop, _AT_ONCE):
                    n = min(stop, s + _AT_ONCE) - s
                    q = x["vector"].slice(s, n).flatten().to_numpy().reshape(n, -1)
                    yield _answers(graph, ids, list(zip(x["h1"].slice(s, n).to_pylist(), x["h2"].slice(s, n).to_pylist(), strict=True)), q, k + 1, beam)

    def best(found: DataFrame, by: list[str], count: int) -> DataFrame:
        each = found.groupBy(*by, "vec_id").agg(F.max("score").alias("score"))
        return each.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= count)

    # one more than is asked for, since a query is a node as well
    top = best(map_batches(both, run, "h1 long, h2 long, vec_id long, score double"), key, k + 1).drop("rank")
    pairs = join_common(own.select("query_id", *key), top, key).filter("query_id <> vec_id")
    return best(pairs, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _answers(graph: Graph, ids: list[list[int]], keys: list[tuple[int, int]], q: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    best = graph.search(q, beam)
    q = scaled(q)
    out: list[tuple[int, int, int, float]] = []
    for i, key in enumerate(keys):
        nodes = best[i][best[i] >= 0]
        v = graph.vectors[nodes]
        cosine = (v * q[i]).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q[i] * q[i]).sum()))
        rows = sorted((-c, x) for c, node in zip(cosine.tolist(), nodes.tolist(), strict=True) for x in ids[node])
        out += [(*key, x, -c) for c, x in rows[:k]]
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["h1", "h2", "vec_id", "score"])


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sound(table(spark, sf_dir, "embeddings"))
    index = stored(build_index(rows), "ann-index")
    return search(index, rows.filter(F.col("vec_id") % 50 == 0))
