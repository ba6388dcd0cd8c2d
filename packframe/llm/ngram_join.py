"""Operator 1, n-gram Jaccard join by prefix trees.

Sets of word shingles (sorted 64-bit hashes) link when 100 * intersection >= 75 * union.  The result is exact, and
nothing in it grows with the square of a group of near copies:

1. Equal sets are one set.  They are compared by 128-bit digests of all their shingles, and numbered by the first half;
   where different sets have the same first half, all but one are numbered by the other half.
2. Shingles have one global order: by the binary logarithm of a count of how often they occur (0 for all but the
   frequent ones, which the tasks find and add up), then by hash.  Linked sets share more than n // SPARE of their first
   n - ceil(0.75 n) + 1 + n // SPARE shingles in that order; only these are shuffled, and those of a single set go.
3. A shingle that few sets share makes pairs of sets; a pair stays if its number of such shared shingles leaves it a
   chance.  A shingle that more sets share is given to its hub, the one of its sets whose shingles are shared most,
   and its sets join the shard of that hub, but for those that have n // SPARE such shingles or fewer: whatever they are
   linked with shares one with them that few sets have.  So sets that merely have some common phrases, as most do in a
   large corpus, don't meet.  A large shard is dealt to blocks.  Rows of a shingle known to be in HOT sets or more are
   dealt to parts of about half as many, so that no task gets all of them.
4. In a block the sets stand in a prefix tree, ordered by hash.  Probing it with a set adds up overlaps along the
   paths, once for all sets that share one, and drops subtrees when what remains on both sides can't make up the
   overlap that is needed.  A pair's first set is probed against those paired with it.  A hub is probed against each
   of its blocks, and so is every set that isn't linked with the hub: against its own block, and, in a second
   round, against the hub's other blocks.  Of the links found only a spanning forest is put out.
5. Components of the forest give the classes; members are joined back.

The broadcast table of frequent shingles has MOST_FREQUENT rows at most.  Which shingles are in it changes the work,
not the result.

Defined results: null and empty texts have no shingles and link with nothing; rows with a null doc_id get no
component (null) and link with nothing; repeated ids are rows of their own, which share the id; very long texts are
sets like any other, worked on alone in their batch; other columns are ignored, whatever their names; an empty table
stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from packframe.llm.common import map_batches, rows_of, stored, table
from packframe.llm.components import components
from packframe.llm.shingles import shingle_sets

WORDS = 5
#: Rows of the table of frequent shingles, and the least count in it; what a task must see of a shingle, at least, in
#: so many shingles, to name it.
MOST_FREQUENT, FREQUENT, SEEN, SEEN_IN = 500_000, 8, 2, 4_000_000
#: Sets sharing a shingle up to which pairs are made; sets of a block.
FEW, BLOCK = 32, 4096
#: One more shingle of a prefix for so many of the set.
SPARE = 20
#: Binary logarithm of the count from which on a shingle's rows are dealt to parts.
HOT = 10
#: Rows up to which a table of two numbers each is broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000


def prefix_length(n: int) -> int:
    """Of a set of n: linked sets share more than n // SPARE, of the larger one, of so many first elements."""
    return n + (-3 * n // 4) + 1 + n // SPARE if n else 0


def linked(common, n, m):
    """Whether Jaccard similarity is 0.75 at least, in integers."""
    return 7 * common >= 3 * (n + m)


def halves(own: np.ndarray, id_bytes: int = 8) -> tuple[int, int]:
    """A 128-bit digest of a set, in two numbers; the first one has id_bytes bytes only."""
    raw = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:id_bytes], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


@dataclass(frozen=True)
class Numbers:
    """How sets are numbered: twins are the digests whose first half another set has too."""

    id_bytes: int = 8
    twins: frozenset[tuple[int, int]] = frozenset()

    def of(self, own: np.ndarray) -> int:
        both = halves(own, self.id_bytes)
        return both[1] if both in self.twins else both[0]


class PrefixTree:
    """Sorted sets (uint64) by common beginnings.  Nodes: a run of shingles, and the sets that pass through it."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.order = np.array(order, np.int64)
        own = [sets[i] for i in order]
        self.sizes = np.array([len(x) for x in own], np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.sizes)))
        flat = np.concatenate(own) if own else np.empty(0, np.uint64)
        self.known, self.flat = np.unique(flat, return_inverse=True)
        self.values = flat
        common = np.zeros(len(own) + 1, np.int64)
        for i in range(1, len(own)):
            k = min(len(own[i - 1]), len(own[i]))
            differ = np.flatnonzero(own[i - 1][:k] != own[i][:k])
            common[i] = differ[0] if len(differ) else k
        parent, begin, stop, last, leaf, low, high = [], [], [], [], [], [], []
        todo = [(0, len(own), 0, -1)] if own else []
        while todo:
            lo, hi, depth, up = todo.pop()
            end = int(self.sizes[lo]) if hi - lo == 1 else int(common[lo + 1 : hi].min())
            me = len(parent)
            parent.append(up)
            begin.append(self.base[lo] + depth)
            stop.append(self.base[lo] + end)
            last.append(self.base[lo] + end - 1 if end else -1)
            ends = self.sizes[lo] == end
            leaf.append(lo if ends else -1)
            low.append(self.sizes[lo:hi].min())
            high.append(self.sizes[lo:hi].max())
            cuts = lo + 1 + np.flatnonzero(common[lo + 1 : hi] == end)
            edges = [lo, *cuts.tolist(), hi]
            todo += [(a, b, end, me) for a, b in zip(edges[:-1], edges[1:], strict=True) if not (ends and a == lo)]
        self.begin, self.stop, self.last, self.leaf, self.low, self.high = (np.array(x, np.int64) for x in (begin, stop, last, leaf, low, high))
        depth = np.array([self.base[0]] * 0, np.int64)
        parents = np.array(parent, np.int64)
        kids = np.argsort(parents, kind="stable")
        self.kids = kids
        self.first_kid = np.searchsorted(parents[kids], np.arange(len(parents)))
        self.last_kid = np.searchsorted(parents[kids], np.arange(len(parents)), "right")
        depth = np.zeros(len(parents), np.int64)
        for i in range(len(parents)):  # parents come before their children
            depth[i] = (depth[parents[i]] if parents[i] >= 0 else 0) + self.stop[i] - self.begin[i]
        self.depth = depth
        self.mark = np.zeros(len(self.known) + 1, bool)

    def probe(self, x: np.ndarray) -> np.ndarray:
        """The numbers, in the list given, of the sets that are linked with x."""
        n = len(x)
        if not n or not len(self.leaf):
            return np.empty(0, np.int64)
        at = np.searchsorted(self.known, x)
        own = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == x)]
        self.mark[own] = True
        found = []
        front, before = np.array([0]), np.zeros(1, np.int64)
        while len(front):
            fits = (4 * self.high[front] >= 3 * n) & (3 * self.low[front] <= 4 * n)
            front, before = front[fits], before[fits]
            if not len(front):
                break
            length = self.stop[front] - self.begin[front]
            ends = np.cumsum(length)
            runs = np.arange(ends[-1]) + np.repeat(self.begin[front] - ends + length, length)
            hits = np.concatenate(([0], np.cumsum(self.mark[self.flat[runs]])))
            overlap = before + hits[ends] - hits[ends - length]
            leaf = self.leaf[front]
            done = leaf >= 0
            done[done] = linked(overlap[done], n, self.sizes[leaf[done]])
            found.append(leaf[done])
            passed = np.where(self.last[front] >= 0, self.values[self.last[front]], np.uint64(0))
            rest = np.where(self.last[front] >= 0, n - np.searchsorted(x, passed, "right"), n)
            chance = overlap + np.minimum(rest, self.high[front] - self.depth[front])
            alive = linked(chance, n, self.low[front])
            front, overlap = front[alive], overlap[alive]
            count = self.last_kid[front] - self.first_kid[front]
            ends = np.cumsum(count)
            if not len(front) or not ends[-1]:
                break
            before = np.repeat(overlap, count)
            front = self.kids[np.arange(ends[-1]) + np.repeat(self.first_kid[front] - ends + count, count)]
        self.mark[own] = False
        return self.order[np.concatenate(found)] if found else np.empty(0, np.int64)


def shingled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, keep: list[str] | None = None, id_bytes: int = 8) -> DataFrame:
    """The columns `keep`, doc_id, n (size of the set), set and twin (both halves of its digest) of every row."""
    fields = [StructField(x, LongType()) for x in ("doc_id", "n", "set", "twin")]
    rows = docs.select(*(F.col(c) for c in keep or []), F.col(id_col).cast("long").alias("packframe_id"), F.col(text_col).alias("packframe_text"))
    k = len(keep or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                own = shingle_sets(part.column(k + 1).cast(pa.binary()).to_pylist(), words)
                numbers = list(zip(*(halves(x, id_bytes) for x in own), strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([*part.columns[: k + 1], pa.array([len(x) for x in own], pa.int64()), *(pa.array(c, pa.int64()) for c in numbers)], [*(keep or []), *(f.name for f in fields)])

    return map_batches(rows, run, StructType([*rows.schema.fields[:k], *fields]))


def contents(docs: DataFrame, numbers: Numbers, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, set, shingles (the sorted hashes, 8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                own = shingle_sets(part.column(1).cast(pa.binary()).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([numbers.of(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["doc_id", "set", "shingles"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), run, "doc_id long, set long, shingles binary")


def _distinct_sets(batches: Iterator[pa.RecordBatch], words: int, numbers: Numbers) -> Iterator[tuple[int, np.ndarray]]:
    """The sets of a task's texts, each once."""
    seen: set[int] = set()
    for batch in batches:
        for part in rows_of(batch):
            for s in shingle_sets(part.column(0).cast(pa.binary()).to_pylist(), words):
                if len(s) and (d := numbers.of(s)) not in seen:
                    seen.add(d)
                    yield d, s


def frequent(texts: DataFrame, words: int = WORDS, numbers: Numbers = Numbers()) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the binary logarithm of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(SEEN_IN, np.uint64), 0
        for _, s in _distinct_sets(batches, words, numbers):
            for at in range(0, len(s), SEEN_IN):
                part = s[at : at + SEEN_IN]
                if size + len(part) > SEEN_IN:
                    yield repeated(held[:size])
                    size = 0
                held[size : size + len(part)] = part
                size += len(part)
        if size:
            yield repeated(held[:size])

    def repeated(value: np.ndarray) -> pa.RecordBatch:
        """Sorts in place; only what is there more than once takes more memory."""
        value.sort()
        same = np.concatenate(([False], value[1:] == value[:-1], [False]))
        first, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
        count = last - first + 1
        keep = count >= SEEN
        return pa.RecordBatch.from_arrays([pa.array(value[first[keep]].view(np.int64)), pa.array(count[keep])], ["shingle", "n"])

    sums = map_batches(texts, run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    got = sums.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toPandas()
    value = got["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], np.log2(np.maximum(1, got["n"].to_numpy(np.int64)[order])).astype(np.uint8)


def prefixes(texts: DataFrame, often: tuple[np.ndarray, np.ndarray], words: int = WORDS, numbers: Numbers = Numbers(), hot: int = HOT) -> DataFrame:
    """shingle, set, n, part: the first shingles of each set in the global order.  part: 0, or from 1 on for shingles
    whose count has a binary logarithm of `hot` or more."""
    value, rank = often

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        size = 0
        for d, s in _distinct_sets(batches, words, numbers):
            n, first = len(s), prefix_length(len(s))
            ranks = np.zeros(n, np.uint8)
            if len(value):
                at = np.minimum(np.searchsorted(value, s), len(value) - 1)
                ranks = np.where(value[at] == s, rank[at], 0)
                if ranks.any():
                    order = np.argsort(ranks, kind="stable")[:first]
                    s, ranks = s[order], ranks[order]
            held.append((d, n, s[:first], ranks[:first]))
            size += first
            if size >= 200_000:
                yield flat(held)
                held, size = [], 0
        if held:
            yield flat(held)

    def flat(held: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        counts = [len(s) for _, _, s, _ in held]
        own = np.repeat(np.array([d for d, _, _, _ in held], np.int64), counts)
        ranks = np.concatenate([r for _, _, _, r in held]).astype(np.int64)
        part = np.where(ranks >= hot, 1 + (own & ((1 << np.maximum(0, ranks - hot + 1)) - 1)), 0)
        columns = [np.concatenate([s for _, _, s, _ in held]).view(np.int64), own, np.repeat(np.array([n for _, n, _, _ in held], np.int32), counts), part.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "set", "n", "part"])  # the two random numbers side by side: shuffled rows compress better

    return map_batches(texts, run, "shingle long, set long, n int, part int")


def shared(rows: DataFrame) -> DataFrame:
    """shingle, set, n, part, size: of the prefixes, what `size` > 1 sets share; each once.  Stored.

    Groups of part 0 are of shingles that no task saw often: one in a million at most, whatever the corpus.  The others
    are counted by part, and their sums, MOST_FREQUENT at most, are broadcast."""
    own = Window.partitionBy("shingle", "part")
    several = rows.withColumns({"lo": F.min("set").over(own), "hi": F.max("set").over(own)}).filter("lo <> hi or part > 0").select("shingle", "set", "n", "part").distinct()
    counted = stored(several.withColumn("size", F.count(F.lit(1)).over(own)), "shared")
    sums = counted.filter("part > 0").groupBy("shingle").agg(F.count(F.lit(1)).alias("sum"))
    return counted.join(F.broadcast(sums), "shingle", "left").select("shingle", "set", "n", "part", F.coalesce("sum", "size").alias("size")).filter("size > 1")


def _large(common: DataFrame, few: int) -> DataFrame:
    """set, large, joins: of sets with shingles that more than `few` share, how many, and whether the set joins shards."""
    count = common.filter(F.col("size") > few).groupBy("set").agg(F.count(F.lit(1)).alias("large"), F.first("n").alias("n"))
    return stored(count.select("set", "large", (F.col("large") > F.floor(F.col("n") / SPARE)).alias("joins")), "large")


def candidates(common: DataFrame, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """a, b, block: pairs of sets that share small groups of prefix shingles, enough to have a chance; b meets its partners
    in blocks -1, -2, ... of about `block` of them.  A pair that doesn't meet in a shard may also share larger groups."""
    small = common.filter(F.col("size") <= few).select("shingle", "set", "n")
    a, b = (small.select("shingle", F.col("set").alias(s), F.col("n").alias(f"n_{s}")) for s in ("a", "b"))
    near = (F.col("a") < F.col("b")) & (4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b"))
    pairs = a.join(b, "shingle").filter(near).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    behind = lambda n: F.ceil(0.75 * F.col(n)) - 1 - F.floor(F.col(n) / SPARE)  # noqa: E731  what follows the prefix
    chance = lambda more: 7 * (F.col("c") + more + F.greatest(behind("n_a"), behind("n_b"))) >= 3 * (F.col("n_a") + F.col("n_b"))
    sized = _sized(_large(common, few))
    for x in ("a", "b"):
        pairs = pairs.join(sized.select(F.col("set").alias(x), F.col("large").alias(f"large_{x}"), F.col("joins").alias(f"joins_{x}")), x, "left")
    both = F.coalesce(F.col("joins_a") & F.col("joins_b"), F.lit(False))
    kept = pairs.filter(chance(F.when(both, 0).otherwise(F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0))))))
    most = (F.col("n_b") - behind("n_b")) * (few - 1)  # partners that b can have
    return kept.select("a", "b", (-1 - F.pmod(F.xxhash64("a"), F.ceil(most / block))).cast("int").alias("block"))


def _sized(df: DataFrame) -> DataFrame:
    """A table of a few numbers, broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def shards(common: DataFrame, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """hub, set, block, blocks: who meets where, for shingles that more sets share; of the sets that join."""
    large = common.filter(F.col("size") > few).select("shingle", "part", "set", "size").join(_sized(_large(common, few).filter("joins").select("set")), "set", "left_semi")
    fame = large.groupBy("set").agg(F.sum("size").alias("fame"))
    hubs = large.join(fame, "set").groupBy("shingle").agg(F.max_by("set", F.struct("fame", "set")).alias("hub"), F.max("part").alias("parts"))
    # hubs of shingles dealt to parts are MOST_FREQUENT at most
    dealt = large.filter("part > 0").join(F.broadcast(hubs.filter("parts > 0").select("shingle", "hub")), "shingle")
    others = large.filter("part = 0").join(hubs.filter("parts = 0").select("shingle", "hub"), "shingle")
    members = stored(dealt.select("hub", "set").union(others.select("hub", "set")).distinct(), "members")
    sizes = members.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).filter("blocks > 1")
    placed = members.join(_sized(sizes), "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return placed.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))


_FOUND = "a long, b long, hub long, block int, apart boolean"


def _probe(rows: DataFrame) -> DataFrame:
    """From rows (hub, block, kind, set, shingles), sorted by kind in each block.  kind 0: probed against the block
    alone; 1: in the tree; 2: in the tree, and probed itself unless it is linked with one of kind 0; 3: probed by
    itself, a stranger to the block.  Puts out links (a, b) and, as `apart`, the sets of kind 2 that aren't linked
    with the hub."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple[int, int, np.ndarray]]]]:
        key, held = None, []
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for hub, block, kind, own, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (hub, block) != key:
                    if held:
                        yield key, held
                    key, held, seen = (hub, block), [], set()
                if (kind, own) in seen:
                    continue
                seen.add((kind, own))
                held.append((kind, own, np.frombuffer(raw, np.uint64)))
        if held:
            yield key, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (hub, block), held in blocks(batches):
            inside = [(k, d, s) for k, d, s in held if k in (1, 2)]
            tree = PrefixTree([s for _, _, s in inside])
            up = list(range(len(held)))
            place = {d: i for i, (_, d, _) in enumerate(held)}

            def root(i: int, up: list[int] = up) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            main = -1
            for i, (kind, d, s) in enumerate(held):
                if kind == 1 or (kind == 2 and main >= 0 and root(i) == root(main)):
                    continue
                if kind == 2 and main < 0:
                    main = place.get(hub, i)
                for j in tree.probe(s).tolist():
                    other = inside[j][1]
                    x, y = root(i), root(place[other])
                    if x != y:
                        up[y] = x
                        out.append((d, other, hub, block, False))
            out += [(d, d, hub, block, True) for i, (k, d, _) in enumerate(held) if k == 2 and root(i) != root(place.get(hub, main))]
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["a", "b", "hub", "block", "apart"])

    dealt = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "kind")
    return map_batches(dealt, run, _FOUND)


def links(docs: DataFrame, sets: DataFrame, numbers: Numbers, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """a, b: a spanning forest, at least, of the links between different sets.  sets: set, least (a doc_id of it)."""
    texts = docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(text_col)
    common = shared(prefixes(texts, frequent(texts, words, numbers), words, numbers))
    pairs = candidates(common)
    members = stored(shards(common), "shards")
    # who meets whom: pairs in blocks of their own (below 0), hubs in each of their blocks
    hubs = members.select("hub", "block").distinct()
    meet = stored(
        pairs.select(F.col("b").alias("hub"), "block", F.lit(1).alias("kind"), F.col("a").alias("set"))
        .union(pairs.select(F.col("b").alias("hub"), "block", F.lit(0).alias("kind"), F.col("b").alias("set")).distinct())
        .union(members.filter("set <> hub").select("hub", "block", F.lit(2).alias("kind"), "set"))
        .union(hubs.select("hub", "block", F.lit(0).alias("kind"), F.col("hub").alias("set"))),
        "meetings",
    )
    needed = _sized(stored(meet.select("set").distinct().join(sets.select("set", F.col("least").alias("doc_id")), "set"), "needed"))
    ids = _sized(needed.select(F.col("doc_id").alias(id_col)).distinct())
    content = contents(docs.select(id_col, text_col).join(ids, id_col, "left_semi"), numbers, id_col, text_col, words)
    content = content.join(needed, ["set", "doc_id"], "left_semi").select("set", "shingles")  # a repeated row repeats its set

    found = stored(_probe(meet.join(content, "set").select("hub", "block", "kind", "set", "shingles")), "links")
    result = found.filter("not apart").select("a", "b")
    # sets that aren't linked with their hub meet the hub's other blocks
    apart = found.filter("apart").select("hub", F.col("block").alias("own"), F.col("a").alias("set"))
    many = members.filter("blocks > 1")
    if not many.isEmpty():
        strangers = apart.join(_sized(many.select("hub", "blocks").distinct()), "hub").select("hub", "own", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).filter("own <> block")
        second = many.filter("set <> hub").select("hub", F.col("block").cast("int").alias("block"), F.lit(1).alias("kind"), "set").union(strangers.select("hub", "block", F.lit(3), "set"))
        more = stored(_probe(second.join(content, "set").select("hub", "block", "kind", "set", "shingles")), "links")
        result = result.union(more.filter("not apart").select("a", "b"))
    return result


def _numbered(rows: DataFrame, id_bytes: int) -> tuple[DataFrame, Numbers]:
    """rows with sets that differ under different numbers.  What reaches the driver are the digests whose first half is
    that of another set: among n sets about n**2 / 2**65."""
    several = rows.groupBy("set").agg(F.min("twin").alias("first"), F.max("twin").alias("last")).filter("first <> last")
    found = rows.join(several, "set").filter("twin <> first").select("set", "twin").distinct().collect()
    if not found:
        return rows, Numbers(id_bytes)
    twins = rows.sparkSession.createDataFrame([(r["set"], r["twin"], True) for r in found], "set long, twin long, packframe_moved boolean")
    moved = rows.join(F.broadcast(twins), ["set", "twin"], "left").withColumn("set", F.when(F.col("packframe_moved"), F.col("twin")).otherwise(F.col("set")))
    return moved.select(*rows.columns), Numbers(id_bytes, frozenset((r["set"], r["twin"]) for r in found))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, keep: list[str] | None = None, id_bytes: int = 8) -> DataFrame:
    """The columns `keep`, doc_id, n_shingles, component_id, class_id of every row.  class_id: a number of the class that no
    other class has, also where ids are repeated; null where component_id is null, or is that of an empty set."""
    rows, numbers = _numbered(stored(shingled(docs, id_col, text_col, words, keep, id_bytes), "sizes"), id_bytes)
    sets = stored(rows.filter("n > 0 and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("least")), "sets")
    roots = components(links(docs, sets, numbers, id_col, text_col, words))
    placed = sets.join(roots, sets["set"] == roots["node"], "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    tops = placed.groupBy("root").agg(F.min("least").alias("component"))
    known = placed.join(tops, "root").select("set", "component", "root")
    got = rows.join(known, "set", "left")
    linked_row = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    component = F.when(linked_row, F.col("component")).otherwise(F.col("doc_id"))
    return got.select(*(keep or []), "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(linked_row, F.col("root")).alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of docs less all but one of each class: the one of the least id, and of equal ids that of the least hash of
    its text.  Rows without an id or without words are in no class, and stay, repeated ones too."""
    blank = F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    alone = F.col(id_col).isNull() | blank
    tagged = docs.withColumn("packframe_tag", F.xxhash64(text_col))
    found = classes(tagged.filter(~alone), id_col, text_col, words, ["packframe_tag"])
    kept = found.groupBy("class_id").agg(F.min(F.struct("doc_id", "packframe_tag")).alias("k")).select(F.col("k.doc_id").alias(id_col), "k.packframe_tag").distinct()
    one = tagged.filter(~alone).join(kept, [id_col, "packframe_tag"], "left_semi").dropDuplicates([id_col, "packframe_tag"])
    return one.select(*(f"`{c}`" for c in docs.columns)).unionByName(docs.filter(alone))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS h FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(c) AS component_id FROM r GROUP BY v) t ON t.v = d.doc_id
"""
