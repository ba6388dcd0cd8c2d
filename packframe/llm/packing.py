"""Operator 4, best-fit packing by exact complements.

Only the histogram of piece lengths, at most `capacity` numbers, is gathered on the driver, and the plan is made on it:
patterns of lengths that fill a sequence, each with the number of its copies.  For every length, longest first, the gap
to the capacity is looked up in indexes of single lengths, sums of two and sums of three, and as many copies are
consumed as the counts allow; what is left is packed best-fit, longest first.  Each step of the exact part uses up a
length (but for an odd last copy), so the plan's size depends on the capacity and not on the corpus.

Pieces of one length are interchangeable: each is numbered among its equals (in salted groups, whose offsets are
added), and the number picks the copy of a pattern, hence its sequence and the place in it.

Defined results: null and empty texts are the end token alone; documents over the capacity are cut into full pieces
and a last one; very long ones are tokenised whole; repeated rows are packed as often as they occur;
other columns are ignored, whatever their names; an empty table has no pieces.
"""

from __future__ import annotations

import functools
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packframe.llm.common import BATCH_BYTES, map_batches, rows_of, stored, table

CAPACITY = 4096
END_TOKEN = 1
#: Words and bytes of words that one generation of a worker's memory holds; two generations are kept.
MEMORY, MEMORY_BYTES = 400_000, 32 << 20

#: Words of letters that are tokenised in one call.
_TOGETHER = 500
#: str.split() takes these for blanks, the tokenizer does not.
_NO_BLANKS = re.compile("[\x1c-\x1f]").search
#: Without these a text is in NFC and lower() works letter by letter, as the tokenizer's own normalisation does.
_NOT_PLAIN = re.compile("[\u0130\u0250-\U0010ffff]").search


class WordTokenizer:
    """A tokenizers file that puts texts in lower case and whose ids depend on each blank-separated word alone; words
    are remembered.  Texts that hold a special token's string, in whatever case, go to the library as they are."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.most = memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.mark = re.match(r"[^\w]*", os.path.commonprefix(special))[0]  # a quick test before the search
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)", re.IGNORECASE).search
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters alone, many of them to a call: tokens are told apart by the word they belong to."""
        out: list[bytes] = []
        for at in range(0, len(words), _TOGETHER):
            part = words[at : at + _TOGETHER]
            got = self.inner.encode(" ".join(part), add_special_tokens=False)
            ids, of = array("I", got.ids).tobytes(), np.array(got.word_ids, np.int64)
            cuts = (4 * np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]))).tolist()
            out += [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if len(cuts) == len(part) + 1 else self._ids(part)
        return out

    def _learn(self, missing: set[str]) -> None:
        """Puts words into the memory.  Marks behind letters are a token sequence of their own: both parts are looked up."""
        ends = {w: base for w in missing if (base := w.rstrip(string.punctuation)) != w and base.isalpha() and (base.isascii() or not _NOT_PLAIN(base))}
        parts = (missing - ends.keys()).union(ends.values(), (w[len(base) :] for w, base in ends.items()))
        for w in parts.difference(self.new).intersection(self.old):
            self.new[w] = self.old[w]
        unknown = parts.difference(self.new)
        letters = [w for w in unknown if w.isalpha() and (w.isascii() or not _NOT_PLAIN(w))]
        others = list(unknown.difference(letters))
        self.new.update(zip(letters, self._word_ids(letters), strict=True))
        self.new.update(zip(others, self._ids(others), strict=True))
        for w, base in ends.items():
            self.new[w] = self.new[base] + self.new[w[len(base) :]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as native (little-endian) unsigned 32-bit integers."""
        split = [None if _NO_BLANKS(t) or (self.mark in t and self.special(t)) else t.split() if _NOT_PLAIN(t) else t.lower().split() for t in texts]
        need = set().union(*(w for w in split if w))
        need.difference_update(self.new)
        again = need.intersection(self.old)
        for w in again:
            self.new[w] = self.old[w]
        self._learn(need.difference(again))
        self.held += sum(map(len, need))
        get = self.new.__getitem__
        out = [self._ids([t])[0] if w is None else b"".join(map(get, w)) for t, w in zip(texts, split, strict=True)]
        if len(self.new) >= self.most or self.held >= MEMORY_BYTES:
            self.old, self.new, self.held = self.new, {}, 0
        return out


@functools.lru_cache(2)
def tokenizer(path: str | None = None, memory: int = MEMORY) -> WordTokenizer:
    import public_tokenizers

    return WordTokenizer(path or public_tokenizers.path("word_bpe_49k.json"), memory)


def release() -> None:
    tokenizer.cache_clear()


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, memory: int = MEMORY, part_bytes: int = BATCH_BYTES) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32 (and ids).

    memory and part_bytes (words remembered, text worked on at a time) trade a worker's memory for its time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, memory)
        end = np.array([END_TOKEN], "<u4").tobytes()
        for batch in batches:
            for part in rows_of(batch, part_bytes):
                rows: list[tuple] = []
                blobs: list[bytes] = []
                for i, ids in zip(part.column(0).to_pylist(), own.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    whole = ids + end
                    for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                        piece = whole[at : at + 4 * capacity]
                        rows.append((i, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                        if with_ids:
                            blobs.append(piece)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(blobs, pa.binary())] if with_ids else []), [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_batches(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), run, schema)


#: Lengths that turned out to have no pair left after which the index of pairs is made anew.
STALE = 64


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their copies that use up counts[length] pieces of each length (1 to capacity)."""
    left = np.zeros(capacity + 1, np.int64)
    left[: len(counts)] = counts
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> bool:
        copies = min(int(left[x]) // pattern.count(x) for x in pattern)
        if copies:
            out.append((pattern, copies))
            for x in pattern:
                left[x] -= copies
        return copies > 0

    def pair(total: int, beside: tuple[int, ...]) -> bool:
        """Consumes beside + (a, total - a) for one a, if any."""
        if total < 2:
            return False
        a = np.arange(total - 1, (total - 1) // 2, -1)
        for x in a[(left[a] > 0) & (left[total - a] > 0)]:
            if take((*beside, int(x), int(total - x))):
                return True
        return False

    take((capacity,))
    for n in range(capacity - 1, 0, -1):  # single complements
        if left[n]:
            take((n, capacity - n))
    for n in range(capacity - 2, 0, -1):  # sums of two
        while left[n] and pair(capacity - n, (n,)):
            pass
    pairs = _sums(left)
    for n in range(capacity - 3, 0, -1):  # sums of three
        top = capacity - n - 2
        while left[n] and top > 0:  # counts only fall, so a length without a pair is not tried again beside n
            a = np.arange(top, 0, -1)
            a = a[(left[a] > 0) & pairs[capacity - n - a]]
            missed = 0
            for x in a.tolist():
                top = x - 1
                while left[n] and pair(capacity - n - x, (n, x)):
                    pass
                missed += bool(left[n])
                if missed == STALE or not left[n]:
                    break
            else:
                break
            if missed == STALE:
                pairs = _sums(left)
    return out + _best_fit(left, capacity)


def _sums(left: np.ndarray) -> np.ndarray:
    """Whether a number is the sum of two lengths that are there."""
    there = (left > 0).astype(np.float32)
    n = 1 << (2 * len(there)).bit_length()
    f = np.fft.rfft(there, n)
    return np.fft.irfft(f * f, n)[: len(there)] > 0.5


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first; each goes where the gap is least, as many to a sequence as fit.  Works on groups of like sequences."""
    groups: dict[int, list[list]] = {}  # gap -> [pattern, copies]
    gaps = np.zeros(capacity + 1, bool)
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], gap: int, copies: int) -> None:
        if copies:
            groups.setdefault(gap, []).append([pattern, copies])
            gaps[gap] = True

    for n in range(capacity, 0, -1):
        count = int(left[n])
        while count:
            fits = np.flatnonzero(gaps[n:])
            gap = n + int(fits[0]) if len(fits) else capacity
            each = min(gap // n, count)
            pattern, copies = groups[gap][-1] if len(fits) else ((), count // each)
            used = min(copies, count // each)
            if len(fits):
                groups[gap][-1][1] -= used
                if not groups[gap][-1][1]:
                    groups[gap].pop()
                    gaps[gap] = bool(groups[gap])
            put((*pattern, *[n] * each), gap - each * n, used)
            count -= used * each
    for kept in groups.values():
        done += [(p, c) for p, c in kept if c]
    return done


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length << 40 | first number) with the first sequence, the place in it, and the first number again."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, copies in patterns:
        at = 0
        for x in pattern:
            rows.append((x << 40 | used.get(x, 0), sequence, at, used.get(x, 0)))
            used[x] = used.get(x, 0) + copies
            at += x
        sequence += copies
    got = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return got[:, 0], got[:, 1], got[:, 2], got[:, 3]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `pieces` (with length) and sequence_id, offset.  `pieces` is read several times: give stored rows."""
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    key, first, place, number = slots(plan(counts, capacity))

    salt = F.pmod(F.xxhash64(*pieces.columns), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    salted = pieces.withColumn("packframe_salt", salt)
    order = Window.partitionBy("length", "packframe_salt").orderBy(*pieces.columns)
    numbered = salted.withColumn("packframe_no", F.row_number().over(order) - 1)
    before = Window.partitionBy("length").orderBy("packframe_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "packframe_salt").count().select("length", "packframe_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("packframe_from"))
    joined = numbered.join(offsets, ["length", "packframe_salt"]).select(*pieces.columns, (F.col("packframe_no") + F.col("packframe_from")).alias("packframe_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, no = batch.column("length").to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            at = np.searchsorted(key, (length << 40) | no, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first[at] + no - number[at]), pa.array(place[at])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return map_batches(joined, run, pieces.select("*").schema.add("sequence_id", "long").add("offset", "long"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(cut(table(spark, sf_dir, "documents")), "pieces")  # a few numbers for each piece
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
