"""Operator 6, byte-level BPE.

Each match of the splitting pattern is encoded by itself.  Over the byte positions of a piece stands a segment tree
whose leaves hold the rank of the pair that starts there (the part at this byte and its live right neighbour) and
whose root therefore names the pair of least rank, the leftmost of equals.  A merge changes three leaves: the merged
part, the swallowed one and the live left neighbour; each is a point update of logarithmic cost, so a piece of n
bytes takes O(n log n) however it is made up.

Ids of short pieces are remembered in a table of bounded size per worker.  Null texts count as empty, texts are
encoded whole however long they are, repeated rows are repeated, other columns are ignored, whatever their names, an
empty table stays empty.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.llm.common import map_batches, rows_of, table

#: Pieces that one generation of a worker's memory holds; two generations are kept.
MEMORY = 200_000
#: Longer pieces (bytes) aren't remembered.
MEMORY_PIECE = 64

_NONE = 1 << 62


class Encoder:
    """Ranks of a byte-level BPE vocabulary: encode_piece(), encode() and decode()."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.memory = _Memory(self)

    def encode_piece(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n < 2:
            return [ranks[piece[i : i + 1]] for i in range(n)]
        size = 1 << (n - 2).bit_length()  # leaves for the n - 1 places where a pair can start
        shift = size.bit_length()
        mask = (1 << shift) - 1
        get = ranks.get
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << shift | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 2))  # where the part that starts here ends; n: the end
        before = list(range(-1, n))

        def put(leaf: int, value: int) -> None:
            i = size + leaf
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least
                i >>= 1

        while tree[1] != _NONE:
            i = tree[1] & mask
            j = after[i]
            k = after[j]
            after[i] = k
            if j < n - 1:
                put(j, _NONE)
            if k < n:
                before[k] = i
                rank = get(piece[i : after[k]])
                put(i, _NONE if rank is None else rank << shift | i)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                rank = get(piece[h:k])
                put(h, _NONE if rank is None else rank << shift | h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids as little-endian unsigned 32-bit integers."""
        return np.frombuffer(b"".join(map(self.memory.__getitem__, self.split(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


class _Memory(dict):
    """piece -> its ids' bytes, in two generations of bounded size."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            raw = piece.encode()
            got = np.array(self.encoder.encode_piece(raw), "<u4").tobytes()
            if len(raw) > MEMORY_PIECE:
                return got
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got


@functools.lru_cache(2)
def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """By a rank file (a line: token in base 64, rank); by default that of the installed public tokenizers."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks, pattern or public_tokenizers.PATTERN)


def release() -> None:
    encoder.cache_clear()


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ids: binary of little-endian unsigned 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in rows_of(batch):
                ids = (own.encode(t.as_py() or "").tobytes() for t in part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    return map_batches(df.select(F.col(id_col).cast("long").alias(id_col), text_col), run, f"{id_col} long, ids binary")


def decode_ids(df: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """id, ids, bytes: the decoded bytes (for whole encodings: the text's UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in rows_of(batch):
                decoded = (own.decode(np.frombuffer(i.as_py() or b"", "<u4")) for i in part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.binary())], [id_col, "ids", "bytes"])

    return map_batches(df.select(F.col(id_col).cast("long").alias(id_col), "ids"), run, f"{id_col} long, ids binary, bytes binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decode_ids(encode_texts(table(spark, sf_dir, "documents")))
    return got.select("doc_id", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
