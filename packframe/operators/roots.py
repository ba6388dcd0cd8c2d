"""Content addresses of tables and graphs: one SHA-256 of all records in byte order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packframe.functions import abbreviate_kind, canonical_cell, number_text
from packframe.errors import WireError
from packframe.operators.sha256 import State
from packframe.streaming.storage import drop, new_folder

#: Bytes of canonical text up to which the root is an aggregate; beyond, sorted parts are hashed one after another.
#: The root is defined as one digest of all records, so hashing is sequential; sorting and formatting are not.
SMALL = 64 << 20
#: Bytes of a part, and of the values in it.
PART, CHUNK = 128 << 20, 1 << 20


def record(df: DataFrame, fields: list[str] | None = None) -> Column:
    """The canonical record of a row: fields in byte order, each with its canonical cell."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(fields or df.columns, key=lambda n: n.encode())
    for n in names:
        if kinds[n].typeName() in ("struct", "array", "map", "variant"):
            raise WireError("delta_invalid", f"nested column {n}")
    cells = [x for n in names for x in (F.lit("\t" + n + "\t"), canonical_cell(F.col(f"`{n}`"), kinds[n]))]
    return F.concat(F.lit("R"), *cells, F.lit("\n"))


def _joined(records: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_list(records)), "")


def table_root_frame(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row: pack_root.  For tables whose canonical text fits into a row."""
    return df.agg(F.concat(F.lit("sha256:"), F.sha2(_joined(record(df, fields)), 256)).alias("pack_root"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a partition, joined to values of about CHUNK bytes."""
    held: list[bytes] = []
    size = 0
    for batch in batches:
        texts = batch.column(0).cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        for at in range(0, len(texts), step := max(1, len(texts) * CHUNK // max(1, int(ends[-1] - ends[0])))):
            first, last = int(ends[at]), int(ends[min(at + step, len(texts))])
            held.append(texts.buffers()[2][first:last].to_pybytes())  # texts stand behind one another in their buffer
            size += last - first
            if size >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])


def _chained(records: DataFrame, size: int, state: State) -> State:
    """The state after the records in byte order.  They are sorted in parts of about PART bytes, which are written to the
    shared folder as a few large values each; then a task a part goes on from the state that the one before it left.
    The driver holds that state alone.  Equal records may be in several parts, so that none grows with their number."""
    spark, path = records.sparkSession, new_folder(records.sparkSession, "parts")
    split = records.select("r", F.monotonically_increasing_id().alias("n")).repartitionByRange(-(-size // PART), "r", "n")
    chunks = split.sortWithinPartitions("r").select("r").mapInArrow(_chunks, "chunk binary")
    chunks.select("chunk", F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("part")).write.partitionBy("part").parquet(path)
    written = spark.read.schema("chunk binary, place long, part int").parquet(path)
    for row in sorted(written.select("part").distinct().collect()):  # a number a part
        state = _hashed(written.filter(F.col("part") == row["part"]), state)
    drop(spark, path)
    return state


def _hashed(chunks: DataFrame, state: State) -> State:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = state.after(x.as_py() for batch in batches for x in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([list(end.words)], pa.list_(pa.int64())), pa.array([end.length], pa.int64()), pa.array([end.tail], pa.binary())], ["words", "length", "tail"])

    row = chunks.coalesce(1).sortWithinPartitions("place").select("chunk").mapInArrow(run, "words array<long>, length long, tail binary").first()
    return State(tuple(row["words"]), row["length"], bytes(row["tail"]))


def root_of(*records: DataFrame, small: int = SMALL) -> str:
    """One digest of the records (r) of each DataFrame, sorted, one DataFrame after another."""
    sizes = [x.agg(F.sum(F.octet_length("r"))).first()[0] or 0 for x in records]
    if sum(sizes) <= small:
        parts = [x.agg(_joined(F.col("r")).alias(f"t{i}")) for i, x in enumerate(records)]  # one row each
        texts = F.concat(*(f"t{i}" for i in range(len(parts))))
        return "sha256:" + reduce(DataFrame.crossJoin, parts).select(F.sha2(texts, 256).alias("d")).first()["d"]
    state = State()
    for x, size in zip(records, sizes, strict=True):
        if size:
            path = new_folder(x.sparkSession, "records")  # read twice: to find the bounds of the parts, and to fill them
            x.select("r").filter("r is not null").write.parquet(path)
            state = _chained(x.sparkSession.read.schema("r string").parquet(path), size, state)
            drop(x.sparkSession, path)
    return "sha256:" + state.hexdigest()


def table_root(df: DataFrame, fields: list[str] | None = None, small: int = SMALL) -> str:
    """The root of a table of any size."""
    return root_of(df.select(record(df, fields).alias("r")), small=small)


def graph_records(symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records (r) of symbols(qualifiedName, kind, score, provenance, distance) and edges(source, target, edgeType).

    Of several symbols of a name the last one (by `_pos`, where there is one, else the greatest kind) gives the kind
    in edges."""
    s = symbols.select(
        F.concat(
            F.lit("S\t"), abbreviate_kind(F.col("kind")), F.lit("\t"), F.col("qualifiedName"), F.lit("\t"), number_text(F.col("score").cast("double")), F.lit("\t"), F.col("provenance"),
            F.lit("\t"), F.col("distance").cast("string"), F.lit("\n"),
        ).alias("r")
    )
    last = F.max_by("kind", F.coalesce("_pos", F.lit(-1))) if "_pos" in symbols.columns else F.max("kind")
    kinds = symbols.groupBy("qualifiedName").agg(abbreviate_kind(last).alias("k"))
    source, target = (kinds.select(F.col("qualifiedName").alias(n), F.col("k").alias(f"{n}_kind")) for n in ("source", "target"))
    joined = edges.select("source", "target", "edgeType").join(source, "source", "left").join(target, "target", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    e = joined.select(F.concat(F.lit("E\t"), blank(F.col("source_kind")), F.lit("\t"), "source", F.lit("\t"), blank(F.col("target_kind")), F.lit("\t"), "target", F.lit("\t"), "edgeType", F.lit("\n")).alias("r"))
    return s, e


def graph_root_frame(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: pack_root."""
    s, e = graph_records(symbols, edges)
    both = s.agg(_joined(F.col("r")).alias("s")).crossJoin(e.agg(_joined(F.col("r")).alias("e")))  # one row each
    return both.select(F.concat(F.lit("sha256:"), F.sha2(F.concat("s", "e"), 256)).alias("pack_root"))


def graph_root(symbols: DataFrame, edges: DataFrame, small: int = SMALL) -> str:
    return root_of(*graph_records(symbols, edges), small=small)
