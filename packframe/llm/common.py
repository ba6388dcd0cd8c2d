"""What the operators share: reading tables, bounded Arrow batches, tables in the shared folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of one Arrow batch between the JVM and a Python worker; a single longer row is a batch of its own.
BATCH_BYTES = 8 << 20


#: Rows of one key from which on join_common() deals them out, and the most rows of a table of keys that is broadcast.
COMMON, BROADCAST_ROWS = 1000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_others(owner: str) -> None:
    """Lets go of what other operators of this subpackage keep in this worker between tasks."""
    for name, module in list(sys.modules.items()):
        if name.startswith("packframe.llm.") and name != owner and hasattr(module, "release"):
            module.release()


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of about BATCH_BYTES, so that long texts don't add up in a worker.

    Spark has this limit as a setting of the session that is read when a plan runs, so it is lowered in the caller's
    session (and never raised)."""
    conf, owner = df.sparkSession.conf, function.__module__
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others(owner)
        yield from function(batches)

    return df.mapInArrow(run, schema)


def rows_of(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most `limit` bytes, one row at least."""
    n, size = batch.num_rows, max(1, batch.nbytes)
    step = max(1, int(n * limit / size)) if size > limit else max(1, n)
    for at in range(0, n, step):
        yield batch.slice(at, step)


def add_columns(df: DataFrame, keep: list[str], text_col: str, fields: list[StructField], function: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """The columns `keep` of every row, and `fields`, which `function` makes of the texts of some rows at a time."""
    rows = df.select(*keep) if text_col in keep else df.select(*keep, text_col)
    at, n = rows.columns.index(text_col), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *function(part.column(at))], [*keep, *(f.name for f in fields)])

    return map_batches(rows, run, StructType([*df.select(*keep).schema.fields, *fields]))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Only where that setting is missing and the master is local, as in tests, a local folder is made and set; on a
    cluster each executor would write to its own disk.  The path is deleted when the driver's JVM ends.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = sc._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="packframe-")
        sc.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written to the shared folder and read again: lineage ends here."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A table of a few numbers a row, broadcast if it has BROADCAST_ROWS at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_common(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of `many` rows of a key with `few`.  Rows of keys that are there more than COMMON times are dealt to
    salts, and what they meet is copied to each salt, so that no key lands in one task."""
    common = stored(many.groupBy(*keys).count().filter(F.col("count") > COMMON).select(*keys, F.ceil(F.col("count") / COMMON).cast("int").alias("packframe_salts")), "common")
    salts = F.coalesce("packframe_salts", F.lit(1))
    dealt = many.join(small(common), keys, "left").withColumn("packframe_salt", F.pmod(F.xxhash64(*many.columns), salts).cast("int")).drop("packframe_salts")
    copied = few.join(small(common), keys, "left").withColumn("packframe_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("packframe_salts")
    return dealt.join(copied, [*keys, "packframe_salt"]).drop("packframe_salt")
