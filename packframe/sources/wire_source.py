"""Tables in files of wire text.

read_table() and write_table() leave the files to Spark: any file system, reading line by line in parallel, a writer's
task a file.  What each file says of itself (its count, its trailer, its fields) is held against what is in it.

spark.read / write / writeStream.format("packframe") is for documents that are read as a whole, one table each: a task
a file.  Its files are opened through pyarrow's file systems (local, s3://, hdfs://, gs://), so a path without a scheme
must be a folder that all executors see.  Without a schema all files are read to merge their cells' types (an integer
column with doubles is double, any other mix is string).  Files of a job are shown when it is complete; those of a
stream's batch are in a folder of their own, which a replay replaces.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from packframe.errors import WireError
from packframe.functions import format_scalar, lenient_cell, split_cells
from packframe.operators.tables import decode_rows
from packframe.plans import document
from packframe.plans.values import declaration, key_text
from packframe.streaming.encoders import TableStream

SUFFIX = ".wire"
#: Columns that PERMISSIVE reading fills, where the schema has them.
ERROR, CORRUPT = "_error_code", "_corrupt_line"


def _store(options: dict) -> tuple[pafs.FileSystem, str]:
    path = options["path"]
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def _files(options: dict) -> list[str]:
    store, path = _store(options)
    if store.get_file_info(path).type != pafs.FileType.Directory:
        return [path]
    found = store.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.endswith(SUFFIX) and not f.base_name.startswith("."))


def _rows(options: dict, path: str) -> list[dict]:
    with _store(options)[0].open_input_stream(path) as f:
        value = document.decode(f.read().decode())
    if isinstance(value, dict) and len(value) == 1:
        value = next(iter(value.values()))
    if isinstance(value, dict):
        return [] if not value else [value]
    return value


def _kind(values: list) -> T.DataType:
    seen = {type(v) for v in values if v is not None}
    if seen == {bool}:
        return T.BooleanType()
    if seen == {int}:
        return T.LongType()
    if seen and seen <= {int, float}:
        return T.DoubleType()
    if seen == {dict}:
        return _struct([v for v in values if v is not None])
    if seen == {list}:
        return T.ArrayType(_kind([x for v in values if v for x in v]))
    return T.StringType()


def _struct(rows: list[dict]) -> T.StructType:
    names = dict.fromkeys(k for r in rows for k in r)
    return T.StructType([T.StructField(n, _kind([r.get(n) for r in rows])) for n in names])


def _as(value: object, kind: T.DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_as(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_as(x, kind.elementType) for x in value]
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else document.scalar_text(value)
    return value


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.options)]

    def read(self, partition: _File) -> Iterator[tuple]:
        """PERMISSIVE: a file that isn't sound is one row of nulls with its path and the code of the error."""
        try:
            rows = _rows(self.options, partition.path)
            for row in rows:
                if extra := row.keys() - {*self.schema.names}:
                    raise WireError("invalid_field_declaration", f"{partition.path} has {sorted(extra)}, which the schema lacks")
        except WireError as e:
            if self.options.get("mode", "FAILFAST").upper() != "PERMISSIVE":
                raise
            said = {ERROR: e.code, CORRUPT: partition.path}
            yield tuple(said.get(n) for n in self.schema.names)
            return
        for row in rows:
            yield _as(row, self.schema)


def _plain(value: object) -> object:
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    return str(value)


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Commits:
    """A part is written under a hidden name and shown when its job (or batch) is complete."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool = False):
        for f in schema.fields:
            if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) or ">" in f.name:
                raise WireError("invalid_field_declaration", f"column {f.name} can't be in a row of a stream")
        self.schema, self.options, self.overwrite = schema, options, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, folder = _store(self.options)
        store.create_dir(folder, recursive=True)
        path = f"{folder}/.{uuid.uuid4().hex}{SUFFIX}"
        with store.open_output_stream(path) as f:
            out = TableStream(lambda text: f.write(text.encode()))
            out.begin(self.options.get("name", "rows"), self.schema.names)
            for row in rows:
                out.row([_plain(v) for v in row])
            out.close()
        return _Written(path)

    def show(self, messages: list, name: str) -> None:
        """Moves the parts to the folder `name`, whose former files go."""
        store, folder = _store(self.options)
        former = _files(self.options) if self.overwrite else []
        if store.get_file_info(f"{folder}/{name}").type == pafs.FileType.Directory:
            store.delete_dir(f"{folder}/{name}")
        store.create_dir(f"{folder}/{name}", recursive=True)
        for i, m in enumerate(x for x in messages if x):
            store.move(m.path, f"{folder}/{name}/part-{i:05d}{SUFFIX}")
        for path in former:  # last, so that there is always a table
            if store.get_file_info(path).type == pafs.FileType.File:
                store.delete_file(path)

    def drop(self, messages: list) -> None:
        store, _ = _store(self.options)
        for m in messages:
            if m and store.get_file_info(m.path).type == pafs.FileType.File:
                store.delete_file(m.path)


class _Writer(_Commits, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self.show(messages, f"job-{uuid.uuid4().hex}")

    def abort(self, messages: list) -> None:
        self.drop(messages)


class _StreamWriter(_Commits, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.show(messages, f"batch-{batchId:08d}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.drop(messages)


class WireSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packframe"

    def schema(self) -> T.StructType:
        """Of the cells of all files: give a schema where there are many."""
        rows = [r for p in _files(self.options) for r in _rows(self.options, p)]
        return _struct(rows)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, self.options, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WireSource)


_HEADER = document.MAGIC + " "


def wire_lines(df: DataFrame, name: str = "rows") -> DataFrame:
    """line: for each partition of df, in its order, a whole wire: header, section `[?]`, a line a row, and the trailer with
    their number.  Cells are formatted in the JVM."""
    if bad := [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) or ">" in f.name]:
        raise WireError("invalid_field_declaration", f"column {bad[0]} can't be in a row of a stream")
    line = F.concat_ws("|", *(format_scalar(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields))
    head = [document.HEADER, f"## {key_text(name)} [?]{declaration(df.columns)}"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        yield pa.RecordBatch.from_arrays([pa.array(head)], ["line"])
        for batch in batches:
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["line"])
        yield pa.RecordBatch.from_arrays([pa.array([f"##! summary counts={n}"])], ["line"])

    return df.select(line.alias("line")).mapInArrow(run, "line string")


def write_table(df: DataFrame, path: str, name: str = "rows", mode: str = "errorifexists") -> None:
    """A file a partition, each a wire of its own, by Spark's writer of text (any file system, complete or not there)."""
    wire_lines(df, name).write.mode(mode).option("maxRecordsPerFile", 0).text(path)


def write_stream(df: DataFrame, path: str, name: str = "rows"):
    """A DataStreamWriter that puts each batch into `path`/batch-N; a replayed batch replaces its folder."""
    return df.writeStream.foreachBatch(lambda batch, n: write_table(batch, f"{path.rstrip('/')}/batch-{n:08d}", name, "overwrite"))


def table_files(spark: SparkSession, path: str, fields: list[str] | None = None, trailer: bool = True) -> DataFrame:
    """file, rows, error: the number of rows of each wire file of a flat table, and the code of what is wrong with the file
    as a whole, if anything: no header, not one section, other fields than `fields`, another number of rows than the
    section or the trailer says, or (with `trailer`) neither of them."""
    lines = _lines(spark, path)
    section = F.when(F.col("line").startswith("## "), F.regexp_extract("line", r'^## (?:"(?:[^"\\]|\\.)*+"|[^"\[{]*+) ?\[([^\]]*)\]', 1))
    declared = F.when(F.col("line").startswith("## "), F.regexp_replace("line", r'^## (?:"(?:[^"\\]|\\.)*+"|[^"\[{]*+) ?\[[^\]]*\]', ""))
    summed = F.when(F.col("line").startswith("##! "), F.regexp_extract("line", r" counts=(\S+)", 1))
    got = lines.groupBy("file").agg(
        F.count_if(F.col("line").startswith(_HEADER)).alias("heads"), F.count(section).alias("sections"), F.max(section).alias("count"), F.max(declared).alias("fields"),
        F.max(summed).alias("sum"), F.count_if(_is_row(F.col("line"))).alias("rows"),
    )
    n, count, total = F.col("rows").cast("string"), F.col("count"), F.col("sum")
    known = count.rlike(r"\A(0|[1-9][0-9]*)\z")
    error = (
        F.when(F.col("heads") != 1, "missing_header")
        .when(F.col("sections") != 1, "invalid_line")
        .when(~known & (count != "?"), "invalid_count")
        .when((known & (count != n)) | (total.isNotNull() & (total != n)) | (F.lit(trailer) & ~known & total.isNull()), "count_mismatch")
    )
    if fields is not None:
        error = error.when((F.col("rows") > 0) & (F.col("fields") != declaration(fields)), "invalid_field_declaration")
    return got.select("file", "rows", error.alias("error"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    got = spark.read.option("recursiveFileLookup", True).text(path)
    return got.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r$", "").alias("line")).filter("line <> ''")


def _is_row(line: Column) -> Column:
    return ~(line.startswith("## ") | line.startswith("##! ") | line.startswith("# ") | line.startswith(_HEADER))


def read_table(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST", trailer: bool = True) -> DataFrame:
    """Flat table rows of wire files anywhere, line by line in parallel.

    Files are checked as a whole first (table_files(), one aggregate).  FAILFAST raises the first error of a file here, and
    that of a row when the result is used.  PERMISSIVE adds `_error_code` and `_corrupt_line`: a row of another width, or
    with a cell of another type, has nulls, its code and its text; sound rows of a file with an error have its code."""
    files = table_files(spark, path, schema.names, trailer)
    if mode.upper() != "PERMISSIVE":
        if (bad := files.filter("error is not null").first()) is not None:
            raise WireError(bad["error"], bad["file"])
        own = _lines(spark, path)
        return decode_rows(own.select(F.when(_is_row(F.col("line")), F.col("line")).alias("line")).filter("line is not null"), schema)
    if nested := [f.name for f in schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]:
        raise WireError("invalid_field_declaration", f"column {nested[0]}: use documents")
    rows = _lines(spark, path).filter(_is_row(F.col("line"))).join(files.filter("error is not null").select("file", "error"), "file", "left")
    cells = rows.select("line", "error", split_cells(F.col("line")).alias("_cells"))
    wide = F.size("_cells") == len(schema.fields)
    read = [lenient_cell(F.get("_cells", F.lit(i)), f.dataType) for i, f in enumerate(schema.fields)]
    wrong = F.lit(False)
    for _, other in read:
        wrong = wrong | other
    code = F.when(~wide, "row_width_mismatch").when(wrong, "invalid_line")
    return cells.select(
        *(F.when(wide & ~wrong, value).alias(f.name) for (value, _), f in zip(read, schema.fields, strict=True)),
        F.coalesce(code, "error").alias(ERROR), F.when(code.isNotNull(), F.col("line")).alias(CORRUPT),
    )
