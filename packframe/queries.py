"""The library's own queries, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packframe import functions as P
from packframe.functions.scalar import KINDS
from packframe.operators import delta as D
from packframe.operators import documents, graph, roots, session, tables
from packframe.operators.ordering import with_row_index
from packframe.plans.document import HEADER, MAGIC
from packframe.plans.values import QUOTE_PATTERN
from packframe.sources import wire_source
from packframe.streaming.reanchor import Policy, ReanchorSession, wire_bytes
from packframe.streaming.storage import new_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def register(function: Query) -> Query:
        key = name or function.__name__
        _QUERIES[key] = function
        if sql:
            _SQL[key] = sql
        return function

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _value(spark: SparkSession, name: str, value: object) -> DataFrame:
    """One row: what was computed."""
    return spark.range(1).select(F.lit(value).alias(name))


# SQL of the scalar grammar


def _quoted(x: str) -> str:
    out = "replace(replace(" + x + ", '\\', '\\\\'), '\"', '\\\"')"
    for code in range(1, 32):
        short = {8: "\\b", 12: "\\f", 10: "\\n", 13: "\\r", 9: "\\t"}.get(code, f"\\u{code:04x}")
        out = f"replace({out}, chr({code}), '{short}')"
    return f"('\"' || {out} || '\"')"


def _string(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN '-' WHEN regexp_matches({x}, '{QUOTE_PATTERN}') THEN {_quoted(x)} ELSE {x} END)"


def _number(x: str) -> str:
    """Of doubles that are written without an exponent."""
    return f"coalesce(regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '\\.0$', ''), '^-0$', '0'), '-')"


def _integer(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '-')"


def _time(x: str) -> str:
    return f"coalesce(strftime({x}, '%Y-%m-%dT%H:%M:%S.%f'), '-')"


def _canonical(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN '-' ELSE {_quoted(x)} END)"


def _line(*cells: str) -> str:
    return " || '|' || ".join(cells)


_LINES = {
    "nation": ("n_nationkey", _line(_integer("n_nationkey"), _string("n_name"), _integer("n_regionkey"))),
    "orders": ("o_orderkey", _line(_integer("o_orderkey"), _integer("o_custkey"), _string("o_orderstatus"), _number("o_totalprice"), _time("o_orderdate"), _string("o_orderpriority"))),
    "customer": ("c_custkey", _line(_integer("c_custkey"), _string("c_name"), _integer("c_nationkey"), _number("c_acctbal"), _string("c_mktsegment"))),
    "events": ("event_id", _line(_integer("event_id"), _time("ts"), _integer("user_id"), _string("event_type"), _number("value"), _string("props"))),
}

_ORDER_RECORD = (
    "'R' || chr(9) || 'o_custkey' || chr(9) || {custkey} || chr(9) || 'o_orderdate' || chr(9) || {date} || chr(9) || 'o_orderkey' || chr(9) || {orderkey} || chr(9) || 'o_orderpriority' || chr(9) || {priority}"
    " || chr(9) || 'o_orderstatus' || chr(9) || {status} || chr(9) || 'o_totalprice' || chr(9) || {price} || chr(10)"
).format(custkey=_integer("o_custkey"), date="(CASE WHEN o_orderdate IS NULL THEN '-' ELSE chr(34) || " + _time("o_orderdate") + " || chr(34) END)", orderkey=_integer("o_orderkey"), priority=_canonical("o_orderpriority"), status=_canonical("o_orderstatus"), price=_number("o_totalprice"))


def _root(record: str, source: str) -> str:
    return f"SELECT 'sha256:' || sha256(coalesce(string_agg(r, '' ORDER BY r), '')) AS pack_root FROM (SELECT {record} AS r FROM {source})"


# scalar functions


@_query(
    f"SELECT 'd' AS source, doc_id AS id, regexp_matches(text, '{QUOTE_PATTERN}') AS quoted FROM documents "
    f"UNION ALL SELECT 'c', conv_id * 1000 + turn, regexp_matches(text, '{QUOTE_PATTERN}') FROM conversations UNION ALL SELECT 'e', event_id, regexp_matches(event_type, '{QUOTE_PATTERN}') FROM events"
)
def needs_quote_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.lit("d").alias("source"), F.col("doc_id").alias("id"), P.needs_quote(F.col("text")).alias("quoted"))
    c = _read(spark, sf_dir, "conversations").select(F.lit("c"), F.col("conv_id") * 1000 + F.col("turn"), P.needs_quote(F.col("text")))
    return d.union(c).union(_read(spark, sf_dir, "events").select(F.lit("e"), "event_id", P.needs_quote(F.col("event_type"))))


@_query(f"SELECT doc_id, {_quoted('text')} AS quoted FROM documents")
def quote_string_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", P.quote_string(F.col("text")).alias("quoted"))


@_query("SELECT doc_id, text FROM documents")
def unquote_string_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_string_text(spark, sf_dir).select("doc_id", P.unquote_string(F.col("quoted")).alias("text"))


@_query(f"SELECT l_orderkey, l_partkey, {_number('l_extendedprice')} AS price, {_number('l_discount')} AS discount FROM lineitem")
def format_number_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", P.number_text(F.col("l_extendedprice")).alias("price"), P.number_text(F.col("l_discount")).alias("discount"))


@_query("SELECT event_id, CASE WHEN value = 0 THEN '0' ELSE regexp_replace(CAST(value / 1e12 AS VARCHAR), 'e([+-])0*', 'e\\1') END AS small FROM events")
def format_number_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", P.number_text(F.col("value") / 1e12).alias("small"))


@_query("SELECT c_custkey, printf('%.2f', c_acctbal / 7) AS score FROM customer")
def score_two_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", P.score_text(F.col("c_acctbal") / 7).alias("score"))


_CELLS = ("", "-", "~", "^", "^{a,b}", "true", "false", "0", "-0", "12", "9223372036854775807", "9223372036854775808", "1.5", "1e9", "-2E-3", "01", "+5", ".5", " 12", "NaN", "abc", '"a b"', '"open', '""')
_TAGS = (
    "CASE WHEN x = '' THEN 'string' WHEN x LIKE '\"%' THEN CASE WHEN length(x) > 1 AND x LIKE '%\"' THEN 'string' ELSE 'error' END WHEN x = '-' THEN 'null' WHEN x = '~' THEN 'absent'"
    " WHEN x = '^' OR regexp_matches(x, '^\\^\\{.*\\}$') THEN 'attachment' WHEN x IN ('true', 'false') THEN 'bool'"
    " WHEN regexp_matches(x, '^-?[0-9]+$') AND regexp_matches(x, '^-?(0|[1-9][0-9]*)$') THEN CASE WHEN try_cast(x AS BIGINT) IS NULL THEN 'error' ELSE 'int' END"
    " WHEN regexp_matches(x, '^-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?$') THEN 'double' ELSE 'string' END"
)


@_query(
    f"WITH t(x) AS (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in _CELLS)}), u AS (SELECT x FROM t UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT o_orderpriority FROM orders)"
    f" SELECT x AS cell, {_TAGS} AS tag FROM u"
)
def parse_scalar_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.range(1).select(F.explode(F.array(*(F.lit(c) for c in _CELLS))).alias("cell"))
    o = _read(spark, sf_dir, "orders")
    cells = fixed.union(o.select(F.col("o_orderkey").cast("string"))).union(o.select("o_orderpriority"))
    return cells.select("cell", P.parse_scalar(F.col("cell"))["tag"].alias("tag"))


@_query("SELECT c_custkey, CAST(5 AS INTEGER) AS n, c_name || ',x' AS second, '' AS third FROM customer")
def split_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("|", F.col("c_custkey").cast("string"), P.quote_string(F.concat("c_name", F.lit(",x"))), F.lit(""), P.quote_string(F.concat("c_mktsegment", F.lit("|"))), F.lit("z"))
    got = _read(spark, sf_dir, "customer").select("c_custkey", P.split_cells(line).alias("c"))
    return got.select("c_custkey", F.size("c").alias("n"), P.unquote_string(F.col("c")[1]).alias("second"), F.col("c")[2].alias("third"))


@_query(
    "SELECT k AS kind, a AS short, k AS back FROM (VALUES "
    + ", ".join(f"('{k}', '{a}')" for k, a in KINDS.items())
    + ", ('gadget', 'gadget')) t(k, a)"
)
def kind_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.range(1).select(F.explode(F.array(*(F.lit(k) for k in (*KINDS, "gadget")))).alias("kind"))
    short = P.abbreviate_kind(F.col("kind"))
    return kinds.select("kind", short.alias("short"), P.expand_kind(short).alias("back"))


# tables


def _encoded(table: str) -> Query:
    key = _LINES[table][0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _read(spark, sf_dir, table)
        plan = tables.TablePlan(columns=[((f.name,), f.dataType) for f in df.schema.fields])
        return tables.row_lines(df.withColumn("_row", F.col(key).cast("long")), plan).select(F.col("row").alias(key), "line")

    return run


for _name, (_key, _text) in _LINES.items():
    _query(f"SELECT CAST({_key} AS BIGINT) AS {_key}, {_text} AS line FROM {_name}", f"encode_rows_{_name}")(_encoded(_name))


@_query(
    f"SELECT CAST(-2 AS BIGINT) AS \"row\", '{HEADER}' AS line UNION ALL"
    " SELECT -1, '## orders [' || count(*) || ']{o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority}' FROM orders"
)
def encode_header_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.encode_table(_read(spark, sf_dir, "orders"), ["o_orderkey"], "orders").filter("row < 0").select("row", "line")


@_query(f"SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS \"row\", {_LINES['customer'][1]} AS line FROM customer")
def encode_table_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.encode_table(_read(spark, sf_dir, "customer"), ["c_custkey"], "customer").filter("row >= 0").select("row", "line")


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders")
def decode_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _read(spark, sf_dir, "orders").schema
    got = tables.decode_rows(_QUERIES["encode_rows_orders"](spark, sf_dir).select("line"), schema)
    return got.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def _nested_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation")
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region"))
    return joined.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 10 != 0, place).alias("nation"))


_NESTED = "FROM customer JOIN nation ON c_nationkey = n_nationkey"


@_query(
    f"SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS \"row\", c_custkey || '|' || {_string('c_name')} || '|' || CASE WHEN c_custkey % 10 <> 0 THEN {_string('n_name')} || '|' || n_regionkey ELSE '-|-' END AS line {_NESTED}"
    " UNION ALL SELECT -1, '## customers [' || count(*) || ']{c_custkey,c_name,\"nation>name\",\"nation>region>key\"}' " + _NESTED
)
def flatten_customer_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.encode_table(_nested_customers(spark, sf_dir), ["c_custkey"], "customers").filter("row >= -1").select("row", "line")


@_query(f"SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 <> 0 THEN n_name END AS nation_name, CAST(CASE WHEN c_custkey % 10 <> 0 THEN n_regionkey END AS DOUBLE) AS region_key, c_custkey % 10 = 0 AS no_nation {_NESTED}")
def unflatten_customer_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nested_customers(spark, sf_dir)
    lines = tables.encode_table(df, ["c_custkey"], "customers").filter("row >= 0").select("line")
    got = tables.decode_rows(lines, df.schema)
    return got.select("c_custkey", "c_name", F.col("nation.name").alias("nation_name"), F.col("nation.region.key").cast("double").alias("region_key"), F.col("nation").isNull().alias("no_nation"))


@_query("SELECT max(c_custkey % 10 = 3) AS hollow, false AS sound, max(c_custkey % 10 = 4) AS inner_null FROM customer")
def flatten_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 10
    inner = F.struct(F.col("c_acctbal").alias("x"))
    df = _read(spark, sf_dir, "customer").select(
        F.struct(F.when(k != 3, F.col("c_name")).alias("a"), F.when(k != 3, F.col("c_acctbal")).alias("b")).alias("hollow"),
        F.when(k != 0, F.struct(F.col("c_name").alias("a"), inner.alias("b"))).alias("sound"),
        F.struct(F.col("c_name").alias("a"), F.when(k != 4, inner).alias("b")).alias("inner_null"),
    )
    return tables.flatten_guards(df)


@_query(
    "WITH k AS (SELECT event_id, unnest(json_keys(props)) AS field, generate_subscripts(json_keys(props), 1) AS p FROM events), f AS (SELECT field, min((event_id, p)) AS f FROM k GROUP BY field)"
    " SELECT field, row_number() OVER (ORDER BY f) - 1 AS place FROM f"
)
def field_union_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.field_union(_read(spark, sf_dir, "events"), "props", "event_id")


def _nation_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    return tables.rows_to_map(n.select("n_regionkey", "n_name", "n_nationkey"), "n_name", by=["n_regionkey"])


@_query(f"SELECT n_regionkey, n_name AS key, {_line(_string('n_name'), _integer('n_nationkey'))} AS line FROM nation")
def keyed_map_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.keyed_rows(_nation_maps(spark, sf_dir), "members", "n_regionkey").withColumn("_row", F.lit(0).cast("long"))
    plan = tables.TablePlan(columns=[((c,), rows.schema[c].dataType) for c in ("key", "n_nationkey")])
    cells = F.concat_ws("|", *(P.format_scalar(F.col(p[0]), k) for p, k in plan.columns))
    return rows.select("n_regionkey", "key", cells.alias("line"))


@_query("SELECT n_regionkey, n_name AS key, n_nationkey FROM nation")
def keyed_map_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.keyed_rows(_nation_maps(spark, sf_dir), "members", "n_regionkey")
    again = tables.rows_to_map(rows, "key", by=["n_regionkey"])
    return tables.keyed_rows(again, "members", "n_regionkey")


@_query(f"SELECT p_brand, '[' || count(*) || ']: ' || string_agg({_string('p_name')}, ',' ORDER BY p_partkey) AS line FROM part GROUP BY p_brand")
def inline_array_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    names = lists.select("p_brand", F.transform("x", lambda s: s["p_name"]).alias("x"))
    kind = names.schema["x"].dataType
    return names.select("p_brand", tables.inline_array(F.col("x"), kind).alias("line"))


@_query(
    "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.tag') AS tag, CAST(len(json_keys(props)) AS INTEGER) AS n FROM events"
)
def document_roundtrip_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    back = documents.from_wire(documents.to_wire(F.col("props")))
    got = e.select("event_id", back.alias("j"))
    return got.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.tag").alias("tag"), F.size(F.json_object_keys("j")).alias("n"))


# content addresses


@_query(_root("'R' || chr(9) || 'n_name' || chr(9) || " + _canonical("n_name") + " || chr(9) || 'n_nationkey' || chr(9) || " + _integer("n_nationkey") + " || chr(9) || 'n_regionkey' || chr(9) || " + _integer("n_regionkey") + " || chr(10)", "nation"))
def table_root_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, "pack_root", roots.table_root(_read(spark, sf_dir, "nation")))


@_query(_root("'R' || chr(9) || 'r_name' || chr(9) || " + _canonical("r_name") + " || chr(9) || 'r_regionkey' || chr(9) || " + _integer("r_regionkey") + " || chr(10)", "region"))
def table_root_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, "pack_root", roots.table_root(_read(spark, sf_dir, "region")))


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _dated(df: DataFrame) -> DataFrame:
    """With dates as text, which compares the same everywhere."""
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@_query(_root(_ORDER_RECORD, "orders"))
def table_root_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, "pack_root", roots.table_root(_read(spark, sf_dir, "orders").select(*_ORDER_COLUMNS)))


@_query(_root(_ORDER_RECORD, "orders"))
def root_row_order_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the path for large tables, from rows and columns in another order."""
    o = _read(spark, sf_dir, "orders").select(*reversed(_ORDER_COLUMNS)).orderBy(F.desc("o_totalprice"))
    return _value(spark, "pack_root", roots.table_root(o, small=0))


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.duplicate_identities(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# deltas


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = _read(spark, sf_dir, "orders").select(*_ORDER_COLUMNS)
    k = F.col("o_orderkey")
    after = o.filter(k % 10 != 1).withColumn("o_orderstatus", F.when(k % 7 == 0, F.lit("Z|z")).otherwise(F.col("o_orderstatus"))).select(*_ORDER_COLUMNS)
    return o.filter(k % 10 != 0), after


_BASE = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0)"
_NEXT = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Z|z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 1)"
_CHANGES = f"""
SELECT CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS op, coalesce(n.o_orderkey, b.o_orderkey) AS o_orderkey,
       {{custkey}} AS o_custkey, n.o_orderstatus, n.o_totalprice, {{date}} AS o_orderdate, n.o_orderpriority
FROM {_BASE} b FULL OUTER JOIN {_NEXT} n ON b.o_orderkey = n.o_orderkey
WHERE b.o_orderkey IS NULL OR n.o_orderkey IS NULL OR b.o_orderstatus IS DISTINCT FROM n.o_orderstatus
"""
_DIFF = _CHANGES.format(custkey="n.o_custkey", date="n.o_orderdate")
_SHOWN = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority"


def _diffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff(*_snapshots(spark, sf_dir), "o_orderkey", check=False)


@_query(_CHANGES.format(custkey="CAST(n.o_custkey AS DOUBLE)", date="strftime(n.o_orderdate, '%Y-%m-%d %H:%M:%S')"))
def diff_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(_diffed(spark, sf_dir)).withColumnRenamed("_op", "op").drop("_id").withColumn("o_custkey", F.col("o_custkey").cast("double"))


@_query(f"SELECT op, count(*) AS n FROM ({_DIFF}) GROUP BY op")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffed(spark, sf_dir).groupBy(F.col("_op").alias("op")).agg(F.count(F.lit(1)).alias("n"))


_NULLED = "(SELECT nullif(o_orderkey, (SELECT {pick}(o_orderkey) FROM orders)) AS k, o_totalprice + {plus} AS v FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey = (SELECT {pick}(o_orderkey) FROM orders))"


@_query(
    "SELECT coalesce(CAST(coalesce(n.k, b.k) AS VARCHAR), '-') AS id, CASE WHEN b.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS op FROM "
    + _NULLED.format(pick="min", plus="0") + " b FULL OUTER JOIN " + _NULLED.format(pick="max", plus="0") + " n ON b.k IS NOT DISTINCT FROM n.k WHERE b.v IS DISTINCT FROM n.v"
)
def diff_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null is an identity like any other."""
    o = _read(spark, sf_dir, "orders")
    ends = o.agg(F.min("o_orderkey").alias("min"), F.max("o_orderkey").alias("max"))

    def side(pick: str) -> DataFrame:
        rows = o.join(F.broadcast(ends.select(F.col(pick).alias("pick"))), F.lit(True))  # one row
        return rows.filter((F.col("o_orderkey") % 3 == 0) | (F.col("o_orderkey") == F.col("pick"))).select(F.expr("nullif(o_orderkey, pick)").alias("k"), F.col("o_totalprice").alias("v"))

    return D.diff(side("min"), side("max"), "k").select(F.col("_id").alias("id"), F.col("_op").alias("op"))


_ROW = _line(_integer("o_orderkey"), _integer("o_custkey"), _string("o_orderstatus"), _number("o_totalprice"), _time("o_orderdate"), _string("o_orderpriority"))
_FIELDS = "{@o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority}"


def _root_of(source: str) -> str:
    return f"(SELECT pack_root FROM ({_root(_ORDER_RECORD, source)}))"


@_query(
    f"WITH d AS MATERIALIZED ({_DIFF}) SELECT -1 AS section, '' AS place, '{MAGIC} profile=generic delta=true base_root=' || {_root_of(_BASE)} || ' new_root=' || {_root_of(_NEXT)} || ' key=o_orderkey' AS line"
    + "".join(f" UNION ALL SELECT {2 * i}, '', '## {op} [' || count(*) || ']{f}' FROM d WHERE op = '{op}' HAVING count(*) > 0" for i, (op, f) in enumerate((("added", _FIELDS), ("changed", _FIELDS), ("removed", "{@o_orderkey}"))))
    + f" UNION ALL SELECT CASE op WHEN 'added' THEN 1 WHEN 'changed' THEN 3 ELSE 5 END, CAST(o_orderkey AS VARCHAR), CASE WHEN op = 'removed' THEN CAST(o_orderkey AS VARCHAR) ELSE {_ROW} END FROM d"
)
def delta_lines_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, after = _snapshots(spark, sf_dir)
    return D.delta_lines(_diffed(spark, sf_dir), "o_orderkey", roots.table_root(base), roots.table_root(after))


@_query(f"SELECT {_SHOWN} FROM {_NEXT}")
def apply_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = _snapshots(spark, sf_dir)
    return _dated(D.apply_delta(base, _diffed(spark, sf_dir), "o_orderkey"))


def _placed(lines: DataFrame, *order: str) -> DataFrame:
    return with_row_index(lines, *order, index="pos").select("pos", "line")


@_query(f"SELECT {_SHOWN} FROM {_NEXT}")
def decode_apply_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta goes over the wire before it is applied."""
    base, _ = _snapshots(spark, sf_dir)
    _, got = D.decode_delta(_placed(delta_lines_orders(spark, sf_dir), "section", "place"), base.schema)
    return _dated(D.apply_delta(base, got, "o_orderkey"))


@_query(f"SELECT {_SHOWN} FROM {_BASE}")
def decode_full_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = _snapshots(spark, sf_dir)
    return _dated(D.decode_full(_placed(D.full_lines(base, "o_orderkey", "orders"), "section", "place"), base.schema))


@_query(_root(_ORDER_RECORD, _NEXT))
def verify_orders_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, after = _snapshots(spark, sf_dir)
    got = D.verify_delta(base, _diffed(spark, sf_dir), "o_orderkey", roots.table_root(base), roots.table_root(after))
    return _value(spark, "pack_root", roots.table_root(got))


@_query(
    f"WITH d AS ({_DIFF}), n AS (SELECT o_orderkey FROM {_NEXT}) SELECT 'delta_invalid' AS code, op, count(*) AS n FROM d WHERE (op = 'added' AND o_orderkey IN (SELECT o_orderkey FROM n))"
    " OR (op <> 'added' AND o_orderkey NOT IN (SELECT o_orderkey FROM n)) GROUP BY op"
)
def verify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forbids to apply a delta a second time."""
    _, after = _snapshots(spark, sf_dir)
    found = D.delta_errors(after, _diffed(spark, sf_dir), "o_orderkey")
    return found.groupBy("code", F.substring_index("detail", " ", 1).alias("op")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT o_orderkey, printf('%.0f', 100.0 * (1.0 - (o_orderkey % 97) / 200.0)) || '%' AS savings FROM orders")
def delta_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", D.savings(F.col("o_orderkey") % 97, F.lit(200)).alias("savings"))


# graphs: regions, nations and customers at distance 0, 1 and 2


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(table: str, name: Column, kind: str, score: Column, distance: int) -> DataFrame:
        return _read(spark, sf_dir, table).select(name.alias("qualifiedName"), F.lit(kind).alias("kind"), score.alias("score"), F.lit("geo").alias("provenance"), F.lit(distance).alias("distance"))

    r = part("region", F.concat(F.lit("r."), F.col("r_regionkey").cast("string")), "package", F.col("r_regionkey") / 8, 0)
    n = part("nation", F.concat(F.lit("n."), F.col("n_nationkey").cast("string")), "class", F.lit(0.5), 1)
    c = part("customer", F.concat(F.lit("c."), F.col("c_custkey").cast("string")), "function", F.col("c_acctbal"), 2)
    return r.union(n).union(c)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = _read(spark, sf_dir, "nation").select(name("n.", "n_nationkey").alias("source"), name("r.", "n_regionkey").alias("target"), F.lit("in").alias("edgeType"), F.lit("unchanged").alias("status"))
    c = _read(spark, sf_dir, "customer")
    to = F.when(F.col("c_custkey") % 50 == 0, F.lit("n.x")).otherwise(name("n.", "c_nationkey"))
    return n.union(c.select(name("c.", "c_custkey"), to, F.lit("of"), F.when(F.col("c_custkey") % 9 == 0, "new").otherwise("")))


_SYMBOLS_SQL = """
SELECT 'r.' || r_regionkey AS qualifiedName, 'package' AS kind, r_regionkey / 8 AS score, 'geo' AS provenance, 0 AS distance FROM region
UNION ALL SELECT 'n.' || n_nationkey, 'class', 0.5, 'geo', 1 FROM nation
UNION ALL SELECT 'c.' || c_custkey, 'function', c_acctbal, 'geo', 2 FROM customer
"""
_EDGES_SQL = """
SELECT 'n.' || n_nationkey AS source, 'r.' || n_regionkey AS target, 'in' AS edgeType, 'unchanged' AS status FROM nation
UNION ALL SELECT 'c.' || c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'n.x' ELSE 'n.' || c_nationkey END, 'of', CASE WHEN c_custkey % 9 = 0 THEN 'new' ELSE '' END FROM customer
"""
_GRAPH_SQL = (
    f"WITH s AS ({_SYMBOLS_SQL}), e AS ({_EDGES_SQL}), i AS (SELECT *, row_number() OVER (ORDER BY distance, score DESC, qualifiedName, kind) - 1 AS id,"
    " CASE kind WHEN 'package' THEN 'pkg' WHEN 'function' THEN 'fn' ELSE kind END AS short FROM s), l AS (SELECT e.*, a.id AS a, b.id AS b FROM e JOIN i a ON a.qualifiedName = source JOIN i b ON b.qualifiedName = target) "
)


@_query(_GRAPH_SQL + "SELECT id, '@' || id || ' ' || short || ' ' || qualifiedName || ' ' || printf('%.2f', score) || ' geo' AS line FROM i")
def graph_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symbol_ids(_symbols(spark, sf_dir)).select("id", graph.symbol_line().alias("line"))


@_query(_GRAPH_SQL + "SELECT id, qualifiedName, CASE distance WHEN 0 THEN 'targets' WHEN 1 THEN 'related' ELSE 'extended' END AS section FROM i")
def graph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symbol_ids(_symbols(spark, sf_dir)).select("id", "qualifiedName", graph.section_name(F.col("distance")).alias("section"))


@_query(_GRAPH_SQL + "SELECT a, b, '@' || b || '<@' || a || ' ' || edgeType || CASE WHEN status IN ('', 'unchanged') THEN '' ELSE ' ' || status END AS line FROM l")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = graph.encode_graph(_symbols(spark, sf_dir), _edges(spark, sf_dir), "geo")
    return lines.filter("part = 3").select("a", "b", "line")


@_query(_GRAPH_SQL + f"SELECT '{MAGIC} profile=graph tool=geo budget=9 symbols=' || (SELECT count(*) FROM s) || ' edges=' || (SELECT count(*) FROM l) AS line UNION ALL SELECT '## edges [' || count(*) || ']' FROM l UNION ALL SELECT '## targets' UNION ALL SELECT '## related' UNION ALL SELECT '## extended'")
def graph_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = graph.encode_graph(_symbols(spark, sf_dir), _edges(spark, sf_dir), "geo", budget=9)
    return lines.filter("part in (0, 2) or b = -1").select("line")


@_query(f"WITH s AS ({_SYMBOLS_SQL}), e AS ({_EDGES_SQL}) SELECT * FROM e WHERE source NOT IN (SELECT qualifiedName FROM s) OR target NOT IN (SELECT qualifiedName FROM s)")
def graph_dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dangling_edges(_edges(spark, sf_dir), _symbols(spark, sf_dir))


_GRAPH_ROOT = (
    "SELECT 'sha256:' || sha256((SELECT string_agg(r, '' ORDER BY r) FROM (SELECT 'S' || chr(9) || CASE kind WHEN 'package' THEN 'pkg' WHEN 'function' THEN 'fn' ELSE kind END || chr(9) || qualifiedName || chr(9) || {score} || chr(9) || provenance || chr(9) || distance || chr(10) AS r FROM s))"
    " || (SELECT string_agg(r, '' ORDER BY r) FROM (SELECT 'E' || chr(9) || coalesce(a.short, '') || chr(9) || source || chr(9) || coalesce(b.short, '') || chr(9) || target || chr(9) || edgeType || chr(10) AS r"
    " FROM e LEFT JOIN k a ON a.qualifiedName = source LEFT JOIN k b ON b.qualifiedName = target))) AS pack_root"
).replace("{score}", _number("CAST(score AS DOUBLE)"))
_KINDS_SQL = "k AS (SELECT qualifiedName, CASE kind WHEN 'package' THEN 'pkg' WHEN 'function' THEN 'fn' ELSE kind END AS short FROM s)"


@_query(f"WITH s AS ({_SYMBOLS_SQL}), e AS ({_EDGES_SQL}), {_KINDS_SQL} " + _GRAPH_ROOT)
def graph_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, "pack_root", roots.graph_root(_symbols(spark, sf_dir), _edges(spark, sf_dir)))


def _later_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    number = F.substring_index("qualifiedName", ".", -1).cast("long")
    return s.filter(number % 11 != 0).withColumn("score", F.when(number % 7 == 0, F.col("score") + 1).otherwise(F.col("score")))


_LATER_SQL = f"SELECT qualifiedName, kind, CASE WHEN n % 7 = 0 THEN score + 1 ELSE score END AS score, provenance, distance FROM (SELECT *, CAST(split_part(qualifiedName, '.', 2) AS BIGINT) AS n FROM ({_SYMBOLS_SQL})) WHERE n % 11 <> 0"


@_query(
    f"WITH s AS ({_SYMBOLS_SQL}), t AS ({_LATER_SQL}) SELECT 'removed' AS op, kind, qualifiedName, CAST(score AS DOUBLE) AS score FROM s WHERE (kind, qualifiedName, score) NOT IN (SELECT (kind, qualifiedName, score) FROM t)"
    " UNION ALL SELECT 'added', kind, qualifiedName, score FROM t WHERE (kind, qualifiedName, score) NOT IN (SELECT (kind, qualifiedName, score) FROM s)"
)
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.symbol_diff(_symbols(spark, sf_dir), _later_symbols(spark, sf_dir))
    return got.select(F.col("_op").alias("op"), "kind", "qualifiedName", "score")


@_query(f"SELECT qualifiedName, kind, CAST(score AS DOUBLE) AS score, provenance, distance FROM ({_LATER_SQL})")
def graph_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t, e = _symbols(spark, sf_dir), _later_symbols(spark, sf_dir), _edges(spark, sf_dir)
    none = graph.edge_diff(e, e)
    got, _ = graph.verify_graph_delta(s, e, graph.symbol_diff(s, t), none, roots.graph_root(t, e))
    return got.select("qualifiedName", "kind", "score", "provenance", "distance")


@_query(
    f"WITH s AS ({_SYMBOLS_SQL}), t AS ({_LATER_SQL}) SELECT 'removed' AS op, kind, qualifiedName, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS distance FROM s WHERE (kind, qualifiedName, score) NOT IN (SELECT (kind, qualifiedName, score) FROM t)"
    " UNION ALL SELECT 'added', kind, qualifiedName, CAST(printf('%.2f', score) AS DOUBLE), CAST(distance AS DOUBLE) FROM t WHERE (kind, qualifiedName, score) NOT IN (SELECT (kind, qualifiedName, score) FROM s)"
)
def graph_delta_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol delta over the wire: scores keep two decimals there."""
    changes, e = graph.symbol_diff(_symbols(spark, sf_dir), _later_symbols(spark, sf_dir)), _edges(spark, sf_dir)
    _, got, _ = graph.decode_delta(_placed(graph.delta_lines(changes, graph.edge_diff(e, e), "geo"), "part", "a", "b", "c"))
    return got.select(F.col("_op").alias("op"), "kind", "qualifiedName", "score", F.col("distance").cast("double").alias("distance"))


def _decoded(spark: SparkSession, sf_dir: str) -> tuple[dict, DataFrame, DataFrame]:
    lines = graph.encode_graph(_symbols(spark, sf_dir), _edges(spark, sf_dir), "geo")
    return graph.decode_graph(_placed(lines, "part", "a", "b", "c"))


@_query(_GRAPH_SQL + "SELECT id, qualifiedName, kind, CAST(printf('%.2f', score) AS DOUBLE) AS score, provenance, distance FROM i")
def graph_decode_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir)[1].select("id", "qualifiedName", "kind", "score", "provenance", "distance")


@_query(_GRAPH_SQL + "SELECT source, target, edgeType, CASE WHEN status = 'unchanged' THEN '' ELSE status END AS status FROM l")
def graph_decode_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir)[2].select("source", "target", "edgeType", "status")


@_query(f"SELECT CASE distance WHEN 0 THEN 'targets' WHEN 1 THEN 'related' ELSE 'extended' END AS section, count(*) AS n FROM ({_SYMBOLS_SQL}) GROUP BY ALL")
def stream_trailer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.group_counts(_symbols(spark, sf_dir))


# sessions: a session is a user, a call a day, a symbol an event type


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"), F.dayofyear("ts").cast("long").alias("call"), F.col("event_id").alias("_pos"), F.col("event_type").alias("qualifiedName"),
        F.lit("function").alias("kind"), F.col("value").alias("score"), F.lit("log").alias("provenance"), F.lit(0).alias("distance"),
    )


_CALLS = "(SELECT CAST(user_id AS VARCHAR) AS session, CAST(dayofyear(ts) AS BIGINT) AS call, event_id, event_type FROM events)"
_FIRSTS = f"(SELECT session, event_type AS qualifiedName, min((call, event_id)) AS f, min(call) AS first_call FROM {_CALLS} GROUP BY ALL)"


@_query(f"SELECT session, qualifiedName, row_number() OVER (PARTITION BY session ORDER BY f) - 1 AS id FROM {_FIRSTS}")
def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.session_ids(_calls(spark, sf_dir)).select("session", "qualifiedName", "id")


@_query(f"SELECT event_id, c.session, call, first_call < call AS known FROM {_CALLS} c JOIN {_FIRSTS} f ON c.session = f.session AND c.event_type = f.qualifiedName")
def session_dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.dedup(_calls(spark, sf_dir)).select(F.col("_pos").alias("event_id"), "session", "call", "known")


@_query(
    f"WITH i AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY f) - 1 AS id FROM {_FIRSTS}) SELECT c.session, call, id, count(*) AS n FROM {_CALLS} c JOIN i ON c.session = i.session AND c.event_type = i.qualifiedName"
    " WHERE first_call < call GROUP BY ALL"
)
def session_bare_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sessions' wires refer to."""
    calls = _calls(spark, sf_dir)
    got = session.resolve_references(session.session_lines(calls), session.session_ids(calls))
    return got.groupBy("session", "call", "id").agg(F.count(F.lit(1)).alias("n"))


#: Days up to which a turn's snapshot goes; the last is the whole table.
_UNTIL = (5, 10, 15, 20, 25, 366)


def _days(spark: SparkSession, sf_dir: str, day: int) -> DataFrame:
    """The last event of each user up to a day."""
    e = _read(spark, sf_dir, "events").filter(F.dayofyear("ts") <= day)
    last = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return e.withColumn("n", F.row_number().over(last)).filter("n = 1").select("user_id", "event_type", "value")


def _reanchored(spark: SparkSession, sf_dir: str, policy: Policy) -> DataFrame:
    held = ReanchorSession(spark, new_folder(spark, "reanchor"), "user_id", "users", policy=policy)
    held.start(_days(spark, sf_dir, _UNTIL[0]))
    out = []
    for turn, day in enumerate(_UNTIL[1:], 1):
        lines, is_full = held.next(_days(spark, sf_dir, day), turn)
        out.append((turn, is_full, wire_bytes(lines)))
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(t).cast("long").alias("turn"), F.lit(f).alias("is_full"), F.lit(n).cast("long").alias("wire_bytes")) for t, f, n in out))))


_USER_FIELDS = "]{@user_id,event_type,value}"


def _reanchor_sql(full: str) -> str:
    """Wire sizes of each turn by the grammar, folded over the turns; full: when a turn is sent in full."""
    line = _line("CAST(user_id AS VARCHAR)", _string("event_type"), _number("value"))
    root = len("sha256:") + 64
    delta_head, full_head = (len(x) + 1 for x in (f"{MAGIC} profile=generic delta=true base_root={'x' * root} new_root={'x' * root} key=user_id", f"{MAGIC} profile=generic pack_root={'x' * root} key=user_id"))
    return f"""
WITH RECURSIVE t(turn, until) AS (VALUES {', '.join(f'({i}, {d})' for i, d in enumerate(_UNTIL))}),
s AS (SELECT turn, user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events JOIN t ON dayofyear(ts) <= until GROUP BY turn, user_id),
r AS (SELECT turn, user_id, strlen({line}) + 1 AS n, {line} AS line FROM s),
f AS (SELECT turn, {full_head} + strlen('## users [' || count(*) || '{_USER_FIELDS}') + 1 + sum(n) AS full_bytes FROM r GROUP BY turn),
c AS (SELECT b.turn, CASE WHEN a.user_id IS NULL THEN 'added' ELSE 'changed' END AS op, b.n FROM r b LEFT JOIN r a ON a.turn = b.turn - 1 AND a.user_id = b.user_id WHERE b.turn > 0 AND b.line IS DISTINCT FROM a.line),
g AS (SELECT turn, op, sum(n) + strlen('## ' || op || ' [' || count(*) || '{_USER_FIELDS}') + 1 AS n FROM c GROUP BY turn, op),
d AS (SELECT f.turn, full_bytes, {delta_head} + coalesce(sum(g.n), 0) AS delta_bytes FROM f LEFT JOIN g ON g.turn = f.turn WHERE f.turn > 0 GROUP BY f.turn, full_bytes),
w AS (
  SELECT 0 AS turn, CAST(0 AS BIGINT) AS total, false AS is_full, CAST(0 AS BIGINT) AS wire_bytes
  UNION ALL
  SELECT d.turn, CASE WHEN {full} THEN 0 ELSE total + delta_bytes END, {full}, CASE WHEN {full} THEN full_bytes ELSE delta_bytes END FROM w JOIN d ON d.turn = w.turn + 1
)
SELECT CAST(turn AS BIGINT) AS turn, is_full, CAST(wire_bytes AS BIGINT) AS wire_bytes FROM w WHERE turn > 0
"""


@_query(_reanchor_sql("d.turn % 3 = 0"))
def reanchor_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reanchored(spark, sf_dir, Policy.fixed(3))


@_query(_reanchor_sql("total + delta_bytes >= full_bytes"))
def reanchor_size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reanchored(spark, sf_dir, Policy.size_guard())


@_query(
    f"SELECT sum(strlen({_LINES['customer'][1]}) + 1)::BIGINT AS wire_bytes, sum(strlen('{{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || ',\"c_acctbal\":' || c_acctbal || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}}'))::BIGINT AS json_bytes FROM customer"
)
def wire_vs_json_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    wire = F.concat_ws("|", *(P.format_scalar(F.col(f.name), f.dataType) for f in c.schema.fields))
    json = F.to_json(F.struct(*c.columns))
    return c.agg(F.sum(P.wire_bytes(wire) + 1).alias("wire_bytes"), F.sum(P.wire_bytes(json)).alias("json_bytes"))


# layouts of nested columns

_ROWS = 'CAST(i AS BIGINT) AS "row", CAST(sub AS INTEGER) AS sub'


def _lines_of(df: DataFrame, order: str, name: str, **how: object) -> DataFrame:
    return tables.encode_table(df, [order], name, **how).filter("row >= -1").select("row", "sub", "line")


@_query(
    f"WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) SELECT {_ROWS}, line FROM ("
    " SELECT -1 AS i, 0 AS sub, '## customers [' || count(*) || ']{c_custkey,info}' AS line FROM c"
    " UNION ALL SELECT i, 0, '@' || i || ' ' || c_custkey || '|^' || CASE WHEN i = 0 THEN '{c_name,c_acctbal,c_mktsegment}' ELSE '' END FROM c"
    f" UNION ALL SELECT i, 1, {_line(_string('c_name'), _number('c_acctbal'), _string('c_mktsegment'))} FROM c)"
)
def inline_schema_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A struct column without path columns: its fields are named in the first row only."""
    c = _read(spark, sf_dir, "customer")
    return _lines_of(c.select("c_custkey", F.struct("c_name", "c_acctbal", "c_mktsegment").alias("info")), "c_custkey", "customers", flatten=False)


@_query(
    "WITH r AS (SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region), "
    "n AS (SELECT i, n_nationkey, n_name, row_number() OVER (PARTITION BY i ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY i) AS n FROM r JOIN nation ON n_regionkey = r_regionkey) "
    f"SELECT {_ROWS}, line FROM (SELECT -1 AS i, 0 AS sub, '## regions [' || count(*) || ']{{r_regionkey,r_name,nations}}' AS line FROM r"
    f" UNION ALL SELECT i, 0, '@' || i || ' ' || r_regionkey || '|' || {_string('r_name')} || '|^' FROM r"
    " UNION ALL SELECT DISTINCT i, 1, '.nations [' || n || ']' || CASE WHEN i = 0 THEN '{n_nationkey,n_name}' ELSE '' END FROM n"
    f" UNION ALL SELECT i, 1 + k, '    ' || n_nationkey || '|' || {_string('n_name')} FROM n)"
)
def shared_schema_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of rows: the first one declares the fields for all."""
    n = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    df = _read(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "r_name", "nations")
    return _lines_of(df, "r_regionkey", "regions")


_CUSTOMERS_SQL = (
    "SELECT c_custkey, c_nationkey, c_mktsegment, ks, ps, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer LEFT JOIN"
    " (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks, list(o_orderpriority ORDER BY o_orderkey) AS ps FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"
)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a list of their orders, null for some, and a struct of two."""
    o = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    c = _read(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.select("c_custkey", "keys", F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("info"))


@_query(
    f"WITH c AS ({_CUSTOMERS_SQL}) SELECT {_ROWS}, line FROM (SELECT -1 AS i, 0 AS sub, '## customers [' || count(*) || ']{{c_custkey,keys,info}}' AS line FROM c"
    " UNION ALL SELECT i, 0, '@' || i || ' ' || c_custkey || CASE WHEN ks IS NULL THEN '|-|^' ELSE '|^|^' END FROM c"
    " UNION ALL SELECT i, 1, '.keys [' || len(ks) || ']: ' || array_to_string(ks, ',') FROM c WHERE ks IS NOT NULL"
    f" UNION ALL SELECT i, CASE WHEN ks IS NULL THEN 0 ELSE 1 END + k, CASE k WHEN 1 THEN '.info {{}}' WHEN 2 THEN '    segment=' || {_string('c_mktsegment')} ELSE '    nation=' || c_nationkey END FROM c, range(1, 4) t(k))"
)
def attachments_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays and structs as attachments behind their rows."""
    return _lines_of(_customers(spark, sf_dir), "c_custkey", "customers", flatten=False)


@_query(f"SELECT row_number() OVER (ORDER BY n_name) - 1 AS \"row\", {_line(_string('n_name'), _integer('n_nationkey'), _integer('n_regionkey'))} AS line FROM nation UNION ALL SELECT -1, '## nations [' || count(*) || ':]{{n_name,n_nationkey,n_regionkey}}' FROM nation".replace("{{", "{").replace("}}", "}"))
def keyed_table_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of rows as a keyed table."""
    n = _read(spark, sf_dir, "nation").select("n_name", "n_nationkey", "n_regionkey")
    return _lines_of(n, "n_name", "nations", keyed=True).select("row", "line")


# documents: nested values, expanded arrays, counts and trailers

_NESTED_JSON = "'{\"id\":' || event_id || ',\"items\":[1,{\"k\":' || user_id || ',\"t\":[\"' || event_type || '\",null]},[],[' || user_id || ',2]],\"o\":{\"a\":{\"b\":' || user_id || '}}}'"


def _nested_json() -> Column:
    user = F.col("user_id").cast("string")
    return F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"items":[1,{"k":'), user, F.lit(',"t":["'), "event_type", F.lit('",null]},[],['), user, F.lit(',2]],"o":{"a":{"b":'), user, F.lit("}}}"))


@_query(
    "SELECT event_id, 'GCF profile=generic' || chr(10) || 'id=' || event_id || chr(10) || '## items [4]' || chr(10) || '@0 =1' || chr(10) || '@1 {}' || chr(10) || '  k=' || user_id || chr(10)"
    f" || '  t[2]: ' || {_string('event_type')} || ',-' || chr(10) || '@2 [0]' || chr(10) || '@3 [2]: ' || user_id || ',2' || chr(10) || '## o' || chr(10) || '  ## a' || chr(10) || '    b=' || user_id || chr(10) AS wire FROM events"
)
def document_expanded_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed arrays are expanded item by item."""
    return _read(spark, sf_dir, "events").select("event_id", documents.to_wire(_nested_json()).alias("wire"))


@_query(f"SELECT event_id, {_NESTED_JSON} AS json FROM events")
def document_expanded_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", documents.to_wire(_nested_json()).alias("wire"))
    return e.select("event_id", documents.from_wire(F.col("wire")).alias("json"))


_LIST_JSON = "'{\"name\":\"' || r_name || '\",\"nations\":[' || string_agg('{\"name\":\"' || n_name || '\",\"tags\":[' || n_nationkey || ',\"x|y\"],\"at\":{\"key\":' || n_nationkey || '}}', ',' ORDER BY n_nationkey) || ']}'"


@_query(f"SELECT r_regionkey, {_LIST_JSON} AS json FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def document_attachments_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in documents, with arrays as attachments and structs as path columns."""
    key = F.col("n_nationkey").cast("string")
    one = F.concat(F.lit('{"name":"'), "n_name", F.lit('","tags":['), key, F.lit(',"x|y"],"at":{"key":'), key, F.lit("}}"))
    n = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("t")))).alias("xs"))
    r = _read(spark, sf_dir, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"))
    json = F.concat(F.lit('{"name":"'), "r_name", F.lit('","nations":['), F.array_join(F.transform("xs", lambda x: x["t"]), ","), F.lit("]}"))
    wire = r.select("r_regionkey", documents.to_wire(json).alias("wire"))
    return wire.select("r_regionkey", documents.from_wire(F.col("wire")).alias("json"))


@_query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 AND o_orderkey % 3 <> 0 THEN 'count_mismatch' WHEN o_orderkey % 5 = 2 THEN 'invalid_count' END AS error,"
    " CASE WHEN o_orderkey % 5 < 2 AND o_orderkey % 3 = 0 OR o_orderkey % 5 > 2 THEN '{\"t\":[{\"a\":1,\"b\":' || o_custkey || '},{\"a\":2,\"b\":null}]}' END AS json FROM orders"
)
def document_counts_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in headers and in trailers are held against what is there; PERMISSIVE gives codes."""
    k = F.col("o_orderkey")
    trailer = F.concat(F.lit("##! summary counts="), (F.lit(2) + k % 3).cast("string"), F.lit("\n"))
    count = F.when(k % 5 == 0, "?").when(k % 5 == 1, (2 + k % 3).cast("string")).when(k % 5 == 2, "02").otherwise("2")
    wire = F.concat(F.lit(f"{HEADER}\n## t ["), count, F.lit("]{a,b}\n1|"), F.col("o_custkey").cast("string"), F.lit("\n2|-\n"), F.when(k % 5 == 0, trailer).otherwise(""))
    got = _read(spark, sf_dir, "orders").select("o_orderkey", documents.from_wire(wire, "PERMISSIVE").alias("r"))
    return got.select("o_orderkey", F.col("r.error").alias("error"), F.col("r.text").alias("json"))


@_query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 IN (0, 1) THEN o_orderkey END AS DOUBLE) AS n FROM orders")
def count_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts may look like."""
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    shown = F.when(k % 4 == 2, F.concat(F.lit("0"), text)).when(k % 4 == 3, F.concat(F.lit("+"), text)).otherwise(text)
    return _read(spark, sf_dir, "orders").select("o_orderkey", P.count_value(shown).cast("double").alias("n"))


@_query(f"SELECT c_custkey, 'c.' || c_custkey AS name, 'function' AS kind, CAST(printf('%.2f', c_acctbal) AS DOUBLE) AS score, CAST(c_nationkey AS DOUBLE) AS distance, CAST(c_custkey AS DOUBLE) AS budget FROM customer WHERE c_nationkey IS NOT NULL")
def graph_payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph a row: JSON form to wire text and back."""
    symbol = F.struct(F.concat(F.lit("c."), F.col("c_custkey").cast("string")).alias("qualifiedName"), F.lit("function").alias("kind"), F.col("c_acctbal").alias("score"), F.lit("geo").alias("provenance"), F.col("c_nationkey").alias("distance"))
    json = F.to_json(F.struct(F.lit("t").alias("tool"), F.col("c_custkey").alias("tokenBudget"), F.array(symbol).alias("symbols")))
    c = _read(spark, sf_dir, "customer").filter("c_nationkey is not null").select("c_custkey", documents.graph_to_wire(json).alias("wire"))
    c = c.select("c_custkey", documents.from_wire(F.col("wire")).alias("j"))
    at = lambda path: F.get_json_object("j", path)
    return c.select("c_custkey", at("$.symbols[0].qualifiedName").alias("name"), at("$.symbols[0].kind").alias("kind"), at("$.symbols[0].score").cast("double").alias("score"), at("$.symbols[0].distance").cast("double").alias("distance"), at("$.tokenBudget").cast("double").alias("budget"))


# graph headers, deltas of edges, streams


@_query(_GRAPH_SQL + "SELECT 'geo' AS tool, CAST(9 AS BIGINT) AS budget, CAST(0 AS BIGINT) AS tokens, (SELECT count(*) FROM i) AS symbols, (SELECT count(*) FROM l) AS edges")
def graph_decode_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = graph.encode_graph(_symbols(spark, sf_dir), _edges(spark, sf_dir), "geo", budget=9)
    head, symbols, edges = graph.decode_graph(_placed(lines, "part", "a", "b", "c"))
    return spark.range(1).select(F.lit(head["tool"]).alias("tool"), F.lit(head["tokenBudget"]).cast("long").alias("budget"), F.lit(head["tokensUsed"]).cast("long").alias("tokens"), F.lit(symbols.count()).cast("long").alias("symbols"), F.lit(edges.count()).cast("long").alias("edges"))


_LATER_EDGES_SQL = f"SELECT source, CASE WHEN source LIKE 'c.%7' THEN 'r.0' ELSE target END AS target, edgeType FROM ({_EDGES_SQL}) WHERE source NOT LIKE 'c.%3'"


def _later_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).filter("source not like 'c.%3'")
    return e.withColumn("target", F.when(F.col("source").like("c.%7"), F.lit("r.0")).otherwise(F.col("target")))


@_query(
    f"WITH e AS (SELECT source, target, edgeType FROM ({_EDGES_SQL})), f AS ({_LATER_EDGES_SQL}) SELECT 'removed' AS op, * FROM (SELECT * FROM e EXCEPT SELECT * FROM f) UNION ALL SELECT 'added', * FROM (SELECT * FROM f EXCEPT SELECT * FROM e)"
)
def graph_delta_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delta of edges over the wire."""
    s = _symbols(spark, sf_dir)
    changes = graph.edge_diff(_edges(spark, sf_dir), _later_edges(spark, sf_dir))
    _, _, got = graph.decode_delta(_placed(graph.delta_lines(graph.symbol_diff(s, s), changes, "geo"), "part", "a", "b", "c"))
    return got.select(F.col("_op").alias("op"), "source", "target", "edgeType")


_STREAM_SQL = (
    f"WITH s AS (SELECT *, row_number() OVER (ORDER BY hash_key) - 1 AS id FROM (SELECT *, md5(qualifiedName) AS hash_key FROM ({_SYMBOLS_SQL}))),"
    " x AS (SELECT *, CASE distance WHEN 0 THEN 'targets' WHEN 1 THEN 'related' ELSE 'extended' END AS section, CASE kind WHEN 'package' THEN 'pkg' WHEN 'function' THEN 'fn' ELSE kind END AS short FROM s),"
    " y AS (SELECT *, lag(section) OVER (ORDER BY id) AS before FROM x),"
    f" e AS (SELECT e.*, a.id AS a, b.id AS b, md5(source) AS k FROM ({_EDGES_SQL}) e JOIN s a ON a.qualifiedName = source JOIN s b ON b.qualifiedName = target)"
)


@_query(
    _STREAM_SQL + f" SELECT 0 AS part, CAST(0 AS BIGINT) AS a, '{MAGIC} profile=graph tool=geo' AS line UNION ALL SELECT 1, id, '## ' || section FROM y WHERE before IS DISTINCT FROM section"
    " UNION ALL SELECT 1, id, '@' || id || ' ' || short || ' ' || qualifiedName || ' ' || printf('%.2f', score) || ' geo' FROM x UNION ALL SELECT 2, 0, '## edges [?]'"
    " UNION ALL SELECT 3, row_number() OVER (ORDER BY k) - 1, '@' || b || '<@' || a || ' ' || edgeType || CASE WHEN status IN ('', 'unchanged') THEN '' ELSE ' ' || status END FROM e"
    " UNION ALL SELECT 4, 0, '##! summary symbols=' || (SELECT count(*) FROM s) || ' edges=' || (SELECT count(*) FROM e) || ' counts=' || (SELECT string_agg(section || ':' || n, ',' ORDER BY f) FROM (SELECT section, count(*) AS n, min(id) AS f FROM x GROUP BY section)) || ',edges:' || (SELECT count(*) FROM e)"
)
def graph_stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph as a stream writes it: in order of arrival (here, of a hash), with deferred counts."""
    symbols = _symbols(spark, sf_dir).withColumn("_pos", F.md5("qualifiedName"))
    names = symbols.select("qualifiedName")
    edges = _edges(spark, sf_dir).withColumn("_k", F.md5("source"))
    known = edges.join(names.withColumnRenamed("qualifiedName", "source"), "source", "left_semi").join(names.withColumnRenamed("qualifiedName", "target"), "target", "left_semi")
    return graph.stream_lines(symbols, with_row_index(known, "_k", index="_pos"), "geo", labeled=True).select("part", "a", "line")


@_query(f"SELECT {_SHOWN} FROM orders")
def sink_roundtrip_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through files: written by Spark's tasks, counted in trailers, checked and read line by line."""
    o = _read(spark, sf_dir, "orders")
    path = new_folder(spark, "orders")
    wire_source.write_table(o, path, "orders")
    return _dated(wire_source.read_table(spark, path, o.schema))


@_query(
    f"SELECT * FROM (SELECT CAST(0 AS BIGINT) AS n, '{HEADER}' AS line UNION ALL SELECT 1, '## nations [?]{{n_nationkey,n_name,n_regionkey}}' UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey) + 1, {_LINES['nation'][1]} FROM nation"
    " UNION ALL SELECT 2 + (SELECT count(*) FROM nation), '##! summary counts=' || (SELECT count(*) FROM nation))"
)
def stream_table_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one file of a table that is streamed out."""
    lines = wire_source.wire_lines(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").repartitionByRange(1, "n_nationkey").sortWithinPartitions("n_nationkey"), "nations")
    return lines.select(F.monotonically_increasing_id().alias("n"), "line")


@_query(
    "SELECT CASE WHEN c_custkey % 97 = 1 THEN 'row_width_mismatch' WHEN c_custkey % 97 = 2 THEN 'invalid_line' END AS error, count(*) AS n, count(*) FILTER (WHERE c_custkey % 97 NOT IN (1, 2)) AS read FROM customer GROUP BY ALL"
)
def read_permissive_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged rows get codes; sound ones are read."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    k = F.col("c_custkey")
    row = F.concat_ws("|", F.when(k % 97 == 2, "x").otherwise(P.format_scalar(k, c.schema["c_custkey"].dataType)), P.format_scalar(F.col("c_name"), c.schema["c_name"].dataType), F.when(k % 97 != 1, P.number_text(F.col("c_acctbal"))))
    path = new_folder(spark, "customers")
    head = spark.range(1).select(F.lit(f"{HEADER}\n## rows [{c.count()}]{{c_custkey,c_name,c_acctbal}}").alias("value"))
    # one file: its header in front of its rows
    head.withColumn("k", F.lit(-1).cast("long")).unionByName(c.select(row.alias("value"), k.alias("k"))).repartitionByRange(1, "k").sortWithinPartitions("k").select("value").write.text(path)
    got = wire_source.read_table(spark, path, c.schema, mode="PERMISSIVE")
    return got.groupBy(F.col("_error_code").alias("error")).agg(F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("read"))


# session wires with edges


@_query(
    f"WITH f AS {_FIRSTS}, i AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY f) - 1 AS id FROM f), c AS {_CALLS},"
    " n AS (SELECT session, call, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS m FROM c GROUP BY ALL)"
    f" SELECT session, call, 0 AS part, CAST(0 AS BIGINT) AS a, '{MAGIC} profile=graph tool=log symbols=' || n || CASE WHEN m > 0 THEN ' edges=' || m ELSE '' END || ' session=true' AS line FROM n"
    " UNION ALL SELECT session, call, 1, 1, '## targets' FROM n"
    " UNION ALL SELECT session, call, 2, 0, '## edges [' || m || ']' FROM n WHERE m > 0"
    " UNION ALL SELECT c.session, c.call, 3, c.event_id, '@' || i.id || '<@' || i.id || ' self new' FROM c JOIN i ON c.session = i.session AND c.event_type = i.qualifiedName WHERE c.event_id % 3 = 0"
)
def session_lines_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and edges of the sessions' wires; symbols are in session_bare_references."""
    calls = _calls(spark, sf_dir)
    edges = calls.filter("_pos % 3 = 0").select("session", "call", "_pos", F.col("qualifiedName").alias("source"), F.col("qualifiedName").alias("target"), F.lit("self").alias("edgeType"), F.lit("new").alias("status"))
    lines = session.session_lines(calls, edges, "log")
    return lines.filter("part <> 1 or line like '## %'").select("session", "call", "part", "a", "line")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

