"""Keyed deltas between two snapshots of a table: diff, wire text, apply, verify.

Identity is the canonical cell of the key column (null is an identity); equality is bytewise on canonical cells.  A diff
has the columns of the table and `_op`: added, changed (the whole new row) or removed (the key; other columns null).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.errors import WireError
from packframe.functions import canonical_cell, format_scalar, savings_text, split_cells, typed_cell
from packframe.operators.ordering import carry_last
from packframe.operators.roots import record, root_of, table_root
from packframe.operators.tables import decode_rows
from packframe.plans.document import MAGIC, header_fields
from packframe.plans.values import find_outside, key_text, parse_count, split_quoted, unquote
from packframe.streaming.storage import stored

ORDER = ("added", "changed", "removed")


def _kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def identity(df: DataFrame, key: str) -> Column:
    return canonical_cell(F.col(f"`{key}`"), _kinds(df)[key])


def duplicate_identities(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _require_unique(df: DataFrame, key: str, what: str) -> None:
    found = duplicate_identities(df.select(identity(df, key).alias("id")), ["id"]).first()
    if found:
        raise WireError("delta_invalid", f"duplicate identity {found['id']} in {what}")


def _mark(df: DataFrame) -> Column:
    """What rows are compared by: a digest of the canonical record, so that no record is shuffled."""
    return F.unhex(F.sha2(record(df), 256))


def diff(base: DataFrame, after: DataFrame, key: str, check: bool = True) -> DataFrame:
    """_op, _id and the columns of `after`.  One full outer join on the identity.

    Both sides must have the same columns in the same order; with `check` (an aggregate each) a repeated identity fails."""
    if base.columns != after.columns or key not in base.columns:
        raise WireError("delta_invalid", "the columns differ: send the full table")
    if check:
        _require_unique(base, key, "base")
        _require_unique(after, key, "next")
    rest = [c for c in after.columns if c != key]
    b = base.select(identity(base, key).alias("_id"), F.col(f"`{key}`").alias("_key"), _mark(base).alias("_record"))
    a = after.select(identity(after, key).alias("_id2"), _mark(after).alias("_record2"), *(f"`{c}`" for c in after.columns))
    both = b.join(a, F.col("_id") == F.col("_id2"), "full_outer")
    op = F.when(F.col("_record").isNull(), "added").when(F.col("_record2").isNull(), "removed").when(F.col("_record") != F.col("_record2"), "changed")
    shown = {key: F.when(F.col("_id2").isNull(), F.col("_key")).otherwise(F.col(f"`{key}`"))} | {c: F.col(f"`{c}`") for c in rest}
    return both.select(op.alias("_op"), F.coalesce("_id", "_id2").alias("_id"), *(shown[c].alias(c) for c in after.columns)).filter(F.col("_op").isNotNull())


def _declared(fields: list[str], key: str) -> str:
    return "{" + ",".join("@" * (f == key) + key_text(f) for f in fields) + "}"


def _row_text(df: DataFrame, fields: list[str]) -> Column:
    kinds = _kinds(df)
    return F.concat_ws("|", *(format_scalar(F.col(f"`{f}`"), kinds[f]) for f in fields))


def _lines(spark: SparkSession, lines: list[tuple[int, str]]) -> DataFrame:
    made = F.array(*(F.struct(F.lit(s).alias("section"), F.lit("").alias("place"), F.lit(t).alias("line")) for s, t in lines))
    return spark.range(1).select(F.inline(made))


def full_lines(df: DataFrame, key: str, name: str = "rows", tool: str = "", root: str | None = None) -> DataFrame:
    """section, place, line of a full snapshot; lines are in the order of (section, place): rows by identity."""
    head = f"{MAGIC} profile=generic" + f" tool={tool}" * bool(tool) + f" pack_root={root or table_root(df)} key={key}"
    tops = _lines(df.sparkSession, [(-2, head), (-1, f"## {key_text(name) if name else 'rows'} [{df.count()}]{_declared(df.columns, key)}")])
    return tops.unionByName(df.select(F.lit(0).alias("section"), identity(df, key).alias("place"), _row_text(df, df.columns).alias("line")))


def delta_lines(delta: DataFrame, key: str, base_root: str, new_root: str, tool: str = "", tokens: tuple[int, int] | None = None) -> DataFrame:
    """section, place, line of a delta: added, changed, removed; empty sections are left out.  tokens: of delta and full."""
    fields = [c for c in delta.columns if c not in ("_op", "_id")]
    counts = {r["_op"]: r["count"] for r in delta.groupBy("_op").count().collect()}  # three rows at most
    head = f"{MAGIC} profile=generic" + f" tool={tool}" * bool(tool) + f" delta=true base_root={base_root} new_root={new_root} key={key}"
    if tokens and tokens[1] > 0:
        head += f" savings={100.0 * (1.0 - tokens[0] / tokens[1]):.0f}%"
    tops = [(-1, head)] + [(2 * i, f"## {op} [{counts[op]}]{_declared(fields if op != 'removed' else [key], key)}") for i, op in enumerate(ORDER) if op in counts]
    section = F.when(F.col("_op") == "added", 1).when(F.col("_op") == "changed", 3).otherwise(5)
    line = F.when(F.col("_op") == "removed", _row_text(delta, [key])).otherwise(_row_text(delta, fields))
    return _lines(delta.sparkSession, tops).unionByName(delta.select(section.alias("section"), F.col("_id").alias("place"), line.alias("line")))


def savings(delta_tokens: Column, full_tokens: Column) -> Column:
    return savings_text(delta_tokens, full_tokens)


def lines_text(lines: DataFrame) -> str:
    """The wire text, for what fits on the driver."""
    return "".join(r["line"] + "\n" for r in lines.orderBy("section", "place").toLocalIterator())


@dataclass
class Section:
    name: str
    count: int
    fields: list[str]
    key: str | None
    first: int


def _declaration(text: str) -> tuple[list[str], str | None]:
    if text[:1] != "{" or text[-1:] != "}":
        raise WireError("delta_invalid", f"field declaration {text}")
    fields, key = [], None
    for part in split_quoted(text[1:-1], ","):
        marked, part = part[:1] == "@", part.removeprefix("@")
        part = unquote(part) if part[:1] == '"' else part
        fields.append(part)
        key = part if marked else key
    if len({*fields}) < len(fields):
        raise WireError("delta_invalid", f"duplicate column in {text}")
    return fields, key


def read_sections(lines: DataFrame) -> tuple[dict[str, str], list[Section], DataFrame]:
    """From lines(pos, line) of a wire: header fields, sections, and the data lines (pos, line, section), where section is
    the place of the section's own header.

    Only the header lines come to the driver; the data lines are written to the shared folder, since they are read for
    their counts and once for each section."""
    own = lines.filter(F.col("line") != "")
    tops = own.filter(F.col("line").startswith("## ") | F.col("line").startswith(f"{MAGIC} ")).orderBy("pos").collect()  # one a section
    if not tops or not tops[0]["line"].startswith(f"{MAGIC} "):
        raise WireError("missing_header")
    head = header_fields(tops[0]["line"])
    if head["profile"] != "generic":
        raise WireError("unknown_profile", head["profile"])
    sections = []
    for row in tops[1:]:
        text = row["line"][3:]
        at = find_outside(text, "[")
        close = text.find("]", at)
        if at < 0 or close < 0:
            raise WireError("delta_invalid", f"section header {text}")
        name = text[:at].strip()
        fields, key = _declaration(text[close + 1 :])
        try:
            sections.append(Section(unquote(name) if name[:1] == '"' else name, parse_count(text[at + 1 : close]), fields, key, row["pos"]))
        except WireError as e:
            raise WireError("delta_invalid", str(e)) from e
    data = ~F.col("line").startswith("## ") & ~F.col("line").startswith("##! ") & ~F.col("line").startswith("# ") & (F.col("pos") > tops[0]["pos"])
    under = carry_last(own.select("pos", "line"), {"section": F.when(F.col("line").startswith("## "), F.col("pos"))})
    body = stored(under.filter(data).select("pos", "line", F.coalesce("section", F.lit(-1)).alias("section")), "body")
    found = {r["section"]: r["count"] for r in body.groupBy("section").count().collect()}  # a row a section
    for s in sections:
        if found.get(s.first, 0) != s.count:
            raise WireError("count_mismatch", f"{s.count} declared in {s.name}, {found.get(s.first, 0)} found")
    if found.get(-1):
        raise WireError("count_mismatch", "rows outside a section")
    return head, sections, body


def decode_full(lines: DataFrame, schema: T.StructType, verify: bool = True) -> DataFrame:
    """The table of a full wire's lines(pos, line).  The declared root is verified unless verify=False."""
    head, sections, body = read_sections(lines)
    if len(sections) != 1 or sections[0].fields != schema.names:
        raise WireError("delta_invalid", "the section's columns aren't those of the schema")
    got = decode_rows(body.select("line"), schema, absent=False)
    if verify and head.get("pack_root") and (root := table_root(got)) != head["pack_root"]:
        raise WireError("root_mismatch", f"computed {root}")
    return got


def decode_delta(lines: DataFrame, schema: T.StructType) -> tuple[dict[str, str], DataFrame]:
    """Header fields and the delta (_op, _id, columns) of a wire's lines(pos, line), read in one pass and stored."""
    head, sections, body = read_sections(lines)
    if head.get("delta") != "true":
        raise WireError("delta_invalid", "not a delta")
    key = head.get("key") or next((s.key for s in sections if s.key), None)
    if key not in schema.names:
        raise WireError("delta_invalid", f"no key column {key}")
    places: dict[str, list[int]] = {op: [] for op in ORDER}
    for s in sections:
        if s.name not in ORDER:
            raise WireError("delta_invalid", f"unknown section {s.name}")
        if s.fields != ([key] if s.name == "removed" else schema.names):
            raise WireError("delta_invalid", f"columns of {s.name}")
        places[s.name].append(s.first)
    if nested := [f.name for f in schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]:
        raise WireError("delta_invalid", f"nested column {nested[0]}")
    op = F.when(F.col("section").isin(places["added"]), "added").when(F.col("section").isin(places["changed"]), "changed").otherwise("removed")
    rows = body.select(op.alias("_op"), split_cells(F.col("line")).alias("_cells"))
    width = F.when(F.col("_op") == "removed", 1).otherwise(len(schema.names))
    wrong = F.raise_error(F.concat(F.lit("row_width_mismatch: "), F.size("_cells").cast("string"), F.lit(" cells"))).cast("array<string>")
    rows = rows.select("_op", F.when(F.size("_cells") == width, F.col("_cells")).otherwise(wrong).alias("_cells"))

    def value(i: int, f: T.StructField) -> Column:
        gone = F.col("_op") == "removed"
        cell = F.when(gone, F.col("_cells")[0] if f.name == key else F.lit(None)).otherwise(F.get("_cells", F.lit(i)))
        return typed_cell(cell, f.dataType, absent=False).alias(f.name)

    got = rows.select("_op", *(value(i, f) for i, f in enumerate(schema.fields)))
    return head, stored(got.select("_op", identity(got, key).alias("_id"), *(f"`{c}`" for c in schema.names)), "delta")


def delta_errors(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """code, detail of what forbids to apply a delta: all is held against the base as it is."""
    ids = base.select(identity(base, key).alias("_id"))
    touched = delta.groupBy("_id").agg(F.count(F.lit(1)).alias("n"), F.first("_op").alias("_op"))
    repeated = touched.filter("n > 1").select(F.concat(F.lit("identity named twice "), "_id").alias("detail"))
    missing = delta.filter("_op <> 'added'").join(ids, "_id", "left_anti").select(F.concat("_op", F.lit(" identity not in base "), "_id").alias("detail"))
    there = delta.filter("_op = 'added'").join(ids, "_id", "left_semi").select(F.concat(F.lit("added identity in base "), "_id").alias("detail"))
    return repeated.union(missing).union(there).select(F.lit("delta_invalid").alias("code"), "detail")


def apply_delta(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The next snapshot; see delta_errors() for what should be checked before."""
    kept = base.withColumn("_id", identity(base, key)).join(delta.select("_id"), "_id", "left_anti").select(*(f"`{c}`" for c in base.columns))
    return kept.unionByName(delta.filter("_op <> 'removed'").select(*(f"`{c}`" for c in base.columns)))


def verify_delta(base: DataFrame, delta: DataFrame, key: str, base_root: str, new_root: str) -> DataFrame:
    """The next snapshot, or a WireError; nothing is applied in part.

    Base and delta are read once, for one full outer join that is stored; errors, both roots and the result come of it."""
    columns = [f"`{c}`" for c in base.columns]
    changed = delta.select("_id", "_op", *columns)
    b = base.select(identity(base, key).alias("_id"), record(base).alias("_record"), F.struct(*columns).alias("_row"))
    d = changed.select(F.col("_id").alias("_id2"), "_op", record(changed.select(*columns)).alias("_record2"), F.struct(*columns).alias("_row2"))
    both = stored(b.join(d, F.col("_id") == F.col("_id2"), "full_outer").withColumn("_id", F.coalesce("_id", "_id2")).drop("_id2"), "verified")
    if root_of(both.filter("_record is not null").select(F.col("_record").alias("r"))) != base_root:
        raise WireError("base_mismatch")
    if (twice := both.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()) is not None:
        raise WireError("delta_invalid", f"identity twice in base or delta {twice['_id']}")
    wrong = both.filter(F.when(F.col("_op") == "added", F.col("_row").isNotNull()).otherwise(F.col("_op").isNotNull() & F.col("_row").isNull())).first()
    if wrong is not None:
        raise WireError("delta_invalid", f"{wrong['_op']} identity {'not ' * (wrong['_op'] != 'added')}in base {wrong['_id']}")
    after = both.filter(F.coalesce(F.col("_op") != "removed", F.lit(True)))
    kept = after.select(F.when(F.col("_op").isNull(), F.col("_record")).otherwise(F.col("_record2")).alias("r"), F.when(F.col("_op").isNull(), F.col("_row")).otherwise(F.col("_row2")).alias("_row"))
    if (root := root_of(kept.select("r"))) != new_root:
        raise WireError("root_mismatch", f"computed {root}")
    return kept.select("_row.*")
