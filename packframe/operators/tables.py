"""Tables with a schema: DataFrames to wire lines and back, in Column expressions.

What depends on the schema alone is planned on the driver (columns, path columns, headers); what depends on the data is
one aggregate (guards for path columns and shared schemas).  Lines are rows (row, sub, line): row -1 is the header.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.errors import WireError
from packframe.functions import format_scalar, split_cells, typed_cell
from packframe.operators.ordering import with_row_index
from packframe.plans.document import HEADER, STEP
from packframe.plans.values import declaration, key_text

#: Optional column: names of the fields that a row doesn't have (`~`).
ABSENT = "_absent"


def _scalar(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def _leaves(kind: T.StructType, path: tuple[str, ...]) -> list[tuple[tuple[str, ...], T.DataType]] | None:
    """Scalar leaves below a struct; None where its shape can't be columns."""
    out: list = []
    for f in kind.fields:
        if not f.name or ">" in f.name:
            return None
        if isinstance(f.dataType, T.StructType):
            below = _leaves(f.dataType, (*path, f.name))
            if not below:
                return None
            out += below
        elif _scalar(f.dataType):
            out.append(((*path, f.name), f.dataType))
        else:
            return None
    return out


def _at(path: tuple[str, ...]) -> Column:
    return reduce(lambda c, n: c.getField(n), path[1:], F.col(f"`{path[0]}`"))


@dataclass
class TablePlan:
    """How the columns of a schema are laid out."""

    columns: list[tuple[tuple[str, ...], T.DataType]] = field(default_factory=list)
    flat: set[str] = field(default_factory=set)
    inline: dict[str, list[str]] = field(default_factory=dict)
    shared: set[str] = field(default_factory=set)
    below: list[str] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [">".join(p) for p, _ in self.columns]


def flatten_guards(df: DataFrame) -> DataFrame:
    """For each struct column of a shape that allows path columns: whether some row forbids them.  One aggregate."""
    found = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType) and f.name and ">" not in f.name and (leaves := _leaves(f.dataType, (f.name,))):
            inner = {p[:i] for p, _ in leaves for i in range(2, len(p))}
            bad = [_at(p[:-1]).isNotNull() & _at(p).isNull() for p in inner]
            bad.append(F.col(f"`{f.name}`").isNotNull() & reduce(lambda a, b: a & b, (_at(p).isNull() for p, _ in leaves)))
            found.append(F.coalesce(F.max(reduce(lambda a, b: a | b, bad)), F.lit(False)).alias(f.name))
    return df.agg(*found) if found else df.limit(1).select(F.lit(False).alias("none"))


def plan_table(df: DataFrame, flatten: bool = True) -> TablePlan:
    """Lays out df, a DataFrame with the place of each row as `_row`."""
    fields = [f for f in df.schema.fields if f.name not in ("_row", ABSENT)]
    data = df.select(*(f"`{f.name}`" for f in fields))
    guards = flatten_guards(data).first() if flatten and any(isinstance(f.dataType, T.StructType) for f in fields) else None
    plan = TablePlan()
    asked = []
    for f in fields:
        kind, name = f.dataType, f.name
        leaves = _leaves(kind, (name,)) if isinstance(kind, T.StructType) and guards is not None and name in guards.asDict() and not guards[name] else None
        if leaves:
            plan.flat.add(name)
            plan.columns += leaves
        elif ">" in name:
            raise WireError("invalid_field_declaration", f"column {name}: use documents")
        else:
            plan.columns.append(((name,), kind))
            if not _scalar(kind):
                plan.below.append(name)
                asked.append(f)
    first = F.col("_row") == 0
    checks = []
    for f in asked:
        c = F.col(f"`{f.name}`")
        checks.append(F.max(F.when(first, c.isNotNull())).alias(f"first {f.name}"))
        full = c.isNull() | ((F.size(c) > 0) if isinstance(f.dataType, T.ArrayType) else F.lit(True))
        checks.append(F.min(full).alias(f"full {f.name}"))
    got = df.agg(*checks).first() if checks else None
    for f in asked:
        if not got[f"first {f.name}"]:
            continue
        kind = f.dataType
        if isinstance(kind, T.StructType) and len(kind.fields) >= 3 and all(_scalar(x.dataType) for x in kind.fields):
            plan.inline[f.name] = [x.name for x in kind.fields]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and all(_scalar(x.dataType) for x in kind.elementType.fields) and got[f"full {f.name}"]:
            plan.shared.add(f.name)
    return plan


def _row_text(value: Column, kind: T.StructType) -> Column:
    return F.concat_ws("|", *(format_scalar(value.getField(f.name), f.dataType) for f in kind.fields))


def inline_array(value: Column, kind: T.ArrayType) -> Column:
    """An array of scalars behind its name."""
    return F.concat(F.lit("["), F.size(value).cast("string"), F.lit("]: "), F.array_join(F.transform(value, lambda x: format_scalar(x, kind.elementType)), ","))


def _array_lines(head: Column, value: Column, kind: T.ArrayType, depth: int, bare: Column) -> Column:
    """Lines of an array behind `head`; `bare`: whether the header goes without fields."""
    if _scalar(kind.elementType):
        return F.array(F.when(F.size(value) == 0, F.concat(head, F.lit("[0]"))).otherwise(F.concat(head, inline_array(value, kind))))
    if not isinstance(kind.elementType, T.StructType) or not all(_scalar(f.dataType) for f in kind.elementType.fields):
        raise WireError("invalid_field_declaration", f"{kind.simpleString()}: use documents")
    names = [f.name for f in kind.elementType.fields]
    header = F.concat(head, F.lit("["), F.size(value).cast("string"), F.lit("]"), F.when(bare | (F.size(value) == 0), "").otherwise(declaration(names)))
    rows = F.transform(value, lambda x: F.concat(F.lit(STEP * depth), F.when(x.isNull(), F.raise_error(F.lit("invalid_line: null in an array of rows")).cast("string")).otherwise(_row_text(x, kind.elementType))))
    return F.concat(F.array(header), rows)


def _member_lines(value: Column, kind: T.StructType, depth: int) -> Column:
    parts = []
    for f in kind.fields:
        x, key, pad = value.getField(f.name), key_text(f.name), STEP * depth
        if _scalar(f.dataType):
            parts.append(F.array(F.concat(F.lit(f"{pad}{key}="), format_scalar(x, f.dataType))))
            continue
        if isinstance(f.dataType, T.StructType):
            own = F.concat(F.array(F.lit(f"{pad}## {key}")), _member_lines(x, f.dataType, depth + 1))
        elif isinstance(f.dataType, T.ArrayType):
            plain = _scalar(f.dataType.elementType)
            own = _array_lines(F.when(F.size(x) == 0, f"{pad}## {key} ").otherwise(f"{pad}{key}" if plain else f"{pad}## {key} "), x, f.dataType, depth, F.lit(False))
        else:
            raise WireError("invalid_field_declaration", f"{f.dataType.simpleString()}: use documents")
        parts.append(F.when(x.isNull(), F.array(F.lit(f"{pad}{key}=-"))).otherwise(own))
    return F.concat(*parts)


def row_lines(df: DataFrame, plan: TablePlan) -> DataFrame:
    """row, sub, line of every row of df, which has `_row`."""
    absent = (lambda n: F.array_contains(ABSENT, n)) if ABSENT in df.columns else (lambda n: F.lit(False))
    first = F.col("_row") == 0
    cells, attached = [], []
    for path, kind in plan.columns:
        name, value = path[0], _at(path)
        if _scalar(kind):
            cell = F.when(F.col(f"`{name}`").isNull(), "-").otherwise(format_scalar(value, kind)) if len(path) > 1 else format_scalar(value, kind)
        else:
            mark = F.when(first, "^" + declaration(plan.inline[name])).otherwise("^") if name in plan.inline else F.lit("^")
            cell = F.when(value.isNull(), "-").otherwise(mark)
            head = f".{key_text(name)} "
            if name in plan.inline:
                own = F.array(_row_text(value, kind))
            elif isinstance(kind, T.StructType):
                own = F.concat(F.array(F.lit(head + "{}")), _member_lines(value, kind, 2))
            elif isinstance(kind, T.ArrayType):
                own = _array_lines(F.lit(head), value, kind, 2, ~first if name in plan.shared else F.lit(False))
            else:
                raise WireError("invalid_field_declaration", f"{kind.simpleString()}: use documents")
            attached.append(F.when(value.isNull() | absent(name), F.array().cast("array<string>")).otherwise(own))
        cells.append(F.when(absent(name), "~").otherwise(cell) if ABSENT in df.columns else cell)
    text = F.concat_ws("|", *cells)
    if not attached:
        return df.select(F.col("_row").alias("row"), F.lit(0).alias("sub"), text.alias("line"))
    lines = F.concat(*attached)
    head = F.when(F.size(lines) > 0, F.concat(F.lit("@"), F.col("_row").cast("string"), F.lit(" "), text)).otherwise(text)
    return df.select(F.col("_row").alias("row"), F.posexplode(F.concat(F.array(head), lines)).alias("sub", "line"))


def encode_table(df: DataFrame, order: list[str | Column], name: str | None = None, flatten: bool = True, keyed: bool = False, count: int | None = None) -> DataFrame:
    """Lines (row, sub, line) of a table, the wire header (row -2) and its own header (row -1) included.

    The order must be total.  The count in the header is counted unless given.  keyed: the first column holds the keys of
    a map of two members at least, each once."""
    placed = with_row_index(df, *order)
    plan = plan_table(placed, flatten)
    n = placed.count() if count is None else count
    if keyed:
        if n < 2 or len(plan.columns) < 2:
            raise WireError("invalid_count", "a keyed table has two members and a key and a field at least")
        if (twice := placed.groupBy(f"`{df.columns[0]}`").count().filter("count > 1").first()) is not None:
            raise WireError("duplicate_key", twice[0])
    title = "## " if name is None else f"## {key_text(name)} "
    head = title + (f"[{n}{':' if keyed else ''}]{declaration(plan.names)}" if n else "[0]")
    spark = df.sparkSession
    tops = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(r).cast("long").alias("row"), F.lit(0).alias("sub"), F.lit(t).alias("line")) for r, t in ((-2, HEADER), (-1, head))))))
    return tops.unionByName(row_lines(placed, plan))


def text_of(lines: DataFrame) -> str:
    """The wire text of lines, for what fits on the driver."""
    return "".join(r["line"] + "\n" for r in lines.orderBy("row", "sub").toLocalIterator())


def decode_rows(lines: DataFrame, schema: T.StructType, line_col: str = "line", absent: bool = True) -> DataFrame:
    """The rows of flat table lines, by a schema whose structs are path columns.  Other columns of `lines` stay.

    A row of another width fails as row_width_mismatch; a null line is a row of nulls (the optimizer may compute a
    column before a filter: whoever leaves out lines that aren't rows has to null them too).  Without `absent`, as in
    sets of deltas, a field may not be left out (`~`)."""
    columns: list[tuple[tuple[str, ...], T.DataType]] = []
    for f in schema.fields:
        leaves = _leaves(f.dataType, (f.name,)) if isinstance(f.dataType, T.StructType) else [((f.name,), f.dataType)]
        if not leaves or not all(_scalar(k) for _, k in leaves):
            raise WireError("invalid_field_declaration", f"column {f.name}: use documents")
        columns += leaves
    cells = split_cells(F.col(line_col))
    width = F.when(F.col("_cells").isNull() | (F.size("_cells") == len(columns)), F.col("_cells")).otherwise(F.raise_error(F.concat(F.lit(f"row_width_mismatch: {len(columns)} fields, "), F.size("_cells").cast("string"), F.lit(" cells"))).cast("array<string>"))
    kept = [c for c in lines.columns if c != line_col]
    checked = lines.withColumn("_cells", cells).select(*kept, width.alias("_cells"))
    place = {p: i for i, (p, _) in enumerate(columns)}

    def value(path: tuple[str, ...], kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            below = [i for p, i in place.items() if p[: len(path)] == path]
            empty = reduce(lambda a, b: a & b, (F.col("_cells")[i].isin("-", "~") for i in below))
            return F.when(~empty, F.struct(*(value((*path, f.name), f.dataType).alias(f.name) for f in kind.fields)))
        return typed_cell(F.col("_cells")[place[path]], kind, absent)

    return checked.select(*kept, *(value((f.name,), f.dataType).alias(f.name) for f in schema.fields))


def key_label(fields: list[str]) -> str:
    """The name of a keyed table's first column."""
    label = "key"
    while label in fields:
        label = "_" + label
    return label


def keyed_rows(df: DataFrame, map_col: str, *keep: str) -> DataFrame:
    """A row per member of a map<string,struct> column: the key column, then the fields."""
    kind = df.schema[map_col].dataType
    if not isinstance(kind, T.MapType) or not isinstance(kind.valueType, T.StructType):
        raise WireError("invalid_field_declaration", f"{map_col} is no map of rows")
    names = [f.name for f in kind.valueType.fields]
    got = df.select(*keep, F.explode(map_col).alias("_key", "_value"))
    return got.select(*keep, F.col("_key").alias(key_label(names)), *(F.col("_value").getField(n).alias(n) for n in names))


def rows_to_map(df: DataFrame, key: str, name: str = "members", by: list[str] | None = None) -> DataFrame:
    """The inverse: one map per group of `by`; a key that is there twice fails."""
    by = by or []
    fields = [c for c in df.columns if c not in (key, *by)]
    return df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct(*fields)))).alias(name))


def field_union(objects: DataFrame, json_col: str, order_col: str) -> DataFrame:
    """field, place: the fields of JSON objects in order of first appearance."""
    keys = objects.select(F.col(order_col).alias("_o"), F.posexplode(F.json_object_keys(json_col)).alias("_p", "field"))
    firsts = keys.groupBy("field").agg(F.min(F.struct("_o", "_p")).alias("_f"))
    return with_row_index(firsts, "_f._o", "_f._p", index="place").select("field", "place")
