"""The scalar grammar as Column expressions.  Everything here stays in the JVM.

Loops over groups are possessive: Java runs others by recursion, and long strings would exhaust the stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.plans.values import NUMBER, QUOTE_PATTERN

#: Fixed values of the wire format: kinds of symbols and their short forms.
KINDS = {
    "function": "fn", "type": "type", "method": "method", "interface": "iface", "var": "var", "const": "const", "resource": "resource", "table": "table", "class": "class",
    "selector": "selector", "field": "field", "route_handler": "route", "external": "ext", "file": "file", "package": "pkg", "service": "svc",
}

_SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_PLAIN_DIGITS = "0." + "#" * 30


def needs_quote(text: Column) -> Column:
    """Whether a bare string would be read as something else."""
    return text.rlike(QUOTE_PATTERN)


def quote_string(text: Column) -> Column:
    """The JSON form of a string; the escapes are only looked for where there is something to escape."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(_SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r'["\\\x{0}-\x{1F}]'), out).otherwise(text), F.lit('"'))


def unquote_string(text: Column) -> Column:
    """The string of a well-formed quoted form; null for others."""
    sound = text.rlike(r'\A"(?:[^"\\\x{0}-\x{1F}]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"\z')
    return F.when(sound, F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"])


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with `name` for value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _exponent_form() -> str:
    """SQL of a lambda from a double to its shortest digits with an exponent, the nearest of those that are as short.

    `f` are the shortest of the runtime's digits that read back.  Of 16 or 17 digits they aren't always the nearest.  The
    numerals of 17 digits that read back are a run of neighbours `n`; its ends are found to five more digits, and the number
    is in their middle `w` (at a third, for a power of two, below which numbers are twice as dense).  Those that end with 0
    are shorter and go first; of two as near the even one counts.  As text, since it is parsed once and not built call by
    call."""
    reads = lambda digits, more: f"cast(concat({digits}, 'E', cast(p.e - {16 + more} as string)) as double) = s"
    end = lambda start, least, digit, other: (
        f"cast(aggregate(sequence(1, 5), cast({start} as string), (acc, k) -> concat(acc, cast(coalesce({least}(filter(sequence(0, 9), "
        f"j -> {reads(f'acc, cast(j as string), repeat({digit!r}, 5 - k)', 5)})), {other}) as string))) as decimal(24, 0))"
    )
    part = "CASE WHEN pow(2.0D, round(log2(s))) = s AND s > 2.2250738585072014E-308D THEN 3 ELSE 2 END"
    ends = f"named_struct('a', {end('array_min(n) - 1', 'array_min', '9', 9)}, 'b', {end('array_max(n)', 'array_max', '0', 0)})"
    middle = _let("y", ends, f"cast(bround((y.a + (y.b - y.a) / {part}) / 4, 0) as decimal(24, 0)) * 4")
    tens = "filter(n, c -> c % 10 = 0)"
    chosen = (
        f"CASE WHEN size({tens}) > 1 THEN array_min(transform({tens}, c -> named_struct('far', abs(cast(c as decimal(18, 0)) * 100000 - w), 'c', c))).c"
        " WHEN abs(pmod(w, 100000) - 50000) <= 4 THEN cast(floor(w / 100000) as bigint) + pmod(cast(floor(w / 100000) as bigint), 2L) ELSE cast(round(w / 100000, 0) as bigint) END"
    )
    digits = f"cast(CASE WHEN size({tens}) = 1 THEN element_at({tens}, 1) ELSE {_let('w', middle, chosen)} END as string)"
    near = _let("m", digits, "concat(substr(m, 1, 1), '.', regexp_replace(substr(m, 2), '0+$', ''), 'e', cast(p.e + length(m) - 17 as string))")
    run = f"filter(transform(sequence(-25, 25), k -> p.d + k), c -> {reads('cast(c as string)', 0)})"
    parts = "named_struct('e', cast(substring_index(f, 'e', -1) as int), 'd', cast(rpad(replace(substring_index(f, 'e', 1), '.', ''), 17, '0') as bigint))"
    doubtful = "length(substring_index(f, 'e', 1)) >= 17 AND length(regexp_replace(substring_index(cast(s as string), 'E', 1), '[.]|0+$', '')) >= 17"
    form = f"CASE WHEN {doubtful} THEN {_let('p', parts, _let('n', run, near))} ELSE f END"
    shortest = "element_at(filter(transform(sequence(0, 16), d -> format_string(concat('%.', cast(d as string), 'e'), s)), t -> cast(t as double) = s), 1)"
    exponent = "cast(substring_index(g, 'e', -1) as int)"
    shown = f"concat(CASE WHEN v < 0 THEN '-' ELSE '' END, substring_index(g, 'e', 1), CASE WHEN {exponent} < 0 THEN 'e-' ELSE 'e+' END, cast(abs({exponent}) as string))"
    return "v -> " + _let("s", "abs(v)", _let("g", _let("f", shortest, form), shown))


_EXPONENT_FORM = _exponent_form()


def number_text(x: Column) -> Column:
    """Shortest digits of a double: plain from 1e-6 up to 2**53, else with an exponent; what isn't finite is 0."""
    size = F.abs(x)
    return (
        F.when(F.isnan(x) | (size == float("inf")) | (x == 0), "0")
        .when((size >= 1e-6) & (size < 2.0**53), F.call_function("format_number", x, F.lit(_PLAIN_DIGITS)))
        .otherwise(F.element_at(F.call_function("transform", F.array(x), F.expr(_EXPONENT_FORM)), 1))
    )


def _text(value: Column, kind: T.DataType) -> Column:
    """The string that stands for a value without a form of its own."""
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return value.cast("string")


def _bare(value: Column, kind: T.DataType) -> Column | None:
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return value.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number_text(value.cast("double"))
    return None


def format_scalar(value: Column, kind: T.DataType) -> Column:
    """A cell: null is -, numbers and booleans are bare, strings quoted where they must be.

    Decimals are strings of plain digits, dates and timestamps ISO 8601 strings, binary values base-64 strings."""
    if isinstance(kind, T.NullType):
        return F.lit("-")
    bare = _bare(value, kind)
    if bare is None:
        text = _text(value, kind)
        bare = F.when(needs_quote(text), quote_string(text)).otherwise(text)
    return F.when(value.isNull(), "-").otherwise(bare)


def canonical_cell(value: Column, kind: T.DataType) -> Column:
    """A cell as it is hashed: strings are always quoted."""
    if isinstance(kind, T.NullType):
        return F.lit("-")
    bare = _bare(value, kind)
    return F.when(value.isNull(), "-").otherwise(quote_string(_text(value, kind)) if bare is None else bare)


def parse_scalar(cell: Column) -> Column:
    """struct<tag,b,l,d,s>; tag: null, absent, attachment, bool, int, double, string or error."""
    digits = cell.rlike(r"\A-?[0-9]+\z")
    number = cell.rlike(rf"\A{NUMBER}\z")
    long, quoted = cell.try_cast("long"), cell.startswith('"')
    text = unquote_string(cell)
    tag = (
        F.when(cell == "", "string")
        .when(quoted, F.when(text.isNull(), "error").otherwise("string"))
        .when(cell == "-", "null")
        .when(cell == "~", "absent")
        .when((cell == "^") | cell.rlike(r"(?s)\A\^\{.*\}\z"), "attachment")
        .when(cell.isin("true", "false"), "bool")
        .when(number & digits, F.when(long.isNull(), "error").otherwise("int"))
        .when(number, "double")
        .otherwise("string")
    )
    return F.struct(
        tag.alias("tag"),
        F.when(tag == "bool", cell == "true").alias("b"),
        F.when(tag == "int", long).alias("l"),
        F.when(tag == "double", cell.try_cast("double")).alias("d"),
        F.when(tag == "string", F.when(quoted, text).otherwise(cell)).alias("s"),
    )


def _read_cell(cell: Column, kind: T.DataType) -> Column:
    """The value of a cell; null for cells of another type."""
    text = F.when(cell.startswith('"'), unquote_string(cell)).otherwise(cell)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BinaryType):
        return F.unbase64(text)
    if isinstance(kind, T.BooleanType):
        return F.when(cell == "true", True).when(cell == "false", False)
    if isinstance(kind, T.IntegralType):
        return F.when(cell.rlike(r"\A-?[0-9]+\z"), cell.try_cast(kind))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(cell.rlike(rf"\A{NUMBER}\z"), cell.try_cast(kind))
    return text.try_cast(kind)


def _marker(cell: Column) -> Column:
    """Whether a cell stands for an attachment."""
    return (cell == "^") | cell.rlike(r"(?s)\A\^\{.*\}\z")


def typed_cell(cell: Column, kind: T.DataType, absent: bool = True) -> Column:
    """A cell read as a value of a known type; null is null, other cells fail loudly.  absent: whether `~` is null too, or
    fails like the marks of attachments."""
    value = _read_cell(cell, kind)
    wrong = F.raise_error(F.concat(F.lit("invalid_line: not a "), F.lit(kind.simpleString()), F.lit(": "), cell)).cast(kind)
    if not absent:
        value = F.when((cell == "~") | _marker(cell), F.raise_error(F.concat(F.lit("delta_invalid: not a scalar: "), cell)).cast(kind)).otherwise(value)
    return F.when(cell.isNull() | cell.isin("-", *["~"] * absent), F.lit(None).cast(kind)).when(value.isNull(), wrong).otherwise(value)


def lenient_cell(cell: Column, kind: T.DataType) -> tuple[Column, Column]:
    """The value of a cell, and whether it is a cell of another type (then the value is null)."""
    void = cell.isNull() | cell.isin("-", "~")
    value = F.when(~void & ~_marker(cell), _read_cell(cell, kind))
    return value, F.coalesce(~void & value.isNull(), F.lit(False))


def split_cells(line: Column, delimiter: str = "|") -> Column:
    """array<string>: split outside quotes."""
    d = "," if delimiter == "," else "|"
    return F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(rf'[{d}]((?:"(?:\\.|[^"\\])*+"|[^{d}"])*+)'), 1)


def _kinds(flip: bool) -> Column:
    return F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in ((v, k) if flip else (k, v))))


def abbreviate_kind(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_kinds(False), kind), kind)


def expand_kind(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_kinds(True), kind), kind)


def score_text(score: Column) -> Column:
    """Two decimals, half-even on the exact binary value."""
    return F.call_function("format_number", score, F.lit("0.00"))


def savings_text(delta: Column, full: Column) -> Column:
    return F.concat(F.call_function("format_number", 100.0 * (1.0 - delta.cast("double") / full.cast("double")), F.lit("0")), F.lit("%"))


def wire_bytes(text: Column) -> Column:
    return F.octet_length(text)


def count_value(text: Column) -> Column:
    """A count in a header; null unless it is a plain non-negative number."""
    return F.when(text.rlike(r"\A(0|[1-9][0-9]*)\z"), text.try_cast("long"))
