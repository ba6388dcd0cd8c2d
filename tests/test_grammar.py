"""Scalars and documents, in plain Python and as Columns."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe import functions as P
from packframe.errors import CODES, WireError
from packframe.operators import documents
from packframe.plans import values as V
from packframe.plans.document import decode, encode
from packframe.sources import json_text

H = "GCF profile=generic\n"

STRINGS = ["", "-", "~", "^", "true", "1", "1.5", "01", "+1", ".5", " a", "a ", "#x", "@0", "a|b", "a,b", 'q"q', "\\", "^{a,b,c}", "a[1]: b", "\t", "\x01", "é", "\x85", "\u3000", "\ufeff", "x\ny", "1\n", "x:[", "-0", "1e5", "nan", "a=b", "## x", "日本", "\x7f"]


@pytest.mark.parametrize(
    "value, wire",
    [
        (42, "=42\n"), ("hello", "=hello\n"), (True, "=true\n"), (None, "=-\n"), ([], "## [0]\n"), ({}, ""), ({"val": "true"}, 'val="true"\n'), ({"val": "a|b"}, 'val="a|b"\n'), ({"val": ""}, 'val=""\n'),
        ({"employees": [{"department": "Engineering", "id": 1, "name": "Alice", "salary": 95000}, {"department": "Sales", "id": 2, "name": "Bob", "salary": 1.5}]},
         "## employees [2]{department,id,name,salary}\nEngineering|1|Alice|95000\nSales|2|Bob|1.5\n"),
        ({"o": [{"id": "a", "customer": {"name": "X"}}]}, '## o [1]{id,"customer>name"}\na|X\n'),
        ({"a": {"x": 1}, "b": {"x": 2}}, "## [2:]{key,x}\na|1\nb|2\n"),
        ({"n": {"a": 1}}, "## n\n  a=1\n"),
        ([1, "x", None], "## [3]: 1,x,-\n"),
        ([{"a": 1}, 2], "## [2]\n@0 {}\n  a=1\n@1 =2\n"),
        ([{"a": 1}, {"b": None}], "## [2]{a,b}\n1|~\n~|-\n"),
    ],
)
def test_goldens(value, wire):
    assert encode(value) == H + wire
    assert decode(H + wire) == value


def test_inline_and_shared_schemas():
    rows = [{"i": 1, "o": {"a": 1, "b": "x", "c": None}, "t": [{"p": 1}, {"p": 2}]}, {"i": 2, "o": {"a": 2, "b": "y", "c": 3}, "t": [{"p": 3}]}]
    wire = encode(rows, flatten=False)
    assert wire == H + "## [2]{i,o,t}\n@0 1|^{a,b,c}|^\n1|x|-\n.t [2]{p}\n    1\n    2\n@1 2|^|^\n2|y|3\n.t [1]\n    3\n"
    assert decode(wire) == rows


NUMBERS = [(0.0, "0"), (-0.0, "0"), (math.nan, "0"), (math.inf, "0"), (10.0, "10"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1e16, "1e+16"), (5e-324, "5e-324"), (2e23, "2e+23"), (-1.5, "-1.5"), (2.0**53, "9.007199254740992e+15"), (2.0**53 - 1, "9007199254740991")]


@pytest.mark.parametrize("x, text", NUMBERS)
def test_numbers(x, text):
    assert V.number_text(x) == text


def test_number_columns(spark):
    rng = random.Random(5)
    xs = [x for x, _ in NUMBERS] + [rng.uniform(0, 1) for _ in range(800)] + [10 ** rng.uniform(-6, 15.9) for _ in range(800)] + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(8000)] + [s * 2.0**k for k in range(-1074, 1024, 3) for s in (1, -1)] + [-992752608297211648.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", P.number_text(F.col("x")).alias("t")).collect()
    assert [(r["x"], r["t"]) for r in got if r["t"] != V.number_text(r["x"])] == []


def test_string_columns(spark):
    rng = random.Random(6)
    parts = ["a", "1", '"', "\\", "|", ",", "[", "]", ":", "^", "{", "}", " ", "-", "~", ".", "e", "+", "\n", "\x00", "\x1f", "é", "\u2028"]
    texts = STRINGS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(3000)] + ["\n" * 50_000, '"' * 50_000]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    quoted, cell = P.quote_string(F.col("s")), P.format_scalar(F.col("s"), T.StringType())
    got = df.select("s", P.needs_quote(F.col("s")).alias("n"), quoted.alias("q"), P.unquote_string(quoted).alias("u"), cell.alias("c"), P.parse_scalar(cell).alias("p"), P.split_cells(F.concat(cell, F.lit("|z"))).alias("two"), P.parse_scalar(F.col("s"))["tag"].alias("tag"))
    for r in got.collect():
        assert r["n"] == V.needs_quote(r["s"]) and r["q"] == json.dumps(r["s"], ensure_ascii=False) and r["u"] == r["s"] == r["p"]["s"] == V.unquote(r["q"])
        assert r["c"] == V.scalar_text(r["s"]) and r["two"] == [r["c"], "z"] == V.split_quoted(r["c"] + "|z", "|")
        if not r["s"].startswith("^{"):
            try:
                v = V.parse_cell(r["s"])
                tag = "absent" if v is V.ABSENT else "attachment" if isinstance(v, V.Attachment) else {type(None): "null", bool: "bool", int: "int", float: "double", str: "string"}[type(v)]
            except WireError:
                tag = "error"
            assert r["tag"] == tag, r["s"]


def test_small_functions(spark):
    row = spark.range(1).select(
        P.score_text(F.lit(0.125)).alias("a"), P.score_text(F.lit(2.675)).alias("b"), P.savings_text(F.lit(30), F.lit(200)).alias("c"), P.wire_bytes(F.lit("é")).alias("d"), P.count_value(F.lit("01")).alias("e"),
        P.count_value(F.lit("10")).alias("f"), P.abbreviate_kind(F.lit("route_handler")).alias("g"), P.expand_kind(F.lit("fn")).alias("h"), P.expand_kind(F.lit("odd")).alias("i"), P.canonical_cell(F.lit("a\tb"), T.StringType()).alias("j"),
        P.canonical_cell(F.lit(59.98), T.DoubleType()).alias("k"), P.canonical_cell(F.lit(None).cast("string"), T.StringType()).alias("l"), P.format_scalar(F.lit("1.50").cast("decimal(9,2)"), T.DecimalType(9, 2)).alias("m"),
    ).first()
    assert tuple(row) == ("0.12", "2.67", "85%", 2, None, 10, "route", "function", "odd", '"a\\tb"', "59.98", "-", '"1.50"')


def _tree(rng, depth):
    keys = ["a", "b", "c", "name", "a>b", ">", "", "key", "x y", 'q"', "a[1]", "é", "=", "a=b"]
    r = rng.random()
    if depth <= 0 or r < 0.5:
        return rng.choice([None, True, False, rng.randint(-5, 10**6), rng.uniform(-1, 1), rng.uniform(-1, 1) * 10 ** rng.randint(-12, 20), rng.choice(STRINGS)])
    if r < 0.6:
        return [_tree(rng, 0) for _ in range(rng.randint(0, 4))]
    if r < 0.8:
        names = rng.sample(keys, rng.randint(1, 4))
        return [{k: _tree(rng, depth - 1) for k in names if rng.random() < 0.9} for _ in range(rng.randint(0, 4))]
    if r < 0.87:
        names = rng.sample(keys, 3)
        return {rng.choice(STRINGS) + str(i): {k: _tree(rng, depth - 2) for k in names} for i in range(rng.randint(1, 4))}
    if r < 0.93:
        return [_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {k: _tree(rng, depth - 1) for k in rng.sample(keys, rng.randint(0, 5))}


def test_random_documents_round_trip():
    rng, seen = random.Random(42), {">": 0, "[": 0, "^{": 0, ":]": 0}
    for _ in range(20_000):
        value = _tree(rng, 4)
        for flatten in (True, False):
            wire = encode(value, flatten)
            back = decode(wire)
            assert back == value and json.dumps(back) != "" and encode(back, flatten) == wire
            for mark in seen:
                seen[mark] += mark in wire
    assert min(seen.values()) > 100  # the generator reached every form


@pytest.mark.parametrize("name", [">", ">foo", "foo>", "a>>b", "a>b>c"])
@pytest.mark.parametrize("value", [1, None, {"x": 1}, [1, 2], [{"y": 1}]])
@pytest.mark.parametrize("flatten", [True, False])
def test_names_that_look_like_paths(name, value, flatten):
    for rows in ([{name: value}], [{name: value, "z": 1}, {"z": 2}]):
        assert decode(encode(rows, flatten)) == rows


ERRORS = {
    "": "missing_header", "nope\n": "missing_header", "GCF \n": "missing_profile", "GCF x\n": "malformed_header_field", "GCF profile=odd\n": "unknown_profile", "GCF profile=generic profile=generic\n": "duplicate_header_field",
    H + "=~\n": "invalid_missing", H + "=^\n": "invalid_attachment_marker", H + '="a\n': "unterminated_quote", H + '="a"b\n': "trailing_characters", H + "=1\n=2\n": "trailing_characters", H + '="\\x"\n': "invalid_escape",
    H + '="\\ud800"\n': "invalid_surrogate", H + "## a\n   b=1\n": "invalid_indent", H + "\ta=1\n": "tab_indentation", H + "a=1\na=2\n": "duplicate_key", H + "## [1]{a,a}\n1|2\n": "duplicate_field_name",
    H + "## [1]{a,b}\n1\n": "row_width_mismatch", H + "## [2]{a}\n1\n": "count_mismatch", H + "## [1]{a}\n1\n2\n": "count_mismatch", H + "## [01]{a}\n1\n": "invalid_count", H + "## [1]{a}\n@0 1\n.b =2\n": "orphan_attachment",
    H + "a=1\nx|y\n": "orphan_inline_attachment", H + "what\n": "invalid_line", H + "## [1]{a}\n@0 ^\n": "missing_attachment", H + "## [1]{a}\n^\n": "missing_attachment", H + "## [1]{a}\n@0 ^\n.a =1\n.a =2\n": "duplicate_attachment",
    H + "## [2]\n@0 =1\n@2 =2\n": "invalid_item_id", H + "## [1]{a b}\n1\n": "invalid_field_declaration", H + "=9223372036854775808\n": "out_of_range", H + "## a [?]{x}\n1\n##! summary counts=2\n": "count_mismatch",
    H + "## [0:]{k,v}\n": "invalid_count", H + "## [1:]{k}\na\n": "invalid_field_declaration", H + "## [2:]{k,v}\na|1\na|2\n": "duplicate_key",
}


@pytest.mark.parametrize("wire", ERRORS)
def test_errors(wire):
    with pytest.raises(WireError) as e:
        decode(wire)
    assert e.value.code == ERRORS[wire] and e.value.code in CODES


def test_tolerated():
    assert decode("\n" + H.replace("\n", "\r\n") + "# note\r\na=1\r\n\r\n") == {"a": 1}
    assert decode(H + "## a [?]{x}\n1\n2\n##! summary counts=2\n") == {"a": [{"x": 1}, {"x": 2}]}
    assert decode(H + "## [1]{a,b}\n@0 1|^\n  .b {}\n    x=1\n") == [{"a": 1, "b": {"x": 1}}]  # the older indent


def test_json_text():
    assert list(json_text.parse('{"b":1,"a":2,"b":3}').items()) == [("b", 3), ("a", 2)]
    for text, code in (("{", "invalid_json"), ("NaN", "invalid_json"), ("9223372036854775808", "out_of_range"), ('"\\ud800"', "invalid_surrogate")):
        with pytest.raises(WireError) as e:
            json_text.parse(text)
        assert e.value.code == code


def test_document_columns(spark):
    texts = ['{"b":[{"x":1,"y":{"z":null}}],"a":"é|"}', "[1,2]", None, "{", "9223372036854775808"]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = df.select(documents.to_wire(F.col("j"), mode="PERMISSIVE").alias("w")).collect()
    assert [r["w"]["error"] for r in got] == [None, None, None, "invalid_json", "out_of_range"]
    back = spark.createDataFrame([(t,) for t in texts[:3]], "j string").select(documents.from_wire(documents.to_wire(F.col("j"))).alias("j")).collect()
    assert [r["j"] and json.loads(r["j"]) for r in back] == [t and json.loads(t) for t in texts[:3]]
    with pytest.raises(Exception, match="invalid_json"):
        df.select(documents.to_wire(F.col("j"))).collect()
