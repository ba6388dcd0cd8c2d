"""Tables, content addresses, deltas, graphs and sessions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from packframe.errors import WireError
from packframe.operators import delta as D
from packframe.operators import graph as G
from packframe.operators import roots, session, sha256, tables
from packframe.operators.ordering import carry_last, with_row_index
from packframe.plans import document
from packframe.plans.graph_text import Graph, decode_graph, encode_graph

ORDERS = "id long, total double, status string, customer string"
BASE = [(1001, 59.98, "shipped", "Alice"), (1002, 29.99, "pending", "Bob"), (1003, 129.50, "shipped", "Carol")]
NEXT = [(1002, 29.99, "shipped", "Bob"), (1003, 129.50, "shipped", "Carol"), (1004, 75.00, "pending", "Dave")]


@pytest.fixture(scope="module")
def snapshots(spark):
    return spark.createDataFrame(BASE, ORDERS), spark.createDataFrame(NEXT, ORDERS)


def lines_of(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "pos long, line string")


def test_row_index(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("k"))
    got = with_row_index(df, "k", index="i").orderBy("k").collect()
    assert [r["i"] for r in got] == list(range(5000))


NESTED = [
    {"id": 1, "c": {"n": "a", "e": {"z": 1.5, "w": None}}, "t": [1, 2], "o": [{"a": 1, "b": "x"}, {"a": 2, "b": None}], "big": {"p": 1, "q": "r|s", "r": True}},
    {"id": 2, "c": None, "t": [], "o": [{"a": 3, "b": "-"}], "big": None},
    {"id": 3, "c": {"n": None, "e": {"z": 2.0, "w": "k"}}, "t": None, "o": None, "big": {"p": 2, "q": "", "r": False}},
]
SCHEMA = "id long, c struct<n:string,e:struct<z:double,w:string>>, t array<long>, o array<struct<a:long,b:string>>, big struct<p:long,q:string,r:boolean>"


@pytest.mark.parametrize("flatten", [True, False])
def test_tables_are_documents(spark, flatten):
    df = spark.createDataFrame([(json.dumps(r),) for r in NESTED], "j string").select(F.from_json("j", SCHEMA).alias("v")).select("v.*")
    got = tables.text_of(tables.encode_table(df, ["id"], "orders", flatten=flatten))
    assert got == document.encode({"orders": NESTED}, flatten) and document.decode(got) == {"orders": NESTED}


@pytest.mark.parametrize("bad", [{"n": None, "e": {"z": None, "w": None}}, {"n": "x", "e": None}])
def test_guards_forbid_path_columns(spark, bad):
    rows = [{"id": 1, "c": {"n": "a", "e": {"z": 1.5, "w": "y"}}}, {"id": 2, "c": bad}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", SCHEMA).alias("v")).select("v.id", "v.c")
    got = tables.text_of(tables.encode_table(df, ["id"]))
    assert ">" not in got.split("\n")[1] and document.decode(got) == rows


def test_absent_cells_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x", ["b"]), (2, None, [])], "a long, b string, _absent array<string>")
    assert tables.text_of(tables.encode_table(df, ["a"])).split("\n")[1:4] == ["## [2]{a,b}", "1|~", "2|-"]
    assert tables.text_of(tables.encode_table(df.limit(0), ["a"], "n")) == document.HEADER + "\n## n [0]\n"


def test_decode_rows(spark):
    schema = spark.createDataFrame([], "a long, s struct<x:string,y:struct<z:double>>, d date, f boolean").schema
    got = tables.decode_rows(spark.createDataFrame([("1|x|2.5|2024-01-02|true",)], "line string"), schema).first()
    assert (got["a"], got["s"]["x"], got["s"]["y"]["z"], str(got["d"]), got["f"]) == (1, "x", 2.5, "2024-01-02", True)
    assert tables.decode_rows(spark.createDataFrame([("2|-|-|~|-",)], "line string"), schema).first()["s"] is None
    for line, what in (("1|2", "row_width_mismatch"), ("x|a|1|-|-", "not a bigint"), ('1|a|1|-|"true"', "not a boolean")):
        with pytest.raises(Exception, match=what):
            tables.decode_rows(spark.createDataFrame([(line,)], "line string"), schema).collect()


def test_keyed_maps(spark):
    df = spark.createDataFrame([({"a": (1, "x"), "b": (2, None)},)], "m map<string,struct<key:long,v:string>>")
    rows = tables.keyed_rows(df, "m")
    assert rows.columns == ["_key", "key", "v"]
    got = tables.text_of(tables.encode_table(rows, ["_key"], "m", keyed=True))
    assert document.decode(got) == {"m": {"a": {"key": 1, "v": "x"}, "b": {"key": 2, "v": None}}}
    assert {k: tuple(v) for k, v in tables.rows_to_map(rows, "_key").first()["members"].items()} == {"a": (1, "x"), "b": (2, None)}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        tables.rows_to_map(rows.union(rows), "_key").collect()


def test_roots(spark, snapshots):
    import hashlib

    base, _ = snapshots
    text = "".join(sorted('R\tcustomer\t"%s"\tid\t%d\tstatus\t"%s"\ttotal\t%s\n' % (c, i, s, ("%g" % t)) for i, t, s, c in BASE))
    want = "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    assert roots.table_root(base) == want == roots.table_root(base, small=0) == roots.table_root(base.select(*reversed(base.columns)).orderBy("total"))
    assert roots.table_root(base.union(base)) != want
    assert roots.table_root(base.limit(0)) == "sha256:" + hashlib.sha256(b"").hexdigest()
    with pytest.raises(WireError):
        roots.table_root(spark.createDataFrame([([1],)], "a array<int>"))


def test_root_of_many_parts_stays_on_the_executors(spark, monkeypatch):
    def forbidden(*_, **__):
        raise AssertionError("records go to the driver")

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", forbidden)
    monkeypatch.setattr(roots, "PART", 5_000)
    monkeypatch.setattr(roots, "CHUNK", 700)
    texts = [f"R\tk\t{i * 7919 % 1000}{'é' * (i % 90)}\n" for i in range(600)] + ["R\tk\tsame\n"] * 900 + ["R" + "x" * 6_000, ""]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "r string").repartition(5)
    want = hashlib.sha256(b"".join(sorted(t.encode() for t in texts)))
    assert roots.root_of(df, small=0) == "sha256:" + want.hexdigest() == roots.root_of(df)
    want.update(b"".join(sorted(t.encode() for t in texts[:600])))
    second = spark.createDataFrame([(t,) for t in texts[:600]], "r string")
    assert roots.root_of(df, second, small=0) == "sha256:" + want.hexdigest() == roots.root_of(df, second)


def test_sha256_goes_on_from_a_state():
    data = bytes(i * i % 251 for i in range(1000))
    for n in (0, 1, 55, 56, 63, 64, 65, 119, 120, 128, 1000):
        state = sha256.State().after([data[: n // 3]]).after([data[n // 3 : n // 2], b"", data[n // 2 : n]])
        assert state.hexdigest() == hashlib.sha256(data[:n]).hexdigest()
        whole = n - n % 64
        assert sha256.compress_plain(sha256.State().words, data[:whole]) == state.words


def test_diff_and_apply(spark, snapshots):
    base, after = snapshots
    d = D.diff(base, after, "id")
    assert {(r["_op"], r["id"]) for r in d.collect()} == {("added", 1004), ("changed", 1002), ("removed", 1001)}
    b, a = roots.table_root(base), roots.table_root(after)
    assert sorted(D.verify_delta(base, d, "id", b, a).collect()) == sorted(after.collect())
    text = D.lines_text(D.delta_lines(d, "id", b, a, tool="t", tokens=(30, 200)))
    assert text == f"GCF profile=generic tool=t delta=true base_root={b} new_root={a} key=id savings=85%\n## added [1]{{@id,total,status,customer}}\n1004|75|pending|Dave\n## changed [1]{{@id,total,status,customer}}\n1002|29.99|shipped|Bob\n## removed [1]{{@id}}\n1001\n"
    head, back = D.decode_delta(lines_of(spark, text), base.schema)
    assert head["new_root"] == a and sorted(D.verify_delta(base, back, "id", b, a).collect()) == sorted(after.collect())
    full = D.lines_text(D.full_lines(base, "id", "orders"))
    assert sorted(D.decode_full(lines_of(spark, full), base.schema).collect()) == sorted(base.collect())
    with pytest.raises(WireError, match="root_mismatch"):
        D.decode_full(lines_of(spark, full.replace("Alice", "Eve")), base.schema)


def test_delta_errors(spark, snapshots):
    base, after = snapshots
    d = D.diff(base, after, "id")
    b, a = roots.table_root(base), roots.table_root(after)
    cases = [(base, d, "sha256:0", a, "base_mismatch"), (base, d, b, "sha256:0", "root_mismatch"), (after, d, a, a, "delta_invalid"), (base, d.union(d.filter("_op = 'added'")), b, a, "delta_invalid"), (base.union(base), d, roots.table_root(base.union(base)), a, "delta_invalid")]
    for x, y, r, s, code in cases:
        with pytest.raises(WireError) as e:
            D.verify_delta(x, y, "id", r, s)
        assert e.value.code == code
    for x, y in ((base.union(base), after), (base, after.drop("total")), (base.select("total", "id", "status", "customer"), after)):
        with pytest.raises(WireError, match="delta_invalid"):
            D.diff(x, y, "id")


def test_null_and_string_identities(spark):
    s = "sku string, n long"
    x, y = spark.createDataFrame([(None, 1), ("1001", 2), ("A", None)], s), spark.createDataFrame([(None, 2), ("1001", 2), ("B", None)], s)
    assert {(r["_op"], r["sku"]) for r in D.diff(x, y, "sku").collect()} == {("changed", None), ("removed", "A"), ("added", "B")}
    d = D.diff(x, y, "sku")
    wire = D.lines_text(D.delta_lines(d, "sku", "b", "n"))
    _, back = D.decode_delta(lines_of(spark, wire), x.schema)
    assert sorted(map(str, D.apply_delta(x, back, "sku").collect())) == sorted(map(str, y.collect()))


@pytest.mark.parametrize(
    "text",
    ["", "GCF profile=graph\n", "GCF profile=generic key=id\n", "GCF profile=generic delta=true key=id\n## added [2]{@id,n}\n1|2\n", "GCF profile=generic delta=true key=id\n## added [1]{@id,n}\n1\n", "GCF profile=generic delta=true key=id\n## bogus [0]{@id}\n", "GCF profile=generic delta=true key=id\n## added [01]{@id,n}\n1|2\n"],
)
def test_malformed_deltas(spark, text):
    schema = spark.createDataFrame([], "id long, n long").schema
    with pytest.raises(Exception):  # noqa: B017  of this module or, in a row, of Spark
        D.decode_delta(lines_of(spark, text), schema)[1].collect()


SYMBOL = "qualifiedName string, kind string, score double, provenance string, distance int, _pos long"
SYMBOLS = [("pkg.New", "function", 0.54, "lsp", 1, 0), ("pkg.Auth", "function", 0.78, "lsp", 0, 1), ("far", "odd", 0.5, "rwr", 5, 2), ("ext", "class", 0.125, "rwr", 2, 3), ("tie", "type", 0.54, "lsp", 1, 4)]
EDGES = [("pkg.New", "pkg.Auth", "calls", ""), ("tie", "ext", "uses", "new"), ("tie", "gone", "uses", ""), ("far", "tie", "uses", "unchanged")]


@pytest.fixture(scope="module")
def graphs(spark):
    return spark.createDataFrame(SYMBOLS, SYMBOL), spark.createDataFrame(EDGES, "source string, target string, edgeType string, status string")


def as_graph():
    names = SYMBOL.replace(",", "").split(" ")[::2]
    return Graph("ctx", 5000, 1847, "", [dict(zip(names, s, strict=True)) for s in SYMBOLS], [dict(zip(("source", "target", "edgeType", "status"), e, strict=True)) for e in EDGES])


def test_graph_text(spark, graphs):
    text = G.graph_text(G.encode_graph(*graphs, tool="ctx", tokens=1847, budget=5000))
    assert text == encode_graph(as_graph())
    assert text.split("\n")[:8] == ["GCF profile=graph tool=ctx budget=5000 tokens=1847 symbols=5 edges=3", "## targets", "@0 fn pkg.Auth 0.78 lsp", "## related", "@1 fn pkg.New 0.54 lsp", "@2 type tie 0.54 lsp", "## extended", "@3 class ext 0.12 rwr"]
    assert "## distance_5\n@4 odd far 0.50 rwr\n## edges [3]\n@0<@1 calls\n@3<@2 uses new\n@2<@4 uses\n" in text
    head, symbols, edges = G.decode_graph(lines_of(spark, text.replace("\n", "\r\n")))
    one = decode_graph(text)
    assert head == {"tool": "ctx", "tokenBudget": 5000, "tokensUsed": 1847, "packRoot": ""}
    assert [(r["qualifiedName"], r["kind"], r["score"], r["distance"]) for r in symbols.orderBy("id").collect()] == [(s["qualifiedName"], s["kind"], s["score"], s["distance"]) for s in one.symbols]
    assert {(r["source"], r["target"], r["edgeType"], r["status"]) for r in edges.collect()} == {tuple(e.values()) for e in one.edges} and len(one.edges) == 3
    assert document.decode(text) == one.as_dict() and [r["target"] for r in G.dangling_edges(graphs[1], graphs[0]).collect()] == ["gone"]


GRAPH_ERRORS = {
    "nope": "missing_header", "GCF profile=graph\n## targets\nfn x 1 y z": "invalid_symbol_id", "GCF profile=graph\n## targets\n@0 fn x": "invalid_node_line", "GCF profile=graph\n## targets\n@0 fn x one y": "invalid_score",
    "GCF profile=graph\n## edges [1]\n@0-@1 calls": "invalid_edge_syntax", "GCF profile=graph\n## edges [1]\n@0<@1 calls": "unknown_edge_reference", "GCF profile=graph\n## targets\n@0 fn x 1 y\n## edges [2]\n@0<@0 c": "count_mismatch",
}


@pytest.mark.parametrize("text", GRAPH_ERRORS)
def test_graph_errors(spark, text):
    with pytest.raises(WireError) as e:
        decode_graph(text)
    assert e.value.code == GRAPH_ERRORS[text]
    with pytest.raises(Exception, match=GRAPH_ERRORS[text]):
        for df in G.decode_graph(lines_of(spark, text))[1:]:
            df.collect()


def test_graph_delta(spark, graphs):
    symbols, edges = graphs
    later = symbols.filter("qualifiedName <> 'far'").withColumn("score", F.when(F.col("kind") == "class", 0.25).otherwise(F.col("score")))
    later_edges = edges.filter("target <> 'gone'")
    s, e = G.symbol_diff(symbols, later), G.edge_diff(edges, later_edges)
    assert {(r["_op"], r["qualifiedName"]) for r in s.collect()} == {("removed", "far"), ("removed", "ext"), ("added", "ext")}
    root = roots.graph_root(later, later_edges)
    assert root == roots.graph_root(later, later_edges, small=0)
    text = G.graph_text(G.delta_lines(s, e, "t", "b", root, (30, 200)))
    assert "savings=85%\n## removed\nclass ext\nodd far\n## added\n@0 class ext 0.25 rwr 2\n## edges_removed\ntie -> gone uses\n" in text
    _, s2, e2 = G.decode_delta(lines_of(spark, text))
    got, _ = G.verify_graph_delta(symbols, edges, s2, e2, root)
    assert {(r["qualifiedName"], r["score"]) for r in got.collect()} == {(r["qualifiedName"], r["score"]) for r in later.collect()}
    for a, b, new, code in ((symbols, edges, "x", "root_mismatch"), (later, edges, root, "delta_invalid")):
        with pytest.raises(WireError) as err:
            G.verify_graph_delta(a, b, s2, e2, new)
        assert err.value.code == code
    with pytest.raises(Exception, match="malformed_delta"):
        G.decode_delta(lines_of(spark, "GCF profile=graph delta=true\n## odd\nx"))
    with pytest.raises(Exception, match="malformed_delta"):
        G.decode_delta(lines_of(spark, "GCF profile=graph delta=true\n## removed\nx"))[1].collect()


def test_sessions(spark):
    calls = spark.createDataFrame([("s", 1, 0, "a.Foo", "function", 0.9, "x", 0), ("s", 2, 0, "a.Bar", "function", 0.1, "x", 0), ("s", 2, 1, "a.Foo", "function", 0.9, "x", 1), ("t", 1, 0, "a.Bar", "function", 0.1, "x", 0)], "session string, call long, _pos long, qualifiedName string, kind string, score double, provenance string, distance int")
    edges = spark.createDataFrame([("s", 2, 0, "a.Foo", "a.Bar", "calls", ""), ("s", 2, 1, "a.Foo", "zzz", "calls", "")], "session string, call long, _pos long, source string, target string, edgeType string, status string")
    lines = session.session_lines(calls, edges, "t").orderBy("session", "call", "part", "a", "b").collect()
    text = {(r["session"], r["call"]): [] for r in lines}
    for r in lines:
        text[r["session"], r["call"]].append(r["line"])
    assert text["s", 1] == ["GCF profile=graph tool=t symbols=1 session=true", "## targets", "@0 fn a.Foo 0.90 x"]
    assert text["s", 2] == ["GCF profile=graph tool=t symbols=2 edges=2 session=true", "## targets", "@1 fn a.Bar 0.10 x", "## related", "@0  # previously transmitted", "## edges [2]", "@1<@0 calls"]
    assert [r["qualifiedName"] for r in session.resolve_references(session.session_lines(calls), session.session_ids(calls)).collect()] == ["a.Foo"]


@pytest.mark.parametrize("adaptive, wide", [(True, True), (True, False), (False, True)])
def test_row_index_of_many_rows(spark, adaptive, wide):
    """More rows than a range partitioning samples, in more than one partition."""
    n = 1_500_000
    df = spark.range(0, n, numPartitions=9).select((F.col("id") * 7919 % 1_500_007).alias("k"), *([F.sha2(F.col("id").cast("string"), 256).alias("w"), F.lit("x" * 40).alias("v")] if wide else []))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = with_row_index(df, F.desc("k"), index="i")
        low, high, count, distinct = got.agg(F.min("i"), F.max("i"), F.count("i"), F.count_distinct("i")).first()
        assert (low, high, count, distinct) == (0, n - 1, n, n)
        follows = got.select((F.col("i") + 1).alias("i"), F.col("k").alias("above")).join(got.select("i", "k"), "i")
        assert follows.filter("above <= k").count() == 0
        assert with_row_index(df.limit(0), "k").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_carry_last(spark):
    df = spark.range(0, 1000, numPartitions=5).select((F.col("id") * 37 % 1000).alias("pos"), F.lit(1).alias("section"))
    got = carry_last(df, {"a": F.when(F.col("pos") % 90 == 5, F.col("pos")), "b": F.when(F.col("pos") == 400, F.lit("x"))}, bucket=16)
    for r in got.collect():
        assert r["a"] == ((r["pos"] - 5) // 90 * 90 + 5 if r["pos"] >= 5 else None) and r["b"] == ("x" if r["pos"] >= 400 else None) and r["section"] == 1


def test_graph_sections_that_alternate(spark):
    text = "GCF profile=graph tool=t\n" + "".join(f"## {'targets' if i % 2 else 'distance_7'}\n@{i} fn s{i} 0.50 lsp\n" for i in range(300)) + "## edges [?]\n@0<@1 calls\n"
    _, symbols, edges = G.decode_graph(lines_of(spark, text))
    assert {r["id"]: r["distance"] for r in symbols.collect()} == {i: 0 if i % 2 else 7 for i in range(300)} and edges.count() == 1


def test_delta_rows_are_scalars(spark):
    head = "GCF profile=generic delta=true key=id\n## added [1]{@id,n}\n"
    schema = spark.createDataFrame([], "id long, n string").schema
    for cell in ("~", "^", "^{a,b}"):
        with pytest.raises(Exception, match="delta_invalid"):
            D.decode_delta(lines_of(spark, f"{head}1|{cell}\n"), schema)[1].collect()
    again = D.decode_delta(lines_of(spark, "GCF profile=generic delta=true key=id\n## added [1]{@id,n}\n1|a\n## removed [1]{@id}\n4\n## added [1]{@id,n}\n2|b\n"), schema)[1]
    assert sorted((r["_op"], r["id"], r["n"]) for r in again.collect()) == [("added", 1, "a"), ("added", 2, "b"), ("removed", 4, None)]


def test_keyed_tables_are_maps(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    assert document.decode(tables.text_of(tables.encode_table(df, ["k"], "m", keyed=True))) == {"m": {"a": {"n": 1}, "b": {"n": 2}}}
    for bad, code in ((df.limit(1), "invalid_count"), (df.select("k"), "invalid_count"), (df.union(df), "duplicate_key")):
        with pytest.raises(WireError, match=code):
            tables.encode_table(bad, ["k"], keyed=True)


def test_graph_streams_are_those_of_the_writer(spark):
    from packframe.streaming.encoders import GraphStream

    rows = [(f"s{i}", "function" if i % 3 else "odd", i / 7, "lsp", (0, 0, 1, 5, 1)[i % 5], i) for i in range(40)]
    edges = [(f"s{i}", f"s{(i * 7) % 45}", "calls", ("", "new", "unchanged")[i % 3], i) for i in range(40)]
    names = ("qualifiedName", "kind", "score", "provenance", "distance", "_pos")
    for labeled in (False, True):
        out = []
        stream = GraphStream(out.append, "t", 5, 6, "r", labeled=labeled)
        for r in rows:
            stream.symbol(dict(zip(names, r, strict=True)))
        for e in edges:
            stream.edge(dict(zip(("source", "target", "edgeType", "status"), e, strict=False)))
        stream.close()
        got = G.stream_lines(spark.createDataFrame(rows, SYMBOL), spark.createDataFrame(edges, "source string, target string, edgeType string, status string, _pos long"), "t", 6, 5, "r", labeled)
        assert G.graph_text(got) == "".join(out)
    none = G.stream_lines(spark.createDataFrame([], SYMBOL), spark.createDataFrame([], "source string, target string, edgeType string, status string, _pos long"), "t")
    assert G.graph_text(none) == "GCF profile=graph tool=t\n##! summary symbols=0 edges=0 counts=0\n"


@pytest.mark.parametrize("seed", range(4))
def test_random_deltas(spark, seed):
    """Diff, wire, decoded wire, verification and application of random tables under one another."""
    import random

    rng = random.Random(seed)
    texts = ["", "-", "~", "^", "a|b", '"q"', "true", "12", "é\U0001f600", "x\ty\n", "# c", "@1 x", None]
    schema = "id string, n long, d double, b boolean, t string"

    def row(k):
        return (k, rng.choice([None, 0, -5, 1 << 62]), rng.choice([None, 0.5, -1e-9, 1e300, float(rng.randint(0, 9))]), rng.choice([None, True, False]), rng.choice(texts))

    keys = [None, *{rng.choice([t for t in texts if t is not None]) + str(rng.randrange(60)) for _ in range(120)}]
    base = {k: row(k) for k in keys if rng.random() < 0.7}
    after = {k: (base[k] if k in base and rng.random() < 0.6 else row(k)) for k in keys if rng.random() < 0.7}
    b, a = (spark.createDataFrame([*x.values()], schema) for x in (base, after))
    changes = D.diff(b, a, "id")
    roots_ = roots.table_root(b), roots.table_root(a)
    _, back = D.decode_delta(lines_of(spark, D.lines_text(D.delta_lines(changes, "id", *roots_))), b.schema)
    got = D.verify_delta(b, back, "id", *roots_)
    assert sorted(map(str, got.collect())) == sorted(map(str, a.collect()))
    assert sorted(map(str, D.decode_full(lines_of(spark, D.lines_text(D.full_lines(a, "id"))), a.schema).collect())) == sorted(map(str, a.collect()))


def test_columns_without_a_type(spark):
    df = spark.range(3).withColumn("odd name", F.lit(None))
    got = with_row_index(df, F.desc("id"), index="i")
    assert got.columns == ["id", "odd name", "i"] and sorted(map(tuple, got.collect())) == [(0, None, 2), (1, None, 1), (2, None, 0)]
    assert document.decode(tables.text_of(tables.encode_table(df, ["id"]))) == [{"id": i, "odd name": None} for i in range(3)]
