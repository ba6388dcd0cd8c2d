"""Streams, sources, sinks and the command line."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from packframe.errors import WireError
from packframe.operators import delta as D
from packframe.operators import roots
from packframe.plans import document
from packframe.plans.graph_text import decode_graph
from packframe.sources import wire_source
from packframe.streaming.encoders import GraphStream, TableStream
from packframe.streaming.reanchor import Policy, ReanchorSession
from packframe.streaming.sessions import dedup_stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def symbol(name, distance=0, score=0.5):
    return {"qualifiedName": name, "kind": "function", "score": score, "provenance": "x", "distance": distance}


@pytest.mark.parametrize("labeled", [True, False])
def test_graph_stream(labeled):
    out = []
    s = GraphStream(out.append, "t", budget=5, labeled=labeled)
    for name, d in (("a", 0), ("b", 1), ("c", 0)):
        s.symbol(symbol(name, d))
    s.edge({"source": "a", "target": "b", "edgeType": "calls", "status": "new"})
    s.edge({"source": "a", "target": "z", "edgeType": "calls", "status": ""})
    s.bare("d", 7, number=40)
    s.close()
    text = "".join(out)
    counts = "targets:2,related:1,distance_7:1,edges:1" if labeled else "2,1,1,1"
    assert text.endswith(f"## edges [?]\n@1<@0 calls new\n## distance_7\n@40  # previously transmitted\n##! summary symbols=4 edges=1 counts={counts}\n")
    g = decode_graph(text.replace("## distance_7\n@40  # previously transmitted\n", ""))
    assert [x["distance"] for x in g.symbols] == [0, 1, 0] and len(g.edges) == 1


def test_table_stream():
    out = []
    s = TableStream(out.append)
    s.member("a b", "true")
    s.inline_array("n", [1, "x,y", None])
    s.begin("rows", ["k", "a,b"])
    s.row([1, "-"])
    s.row([None, "|"])
    s.begin("m", ["key", "v"], keyed=True)
    s.row(["x", 1.0])
    s.row(["y", True])
    s.close()
    assert document.decode("".join(out)) == {"a b": "true", "n": [1, "x,y", None], "rows": [{"k": 1, "a,b": "-"}, {"k": None, "a,b": "|"}], "m": {"x": {"v": 1}, "y": {"v": True}}}
    assert out[-1] == "##! summary counts=2,2\n"
    t = TableStream(out.append)
    t.row([1])  # outside a table
    for call in (lambda: t.begin("x", ["a>b"]), lambda: (t.begin("x", ["a"]), t.row([1, 2])), lambda: t.member("late", 1)):
        with pytest.raises(WireError):
            call()


ORDERS = "id long, v double"


def turns(spark):
    yield from (spark.createDataFrame([(i, 10.0 + (i == k)) for i in range(90)] + [(100 + k, 1.0)], ORDERS) for k in range(5))


@pytest.mark.parametrize("policy", [Policy.fixed(3), Policy.size_guard()])
def test_reanchor(spark, tmp_path, policy):
    snapshots = list(turns(spark))
    held = ReanchorSession(spark, f"file://{tmp_path}", "id", policy=policy)
    held.start(snapshots[0])
    state, flags = snapshots[0], []
    for turn, after in enumerate(snapshots[1:], 1):
        lines, is_full = held.next(after, turn)
        if turn == 2:  # a replay
            again, again_full = held.next(after, turn)
            assert is_full == again_full and D.lines_text(lines) == D.lines_text(again)
        wire = spark.createDataFrame(list(enumerate(D.lines_text(lines).split("\n"))), "pos long, line string")
        if is_full:
            state = D.decode_full(wire, after.schema)
        else:
            head, d = D.decode_delta(wire, after.schema)
            state = D.apply_delta(state, d, "id")
            assert head["new_root"] == roots.table_root(state)
        state = spark.createDataFrame(state.collect(), ORDERS)
        assert roots.table_root(state) == roots.table_root(after)
        flags.append(is_full)
    if policy.every == 3:
        assert flags == [False, False, True, False]
    else:
        assert any(flags) and not all(flags)
    assert Policy.fixed(0).every == 15
    assert held.next(snapshots[0].select("id"), 5)[1]  # other columns: in full


def test_reanchor_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    for i, s in enumerate(list(turns(spark))[:3]):
        s.coalesce(1).write.parquet(f"{src}/{i}")
    held = ReanchorSession(spark, f"file://{tmp_path}/held", "id", policy=Policy.fixed(2))
    stream = spark.readStream.schema(ORDERS).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    stream.writeStream.foreachBatch(held.write_batch(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    heads = [next(line for f in sorted((tmp_path / f"out/turn-{i:08d}").glob("part-*")) for line in f.read_text().splitlines()) for i in range(3)]
    assert ["delta=true" in h for h in heads] == [False, True, False]


def test_session_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session string, call long, _pos long, qualifiedName string"
    for i, rows in enumerate(([("s", 1, 0, "a"), ("s", 1, 1, "b")], [("s", 2, 0, "b"), ("s", 2, 1, "c"), ("t", 1, 0, "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    dedup_stream(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r["session"], r["call"], r["qualifiedName"], r["id"], r["known"]) for r in spark.table("seen").collect()}
    assert got == {("s", 1, "a", 0, False), ("s", 1, "b", 1, False), ("s", 2, "b", 1, True), ("s", 2, "c", 2, False), ("t", 1, "c", 0, False)}


def test_source_and_sink(spark, tmp_path):
    wire_source.register(spark)
    df = spark.createDataFrame([(1, "a|b", 1.5, None), (2, None, 2.0, True), (3, "true", 0.0, False)], "id long, s string, d double, b boolean")
    path = f"{tmp_path}/t"
    df.repartition(2).write.format("packframe").option("name", "t").mode("append").save(path)
    assert sorted(map(str, spark.read.format("packframe").schema(df.schema).load(path).collect())) == sorted(map(str, df.collect()))
    inferred = spark.read.format("packframe").load(path)
    assert inferred.columns == df.columns and inferred.count() == 3
    assert sorted(map(str, wire_source.read_table(spark, path, df.schema).collect())) == sorted(map(str, df.collect()))
    df.limit(1).write.format("packframe").mode("overwrite").save(path)
    assert spark.read.format("packframe").schema(df.schema).load(path).count() == 1
    (tmp_path / "bad.wire").write_text("nonsense")
    bad = spark.read.format("packframe").schema("id long, _error_code string, _corrupt_line string").option("mode", "PERMISSIVE").load(f"{tmp_path}/bad.wire").collect()
    assert [(r["id"], r["_error_code"]) for r in bad] == [(None, "missing_header")] and bad[0]["_corrupt_line"].endswith("bad.wire")
    with pytest.raises(Exception, match="missing_header"):
        spark.read.format("packframe").schema(df.schema).load(f"{tmp_path}/bad.wire").collect()


def test_stream_sink(spark, tmp_path):
    wire_source.register(spark)
    spark.range(10).withColumn("s", F.lit("x")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, s string").parquet(f"{tmp_path}/in")
    stream.writeStream.format("packframe").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.format("packframe").schema("id long, s string").load(f"{tmp_path}/out").count() == 10


def test_stream_sink_replays(tmp_path):
    """A replayed batch with fewer parts leaves nothing of the former one."""
    from pyspark.sql.types import StructType

    sink = wire_source._StreamWriter(StructType().add("id", "long"), {"path": f"file://{tmp_path}/o"})
    sink.commit([sink.write(iter([(1,)])), sink.write(iter([(2,)]))], 0)
    sink.commit([sink.write(iter([(3,)]))], 0)
    dropped = sink.write(iter([(4,)]))
    sink.abort([dropped], 1)
    assert [wire_source._rows({"path": f"{tmp_path}/o"}, f) for f in wire_source._files({"path": f"{tmp_path}/o"})] == [[{"id": 3}]]


def test_schemas_of_all_files_are_merged(spark, tmp_path):
    wire_source.register(spark)
    (tmp_path / "a.wire").write_text(document.encode({"rows": [{"x": 1, "y": 2}]}))
    (tmp_path / "b.wire").write_text(document.encode({"rows": [{"x": 1.5, "z": "t"}]}))
    got = spark.read.format("packframe").load(str(tmp_path))
    assert got.schema.simpleString() == "struct<x:double,y:bigint,z:string>" and sorted(map(tuple, got.collect())) == [(1.0, 2, None), (1.5, None, "t")]
    with pytest.raises(Exception, match="invalid_field_declaration"):
        spark.read.format("packframe").schema("x double").load(str(tmp_path)).collect()


def test_tables_written_and_read_by_spark(spark, tmp_path):
    df = spark.range(0, 1000, numPartitions=3).select("id", F.concat(F.lit("a|b"), F.col("id").cast("string")).alias("s"), (F.col("id") / 8).alias("d"))
    path = f"{tmp_path}/t"
    wire_source.write_table(df, path, "my table")
    assert sorted(map(tuple, wire_source.read_table(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))
    files = sorted((tmp_path / "t").glob("part-*"))
    assert len(files) == 3 and all(document.decode(f.read_text())["my table"] for f in files)
    with pytest.raises(WireError, match="invalid_field_declaration"):
        wire_source.read_table(spark, path, spark.range(1).schema)
    whole = files[0].read_text()
    for text, code in ((whole.replace("\n10|", "\n", 1).replace('"a|b10"|1.25\n', "", 1), "count_mismatch"), (whole[: whole.index("##!")], "count_mismatch"), (whole.partition("\n")[2], "missing_header"), (whole.replace("[?]", "[01]"), "invalid_count"), (whole.replace("[?]", "[5]"), "count_mismatch")):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad/one").write_text(text)
        with pytest.raises(WireError, match=code):
            wire_source.read_table(spark, f"{tmp_path}/bad", df.schema)
    (tmp_path / "bad/one").write_text("GCF profile=generic\n## rows [4]{id,s,d}\n1|x|2\n1|x\ny|x|2\n2|-|-\n")
    got = wire_source.read_table(spark, f"{tmp_path}/bad", df.schema, mode="PERMISSIVE").collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, [(1, "x", 2.0, None, None), (None, None, None, "row_width_mismatch", "1|x"), (None, None, None, "invalid_line", "y|x|2"), (2, None, None, None, None)]))
    wire_source.write_table(df.limit(0), f"{tmp_path}/none")
    assert wire_source.read_table(spark, f"{tmp_path}/none", df.schema).count() == 0


def test_table_stream(spark, tmp_path):
    spark.range(10).withColumn("s", F.lit("x")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, s string").parquet(f"{tmp_path}/in")
    wire_source.write_stream(stream, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert wire_source.read_table(spark, f"{tmp_path}/out/*", spark.createDataFrame([], "id long, s string").schema).count() == 10


def command(name, text):
    return subprocess.run([sys.executable, "-m", "packframe", name], input=text.encode(), capture_output=True, cwd=ROOT)


def test_command_line():
    value = {"b": [{"x": 1, "c": {"n": "é"}}], "a": None}
    wire = command("encode-generic", json.dumps(value)).stdout.decode()
    assert wire == document.encode(value) and json.loads(command("decode-generic", wire).stdout) == value
    graph = command("encode", json.dumps({"tool": "t", "budget": 9, "symbols": [symbol("a")], "edges": []})).stdout.decode()
    assert graph == "GCF profile=graph tool=t budget=9 symbols=1\n## targets\n@0 fn a 0.50 x\n"
    assert json.loads(command("decode", graph).stdout)["symbols"][0]["qualifiedName"] == "a"
    assert command("version", "").stdout.startswith(b"packframe ") and command("odd", "").returncode == 1 and command("help", "").returncode == 0
    bad = command("decode-generic", "x")
    assert bad.returncode == 1 and b"missing_header" in bad.stderr
