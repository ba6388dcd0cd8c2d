"""Call sessions: symbols that a session has seen are referred to by a stable id.

calls: session, call, _pos and the columns of symbols.  Ids count the first occurrences of a session, in the order of
(call, _pos).  All windows are by session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packframe.operators.graph import edge_line, section_name, symbol_line
from packframe.plans.document import MAGIC

BARE = "  # previously transmitted"


def session_ids(calls: DataFrame) -> DataFrame:
    """session, qualifiedName, id, first_call of every name that a session has seen."""
    firsts = calls.groupBy("session", "qualifiedName").agg(F.min(F.struct("call", "_pos")).alias("f"))
    order = Window.partitionBy("session").orderBy("f", "qualifiedName")
    return firsts.select("session", "qualifiedName", (F.row_number().over(order) - 1).cast("long").alias("id"), F.col("f.call").alias("first_call"))


def dedup(calls: DataFrame) -> DataFrame:
    """calls with id and known: whether an earlier call of the session had the name."""
    return calls.join(session_ids(calls), ["session", "qualifiedName"]).withColumn("known", F.col("first_call") < F.col("call")).drop("first_call")


def session_lines(calls: DataFrame, edges: DataFrame | None = None, tool: str = "") -> DataFrame:
    """session, call, part, a, b, line: the wire of each call.  edges: session, call, _pos, source, target, edgeType, status."""
    seen = dedup(calls)
    keys = ["session", "call"]
    order = Window.partitionBy(*keys).orderBy("distance", F.desc("score"), "_pos")
    ranked = seen.withColumn("a", F.row_number().over(order).cast("long"))
    full = symbol_line()
    body = ranked.select(*keys, F.lit(1).alias("part"), "a", F.lit(1).alias("b"), F.when(F.col("known"), F.concat(F.lit("@"), F.col("id").cast("string"), F.lit(BARE))).otherwise(full).alias("line"))
    heads = ranked.groupBy(*keys, "distance").agg(F.min("a").alias("a")).select(*keys, F.lit(1).alias("part"), "a", F.lit(0).alias("b"), F.concat(F.lit("## "), section_name(F.col("distance"))).alias("line"))
    counts = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if edges is not None:
        counts = counts.join(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys, "left")
    m = F.coalesce("m", F.lit(0)) if edges is not None else F.lit(0)
    top = F.concat(F.lit(f"{MAGIC} profile=graph tool={tool} symbols="), F.col("n").cast("string"), F.when(m > 0, F.concat(F.lit(" edges="), m.cast("string"))).otherwise(""), F.lit(" session=true"))
    zero = F.lit(0).cast("long")
    out = counts.select(*keys, F.lit(0).alias("part"), zero.alias("a"), F.lit(0).alias("b"), top.alias("line")).unionByName(heads).unionByName(body)
    if edges is None:
        return out
    ids = seen.select(*keys, "qualifiedName", "id").distinct()
    s, t = (ids.select(*keys, F.col("qualifiedName").alias(n), F.col("id").alias(f"{n}_id")) for n in ("source", "target"))
    links = edges.join(s, [*keys, "source"]).join(t, [*keys, "target"])
    lines = links.select(*keys, F.lit(3).alias("part"), F.col("_pos").cast("long").alias("a"), F.lit(0).alias("b"), edge_line(F.col("source_id"), F.col("target_id")).alias("line"))
    return out.unionByName(counts.filter(m > 0).select(*keys, F.lit(2).alias("part"), zero.alias("a"), F.lit(0).alias("b"), F.concat(F.lit("## edges ["), m.cast("string"), F.lit("]")).alias("line"))).unionByName(lines)


def resolve_references(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Names of the bare references in session lines, by session_ids()."""
    ref = F.regexp_extract("line", r"\A@([0-9]+)  # previously transmitted\z", 1).try_cast("long")
    bare = lines.select("session", "call", ref.alias("id")).filter("id is not null")
    return bare.join(ids.select("session", "id", "qualifiedName"), ["session", "id"])
