"""Graphs: symbols(qualifiedName, kind, score, provenance, distance[, _pos]) and edges(source, target, edgeType, status).

Symbols are ordered by distance, then by descending score, then by input place (`_pos`), and get dense ids in that
order.  Values are never quoted in this profile: names and provenances must be non-empty and without blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packframe.errors import WireError
from packframe.functions import abbreviate_kind, expand_kind, score_text
from packframe.operators.ordering import carry_last, with_row_index
from packframe.operators.roots import graph_root
from packframe.plans.document import MAGIC
from packframe.streaming.storage import stored

#: Fixed values of the wire format: sections of the first distances.
SECTIONS = ("targets", "related", "extended")


def section_name(distance: Column) -> Column:
    """The section of a distance; a negative one fails."""
    named = F.when(distance < 0, F.raise_error(F.lit("invalid_node_line: negative distance")).cast("string"))
    for i, name in enumerate(SECTIONS):
        named = named.when(distance == i, name)
    return named.otherwise(F.concat(F.lit("distance_"), distance.cast("string")))


def symbol_ids(symbols: DataFrame) -> DataFrame:
    """Adds `id`: the place in (distance, descending score, `_pos`)."""
    pos = ["_pos"] if "_pos" in symbols.columns else ["qualifiedName", "kind"]
    return with_row_index(symbols, "distance", F.desc("score"), *pos, index="id")


def resolve_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges with source_id and target_id; those with an unknown end are dropped.  Of several symbols of a name the
    last one counts."""
    last = ids.groupBy("qualifiedName").agg(F.max("id").alias("id"))
    s, t = (last.select(F.col("qualifiedName").alias(n), F.col("id").alias(f"{n}_id")) for n in ("source", "target"))
    return edges.join(s, "source").join(t, "target")


def dangling_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The edges with an end that is no symbol."""
    names = symbols.select("qualifiedName").distinct()
    s, t = (names.select(F.col("qualifiedName").alias(n), F.lit(True).alias(f"{n}_known")) for n in ("source", "target"))
    return edges.join(s, "source", "left").join(t, "target", "left").filter("source_known is null or target_known is null").select(*edges.columns)


def symbol_line(number: Column | str = "id") -> Column:
    return F.concat_ws(" ", F.concat(F.lit("@"), F.col(number).cast("string") if isinstance(number, str) else number), abbreviate_kind(F.col("kind")), "qualifiedName", score_text(F.col("score").cast("double")), "provenance")


def edge_line(source: Column, target: Column) -> Column:
    status = F.col("status")
    return F.concat_ws(" ", F.concat(F.lit("@"), target.cast("string"), F.lit("<@"), source.cast("string")), "edgeType", F.when((status != "") & (status != "unchanged"), status))


def _head(tool: str, budget: int, tokens: int, n_symbols: int, n_edges: int, root: str, session: bool = False) -> str:
    return (
        f"{MAGIC} profile=graph tool={tool}" + f" budget={budget}" * (budget > 0) + f" tokens={tokens}" * (tokens > 0) + f" symbols={n_symbols}" + f" edges={n_edges}" * (n_edges > 0)
        + " session=true" * session + f" pack_root={root}" * bool(root)
    )



def _fixed(df: DataFrame, lines: list[tuple[int, int, str]]) -> DataFrame:
    made = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(a).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit("").alias("c"), F.lit(t).alias("line")) for p, a, t in lines))
    return df.sparkSession.range(1).select(F.inline(made))


def encode_graph(symbols: DataFrame, edges: DataFrame, tool: str = "", tokens: int = 0, budget: int = 0, root: str = "") -> DataFrame:
    """Lines (part, a, b, c, line) of a graph, in that order."""
    ids = symbol_ids(symbols)
    resolved = resolve_edges(edges, ids)
    n_symbols, n_valid, any_edge = symbols.count(), resolved.count(), not edges.isEmpty()
    heads = ids.groupBy("distance").agg(F.min("id").alias("a")).select(F.lit(1).alias("part"), "a", F.lit(-1).cast("long").alias("b"), F.lit("").alias("c"), F.concat(F.lit("## "), section_name(F.col("distance"))).alias("line"))
    body = ids.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("").alias("c"), symbol_line().alias("line"))
    links = resolved.select(F.lit(3).alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("edgeType").alias("c"), edge_line(F.col("source_id"), F.col("target_id")).alias("line"))
    top = _fixed(symbols, [(0, 0, _head(tool, budget, tokens, n_symbols, n_valid, root))] + [(2, 0, f"## edges [{n_valid}]")] * any_edge)
    return top.unionByName(heads).unionByName(body).unionByName(links)


def graph_text(lines: DataFrame) -> str:
    """The wire text, for what fits on the driver."""
    return "".join(r["line"] + "\n" for r in lines.orderBy("part", "a", "b", "c").toLocalIterator())


def decode_graph(lines: DataFrame) -> tuple[dict[str, object], DataFrame, DataFrame]:
    """Header, symbols (with id and _pos) and edges of lines(pos, line), line-parallel.

    One row comes to the driver; sections are carried forward to their lines, however many there are; symbol and edge
    lines are parsed where they are.
    Malformed lines fail with their code when the result is used."""
    clean = stored(lines.select("pos", F.regexp_replace("line", "\r$", "").alias("line")).filter("line <> ''"), "lines")
    header, name = F.col("line").startswith("## "), F.substring_index(F.substr("line", F.lit(4)), " [", 1)
    counted = F.regexp_extract("line", r"\A## edges \[([^\]]*)", 1)
    top = clean.agg(F.min_by("line", "pos").alias("line"), F.min("pos").alias("pos"), F.max_by(counted, F.when(header & (name == "edges") & ~counted.isin("", "?"), F.col("pos"))).alias("edges")).first()
    if top["pos"] is None or not top["line"].startswith(MAGIC + " "):
        raise WireError("missing_header")
    pairs = dict(p.partition("=")[::2] for p in top["line"].split(" ")[1:] if "=" in p)
    number = lambda t: int(t) if t.lstrip("+-").isdigit() else 0
    head = {"tool": pairs.get("tool", ""), "tokenBudget": number(pairs.get("budget", "")), "tokensUsed": number(pairs.get("tokens", "")), "packRoot": pairs.get("pack_root", "")}
    declared = None
    if top["edges"] is not None:
        if not top["edges"].lstrip("-").isdigit():
            raise WireError("count_mismatch", top["edges"])
        declared = int(top["edges"])
    at = F.regexp_extract(name, r"\Adistance_([0-9]+)\z", 1).try_cast("int")
    for i, section in enumerate(SECTIONS):
        at = F.when(name == section, i).otherwise(at)
    under = carry_last(clean, {"e": F.when(header, name == "edges"), "distance": F.when(header, at)})
    data = (F.col("pos") > top["pos"]) & ~header & ~F.col("line").startswith("##! ") & ~F.col("line").startswith("# ")
    bodies = stored(under.filter(data).select("pos", "line", F.coalesce("e", F.lit(False)).alias("e"), F.coalesce("distance", F.lit(0)).alias("distance")), "lines")
    parts = F.filter(F.split("line", " "), lambda x: x != "")
    fail = lambda code, kind: F.raise_error(F.concat(F.lit(code + ": "), F.col("line"))).cast(kind)
    # lines of the other kind are nulled as well: the optimizer may compute a column before a filter
    s, e = (bodies.select("pos", F.when(F.col("e") == w, F.col("line")).alias("line"), "distance").filter("line is not null").withColumn("p", parts) for w in (False, True))
    wide = F.size("p") >= 5
    ident, value = F.regexp_extract("line", r"\A@(-?[0-9]+) ", 1).try_cast("long"), F.try_element_at("p", F.lit(4)).try_cast("double")
    symbols = s.select(
        F.col("pos").alias("_pos"),
        F.when(F.col("line").isNull(), None).when(~F.col("line").startswith("@"), fail("invalid_symbol_id", "long")).when(~wide, fail("invalid_node_line", "long")).when(ident.isNull(), fail("invalid_symbol_id", "long")).otherwise(ident).alias("id"),
        F.try_element_at("p", F.lit(3)).alias("qualifiedName"),
        expand_kind(F.try_element_at("p", F.lit(2))).alias("kind"),
        F.when(wide & value.isNull(), fail("invalid_score", "double")).otherwise(value).alias("score"),
        F.try_element_at("p", F.lit(5)).alias("provenance"),
        "distance",
    )
    if declared is not None and (n := e.count()) != declared:
        raise WireError("count_mismatch", f"{declared} edges declared, {n} found")
    ref = r"\A@(-?[0-9]+)<@(-?[0-9]+)\z"
    first = F.try_element_at("p", F.lit(1))
    t, f = (F.when(F.col("line").isNull(), None).when(first.rlike(ref) & (F.size("p") >= 2), F.regexp_extract(first, ref, i).try_cast("long")).otherwise(fail("invalid_edge_syntax", "long")) for i in (1, 2))
    refs = e.select("pos", "line", t.alias("t"), f.alias("f"), F.try_element_at("p", F.lit(2)).alias("edgeType"), F.coalesce(F.try_element_at("p", F.lit(3)), F.lit("")).alias("status"))
    last = symbols.groupBy("id").agg(F.max_by("qualifiedName", "_pos").alias("n"))
    joined = refs.join(last.select(F.col("id").alias("f"), F.col("n").alias("source")), "f", "left").join(last.select(F.col("id").alias("t"), F.col("n").alias("target")), "t", "left")
    # the message names the reference, so that a malformed one fails first
    known = lambda c, ref: F.when(F.col("line").isNotNull() & F.col(c).isNull(), F.raise_error(F.concat(F.lit("unknown_edge_reference: @"), F.coalesce(F.col(ref).cast("string"), F.lit("")), F.lit(" in "), F.col("line"))).cast("string")).otherwise(F.col(c)).alias(c)
    return head, symbols, joined.select(F.col("pos").alias("_pos"), known("source", "f"), known("target", "t"), "edgeType", "status")


_SYMBOL, _EDGE = ("kind", "qualifiedName"), ("source", "target", "edgeType")


def graph_diff(base: DataFrame, after: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """_op (removed, added) of symbols or edges by identity; a change of other columns is both."""
    rest = [c for c in after.columns if c not in identity and not c.startswith("_")]
    a, b = (x.select(*identity, F.struct(*(rest or identity)).alias(n)) for x, n in ((base, "_a"), (after, "_b")))
    both = a.join(b, list(identity), "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    sides = F.array_compact(F.array(F.when(F.col("_a").isNotNull(), F.struct(F.lit("removed").alias("_op"), F.col("_a").alias("_v"))), F.when(F.col("_b").isNotNull(), F.struct(F.lit("added").alias("_op"), F.col("_b").alias("_v")))))
    return both.select(*identity, F.inline(sides)).select("_op", *identity, *(F.col("_v")[c].alias(c) for c in rest))


def symbol_diff(base: DataFrame, after: DataFrame) -> DataFrame:
    return graph_diff(base, after, _SYMBOL)


def edge_diff(base: DataFrame, after: DataFrame) -> DataFrame:
    return graph_diff(base.select("source", "target", "edgeType"), after.select("source", "target", "edgeType"), _EDGE)


def delta_lines(symbols: DataFrame, edges: DataFrame, tool: str = "", base_root: str = "", new_root: str = "", tokens: tuple[int, int] = (0, 0)) -> DataFrame:
    """Lines (part, a, b, c, line) of a graph delta: symbols(_op, ...) and edges(_op, ...)."""
    saved = 100.0 * (1.0 - tokens[0] / tokens[1]) if tokens[1] > 0 else 0.0
    tops = [(0, 0, f"{MAGIC} profile=graph tool={tool} delta=true base_root={base_root} new_root={new_root} tokens={tokens[0]} savings={saved:.0f}%")]
    there = {(n, r["_op"]) for n, x in (("s", symbols), ("e", edges)) for r in x.select("_op").distinct().collect()}  # two values each
    for part, who, op, name in ((1, "s", "removed", "removed"), (3, "s", "added", "added"), (5, "e", "removed", "edges_removed"), (7, "e", "added", "edges_added")):
        if (who, op) in there:
            tops.append((part, 0, f"## {name}"))
    blank = F.lit(0).cast("long")
    kind = abbreviate_kind(F.col("kind"))
    removed = symbols.filter("_op = 'removed'").select(F.lit(2).alias("part"), blank.alias("a"), blank.alias("b"), F.concat("kind", F.lit(" "), "qualifiedName").alias("c"), F.concat_ws(" ", kind, "qualifiedName").alias("line"))
    placed = with_row_index(symbols.filter("_op = 'added'"), "kind", "qualifiedName", index="id")
    added = placed.select(F.lit(4).alias("part"), F.col("id").alias("a"), blank.alias("b"), F.lit("").alias("c"), F.concat_ws(" ", symbol_line(), F.col("distance").cast("string")).alias("line"))
    link = F.concat("source", F.lit(" -> "), "target", F.lit(" "), "edgeType")
    links = edges.select(F.when(F.col("_op") == "removed", 6).otherwise(8).alias("part"), blank.alias("a"), blank.alias("b"), link.alias("c"), link.alias("line"))
    return _fixed(symbols, tops).unionByName(removed).unionByName(added).unionByName(links)


def decode_delta(lines: DataFrame) -> tuple[dict[str, str], DataFrame, DataFrame]:
    """Header, symbols(_op, ...) and edges(_op, ...) of a graph delta's lines(pos, line)."""
    clean = stored(lines.select("pos", F.regexp_replace("line", "\r$", "").alias("line")).filter("line <> ''"), "lines")
    header, name = F.col("line").startswith("## "), F.trim(F.substr("line", F.lit(4)))
    magic = F.col("line").startswith(MAGIC + " ")
    known = name.isin("removed", "added", "edges_removed", "edges_added")
    top = clean.agg(F.min_by("line", F.when(magic | header, F.col("pos"))).alias("line"), F.min(F.when(magic | header, F.col("pos"))).alias("pos"), F.max(F.when(header & ~known, name)).alias("unknown")).first()
    if top["line"] is None:
        raise WireError("missing_header")
    if not top["line"].startswith(f"{MAGIC} profile=graph"):
        raise WireError("missing_profile")
    if top["unknown"] is not None:
        raise WireError("malformed_delta", f"unknown section {top['unknown']}")
    head = dict(p.partition("=")[::2] for p in top["line"].split() if "=" in p)
    under = carry_last(clean, {"s": F.when(header, name)}).filter(~header & (F.col("pos") > top["pos"]))
    body = stored(under.select("line", F.coalesce("s", F.lit("")).alias("s"), F.filter(F.split("line", "[ \t]+"), lambda x: x != "").alias("p")), "lines")
    p = lambda i: F.try_element_at("p", F.lit(i))
    bad = F.raise_error(F.concat(F.lit("malformed_delta: "), F.col("line"))).cast("string")
    score, distance = p(4).try_cast("double"), p(6).try_cast("int")
    sound = ((F.col("s") == "removed") & (F.size("p") == 2)) | ((F.col("s") == "added") & (F.size("p") == 6) & score.isNotNull() & distance.isNotNull()) | (F.col("s").startswith("edges_") & (F.size("p") == 4) & (p(2) == "->"))
    body = body.select(F.when(sound | F.col("line").isNull(), F.col("s")).otherwise(bad).alias("s"), "p")
    gone = F.col("s") == "removed"
    symbols = body.filter(~F.col("s").startswith("edges_")).select(
        F.col("s").alias("_op"), expand_kind(F.when(gone, p(1)).otherwise(p(2))).alias("kind"), F.when(gone, p(2)).otherwise(p(3)).alias("qualifiedName"),
        F.when(~gone, score).alias("score"), F.when(~gone, p(5)).alias("provenance"), F.when(~gone, distance).alias("distance"),
    )
    edges = body.filter(F.col("s").startswith("edges_")).select(F.substr("s", F.lit(7)).alias("_op"), p(1).alias("source"), p(3).alias("target"), p(4).alias("edgeType"))
    return head, symbols, edges


def apply_graph_delta(base: DataFrame, delta: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """Symbols or edges after a delta: first what is removed, then what is added."""
    keys = list(identity)
    kept = base.join(delta.filter("_op = 'removed'").select(*keys), keys, "left_anti")
    return kept.unionByName(delta.filter("_op = 'added'").select(*(c for c in kept.columns if c in delta.columns)), allowMissingColumns=True)


def _graph_errors(base: DataFrame, delta: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    keys = list(identity)
    removed, added = (delta.filter(F.col("_op") == op).select(*keys) for op in ("removed", "added"))
    missing = removed.join(base.select(*keys), keys, "left_anti").select(F.concat_ws(" ", F.lit("removing what isn't there:"), *keys).alias("detail"))
    there = added.join(base.select(*keys).join(removed, keys, "left_anti"), keys, "left_semi").select(F.concat_ws(" ", F.lit("adding what is there:"), *keys).alias("detail"))
    twice = delta.groupBy("_op", *keys).count().filter("count > 1").select(F.concat_ws(" ", F.lit("named twice:"), *keys).alias("detail"))
    return missing.union(there).union(twice)


def verify_graph_delta(base_symbols: DataFrame, base_edges: DataFrame, symbols: DataFrame, edges: DataFrame, new_root: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges after the delta, or a WireError."""
    for base, delta, identity in ((base_symbols, symbols, _SYMBOL), (base_edges, edges, _EDGE)):
        if (error := _graph_errors(base, delta, identity).first()) is not None:
            raise WireError("delta_invalid", error["detail"])
    s, e = apply_graph_delta(base_symbols, symbols, _SYMBOL), apply_graph_delta(base_edges, edges, _EDGE)
    if (root := graph_root(s, e)) != new_root:
        raise WireError("root_mismatch", f"computed {root}")
    return s, e


def stream_lines(symbols: DataFrame, edges: DataFrame, tool: str = "", tokens: int = 0, budget: int = 0, root: str = "", labeled: bool = False) -> DataFrame:
    """Lines (part, a, b, c, line) of a graph as a stream writes them: symbols and edges in the order of their `_pos`, ids
    in that order, a section header wherever the section changes, counts in a trailer.  labeled: with the sections' names."""
    ids = with_row_index(symbols, "_pos", index="id").withColumn("_section", section_name(F.col("distance")))
    before = ids.select((F.col("id") + 1).alias("id"), F.col("_section").alias("_before"))
    starts = ids.join(before, "id", "left").filter(~F.col("_section").eqNullSafe(F.col("_before")))
    links = stored(resolve_edges(edges, ids).select("_pos", edge_line(F.col("source_id"), F.col("target_id")).alias("line")), "links")
    n, m = ids.count(), links.count()
    sections = ids.groupBy("_section").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))  # a row a section
    counted = F.concat(F.col("x._section"), F.lit(":"), F.col("x.n").cast("string")) if labeled else F.col("x.n").cast("string")
    label = f"edges:{m}" if labeled else str(m)
    counts = sections.agg(F.sort_array(F.collect_list(F.struct("first", "_section", "n"))).alias("xs")).select(F.posexplode_outer("xs").alias("i", "x")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", counted.alias("t")))), lambda x: x["t"]), ",").alias("t"))
    blank, none = F.lit(0).cast("long"), F.lit("")
    row = lambda df, part, a, b, line: df.select(F.lit(part).alias("part"), a.cast("long").alias("a"), F.lit(b).cast("long").alias("b"), none.alias("c"), line.alias("line"))
    head = f"{MAGIC} profile=graph tool={tool}" + f" budget={budget}" * (budget > 0) + f" tokens={tokens}" * (tokens > 0) + f" pack_root={root}" * bool(root)
    summary = F.concat(F.lit(f"##! summary symbols={n} edges={m} counts="), F.concat_ws(",", F.when(F.col("t") != "", F.col("t")), F.lit(label)))
    return (
        _fixed(symbols, [(0, 0, head)] + [(2, 0, "## edges [?]")] * (m > 0))
        .unionByName(row(starts, 1, F.col("id"), 0, F.concat(F.lit("## "), "_section")))
        .unionByName(row(ids, 1, F.col("id"), 1, symbol_line()))
        .unionByName(row(links, 3, F.col("_pos"), 0, F.col("line")))
        .unionByName(row(counts, 4, blank, 0, summary))
    )


def group_counts(symbols: DataFrame) -> DataFrame:
    """section, n: what a stream's trailer counts."""
    return symbols.groupBy(section_name(F.col("distance")).alias("section")).agg(F.count(F.lit(1)).alias("n"))


