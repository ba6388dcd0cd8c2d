"""One graph document in plain Python, for documents of either profile and the command line."""

from __future__ import annotations

from dataclasses import dataclass, field

from packframe.errors import WireError
from packframe.functions.scalar import KINDS

_MAGIC = "GCF"
_SECTIONS = ("targets", "related", "extended")
_LONG = {v: k for k, v in KINDS.items()}


@dataclass
class Graph:
    tool: str = ""
    budget: int = 0
    tokens: int = 0
    root: str = ""
    symbols: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)

    @staticmethod
    def of(value: dict) -> Graph:
        """From the JSON form; older names of the header's members are taken too."""

        def first(kind: type, default: object, *names: str) -> object:
            return next((value[n] for n in names if isinstance(value.get(n), kind)), default)

        symbol = {"qualifiedName": "", "kind": "", "score": 0.0, "provenance": "", "distance": 0}
        edge = {"source": "", "target": "", "edgeType": "", "status": ""}
        return Graph(
            first(str, "", "tool"), first(int, 0, "tokenBudget", "budget"), first(int, 0, "tokensUsed", "tokens"), first(str, "", "packRoot", "pack_root"),
            [{k: s.get(k, d) for k, d in symbol.items()} for s in value.get("symbols") or []], [{k: e.get(k, d) for k, d in edge.items()} for e in value.get("edges") or []],
        )

    def as_dict(self) -> dict:
        return {"tool": self.tool, "tokenBudget": self.budget, "tokensUsed": self.tokens, "packRoot": self.root, "symbols": self.symbols, "edges": self.edges}


def section_of(distance: int) -> str:
    if distance < 0:
        raise WireError("invalid_node_line", f"distance {distance}")
    return _SECTIONS[distance] if distance < len(_SECTIONS) else f"distance_{distance}"


def symbol_text(number: int, s: dict) -> str:
    return f"@{number} {KINDS.get(s['kind'], s['kind'])} {s['qualifiedName']} {s['score']:.2f} {s['provenance']}"


def edge_text(source: int, target: int, e: dict) -> str:
    status = e.get("status") or ""
    return f"@{target}<@{source} {e['edgeType']}" + (f" {status}" if status not in ("", "unchanged") else "")


def encode_graph(g: Graph) -> str:
    order = sorted(g.symbols, key=lambda s: (s["distance"], -s["score"]))  # stable
    ids = {s["qualifiedName"]: i for i, s in enumerate(order)}
    valid = sorted(((ids[e["source"]], ids[e["target"]], e["edgeType"].encode(), e) for e in g.edges if e["source"] in ids and e["target"] in ids), key=lambda x: x[:3])
    head = [f"{_MAGIC} profile=graph tool={g.tool}"]
    head += [f"{k}={v}" for k, v in (("budget", g.budget), ("tokens", g.tokens)) if v > 0] + [f"symbols={len(g.symbols)}"]
    head += [f"edges={len(valid)}"] * bool(valid) + [f"pack_root={g.root}"] * bool(g.root)
    lines, current = [" ".join(head)], None
    for s in order:
        if s["distance"] != current:
            current = s["distance"]
            lines.append(f"## {section_of(current)}")
        lines.append(symbol_text(ids[s["qualifiedName"]], s))
    if g.edges:
        lines.append(f"## edges [{len(valid)}]")
        lines += [edge_text(a, b, e) for a, b, _, e in valid]
    return "".join(x + "\n" for x in lines)


def _integer(text: str, code: str, line: str) -> int:
    try:
        return int(text)
    except ValueError:
        raise WireError(code, line) from None


def decode_graph(text: str) -> Graph:
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    if not lines[0].startswith(_MAGIC + " "):
        raise WireError("missing_header", lines[0][:40])
    g, names, distance, in_edges, declared = Graph(), {}, 0, False, None
    for key, eq, value in (p.partition("=") for p in lines[0].split(" ")[1:]):
        if eq and key in ("tool", "pack_root"):
            setattr(g, {"tool": "tool", "pack_root": "root"}[key], value)
        elif eq and key in ("budget", "tokens"):
            setattr(g, key, int(value) if value.lstrip("+-").isdigit() else 0)
    for line in lines[1:]:
        if not line or line.startswith(("##! ", "# ")):
            continue
        if line.startswith("## "):
            name, bracket, count = line[3:].partition(" [")
            count = count.partition("]")[0]
            in_edges = name == "edges"
            if bracket and count not in ("", "?"):
                n = _integer(count, "count_mismatch", line)
                declared = n if in_edges else declared
            if name in _SECTIONS:
                distance = _SECTIONS.index(name)
            elif name.startswith("distance_") and name[9:].isdigit():
                distance = int(name[9:])
            continue
        parts = [p for p in line.split(" ") if p]
        if in_edges:
            target, lt, source = parts[0].partition("<") if parts else ("", "", "")
            if len(parts) < 2 or not lt:
                raise WireError("invalid_edge_syntax", line)
            t, s = _integer(target[1:], "invalid_edge_syntax", line), _integer(source[1:], "invalid_edge_syntax", line)
            if t not in names or s not in names:
                raise WireError("unknown_edge_reference", line)
            g.edges.append({"source": names[s], "target": names[t], "edgeType": parts[1], "status": parts[2] if len(parts) > 2 else ""})
            continue
        if not line.startswith("@"):
            raise WireError("invalid_symbol_id", line)
        if len(parts) < 5:
            raise WireError("invalid_node_line", line)
        number = _integer(parts[0][1:], "invalid_symbol_id", line)
        try:
            score = float(parts[3])
        except ValueError:
            raise WireError("invalid_score", parts[3]) from None
        names[number] = parts[2]
        g.symbols.append({"qualifiedName": parts[2], "kind": _LONG.get(parts[1], parts[1]), "score": score, "provenance": parts[4], "distance": distance})
    if declared is not None and declared != len(g.edges):
        raise WireError("count_mismatch", f"{declared} edges declared, {len(g.edges)} found")
    return g
