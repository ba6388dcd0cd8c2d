"""Writers that put out wire text as items arrive: counts are deferred to a trailer.

`write` is any function of a string, for example that of a file, or a list's append.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from packframe.errors import WireError
from packframe.plans.document import HEADER, MAGIC
from packframe.plans.graph_text import edge_text, section_of, symbol_text
from packframe.plans.values import declaration, key_text, scalar_text


class GraphStream:
    """Symbols and edges in order of arrival; ids count symbols.  With a session's ids given, references are to them."""

    def __init__(self, write: Callable[[str], object], tool: str, budget: int = 0, tokens: int = 0, root: str = "", session: bool = False, labeled: bool = False):
        self._write, self._labeled, self._lock = write, labeled, threading.Lock()
        self._ids: dict[str, int] = {}
        self._next, self._edges, self._section = 0, 0, ""
        self._counts: dict[str, int] = {}
        head = [f"{MAGIC} profile=graph tool={tool}"] + [f"{k}={v}" for k, v in (("budget", budget), ("tokens", tokens)) if v > 0]
        write(" ".join(head + [f"pack_root={root}"] * bool(root) + ["session=true"] * session) + "\n")

    def _place(self, name: str, distance: int, number: int | None) -> int:
        section = section_of(distance)
        if section != self._section:
            self._write(f"## {section}\n")
            self._section = section
        self._counts[section] = self._counts.get(section, 0) + 1
        got = self._next if number is None else number
        self._ids[name] = got
        self._next += 1
        return got

    def symbol(self, s: dict) -> None:
        with self._lock:
            number = self._place(s["qualifiedName"], s["distance"], None)
            self._write(symbol_text(number, s) + "\n")

    def bare(self, name: str, distance: int, number: int | None = None) -> None:
        """A reference to what was sent before; number: its stable id in the session, if known."""
        with self._lock:
            self._write(f"@{self._place(name, distance, number)}  # previously transmitted\n")

    def edge(self, e: dict) -> None:
        with self._lock:
            if e["source"] not in self._ids or e["target"] not in self._ids:
                return
            if not self._edges:
                self._write("## edges [?]\n")
            self._edges += 1
            self._write(edge_text(self._ids[e["source"]], self._ids[e["target"]], e) + "\n")

    def close(self) -> None:
        with self._lock:
            parts = [*self._counts.items(), ("edges", self._edges)]
            counts = ",".join(f"{k}:{v}" if self._labeled else str(v) for k, v in parts)
            self._write(f"##! summary symbols={self._next} edges={self._edges} counts={counts}\n")


class TableStream:
    """Tables, keyed tables and members one after another."""

    def __init__(self, write: Callable[[str], object]):
        self._write, self._lock = write, threading.Lock()
        self._done: list[int] = []
        self._fields: list[str] | None = None
        self._count = 0
        write(HEADER + "\n")

    def _finish(self) -> None:
        if self._fields is not None:
            self._done.append(self._count)
            self._fields = None

    def begin(self, name: str, fields: list[str], keyed: bool = False) -> None:
        """A table; keyed: the first field is the key."""
        if any(">" in f for f in fields[keyed:]):
            raise WireError("invalid_field_declaration", "a row of a stream has no path columns")
        with self._lock:
            self._finish()
            self._write(f"## {key_text(name)} [?{':' * keyed}]{declaration(fields)}\n")
            self._fields, self._count = list(fields), 0

    def row(self, values: list) -> None:
        with self._lock:
            if self._fields is None:
                return
            if len(values) != len(self._fields):
                raise WireError("row_width_mismatch", f"{len(self._fields)} fields, {len(values)} cells")
            self._write("|".join(map(scalar_text, values)) + "\n")
            self._count += 1

    def end(self) -> None:
        with self._lock:
            self._finish()

    def member(self, name: str, value: object) -> None:
        """Members stand in front of the sections: a line behind one would belong to it."""
        with self._lock:
            if self._fields is not None or self._done:
                raise WireError("invalid_line", f"member {name} behind a section")
            self._write(f"{key_text(name)}={scalar_text(value)}\n")

    def inline_array(self, name: str, values: list) -> None:
        with self._lock:
            if self._fields is not None or self._done:
                raise WireError("invalid_line", f"array {name} behind a section")
            self._write(f"{key_text(name)}[{len(values)}]: {','.join(map(scalar_text, values))}\n")

    def section(self, name: str) -> None:
        with self._lock:
            self._finish()
            self._write(f"## {key_text(name)}\n")

    def close(self) -> None:
        with self._lock:
            self._finish()
            if self._done:
                self._write(f"##! summary counts={','.join(map(str, self._done))}\n")
