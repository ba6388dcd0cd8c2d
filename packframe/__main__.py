"""python -m packframe COMMAND: standard input to standard output."""

from __future__ import annotations

import sys

from packframe.errors import WireError
from packframe.plans import document
from packframe.plans.graph_text import Graph, decode_graph, encode_graph
from packframe.sources import json_text

VERSION = "0.1.0"
COMMANDS = {
    "encode-generic": ("JSON to the generic profile", lambda t: document.encode(json_text.parse(t))),
    "decode-generic": ("generic profile to JSON", lambda t: json_text.serialize(document.decode(t), pretty=True) + "\n"),
    "encode": ("JSON graph to the graph profile", lambda t: encode_graph(Graph.of(json_text.parse(t)))),
    "decode": ("graph profile to JSON", lambda t: json_text.serialize(decode_graph(t).as_dict(), pretty=True) + "\n"),
    "version": ("print the version", None),
}


def main(args: list[str]) -> int:
    if not args or args[0] in ("help", "-h", "--help") or args[0] not in COMMANDS:
        print("\n".join(["commands:", *(f"  {k:16}{v[0]}" for k, v in COMMANDS.items())]), file=sys.stderr)
        return int(not args or args[0] not in ("help", "-h", "--help"))
    if args[0] == "version":
        print(f"packframe {VERSION}")
        return 0
    try:
        sys.stdout.write(COMMANDS[args[0]][1](sys.stdin.buffer.read().decode("utf-8")))
    except (WireError, UnicodeDecodeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
