"""Documents: ordered value trees (dict, list, str, int, float, bool, None) to wire text and back.

This is the form for data without a fixed schema.  Spark runs it in Arrow UDFs, one document at a time
(packframe.operators.documents); tables with a schema have Column expressions instead (packframe.operators.tables).
"""

from __future__ import annotations

from packframe.errors import WireError
from packframe.plans.values import ABSENT, Attachment, declaration, find_outside, key_text, parse_cell, parse_count, parse_declaration, parse_key, parse_value, scalar_text, split_quoted, unquote

#: Fixed values of the wire format.
MAGIC = "GCF"
HEADER = f"{MAGIC} profile=generic"
STEP = "  "


def _nested(value: object) -> bool:
    return isinstance(value, (dict, list))


def _union(rows: list) -> list[str] | None:
    """The fields of all rows in order of appearance; None unless all are objects and there is a field."""
    if not all(isinstance(r, dict) for r in rows):
        return None
    return list(dict.fromkeys(k for r in rows for k in r)) or None


def keyed_fields(value: object) -> list[str] | None:
    """The key label and the fields of a keyed table, if this object is written as one."""
    if not isinstance(value, dict) or len(value) < 2:
        return None
    fields = _union(list(value.values()))
    if not fields or all(">" in f for f in fields):
        return None
    label = "key"
    while label in fields:
        label = "_" + label
    return [label, *fields]


def flat_paths(rows: list[dict], path: tuple[str, ...]) -> list[tuple[str, ...]] | None:
    """The leaves of the objects at `path`, if they can be columns of their own without loss."""
    if not path[-1] or ">" in path[-1]:
        return None
    objects = []
    for row in rows:
        value: object = row
        for name in path:
            if value is None or name not in value:
                value = ABSENT
                break
            value = value[name]
        if value is None and len(path) > 1:
            return None
        if value is ABSENT or value is None:
            continue
        if not isinstance(value, dict):
            return None
        objects.append(value)
    if not objects or any(list(o) != list(objects[0]) for o in objects[1:]):
        return None
    leaves: list[tuple[str, ...]] = []
    for name in objects[0]:
        if not name or ">" in name or any(isinstance(o[name], list) for o in objects):
            return None
        if isinstance(objects[0][name], dict):
            below = flat_paths(rows, (*path, name))
            if not below:
                return None
            leaves += below
        elif any(isinstance(o[name], dict) for o in objects):
            return None
        else:
            leaves.append((*path, name))
    if leaves and any(all(_at(o, leaf[len(path) :]) is None for leaf in leaves) for o in objects):
        return None
    return leaves or None


def _at(value: object, path: tuple[str, ...]) -> object:
    for name in path:
        if not isinstance(value, dict) or name not in value:
            return ABSENT
        value = value[name]
    return value


def _cell(value: object) -> str:
    return "~" if value is ABSENT else scalar_text(value)


class _Writer:
    def __init__(self, flatten: bool):
        self.flatten = flatten
        self.lines: list[str] = []

    def put(self, depth: int, text: str) -> None:
        self.lines.append(STEP * depth + text)

    def members(self, value: dict, depth: int) -> None:
        for name, x in value.items():
            key = key_text(name)
            if isinstance(x, list):
                if x and not any(map(_nested, x)):
                    self.put(depth, f"{key}{self.inline(x)}")
                else:
                    self.array(f"## {key} ", x, depth, depth)
            elif isinstance(x, dict):
                keyed = keyed_fields(x)
                if keyed:
                    self.keyed(f"## {key} ", x, keyed, depth, depth)
                else:
                    self.put(depth, f"## {key}")
                    self.members(x, depth + 1)
            else:
                self.put(depth, f"{key}={scalar_text(x)}")

    @staticmethod
    def inline(x: list) -> str:
        return f"[{len(x)}]: " + ",".join(map(scalar_text, x))

    def array(self, head: str, x: list, at: int, depth: int) -> None:
        """An array whose header stands at depth `at` and whose body at `depth`."""
        if not x:
            self.put(at, f"{head}[0]")
        elif not any(map(_nested, x)):
            self.put(at, head + self.inline(x))
        elif fields := _union(x):
            self.table(head, x, fields, at, depth)
        else:
            self.items(head, x, at, depth)

    def items(self, head: str, x: list, at: int, depth: int) -> None:
        self.put(at, f"{head}[{len(x)}]")
        for i, item in enumerate(x):
            if isinstance(item, dict):
                keyed = keyed_fields(item)
                if keyed:
                    self.keyed(f"@{i} ", item, keyed, depth, depth + 1)
                else:
                    self.put(depth, f"@{i} {{}}")
                    self.members(item, depth + 1)
            elif isinstance(item, list):
                self.array(f"@{i} ", item, depth, depth + 1)
            else:
                self.put(depth, f"@{i} ={scalar_text(item)}")

    def keyed(self, head: str, x: dict, fields: list[str], at: int, depth: int) -> None:
        self.table(head, [{fields[0]: k, **v} for k, v in x.items()], fields, at, depth, ":")

    def table(self, head: str, rows: list[dict], fields: list[str], at: int, depth: int, mark: str = "") -> None:
        flat = {f: leaves for f in fields if self.flatten and (leaves := flat_paths(rows, (f,)))}
        aside = [f for f in fields if f not in flat and ">" in f]
        columns = [leaf for f in fields if f not in aside for leaf in flat.get(f, [(f,)])]
        if not columns:
            self.items(head, rows, at, depth)
            return
        inline = {f: names for f in fields if f not in flat and (names := self.inline_fields(rows, f))}
        shared = {f: names for f in fields if f not in flat and (names := self.shared_fields(rows, f))}
        self.put(at, f"{head}[{len(rows)}{mark}]" + declaration([">".join(c) for c in columns]))
        for i, row in enumerate(rows):
            cells, below = [], []
            for column in columns:
                f = column[0]
                value = row.get(f, ABSENT)
                if f in flat:
                    cells.append(_cell(value if value is None else _at(row, column)))
                elif _nested(value):
                    own = isinstance(value, dict) and f in inline
                    cells.append("^" + declaration(inline[f]) if own and i == 0 else "^")
                    below.append((f, value, own))
                else:
                    cells.append(_cell(value))
            below += [(f, row[f], False) for f in aside if f in row]
            self.put(depth, (f"@{i} " if below else "") + "|".join(cells))
            for f, value, own in below:
                if own:
                    self.put(depth, "|".join(_cell(value.get(n, ABSENT)) for n in inline[f]))
                else:
                    self.attachment(f, value, depth, shared.get(f) if i else None)

    def attachment(self, name: str, value: object, depth: int, shared: list[str] | None) -> None:
        head = f".{key_text(name)} "
        if isinstance(value, dict):
            keyed = keyed_fields(value)
            if keyed:
                self.keyed(head, value, keyed, depth, depth + 2)
            else:
                self.put(depth, head + "{}")
                self.members(value, depth + 2)
        elif isinstance(value, list):
            if shared and value and _union(value) == shared:
                self.put(depth, f"{head}[{len(value)}]")
                for row in value:
                    self.put(depth + 2, "|".join(_cell(row.get(n, ABSENT)) for n in shared))
            else:
                self.array(head, value, depth, depth + 2)
        else:
            self.put(depth, f"{head}={scalar_text(value)}")

    @staticmethod
    def inline_fields(rows: list[dict], f: str) -> list[str] | None:
        """Fields that all objects of a column share, at least three scalars, so that they are named once only."""
        if not isinstance(rows[0].get(f), dict):
            return None
        found = [r[f] for r in rows if r.get(f) is not None]
        names = list(rows[0][f])
        same = all(isinstance(v, dict) and list(v) == names and not any(map(_nested, v.values())) for v in found)
        return names if same and len(names) >= 3 else None

    @staticmethod
    def shared_fields(rows: list[dict], f: str) -> list[str] | None:
        """Fields that all arrays of a column share, so that later headers go without them."""
        if not isinstance(rows[0].get(f), list):
            return None
        found = [r[f] for r in rows if r.get(f) is not None]
        if not all(isinstance(v, list) for v in found):
            return None
        unions = [_union(v) if v else None for v in found]
        plain = all(u == unions[0] and u for u in unions) and not any(_nested(x) for v in found for item in v for x in item.values())
        return unions[0] if plain else None


def encode(value: object, flatten: bool = True) -> str:
    """The wire text of a value tree."""
    w = _Writer(flatten)
    if isinstance(value, dict):
        keyed = keyed_fields(value)
        if keyed:
            w.keyed("## ", value, keyed, 0, 0)
        else:
            w.members(value, 0)
    elif isinstance(value, list):
        w.array("## ", value, 0, 0)
    else:
        w.put(0, "=" + scalar_text(value))
    return "".join(f"{line}\n" for line in [HEADER, *w.lines])


def header_fields(line: str) -> dict[str, str]:
    """The k=v fields of a header line; profile is among them."""
    if not line.startswith(MAGIC + " "):
        raise WireError("missing_header", line[:40])
    out: dict[str, str] = {}
    for token in line.split(" ")[1:]:
        if not token:
            continue
        key, eq, value = token.partition("=")
        if not eq:
            raise WireError("malformed_header_field", token)
        if key in out:
            raise WireError("duplicate_header_field", key)
        out[key] = value
    if not out.get("profile"):
        raise WireError("missing_profile")
    return out


class _Reader:
    """A place in the lines; every method reads what starts there and moves on."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.at = 0

    def peek(self, depth: int) -> str | None:
        """The line here without the indent of `depth`; None where the body at that depth ends."""
        if self.at >= len(self.lines) or not self.lines[self.at].startswith(STEP * depth):
            return None
        return self.lines[self.at][2 * depth :]

    def members(self, depth: int) -> dict:
        out: dict = {}
        while (line := self.peek(depth)) is not None:
            if line[:1] == " ":
                raise WireError("invalid_indent", line)
            if line.startswith("## "):
                bracket = find_outside(line, " [")
                name = parse_key(line[3:bracket] if bracket >= 3 else line[3:])
            else:
                split, inline = self.member_split(line), False
                if split is None:
                    split, inline = self.inline_start(line), True
                if split is None:
                    raise WireError("orphan_inline_attachment" if "|" in line else "invalid_line", line)
                name = parse_key(line[:split])
            if name in out:
                raise WireError("duplicate_key", name)
            if line.startswith("## "):
                if bracket >= 3:
                    out[name] = self.array(line[bracket + 1 :], depth)
                else:
                    self.at += 1
                    out[name] = self.members(depth + 1)
            elif inline:
                out[name] = self.array(line[split:], depth)
            else:
                out[name] = parse_value(line[split + 1 :])
                self.at += 1
        return out

    @staticmethod
    def member_split(line: str) -> int | None:
        """Where the = of name=value stands."""
        if line[:1] == '"':
            end = len(line) - len(_after_quoted(line))
            return end if line[end : end + 1] == "=" else None
        eq = line.find("=")
        return eq if eq > 0 and "[" not in line[:eq] else None

    @staticmethod
    def inline_start(line: str) -> int | None:
        """Where the [ of name[n]: a,b stands."""
        if line[:1] == "@":
            return None
        start = find_outside(line, "[")
        close = line.find("]", start)
        return start if start > 0 and close > 0 and (line[close + 1 :] == ":" or line.startswith(": ", close + 1)) else None

    def array(self, head: str, depth: int) -> list | dict:
        """What a header [n]..., on the line here, announces."""
        head = head.strip(" ")
        close = head.find("]")
        if head[:1] != "[" or close < 0:
            raise WireError("invalid_count", head)
        number, rest = head[1:close], head[close + 1 :]
        keyed = number.endswith(":")
        if keyed:
            number = number[:-1]
            if rest[:1] != "{":
                raise WireError("invalid_field_declaration", head)
        count = None if number == "?" else parse_count(number)
        if keyed and count == 0:
            raise WireError("invalid_count", head)
        self.at += 1
        if rest == ":" or rest.startswith(": "):
            parts = split_quoted(rest[2:], ",") if rest[2:] else []
            got: list = [parse_value(p.strip()) for p in parts]
        elif rest[:1] == "{":
            end = find_outside(rest, "}")
            fields = parse_declaration(rest[: end + 1])
            if keyed and len(fields) < 2:
                raise WireError("invalid_field_declaration", head)
            got = self.rows(fields, count, depth)
        elif count == 0:
            got = []
        else:
            got = self.items(depth)
        if count is not None and len(got) != count:
            raise WireError("count_mismatch", f"{count} declared, {len(got)} found")
        return self.unkeyed(got, fields[0]) if keyed else got

    @staticmethod
    def unkeyed(rows: list[dict], label: str) -> dict:
        out: dict = {}
        for row in rows:
            if label not in row:
                raise WireError("invalid_field_declaration", f"a row without {label}")
            key = row.pop(label)
            key = key if isinstance(key, str) else scalar_text(key)
            if key in out:
                raise WireError("duplicate_key", key)
            out[key] = row
        return out

    def items(self, depth: int) -> list:
        out: list = []
        while (line := self.peek(depth)) is not None and line[:1] == "@" and " " in line:
            number, _, body = line[1:].partition(" ")
            if number != str(len(out)):
                raise WireError("invalid_item_id", number)
            if body[:1] == "=":
                out.append(parse_value(body[1:]))
                self.at += 1
            elif body.startswith("{}"):
                self.at += 1
                out.append(self.members(depth + 1))
            elif body[:1] == "[":
                out.append(self.array(body, depth + 1))
            else:
                break
        return out

    def rows(self, fields: list[str], count: int | None, depth: int) -> list[dict]:
        paths = {f: tuple(f.split(">")) for f in fields if ">" in f and all(f.split(">"))}
        inline: dict[str, list[str]] = {}
        shared: dict[str, list[str]] = {}
        out: list[dict] = []
        while (count is None or len(out) < count) and (line := self.peek(depth)) is not None:
            if line[:1] == " " or line.startswith(("## ", "##!")):
                break
            number, space, rest = line[1:].partition(" ")
            named = line[:1] == "@" and bool(space) and number.isascii() and number.isdigit()
            cells = split_quoted(rest if named else line, "|")
            if len(cells) != len(fields):
                raise WireError("row_width_mismatch", f"{len(fields)} fields, {len(cells)} cells")
            values, waiting = {}, {}
            for f, text in zip(fields, cells, strict=True):
                value = parse_cell(text)
                if isinstance(value, Attachment):
                    if f in paths:
                        raise WireError("invalid_attachment_marker", text)
                    if value.fields is not None:
                        inline[f] = value.fields
                    waiting[f] = f in inline
                else:
                    values[f] = value
            self.at += 1
            if waiting and not named:
                raise WireError("missing_attachment", next(iter(waiting)))
            below = self.attachments(waiting, inline, shared, not out, depth) if named else {}
            out.append(self.row(fields, paths, values, below))
        return out

    def attachments(self, waiting: dict[str, bool], inline: dict[str, list[str]], shared: dict[str, list[str]], first: bool, depth: int) -> dict:
        got: dict = {}
        while (line := self.peek(depth)) is not None:
            if line.startswith(STEP + "."):  # an older form has one more indent
                line = line[2:]
            if line[:1] == ".":
                name, rest = _attachment_name(line[1:])
                if name not in waiting and ">" not in name:
                    raise WireError("duplicate_attachment" if name in got else "orphan_attachment", name)
                if name in got:
                    raise WireError("duplicate_attachment", name)
                if waiting.get(name) and rest[:1] != "[" and not rest.startswith("{}"):
                    got[name] = self.inline_body(rest, inline[name])
                    self.at += 1
                else:
                    got[name] = self.attachment(name, rest, shared, first, depth + 2)
                continue
            name = next((f for f, own in waiting.items() if own and f not in got), None)
            if name is None:
                break
            got[name] = self.inline_body(line, inline[name])
            self.at += 1
        for f in waiting:
            if f not in got:
                raise WireError("missing_attachment", f)
        return got

    @staticmethod
    def inline_body(text: str, names: list[str]) -> dict:
        cells = split_quoted(text, "|")
        if len(cells) != len(names):
            raise WireError("row_width_mismatch", f"{len(names)} fields, {len(cells)} cells")
        return {n: parse_value(c) for n, c in zip(names, cells, strict=True) if c != "~"}

    def attachment(self, name: str, rest: str, shared: dict[str, list[str]], first: bool, depth: int) -> object:
        if rest.startswith("{}"):
            self.at += 1
            return self.members(depth)
        if rest[:1] == "[":
            close = rest.find("]")
            behind = rest[close + 1 :]
            if close > 0 and behind[:1] == "{" and first:
                shared[name] = parse_declaration(behind[: find_outside(behind, "}") + 1])
            elif close > 0 and not behind and name in shared and rest[1:close] != "0":
                count = None if rest[1:close] == "?" else parse_count(rest[1:close])
                ahead = self.lines[self.at + 1] if self.at + 1 < len(self.lines) else ""
                if not ahead.lstrip(" ").startswith("@"):
                    self.at += 1
                    rows = self.rows(shared[name], count, depth)
                    if count is not None and len(rows) != count:
                        raise WireError("count_mismatch", f"{count} declared, {len(rows)} found")
                    return rows
            return self.array(rest, depth)
        if rest[:1] == "=":
            self.at += 1
            value = parse_cell(rest[1:])
            return None if value is ABSENT else parse_value(rest[1:])
        raise WireError("invalid_field_declaration", f".{name} {rest}")

    @staticmethod
    def row(fields: list[str], paths: dict[str, tuple[str, ...]], values: dict, below: dict) -> dict:
        out: dict = {}
        for f in fields:
            if f in paths:
                top = paths[f][0]
                if top in out:
                    continue
                group = [g for g in fields if g in paths and paths[g][0] == top]
                if all(values[g] is ABSENT for g in group):
                    continue
                if all(values[g] is None for g in group):
                    out[top] = None
                    continue
                for g in group:
                    if values[g] is not ABSENT:
                        place = out
                        for name in paths[g][:-1]:
                            place = place.setdefault(name, {})
                        place[paths[g][-1]] = values[g]
            elif f in below:
                out[f] = below[f]
            elif values[f] is not ABSENT:
                out[f] = values[f]
        return out | {k: v for k, v in below.items() if k not in out}


def _after_quoted(text: str) -> str:
    """What stands behind the quoted string at the beginning."""
    i = 1
    while i < len(text):
        if text[i] == '"':
            return text[i + 1 :]
        i += 2 if text[i] == "\\" else 1
    raise WireError("unterminated_quote", text)


def _attachment_name(text: str) -> tuple[str, str]:
    if text[:1] == '"':
        rest = _after_quoted(text)
        return unquote(text[: len(text) - len(rest)]), rest.strip(" ")
    name, _, rest = text.partition(" ")
    if not name:
        raise WireError("invalid_field_declaration", text)
    return name, rest.strip(" ")


def decode(text: str) -> object:
    """The value tree of wire text, generic or graph profile."""
    lines = text.strip("\n\r").split("\n")
    head = header_fields(lines[0].strip("\r"))
    if head["profile"] == "graph":
        from packframe.plans.graph_text import decode_graph

        return decode_graph(text).as_dict()
    if head["profile"] != "generic":
        raise WireError("unknown_profile", head["profile"])
    body, trailer, deferred = [], "", 0
    for raw in lines[1:]:
        line = raw.strip("\r")
        own = line.strip()
        if not line:
            continue
        if "\t" in line[: len(line) - len(line.lstrip(" \t"))]:
            raise WireError("tab_indentation", line)
        if own.startswith("# "):
            continue
        if own.startswith("##! "):
            trailer = own
            continue
        deferred += _deferred(own)
        body.append(line)
    if trailer and deferred:
        _check_trailer(trailer, deferred, body)
    if not body:
        return {}
    first = body[0].strip(" ")
    if first[:1] == "=":
        if len(body) > 1:
            raise WireError("trailing_characters", body[1])
        return parse_value(first[1:])
    reader = _Reader(body)
    got = reader.array(first[3:], 0) if first.startswith("## [") else reader.members(0)
    if reader.at < len(body):
        raise WireError("count_mismatch", f"more than declared: {body[reader.at]}")
    return got


def _deferred(line: str) -> bool:
    return line.startswith("## ") and ("[?]" in line or "[?:]" in line)


def _check_trailer(trailer: str, deferred: int, body: list[str]) -> None:
    """The counts of a trailer against the rows of the sections that were opened without a count."""
    counts = next((t[7:] for t in trailer.split(" ") if t.startswith("counts=")), "")
    if not counts:
        return
    declared = [c for c in counts.split(",") if c]
    if len(declared) != deferred:
        raise WireError("count_mismatch", f"{deferred} sections, {len(declared)} counts")
    found: list[int] = []
    is_open = False
    for line in body:
        own = line.strip()
        if own.startswith("## "):
            is_open = _deferred(own)
            if is_open:
                found.append(0)
        elif is_open and own[:1] != ".":
            found[-1] += 1
    for d, n in zip(declared, found, strict=True):
        if d != str(n):
            raise WireError("count_mismatch", f"{d} declared, {n} found")
