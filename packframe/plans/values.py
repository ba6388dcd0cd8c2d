"""The scalar grammar on Python values: for schemas and headers on the driver, and for documents in Arrow UDFs."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

from packframe.errors import WireError

# Fixed values of the wire format: what a bare string must not look like (see functions.scalar for the Column form).
NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
QUOTE_PATTERN = (
    r"(?s)\A(?:|-|~|\^|true|false|\^\{.*\}|" + NUMBER + r")\z"
    r"|\A[+-]\.?[0-9]|\A\.[0-9]|\A0[0-9]|\A[ #@.]| \z|\[[^\]]*\]\s*:"
    r'|["\\|,\x{0}-\x{1F}\x{80}-\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]'
)
BARE_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")

_QUOTE = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), QUOTE_PATTERN).replace(r"\z", r"\Z"))
_NUMBER = re.compile(NUMBER + r"\Z")
_DIGITS = re.compile(r"-?[0-9]+\Z")
_COUNT = re.compile(r"(?:0|[1-9][0-9]*)\Z")
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

#: What `~` and `^` (with the fields of `^{...}`) are in a cell.
ABSENT = object()


class Attachment:
    def __init__(self, fields: list[str] | None = None):
        self.fields = fields


def needs_quote(text: str) -> bool:
    return _QUOTE.search(text) is not None


def quote(text: str) -> str:
    return json.dumps(text, ensure_ascii=False).replace("\x7f", "\x7f")


def number_text(x: float) -> str:
    """Shortest digits; plain from 1e-6 up to 2**53, else with an exponent.  What isn't finite is 0."""
    if not math.isfinite(x) or x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    exponent += len(digits) - len(text)
    if 1e-6 <= abs(x) < 2**53:
        if exponent >= 0:
            body = text + "0" * exponent
        elif -exponent < len(text):
            body = f"{text[:exponent]}.{text[exponent:]}"
        else:
            body = "0." + "0" * (-exponent - len(text)) + text
    else:
        power = exponent + len(text) - 1
        body = text[0] + ("." + text[1:] if text[1:] else "") + f"e{'+' if power >= 0 else '-'}{abs(power)}"
    return "-" * sign + body


def scalar_text(value: object) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        if not _LOW <= value <= _HIGH:
            raise WireError("out_of_range", value)
        return str(value)
    if isinstance(value, float):
        return number_text(value)
    return quote(value) if needs_quote(value) else value


def key_text(name: str) -> str:
    return name if BARE_KEY.match(name) else quote(name)


def declaration(names: list[str]) -> str:
    return "{" + ",".join(map(key_text, names)) + "}"


_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_UNICODE = re.compile(r"u([0-9a-fA-F]{4})")


def unquote(text: str) -> str:
    """A quoted string, strictly."""
    out: list[str] = []
    i, n = 1, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            if i + 1 != n:
                raise WireError("trailing_characters", text)
            return "".join(out)
        if c < " ":
            raise WireError("invalid_escape", repr(c))
        if c != "\\":
            out.append(c)
            i += 1
            continue
        e = text[i + 1 : i + 2]
        if e in _ESCAPES and e:
            out.append(_ESCAPES[e])
            i += 2
            continue
        m = _UNICODE.match(text, i + 1)
        if not m:
            raise WireError("invalid_escape" if e else "unterminated_quote", text)
        code = int(m[1], 16)
        i = m.end()
        if 0xD800 <= code < 0xDC00:
            low = _UNICODE.match(text, i + 1) if text[i : i + 1] == "\\" else None
            if not low or not 0xDC00 <= int(low[1], 16) < 0xE000:
                raise WireError("invalid_surrogate", text)
            code = 0x10000 + (code - 0xD800 << 10) + int(low[1], 16) - 0xDC00
            i = low.end()
        elif 0xDC00 <= code < 0xE000:
            raise WireError("invalid_surrogate", text)
        out.append(chr(code))
    raise WireError("unterminated_quote", text)


def parse_cell(text: str) -> object:
    """A value, ABSENT or an Attachment."""
    if text == "":
        return ""
    if text[0] == '"':
        return unquote(text)
    if text == "-":
        return None
    if text == "~":
        return ABSENT
    if text == "^":
        return Attachment()
    if text.startswith("^{") and text.endswith("}"):
        return Attachment(parse_declaration(text[1:]))
    if text in ("true", "false"):
        return text == "true"
    if _NUMBER.match(text):
        if _DIGITS.match(text):
            value = int(text)
            if not _LOW <= value <= _HIGH:
                raise WireError("out_of_range", text)
            return value
        return float(text)
    return text


def parse_value(text: str) -> object:
    """A cell where neither absence nor attachments can stand."""
    value = parse_cell(text)
    if value is ABSENT:
        raise WireError("invalid_missing", text)
    if isinstance(value, Attachment):
        raise WireError("invalid_attachment_marker", text)
    return value


_PART = {d: re.compile(rf'((?:"(?:\\.|[^"\\])*"|[^"{re.escape(d)}])*)({re.escape(d)}|\Z)', re.S) for d in "|,"}


def split_quoted(text: str, delimiter: str) -> list[str]:
    """Splits outside quotes; an open quote takes the rest."""
    out, at = [], 0
    while True:
        m = _PART[delimiter].match(text, at)
        if not m:
            return [*out, text[at:]]
        out.append(m[1])
        if not m[2]:
            return out
        at = m.end()


_OUTSIDE = re.compile(r'"(?:\\.|[^"\\])*"?|[^"]', re.S)


def find_outside(text: str, wanted: str) -> int:
    """The first place of `wanted` outside quotes, or -1."""
    at = 0
    while at < len(text):
        if text[at] != '"' and text.startswith(wanted, at):
            return at
        at = _OUTSIDE.match(text, at).end()
    return -1


def parse_declaration(text: str) -> list[str]:
    """The names of {a,"b c"}."""
    if len(text) < 2 or text[0] != "{" or text[-1] != "}":
        raise WireError("invalid_field_declaration", text)
    names = []
    for part in split_quoted(text[1:-1], ","):
        if part[:1] == '"':
            names.append(unquote(part))
        elif BARE_KEY.match(part):
            names.append(part)
        else:
            raise WireError("invalid_field_declaration", part)
    if len({*names}) < len(names):
        raise WireError("duplicate_field_name", text)
    return names


def parse_count(text: str) -> int:
    if not _COUNT.match(text):
        raise WireError("invalid_count", text)
    return int(text)


def parse_key(text: str) -> str:
    text = text.strip()
    return unquote(text) if text[:1] == '"' and len(text) >= 2 else text
