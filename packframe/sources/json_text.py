"""JSON text and ordered value trees."""

from __future__ import annotations

import json

from packframe.errors import WireError

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _integer(text: str) -> int:
    value = int(text) if len(text) < 40 else _HIGH + 1
    if not _LOW <= value <= _HIGH:
        raise WireError("out_of_range", text)
    return value


def _constant(text: str) -> object:
    raise WireError("invalid_json", text)


def _sound(value: object) -> object:
    """Refuses lone surrogates, which have no UTF-8."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            try:
                x.encode()
            except UnicodeEncodeError:
                raise WireError("invalid_surrogate", ascii(x)) from None
        elif isinstance(x, dict):
            todo += [*x.keys(), *x.values()]
        elif isinstance(x, list):
            todo += x
    return value


def parse(text: str) -> object:
    """Members keep their order; of a repeated name the last value stays, in the first place."""
    try:
        return _sound(json.loads(text, parse_int=_integer, parse_constant=_constant))
    except WireError:
        raise
    except (ValueError, RecursionError) as e:
        raise WireError("invalid_json", e) from None


def serialize(value: object, pretty: bool = False) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))
