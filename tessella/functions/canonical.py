"""Canonical JSON (RFC 8785 style), strict decoding, and the ids derived from them."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from tessella.errors import invalid

SAFE = 2**53 - 1
DEPTH = 100


def canonical(value: Any) -> str:
    """Keys by UTF-16 code units, shortest numbers, no white space."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_string(k)}:{canonical(value[k])}" for k in keys) + "}"
    raise invalid("not a JSON value", type=type(value).__name__)


def _string(text: str) -> str:
    short = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + "".join(short.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in text) + '"'


def number(x: int | float) -> str:
    """As an integer below 1e21 in magnitude, else the shortest digits that read back as the same number."""
    if isinstance(x, float):
        if not math.isfinite(x):
            raise invalid("numbers must be finite")
        if x == 0:
            return "0"
        if x.is_integer() and abs(x) < 1e21:
            return str(int(x))
        sign = "-" if x < 0 else ""
        digits, _, exponent = repr(abs(x)).partition("e")
        whole, _, part = digits.partition(".")
        part = "" if part == "0" else part
        point = len(whole) + int(exponent or 0)
        figures = (whole + part).lstrip("0")
        point -= len(whole + part) - len((whole + part).lstrip("0"))
        figures = figures.rstrip("0") or "0"
        if 0 < point <= 21:
            if len(figures) <= point:
                return sign + figures + "0" * (point - len(figures))
            return sign + figures[:point] + "." + figures[point:]
        if -6 < point <= 0:
            return sign + "0." + "0" * -point + figures
        tail = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
        return sign + figures[0] + ("." + figures[1:] if len(figures) > 1 else "") + tail
    return str(x)


def decode(text: str, depth: int = DEPTH) -> Any:
    """Decodes JSON strictly: no duplicate keys, no numbers that binary64 cannot hold, bounded nesting."""

    def pairs(items: list[tuple[str, Any]]) -> dict[str, Any]:
        out = dict(items)
        if len(out) != len(items):
            raise invalid("duplicate object key")
        return out

    def integer(digits: str) -> int:
        if abs(value := int(digits)) > SAFE:
            raise invalid("integer is not exact in binary64")
        return value

    def real(digits: str) -> float:
        value = float(digits)
        if math.isinf(value):
            raise invalid("number overflow")
        if value == 0 and any(c in "123456789" for c in digits.lower().partition("e")[0]):
            raise invalid("number underflow")
        return value

    def constant(name: str) -> Any:
        raise invalid(f"invalid token {name}")

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_int=integer, parse_float=real, parse_constant=constant)
    except (json.JSONDecodeError, RecursionError) as e:
        raise invalid(f"invalid JSON: {e}") from e
    stack = [(value, 1)]
    while stack:
        v, d = stack.pop()
        if isinstance(v, (dict, list)):
            if d > depth:
                raise invalid("JSON is nested too deeply")
            stack += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return value


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode("utf-8", "surrogatepass")).hexdigest()


def revision_id(document_id: str, history_id: str, parent: str | None, deleted: bool, body: Any, attachments: dict | None = None) -> str:
    """generation-digest; the generation is one more than the parent's."""
    generation = 1 if parent is None else int(parent.partition("-")[0]) + 1
    payload = {
        "version": 1, "document_id": document_id, "history_id": history_id, "parent_revision": parent,
        "deleted": deleted, "body": body, "attachments": attachments or {},
    }
    return f"{generation}-{digest(payload)}"
