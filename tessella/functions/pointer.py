"""JSON Pointers (RFC 6901)."""

from __future__ import annotations

import re

from tessella.errors import invalid


def parse(pointer: str, empty: bool = False) -> tuple[str, ...]:
    """The tokens of a pointer; the empty pointer, the whole document, only where allowed."""
    if not isinstance(pointer, str):
        raise invalid("a pointer must be a string")
    if pointer == "":
        if empty:
            return ()
        raise invalid("an empty pointer is not allowed here")
    if not pointer.startswith("/") or re.search("~(?![01])", pointer):
        raise invalid("not a JSON Pointer", pointer=pointer)
    return tuple(t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/"))


def is_index(token: str) -> bool:
    """Whether a token can address an array element."""
    return bool(re.fullmatch("0|[1-9][0-9]{0,8}", token))


def lookup(body: object, tokens: tuple[str, ...]) -> tuple[bool, object]:
    """(found, value) in a decoded document."""
    for token in tokens:
        if isinstance(body, dict) and token in body:
            body = body[token]
        elif isinstance(body, list) and is_index(token) and int(token) < len(body):
            body = body[int(token)]
        else:
            return False, None
    return True, body
