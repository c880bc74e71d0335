"""Opaque bookmarks: canonical JSON with a checksum, bound to the query and the data it was made for."""

from __future__ import annotations

import base64
import binascii
import hashlib
from typing import Any

from tessella.errors import EngineError
from tessella.functions.canonical import canonical, decode


def encode(payload: dict[str, Any]) -> str:
    text = canonical(payload)
    return base64.urlsafe_b64encode(canonical({"c": hashlib.sha256(text.encode()).hexdigest(), "p": text}).encode()).decode().rstrip("=")


def read(bookmark: Any) -> dict[str, Any]:
    try:
        outer = decode(base64.urlsafe_b64decode(bookmark + "=" * (-len(bookmark) % 4)).decode())
        if hashlib.sha256(outer["p"].encode()).hexdigest() != outer["c"]:
            raise ValueError
        return decode(outer["p"])
    except (EngineError, ValueError, KeyError, TypeError, AttributeError, binascii.Error, UnicodeDecodeError) as e:
        raise EngineError("invalid_bookmark", "the bookmark cannot be read") from e


def check(payload: dict[str, Any], fingerprint: str, version: str) -> None:
    """A bookmark is for one query and one state of the data."""
    if payload.get("f") != fingerprint:
        raise EngineError("invalid_bookmark", "the bookmark belongs to another query")
    if payload.get("v") != version:
        raise EngineError("bookmark_stale", "the data have changed since the bookmark was made")
