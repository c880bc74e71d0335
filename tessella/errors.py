"""One exception for all failures a caller can meet, by code."""

from __future__ import annotations

#: Codes, and whether a retry may succeed.
CODES = {
    "invalid_request": False,
    "invalid_bookmark": False,
    "document_not_found": False,
    "revision_not_found": False,
    "index_not_found": False,
    "view_not_found": False,
    "attachment_not_found": False,
    "revision_conflict": False,
    "bookmark_stale": True,
    "checkpoint_conflict": True,
    "history_truncated": False,
    "source_history_reset": False,
    "boundary_conflict": False,
    "index_name_conflict": False,
    "view_name_conflict": False,
    "view_not_caught_up": True,
    "invalid_index_hint": False,
    "index_required": False,
    "integrity_violation": False,
    "subscription_overloaded": True,
    "resource_limit": False,
}


class EngineError(Exception):
    def __init__(self, code: str, message: str, **details: object):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details
        self.retryable = CODES[code]


def invalid(message: str, **details: object) -> EngineError:
    return EngineError("invalid_request", message, **details)
