"""Errors with a code that callers can act on."""

from __future__ import annotations


class EngineError(Exception):
    """An error of a call; ``code`` is one of the class attributes below."""

    NOT_FOUND = "NOT_FOUND"
    INVALID_INPUT = "INVALID_INPUT"
    SOURCE_ERROR = "SOURCE_ERROR"
    TIMEOUT = "TIMEOUT"

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


def not_found(what: str, key: str) -> EngineError:
    return EngineError(EngineError.NOT_FOUND, f"{what} not found: {key}")


def invalid(message: str) -> EngineError:
    return EngineError(EngineError.INVALID_INPUT, message)


def from_source(error: Exception) -> EngineError:
    """The coded form of an error of a live source."""
    status = getattr(error, "status", None)
    if status == 404:
        return EngineError(EngineError.NOT_FOUND, str(error))
    if isinstance(error, TimeoutError) or "timed out" in str(error):
        return EngineError(EngineError.TIMEOUT, "request timed out")
    return EngineError(EngineError.SOURCE_ERROR, str(error))
