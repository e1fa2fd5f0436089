"""Stable failures: every refusal carries a code that callers can rely on."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


class StaticError(EngineError):
    """The query can't be run as written."""


class CardinalityError(EngineError):
    """An attachment found more or fewer rows than it expects."""


class CoverageError(EngineError):
    """Part of the data is missing and the query doesn't allow that."""


class BudgetError(EngineError):
    """The query would take more than its budget."""
