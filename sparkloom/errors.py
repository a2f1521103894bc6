"""One exception for each way in which a request can fail."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all."""


class NotFound(EngineError, KeyError):
    """No column of that name."""


class OutOfBounds(EngineError, IndexError):
    """A position, a shape or a length beyond what is there."""


class InvalidRequest(EngineError, ValueError):
    """Arguments that contradict each other."""


class InvalidPattern(InvalidRequest):
    """A regular expression that can't be compiled; kind says why: bracket, parenthesis, metacharacter, branches, groups or unknown."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class NotSymmetric(EngineError, ValueError):
    """A symmetric matrix was asked for."""


class UnableToConverge(EngineError, ArithmeticError):
    """An iteration ended without meeting its tolerance."""


class NullValue(EngineError, ValueError):
    """A null where none may be."""
