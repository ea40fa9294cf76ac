"""Error taxonomy."""

from __future__ import annotations


class CorvaneError(Exception):
    """Base of all errors of the engine."""


class SourceError(CorvaneError):
    """A repository cannot be read or holds no source file."""


class StoreError(CorvaneError):
    """A vector store is missing, exists already, or does not fit."""


class RetrievalError(CorvaneError):
    """A query cannot be answered, e.g. because it is blank."""


class JobError(CorvaneError):
    """A job is unknown or exists already."""
