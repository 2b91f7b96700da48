"""Errors of the engine. Row-level ones are raised by Spark while a query runs; ``translated`` turns them into these classes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException


class EngineError(Exception):
    """Base of all."""


class CardinalityError(EngineError):
    """A relation that may have one row has several."""


class MissingEntityError(EngineError):
    """A relation that must have a row has none."""


class NoResultError(EngineError):
    """A query that must give an entity gave none."""


class KeyMismatchError(EngineError):
    """Specs with different entity keys can't be merged."""


class NestedWriteError(EngineError):
    """A write can't be the child of a join."""


class StarSelectionError(EngineError):
    """A selection that has to be explicit holds a wildcard."""


class AmbiguousColumnError(EngineError):
    """A column name that stands for several columns."""


class UnknownCollectionError(EngineError, KeyError):
    """No collection of that name."""


class MappedSpecError(EngineError):
    """A spec whose rows already are mapped can't be configured further."""


_RAISED = {"cardinality": CardinalityError, "missing": MissingEntityError}


def message(kind: str, text: str) -> str:
    """What ``raise_error`` is given, so that ``translated`` knows it again."""
    return f"[thicket:{kind}] {text}"


@contextmanager
def translated() -> Iterator[None]:
    """Around an action: row-level violations come out as errors of this module."""
    try:
        yield
    except PySparkException as e:
        found = re.search(r"\[thicket:(\w+)\] ([^\n]*)", str(e))
        if found:
            raise _RAISED[found[1]](found[2]) from e
        raise
