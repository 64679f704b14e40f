"""All registered queries of the library, by name."""

from __future__ import annotations

from . import building, data, search, tables  # noqa: F401
from .base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
