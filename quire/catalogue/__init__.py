"""Queries over the driver's tables, read as stores, one or more for each operator, with equivalent SQL."""

from . import bindings, checked, records, search, storage, stores  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
