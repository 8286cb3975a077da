"""Queries over the driver's tables, and each in DuckDB's SQL."""

from . import code, judgements, programs, rest, texts  # noqa: F401
from .oracle import ORACLE_SQL
from .queries import QUERIES, flagship
from .registry import ORACLE_SQL as MORE_SQL
from .registry import QUERIES as MORE

PLANS = QUERIES | MORE
PLANS_SQL = ORACLE_SQL | MORE_SQL

__all__ = ["PLANS", "PLANS_SQL", "flagship"]
