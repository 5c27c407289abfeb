"""The named queries and their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, counting, lifecycle, ordering, streams
from .registry import ORACLE, QUERIES

MODULES = (audits, counting, lifecycle, ordering, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
