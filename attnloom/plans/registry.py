"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as _queries
from .oracles import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
