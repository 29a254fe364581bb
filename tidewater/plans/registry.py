"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import folder, settled

__all__ = ["AT", "QUERIES", "ZONE", "Query", "folder", "now", "query", "settled", "utc"]

#: The moment that queries take as now.
AT = "2024-01-16 00:00:00"
ZONE = "Europe/London"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(run):
        @wraps(run)
        def plain(spark, sf_dir):
            """Timestamps are given without a zone, in UTC, as the tables have them."""
            found = run(spark, sf_dir)
            return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in found.dtypes if kind == "timestamp"})

        QUERIES[run.__name__] = Query(plain, sql)
        return plain

    return add


def now():
    return F.lit(AT).cast("timestamp")


def utc(column: str):
    """A zone-less timestamp of the tables, taken as UTC."""
    return F.col(column).cast("timestamp")
