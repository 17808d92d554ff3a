"""What a query of the catalogue is: a function of session and data folder, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.plans.views import ansi, view


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def at(time: str) -> Column:
    return F.lit(time).cast("timestamp")


def on_views(names: str, run: Callable[..., DataFrame], sql: str | None) -> Query:
    """A query of views of the graph."""
    return Query(lambda s, d: run(*[view(s, d, n) for n in names.split()]), sql and ansi(sql))


def on_table(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None) -> Query:
    """A query of one table of the data folder."""
    return Query(lambda s, d: run(s.read.parquet(f"{d}/{name}.parquet")), sql)
