"""How plans are registered: a query over a data folder and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries by name, and the SQL of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Presentation: doubles rounded, other columns as they are."""
    return df.select([shown(F.col(c), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def shown(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits)
