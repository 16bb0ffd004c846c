"""The catalogue that queries are entered in, with their SQL, and how figures are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def entry(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        CATALOG[query.__name__] = (query, sql)
        return query

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Without -0.0, which rounding may leave."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + 0.0 for c in columns})


def rounded_sql(*columns: str) -> str:
    return ", ".join(f"round({c}::double, 6) + 0.0 as {c}" for c in columns)
