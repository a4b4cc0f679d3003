"""The package's queries, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f for name, f in vars(q).items() if name[:1] == "p" and name[1:2].isdigit()
}
SQL: dict[str, str] = dict(q.SQL)
