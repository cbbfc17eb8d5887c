"""All queries by name, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corridor.plans import conversations, files, planning, reasoning, records, spatial

_ALL = planning.QUERIES | spatial.QUERIES | reasoning.QUERIES | conversations.QUERIES | records.QUERIES | files.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _ALL.items() if sql}
