"""All registered queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import built, checked, sql, stored
from millrace.plans import queries as core


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*core.ALL, *built.ALL, *stored.ALL, *checked.ALL)}


def oracle_sql() -> dict[str, str]:
    return sql.SQL | built.SQL | stored.SQL | checked.SQL
