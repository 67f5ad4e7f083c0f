"""Query registry: one Spark callable and (where SQL can say it) one DuckDB
oracle statement per SURVEY §2 key.  ``__spark_entry__`` only re-exports
this.  Callables take ``(spark, sf_dir)`` and return a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from farmspark.oracle_sql import with_adapters
from farmspark.sources.feeds import FEED_SQL
from farmspark.sources.tables import Tables

AS_OF_YEAR = 2001  # T-5: the reference reads the clock; tests pin the year

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, feeds: tuple[str, ...] = (),
          extra: dict[str, str] | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables.from_driver(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        SPARK[name] = run
        if sql is not None:
            ctes = {f: FEED_SQL[f] for f in feeds}
            ctes.update(extra or {})
            SQL[name] = with_adapters(sql, ctes)
        return fn
    return deco


def _load_all() -> None:
    # importing the modules registers their queries
    from farmspark import keys  # noqa: F401


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(SPARK)


def oracle_queries() -> dict[str, str]:
    _load_all()
    return dict(SQL)
