"""Query name -> (Spark function, optional check SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import apply_runtime_settings, spread

QueryFn = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, QueryFn] = {}
_oracles: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_runtime_settings(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in _queries:
            raise ValueError(f"query {name} registered twice")
        _queries[name] = run
        if sql is not None:
            _oracles[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents for CPU-heavy per-row work, dealt by id: the given file is a single split."""
    return spread(table(spark, sf_dir, "documents").select(*columns), "doc_id")


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for parsing, dealt by id: the given file is a single split."""
    return spread(table(spark, sf_dir, "pages"), "page_id")


def all_queries() -> dict[str, QueryFn]:
    return dict(_queries)


def all_oracles() -> dict[str, str]:
    return dict(_oracles)
