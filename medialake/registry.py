"""Every query of the engine by name, each with the DuckDB SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    """Imports every module that registers queries."""
    import importlib

    for name in ("event_queries", "column_queries", "filter_queries", "report_queries", "vector_queries", "curation_queries", "more_queries", "date_queries", "card_queries", "note_queries", "series_queries", "stream_queries", "repair_queries", "map_queries", "fold_queries", "phrase_queries", "audit_queries", "people_queries", "reingest_queries", "keyword_queries", "detail_queries"):
        importlib.import_module(f"medialake.plans.{name}")
