"""Every registered query with its SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from . import base

MODULES = ("reports", "notes", "tags", "graph", "vectors", "search", "lifecycle", "transcripts", "triggers", "bus")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"noteloom.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["r11_surface_stats"](spark, sf_dir)


def queries() -> dict:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(base.SQL)
