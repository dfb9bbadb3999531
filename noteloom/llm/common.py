"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.tables import discard, materialize, new_path, shared_dir

__all__ = ["WORD", "discard", "free_name", "let", "materialize", "new_path", "shared_dir", "table"]

#: Words of the contracts: runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have (names clash without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def let(x: Column, make: Callable[[Column], Column]) -> Column:
    """`make` of a value that is computed once, however often `make` names it and in whatever lambda."""
    return F.element_at(F.transform(F.array(x), make), 1)
