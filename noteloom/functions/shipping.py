"""Makes this package importable on Spark's Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(package):  # it runs from such a file already
        return
    path = os.path.join(tempfile.mkdtemp(prefix="noteloom-"), "noteloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.join("noteloom", os.path.relpath(os.path.join(at, name), package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
