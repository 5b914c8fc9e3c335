"""Make the package importable where Python tasks run."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def importable() -> bool:
    """Whether workers find the package by themselves: by PYTHONPATH or their folder."""
    home = str(ROOT.parent)
    return os.getcwd() == home or home in os.environ.get("PYTHONPATH", "").split(os.pathsep)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or importable():
        return
    path = Path(tempfile.mkdtemp(prefix="trailmark-")) / "trailmark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with the package sent first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
