"""The registered queries and their SQL."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .plans.channels import CHANNELS, CHANNELS_SQL
from .plans.more import MORE, MORE_SQL
from .plans.queries import ORACLES as FIRST_SQL
from .plans.queries import QUERIES as FIRST
from .plans.recorded import RECORDED, RECORDED_SQL

QUERIES, ORACLES = FIRST | MORE | RECORDED | CHANNELS, FIRST_SQL | MORE_SQL | RECORDED_SQL | CHANNELS_SQL

__all__ = ["ORACLES", "QUERIES", "flagship", "ship", "shipped"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return QUERIES["alpha_zscore"](spark, sf_dir)


def ship(spark: SparkSession) -> None:
    """Sends this package to workers that would not find it: those started without its folder in PYTHONPATH."""
    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark.sparkContext, "_wavelake_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "wavelake.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in [*root.glob("*.py"), *root.glob("wavelake/**/*.py")]:
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._wavelake_shipped = True


def shipped(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
