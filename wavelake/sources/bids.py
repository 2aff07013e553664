"""BIDS file names and sidecar tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming

ENTITIES = ("sub", "ses", "task", "acq", "run")


def entity(path: Column, name: str) -> Column:
    """An entity's label in a file's name; null without it."""
    return F.nullif(F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), f"(?:^|_){name}-([A-Za-z0-9]+)(?=_|\\.|$)", 1), F.lit(""))


def index(spark: SparkSession, root: str) -> DataFrame:
    """(path, suffix, extension, sub, ses, task, acq, run) of a tree's files, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select("path", F.regexp_extract(name, "_?([A-Za-z0-9]+)\\.[^/]*$", 1).alias("suffix"), F.regexp_extract(name, "(\\.[^/]*)$", 1).alias("extension"), *(entity(F.col("path"), e).alias(e) for e in ENTITIES))


def channel_table(rec: DataFrame) -> DataFrame:
    """(name, type, units) of a recording's channels."""
    return rec.select(F.col("channel").alias("name")).distinct().select("name", naming.channel_type(F.col("name")).alias("type"), F.lit("uV").alias("units"))


def valid_label(label: Column) -> Column:
    return F.coalesce(label.rlike("^[A-Za-z0-9]+$"), F.lit(False))
