"""Delimited recordings, event tables and reference tables through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def first_lines(spark: SparkSession, path: str, n: int = 20) -> list[str]:
    """A few lines, to settle the delimiter and the header on the driver."""
    return [r["value"].lstrip("﻿") for r in spark.read.text(path).limit(n).collect()]


def delimiter(lines: list[str]) -> str:
    body = [x for x in lines if x.strip() and not x.startswith("#")]
    return max(";\t,", key=lambda d: (min((x.count(d) for x in body), default=0), d == ";"))


def number(text: Column) -> Column:
    """A double from text with a decimal point or comma, with or without separators of thousands."""
    t = F.trim(text)
    german = t.rlike(r"^[+-]?[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$")
    comma = t.rlike(r"^[+-]?[0-9]+,[0-9]+$")
    english = t.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+\.[0-9]+$")
    plain = F.when(german, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(comma, F.replace(t, F.lit(","), F.lit("."))).when(english, F.replace(t, F.lit(","), F.lit(""))).otherwise(t)
    return plain.try_cast("double")


def clock(text: Column) -> Column:
    """Seconds from seconds or hh:mm:ss."""
    p = F.split(text, ":")
    return F.when(F.size(p) == 3, number(p[0]) * 3600 + number(p[1]) * 60 + number(p[2])).when(F.size(p) == 2, number(p[0]) * 60 + number(p[1])).otherwise(number(text))


def read_recording(spark: SparkSession, path: str, time: str | None = None) -> DataFrame:
    """(channel, t, v) from a table with a time column (seconds, or milliseconds if its name says so)."""
    sep = delimiter(first_lines(spark, path))
    df = spark.read.option("header", True).option("sep", sep).option("comment", "#").csv(path)
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    time = time or next(c for c in df.columns if c.lower().startswith(("time", "sec", "t_")) or c.lower() == "t")
    scale = 1e-3 if time.lower().endswith(("ms", "msec")) else 1.0
    rest = [c for c in df.columns if c != time]
    return df.unpivot([time], rest, "channel", "raw").select("channel", (clock(F.col(time)) * scale).alias("t"), number(F.col("raw")).alias("v"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(onset, duration, text) under the usual names of those columns; n/a is null."""
    sep = delimiter(first_lines(spark, path))
    df = spark.read.option("header", True).option("sep", sep).option("nullValue", "n/a").csv(path)
    have = {c.lower().strip(): c for c in df.columns}
    pick = lambda names: F.coalesce(*(F.col(have[n]) for n in names if n in have), F.lit(None).cast("string"))
    return df.select(number(pick(["onset", "onset_sec"])).alias("onset"), F.coalesce(number(pick(["duration", "duration_sec"])), F.lit(0.0)).alias("duration"), F.coalesce(pick(["trial_type", "text", "label", "event", "value"]), F.lit("")).alias("text"))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """(channel, band, mean, std, n) with lower-case keys; rows with a deviation of 0 or less go, the last of a key stays."""
    sep = delimiter(first_lines(spark, path))
    df = spark.read.option("header", True).option("sep", sep).option("comment", "#").csv(path)
    # files in order of their names, and rows as they stand in a file
    df = df.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("ord"))
    n = number(F.col("n")) if "n" in df.columns else F.lit(None).cast("double")
    rows = df.select(F.lower("channel").alias("channel"), F.lower("band").alias("band"), number(F.col("mean")).alias("mean"), number(F.col("std")).alias("std"), n.alias("n"), "ord").where("std > 0")
    return rows.groupBy("channel", "band").agg(F.max_by(F.struct("mean", "std", "n"), "ord").alias("r")).select("channel", "band", "r.*")


def write_events(events: DataFrame, path: str, sep: str = "\t") -> None:
    events.select(F.round("onset", 6).alias("onset"), F.round("duration", 6).alias("duration"), F.col("text").alias("trial_type")).write.option("header", True).option("sep", sep).option("nullValue", "n/a").csv(path)
