"""Recordings, BIDS sidecars and tables written by Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from . import records


def write_recordings(rec: DataFrame, folder: str, kind: str = "edf", events: DataFrame | None = None, **how) -> DataFrame:
    """Writes (recording, channel, fs, n, v) as EDF, BDF or BrainVision files in a folder that all workers reach; gives (recording, file, bytes) of those of that kind that are there."""
    records.write(rec, folder, kind, events, **how)
    suffix = "eeg" if kind == "brainvision" else kind
    files = rec.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(folder)
    file = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(file, r"\.[^.]*$", "").alias("recording"), file.alias("file"), F.col("length").alias("bytes"))


def recording_table(rec: DataFrame, fs: float) -> DataFrame:
    """A row for each sample: time and channels, six decimals, as text tables have them."""
    names = [r[0] for r in rec.select("channel").distinct().orderBy("channel").collect()]
    wide = rec.groupBy("n").pivot("channel", names).agg(F.round(F.first("v"), 6))
    return wide.select(F.round(F.col("n") / fs, 6).alias("time"), *(F.col(f"`{c}`") for c in names)).orderBy("time")


def bids_channels(rec: DataFrame, fs: float, bad: DataFrame | None = None) -> DataFrame:
    """channels.tsv: name, type, units, sampling_frequency, status."""
    out = rec.select(F.col("channel").alias("name")).distinct().select("name", naming.channel_type(F.col("name")).alias("type"), F.when(naming.channel_type(F.col("name")) == "TRIG", "n/a").otherwise("uV").alias("units"), F.lit(fs).alias("sampling_frequency"))
    if bad is None:
        return out.withColumn("status", F.lit("good"))
    return out.join(bad.select(F.col("channel").alias("name"), F.lit("bad").alias("status")), "name", "left").fillna("good", ["status"])


def bids_electrodes(montage: DataFrame) -> DataFrame:
    """electrodes.tsv: name, x, y, z on the unit sphere."""
    r2 = F.least(F.col("x") * F.col("x") + F.col("y") * F.col("y"), F.lit(1.0))
    return montage.select("name", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(F.sqrt(1 - r2), 6).alias("z"))


def bids_sidecars(name: str, task: str, fs: float, types: DataFrame, line_hz: float = 50.0) -> dict[str, str]:
    """dataset_description.json, *_eeg.json and *_events.json as text; types is a table of channels."""
    counts = {r["type"]: r["count"] for r in types.groupBy("type").count().collect()}
    eeg = {"TaskName": task, "SamplingFrequency": fs, "PowerLineFrequency": line_hz, "EEGReference": "n/a", "SoftwareFilters": "n/a", **{f"{k}ChannelCount": counts.get(k, 0) for k in ("EEG", "EOG", "ECG", "EMG", "TRIG")}}
    events = {"onset": {"Units": "s"}, "duration": {"Units": "s"}, "trial_type": {"Description": "text of the event"}}
    return {"dataset_description.json": json.dumps({"Name": name, "BIDSVersion": "1.8.0", "DatasetType": "raw"}, indent=2), f"task-{task}_eeg.json": json.dumps(eeg, indent=2), f"task-{task}_events.json": json.dumps(events, indent=2)}


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """A table as text; nulls are n/a."""
    df.write.option("header", True).option("sep", sep).option("nullValue", "n/a").mode("error").csv(path)


def reshaped(spark: SparkSession, source: str, target: str) -> None:
    """A comma table as a tab table; cells keep their text."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(source)
    df.select(*(F.regexp_replace(F.col(f"`{c}`"), "[\t\r\n]+", " ").alias(c) for c in df.columns)).write.option("header", True).option("sep", "\t").option("quote", "").csv(target)


def run_meta(spark: SparkSession, path: str) -> DataFrame:
    """(path, tool, version, timestamp_utc, input_path, outputs) of run descriptions: outputs are relative paths that stay in their folder, once each."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    get = lambda *names: F.coalesce(*(F.get_json_object("value", f"$.{n}") for n in names))
    outputs = F.from_json(F.get_json_object("value", "$.Outputs"), "array<string>")
    safe = F.filter(F.transform(outputs, lambda x: F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"^(\./)+", "")), lambda x: (x != "") & ~x.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)"))
    return text.select("path", get("Tool").alias("tool"), get("Version").alias("version"), get("TimestampUTC").alias("timestamp_utc"), get("InputPath", "input_path", "Input.Path", "Input.path").alias("input_path"), F.array_distinct(F.coalesce(safe, F.array().cast("array<string>"))).alias("outputs"))


def channel_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, target) of a file of `old,new` or `old=new` lines; an empty target keeps the name, DROP, NONE or NULL drops the channel (null)."""
    line = F.trim(F.regexp_replace("value", "^﻿", ""))
    rows = spark.read.text(path).select(line.alias("line")).where("line <> '' and not line like '#%'")
    part = F.split("line", "[,;\t=]", 2)
    clean = lambda i: F.trim(F.regexp_replace(F.trim(F.get(part, F.lit(i))), '^"|"$', ""))
    rows = rows.select(clean(0).alias("old"), clean(1).alias("new")).where("new is not null and not (lower(old) in ('old', 'from', 'source') and lower(new) in ('new', 'to', 'target'))")
    return rows.select(naming.normalize(F.col("old")).alias("key"), F.when(F.upper("new").isin("DROP", "NONE", "NULL"), None).when(F.col("new") == "", F.col("old")).otherwise(F.col("new")).alias("target")).where("key <> ''")


def apply_map(rec: DataFrame, mapping: DataFrame) -> DataFrame:
    """rec with channels renamed or dropped; two channels of one name are refused."""
    names = rec.select("channel").distinct().withColumn("key", naming.normalize(F.col("channel")))
    named = names.join(mapping.withColumn("known", F.lit(True)), "key", "left").select("channel", F.when(F.col("known"), F.col("target")).otherwise(F.col("channel")).alias("target")).where("target is not null")
    twice = named.groupBy("target").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two channels would be named {twice[0]['target']}")
    return rec.join(F.broadcast(named), "channel").withColumn("channel", F.col("target")).drop("target")


def picked(rec: DataFrame, names: list[str]) -> DataFrame:
    """rec with the named channels only, under the names that were asked for, whatever their case, prefix or reference suffix; names that match none, or more than one, are refused."""
    asked = rec.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, target string").withColumn("key", naming.normalize(F.col("target")))
    have = rec.select("channel").distinct().withColumn("key", naming.normalize(F.col("channel")))
    found = asked.join(have, "key", "left")
    wrong = found.groupBy("place", "target").agg(F.count("channel").alias("n")).where("n <> 1").orderBy("place").first()
    if wrong is not None:
        raise ValueError(f"{wrong['n']} channels are named {wrong['target']}")
    return rec.join(F.broadcast(found.select("channel", "target")), "channel").withColumn("channel", F.col("target")).drop("target")


def bad_channels(spark: SparkSession, path: str) -> DataFrame:
    """(channel) of a quality table's bad rows, or of a list of names, by whether the file has a header with `channel` and `bad`."""
    head = (spark.read.text(path).first() or [""])[0].lower()
    if "channel" in head and "bad" in head:
        df = spark.read.option("header", True).csv(path)
        return df.where(F.lower("bad").isin("1", "true", "yes")).select(F.trim("channel").alias("channel"))
    rows = spark.read.text(path).select(F.explode(F.split(F.regexp_replace("value", "#.*", ""), "[,;\t]")).alias("c"))
    return rows.select(F.trim("c").alias("channel")).where("channel <> ''")
