"""Channel names, scalp regions and the standard montage, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Approximate unit-circle positions of the 19 channels of the 10-20 system.
MONTAGE_1020 = """
Fp1 -0.50 0.92
Fp2 0.50 0.92
F7 -0.92 0.62
F3 -0.42 0.55
Fz 0.00 0.58
F4 0.42 0.55
F8 0.92 0.62
T7 -1.02 0.00
C3 -0.52 0.02
Cz 0.00 0.00
C4 0.52 0.02
T8 1.02 0.00
P7 -0.92 -0.55
P3 -0.42 -0.52
Pz 0.00 -0.56
P4 0.42 -0.52
P8 0.92 -0.55
O1 -0.50 -0.92
O2 0.50 -0.92
"""
# Approximate unit-circle positions of 61 channels of the 10-10 system.
MONTAGE_1010 = """
Fp1 -0.35 0.92
Fpz 0.00 0.98
Fp2 0.35 0.92
AF7 -0.55 0.80
AF3 -0.25 0.78
AFz 0.00 0.80
AF4 0.25 0.78
AF8 0.55 0.80
F7 -0.82 0.62
F5 -0.62 0.62
F3 -0.42 0.62
F1 -0.18 0.62
Fz 0.00 0.62
F2 0.18 0.62
F4 0.42 0.62
F6 0.62 0.62
F8 0.82 0.62
FT7 -0.92 0.34
FC5 -0.66 0.34
FC3 -0.42 0.34
FC1 -0.18 0.34
FCz 0.00 0.34
FC2 0.18 0.34
FC4 0.42 0.34
FC6 0.66 0.34
FT8 0.92 0.34
T7 -1.00 0.00
C5 -0.66 0.00
C3 -0.42 0.00
C1 -0.18 0.00
Cz 0.00 0.00
C2 0.18 0.00
C4 0.42 0.00
C6 0.66 0.00
T8 1.00 0.00
TP7 -0.92 -0.34
CP5 -0.66 -0.34
CP3 -0.42 -0.34
CP1 -0.18 -0.34
CPz 0.00 -0.34
CP2 0.18 -0.34
CP4 0.42 -0.34
CP6 0.66 -0.34
TP8 0.92 -0.34
P7 -0.82 -0.62
P5 -0.62 -0.62
P3 -0.42 -0.62
P1 -0.18 -0.62
Pz 0.00 -0.62
P2 0.18 -0.62
P4 0.42 -0.62
P6 0.62 -0.62
P8 0.82 -0.62
PO7 -0.55 -0.80
PO3 -0.25 -0.80
POz 0.00 -0.84
PO4 0.25 -0.80
PO8 0.55 -0.80
O1 -0.35 -0.94
Oz 0.00 -0.98
O2 0.35 -0.94
"""
# Older names of four channels.
ALIASES = {"t3": "t7", "t4": "t8", "t5": "p7", "t6": "p8"}
# Lobes by the beginning of a normalised name; two letters before one.
LOBES = [("fp", "Frontal"), ("af", "Frontal"), ("ft", "Temporal"), ("tp", "Temporal"), ("po", "Occipital"), ("fc", "Central"), ("cp", "Parietal"), ("f", "Frontal"), ("c", "Central"), ("p", "Parietal"), ("o", "Occipital"), ("t", "Temporal")]


def montage(spark: SparkSession, text: str = MONTAGE_1020) -> DataFrame:
    """(name, x, y, key) of a built-in montage."""
    rows = [(n, float(x), float(y)) for n, x, y in (line.split() for line in text.split("\n") if line)]
    return spark.createDataFrame(rows, "name string, x double, y double").withColumn("key", normalize(F.col("name")))


def read_montage(spark: SparkSession, path: str) -> DataFrame:
    """(name, x, y, key) of a file of name, x, y; a header and comments are no rows."""
    df = spark.read.option("comment", "#").schema("name string, x string, y string").csv(path)
    rows = df.select(F.trim("name").alias("name"), F.trim("x").try_cast("double").alias("x"), F.trim("y").try_cast("double").alias("y")).where("x is not null and y is not null")
    return rows.withColumn("key", normalize(F.col("name")))


def normalize(name: Column) -> Column:
    """The key by which channel names match: lower-case letters and digits, without EEG prefixes and reference suffixes."""
    key = F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, "^﻿", ""))), "[^a-z0-9]", "")
    key = F.regexp_replace(key, "^(seeg|ieeg|eeg)(?=[a-z])", "")
    key = F.regexp_replace(key, "(reference|ref)$", "")
    return renamed(key, ALIASES)


def renamed(key: Column, names: dict[str, str]) -> Column:
    """The name that a small map has for a key, or the key."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key), key)


def hemisphere(name: Column) -> Column:
    key = normalize(name)
    digits = F.regexp_extract(key, "([0-9]+)$", 1)
    odd = F.substring(digits, -1, 1).isin("1", "3", "5", "7", "9")
    return F.when(key.endswith("z"), "Midline").when(digits == "", "Unknown").when(odd, "Left").otherwise("Right")


def lobe(name: Column) -> Column:
    start = F.regexp_extract(normalize(name), "^(" + "|".join(x for x, _ in LOBES) + ")", 1)
    return renamed(start, {"": "Other", **dict(LOBES)})


def channel_type(name: Column) -> Column:
    """A guess at a BIDS channel type."""
    key = F.upper(name)
    return (
        F.when(key.rlike("TRIG|STATUS|STI"), "TRIG").when(key.rlike("VEOG"), "VEOG").when(key.rlike("HEOG"), "HEOG").when(key.rlike("EOG"), "EOG").when(key.rlike("ECG|EKG"), "ECG").when(key.rlike("EMG"), "EMG").when(key.rlike("^REF"), "REF").otherwise("EEG")
    )
