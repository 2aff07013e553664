"""Spectra of epochs around events, against a baseline before each.

Epochs are exploded into the samples they want, which meet the recording by equality (sorted: what was exploded looks
small enough to be broadcast); an epoch of a channel and its
baseline, a few seconds each, are packed by one aggregate and go through Welch's estimate in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from . import kernels


def spans(events: DataFrame, total: DataFrame, fs: float, by: tuple[str, ...] = (), offset: float = 0.0, window: float = 0.0, baseline: float = 0.0, gap: float = 0.0) -> DataFrame:
    """events (by, event_id, onset, duration) with start and end, baseline_start and baseline_end in seconds, and the samples first, last, base_first, base_last (ends excluded).

    An epoch begins `offset` after its onset and lasts `window` (0: the event's duration); the baseline ends `gap` before
    it. Both are cut to the recording (by, total); events without two samples go, a baseline without two is null.
    """
    rows = events.join(total, list(by)) if by else events.crossJoin(F.broadcast(total))  # one row without keys
    length = F.col("total") / fs
    start = F.col("onset") + offset
    end = start + (F.lit(window) if window > 0 else F.col("duration"))
    inside = lambda t: F.greatest(F.lit(0.0), F.least(length, t))
    low = lambda t: F.floor(t * fs + 1e-9)
    high = lambda t: F.least(F.col("total"), F.ceil(t * fs - 1e-9))
    rows = rows.where(end > start).withColumns({"_s": start, "_e": end}).where((F.col("_s") < length) & (F.col("_e") > 0))
    rows = rows.withColumns({"start": inside(F.col("_s")), "end": inside(F.col("_e"))}).withColumns({"first": low(F.col("start")), "last": high(F.col("end"))}).where("last > first + 1")
    rows = rows.withColumn("_b", F.col("start") - gap).withColumns({"baseline_start": inside(F.col("_b") - baseline), "baseline_end": inside(F.col("_b"))})
    valid = (F.lit(baseline) > 0) & (F.col("baseline_end") > F.col("baseline_start")) & (high(F.col("baseline_end")) > low(F.col("baseline_start")) + 1)
    rows = rows.withColumns({"base_first": F.when(valid, low(F.col("baseline_start"))), "base_last": F.when(valid, high(F.col("baseline_end")))})
    return rows.drop("_s", "_e", "_b", "total")


def powers(rec: DataFrame, spans: DataFrame, fs: float, nperseg: int, bands: list[tuple[str, float, float]], mode: str = "ratio", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, event_id, channel, band, epoch_power, baseline_power, norm) of rec (by, channel, n, v): an epoch that a channel doesn't hold whole is left out, a baseline likewise null."""
    part = F.array(F.struct(F.lit("e").alias("part"), F.col("first").alias("a"), F.col("last").alias("b")), F.struct(F.lit("b").alias("part"), F.col("base_first").alias("a"), F.col("base_last").alias("b")))
    want = spans.select(*by, "event_id", F.inline(part)).where("a is not null")
    want = want.select(*by, "event_id", "part", (F.col("b") - F.col("a")).alias("size"), F.explode(F.sequence("a", F.col("b") - 1)).alias("n"))
    packed = want.join(rec.hint("merge"), [*by, "n"]).groupBy(*by, "event_id", "part", "size", "channel").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("x"))  # an epoch's samples
    packed = packed.where(F.size("x") == F.col("size"))

    def run(x: pd.Series) -> pd.Series:
        out: list = [None] * len(x)
        sizes = np.array([len(v) for v in x])
        for size in np.unique(sizes):  # epochs of one length together; an area is a sum of bins with fixed weights
            same = np.flatnonzero(sizes == size)
            f, p = kernels.welch_rows(np.stack([x.iloc[i] for i in same]), fs, nperseg)
            weights = np.array([[kernels.area(f, e, lo, hi) for _, lo, hi in bands] for e in np.eye(len(f))])
            for i, row in zip(same, p @ weights, strict=True):
                out[i] = row
        return pd.Series(out)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    names = F.array(*(F.lit(b[0]) for b in bands))
    rows = packed.select(*by, "event_id", "channel", "part", F.arrays_zip(names.alias("band"), F.pandas_udf(run, "array<double>")(F.col("x.v")).alias("power")).alias("p")).select(*by, "event_id", "channel", "part", F.inline("p"))
    wide = rows.groupBy(*by, "event_id", "channel", "band").agg(*(F.max(F.when(F.col("part") == k, F.col("power"))).alias(c) for k, c in (("e", "epoch_power"), ("b", "baseline_power")))).where("epoch_power is not null")
    return wide.withColumn("norm", scalar.baseline(F.col("epoch_power"), F.col("baseline_power"), mode))


def summary(powers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, channel, band, mean_power, n_epochs, mean_norm, n_norm) under lower-case names."""
    keys = [*by, F.lower("channel").alias("channel"), F.lower("band").alias("band")]
    return powers.groupBy(*keys).agg(F.avg("epoch_power").alias("mean_power"), F.count(F.lit(1)).alias("n_epochs"), F.avg("norm").alias("mean_norm"), F.count("norm").alias("n_norm"))
