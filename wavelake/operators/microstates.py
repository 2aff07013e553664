"""Microstates: choosing field-power peaks, assigning samples to template maps, smoothing labels, and their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, scans, selection
from .recordings import average_reference, runs


def top_fraction(peaks: DataFrame, fraction: float, least: int = 1, most: int = 0) -> DataFrame:
    """The ceil(fraction * n) strongest peaks (n, gfp), at least `least` and at most `most` (0: any number).

    The place of the cut comes from counts by value, so that no task ranks all peaks.
    """
    fraction = fraction if 0 < fraction <= 1 else 1.0
    total = peaks.count()
    want = min(total, max(least, -int(-fraction * total // 1)))
    return selection.largest(peaks, "gfp", "n", min(want, most) if most else want)


def thinned(peaks: DataFrame, distance: int) -> DataFrame:
    """Peaks (n, gfp), the strongest first, none nearer than `distance` to a kept one.

    Only peaks within reach of each other decide about each other: chains of near peaks are walked one by one, each in a
    task of its own kind.
    """
    w = Window.partitionBy("_chunk").orderBy("n")
    # a chain begins where no peak stands within reach before; chunks of places keep the windows bounded, with the last peak before a chunk found by its maximum
    chunk = F.floor(F.col("n") / (1 << 20))
    rows = peaks.withColumn("_chunk", chunk)
    tops = rows.groupBy("_chunk").agg(F.max("n").alias("_top"))
    before = tops.select("_chunk", F.max("_top").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    rows = rows.join(F.broadcast(before), "_chunk").withColumn("_prev", F.coalesce(F.lag("n").over(w), "_before"))
    rows = rows.withColumn("_new", (F.col("_prev").isNull() | (F.col("n") - F.col("_prev") >= distance)).cast("int"))
    counts = rows.groupBy("_chunk").agg(F.sum("_new").alias("_n"))
    base = counts.select("_chunk", F.coalesce(F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rows = rows.join(F.broadcast(base), "_chunk").withColumn("_chain", F.col("_base") + F.sum("_new").over(w))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gfp", "n"], ascending=[False, True])
        kept: list[int] = []
        for n in pdf["n"]:
            at = np.searchsorted(kept, n)
            if (at == 0 or n - kept[at - 1] >= distance) and (at == len(kept) or kept[at] - n >= distance):
                kept.insert(at, n)
        return pdf[pdf["n"].isin(kept)][["n", "gfp"]]

    return rows.select("_chain", "n", "gfp").groupBy("_chain").applyInPandas(keep, "n long, gfp double")


def templates(rec: DataFrame, peaks: DataFrame, k: int, most: int = 1000, seed: int = 1) -> np.ndarray:
    """k unit maps from the maps at the strongest `most` peaks (a bounded table, fitted in one place), channels in order."""
    rows = average_reference(rec).join(peaks.orderBy(F.desc("gfp"), "n").limit(most).select("n"), "n").toPandas()
    maps = rows.pivot(index="n", columns="channel", values="v").sort_index(axis=1).to_numpy()
    return kernels.microstates(maps, k, seed=seed)


def assigned(rec: DataFrame, maps: np.ndarray, channels: list) -> DataFrame:
    """(n, label, corr, gfp): the map whose size of correlation with a sample's field is greatest (label -1, corr 0 where the field is flat)."""
    spark = rec.sparkSession
    unit = maps - maps.mean(1, keepdims=True)
    unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
    weights = spark.createDataFrame([(c, j, float(unit[j, i])) for i, c in enumerate(channels) for j in range(len(unit))], f"channel {dict(rec.dtypes)['channel']}, label int, w double")
    fields = average_reference(rec)
    # sums by sample and map are combined before the shuffle; their size is samples times maps
    dots = fields.join(F.broadcast(weights), "channel").groupBy("n", "label").agg(F.abs(F.sum(F.col("v") * F.col("w"))).alias("dot"), F.sum(F.col("v") * F.col("v")).alias("square"), F.count(F.lit(1)).alias("size"))
    best = dots.groupBy("n").agg(F.max(F.struct("dot", (-F.col("label")).alias("order"))).alias("b"), F.first("square").alias("square"), F.first("size").alias("size"))
    flat = F.col("square") <= 1e-24
    return best.select("n", F.when(flat, -1).otherwise(-F.col("b.order")).alias("label"), F.when(flat, 0.0).otherwise(F.col("b.dot") / F.sqrt("square")).alias("corr"), F.sqrt(F.col("square") / F.col("size")).alias("gfp"))


def smooth(labels: np.ndarray, least: int, passes: int = 10) -> np.ndarray:
    """Runs shorter than `least` take the label of the longer neighbour (of equal ones the one before), until nothing changes."""
    for _ in range(passes if least > 1 else 0):
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        run = [[int(labels[a]), b - a] for a, b in zip(cuts, cuts[1:], strict=False)] if len(labels) else []
        out: list[list[int]] = []  # runs so far, those of one label joined
        changed = False
        for i, (label, size) in enumerate(run):
            after = run[i + 1] if i + 1 < len(run) else None
            if label >= 0 and size < least and (out or after):
                longer = after[0] if not out or (after and after[1] > out[-1][1]) else out[-1][0]
                if longer >= 0 and longer != label:
                    label, changed = longer, True
            if out and out[-1][0] == label:
                out[-1][1] += size
            else:
                out.append([label, size])
        labels = np.repeat([r[0] for r in out], [r[1] for r in out]) if out else labels
        if not changed:
            break
    return labels


def smoothed(rows: DataFrame, by: list[str], least: int, size: int = scans.PLACES) -> DataFrame:
    """rows (by, n, label, ...) with labels smoothed within each recording of `by`.

    What a run becomes depends on the runs before it, but a run keeps its label if it is long enough (or has none), and
    two such runs side by side part what comes before from what comes after, in every pass. So runs, not samples, are
    walked, and each stretch between such pairs by itself.
    """
    marked = scans.with_runs(rows, by, "n", "label", size)
    runs_of = scans.runs(rows, by, "n", "label", size)
    fixed = (F.col("n") >= least) | (F.col("label") < 0)
    cuts = scans.neighbour(runs_of.withColumn("_fixed", fixed), by, "first", "_fixed", "_was", size=size)
    heads = cuts.withColumn("_head", F.when(~F.coalesce("_was", F.lit(False)) | ~F.col("_fixed"), None).otherwise(F.col("first")))
    stretch = scans.forward_filled(heads, by, "first", "_head", -1, size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        after = smooth(np.repeat(pdf["label"].to_numpy(), pdf["n"]), least)
        return pdf.assign(label=after[np.append(0, np.cumsum(pdf["n"].to_numpy())[:-1])])

    keys = ", ".join(f"`{c}` {t}" for c, t in rows.select(*by).dtypes)
    kind = dict(rows.dtypes)["label"]
    walked = stretch.select(*by, "_head", "first", "label", "n").groupBy(*by, "_head").applyInPandas(run, f"{keys}{', ' if by else ''}_head {dict(stretch.dtypes)['_head']}, first {dict(rows.dtypes)['n']}, label {kind}, n long")
    names = walked.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col("first").alias("_first"), F.col("label").alias("_label"))
    same = [F.col("run") == F.col("_first"), *(F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by))]
    return marked.join(names, same).select(*(F.col("_label").alias("label") if c == "label" else F.col(c) for c in rows.columns))


def segments(rows: DataFrame, by: list[str], fs: float) -> DataFrame:
    """(by, label, first, last, start, end, duration, mean_corr, mean_gfp) of runs of a label that isn't -1."""
    marked = scans.with_runs(rows, by, "n", "label")
    out = marked.where("label >= 0").groupBy(*by, "label", "run").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.avg("corr").alias("mean_corr"), F.avg("gfp").alias("mean_gfp"))
    return out.select(*by, "label", "first", "last", (F.col("first") / fs).alias("start"), ((F.col("last") + 1) / fs).alias("end"), ((F.col("last") + 1 - F.col("first")) / fs).alias("duration"), "mean_corr", "mean_gfp")


def statistics(rows: DataFrame, by: list[str], fs: float) -> DataFrame:
    """(by, label, coverage, mean_duration, occurrence, gev): a label's share of samples, its runs' mean length and number a second, and its part of the explained variance."""
    weight = F.col("gfp") * F.col("gfp")
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
    own = rows.where("label >= 0").groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_own"), F.sum(weight * F.col("corr") * F.col("corr")).alias("_x"))
    lengths = runs(rows.where("label >= 0"), by, "n", "label").groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_runs"), F.avg("n").alias("_mean"))
    return own.join(lengths, [*by, "label"]).join(total, by).select(*by, "label", (F.col("_own") / F.col("_n")).alias("coverage"), (F.col("_mean") / fs).alias("mean_duration"), (F.col("_runs") / (F.col("_n") / fs)).alias("occurrence"), F.when(F.col("_w") > 0, F.col("_x") / F.col("_w")).otherwise(0.0).alias("gev"))
