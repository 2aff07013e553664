"""Filters, preprocessing, spectrograms, phase measures, interpolation and alpha peaks as DataFrame operators over (channel, n, v).

Recurrences run over chunks of a channel with a run-in on either side that their memory doesn't outlast, many chunks in
one Arrow batch; so a channel of any length is spread over tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.specs import alpha_bands  # noqa: F401
from ..sources import shared
from . import kernels, recordings, selection, spectra


def stages(fs: float, notch: float = 0.0, low: float = 0.0, high: float = 0.0, notch_q: float = 30.0) -> list[np.ndarray]:
    """Notch, then highpass, then lowpass sections; frequencies of 0 are left out."""
    if low > 0 and high > 0 and low >= high:
        raise ValueError("a band's low end must lie below its high end")
    out = [kernels.biquad("notch", fs, notch, notch_q)] if notch > 0 else []
    out += [kernels.biquad("highpass", fs, low, math.sqrt(0.5))] if low > 0 else []
    return out + ([kernels.biquad("lowpass", fs, high, math.sqrt(0.5))] if high > 0 else [])


def run_in(sections: list[np.ndarray], size: float = 1e-12) -> int:
    """Samples after which what came before has faded to `size`, by the sections' poles."""
    radius = max((max(abs(np.roots([1.0, s[3], s[4]]))) for s in sections), default=0.0)
    return math.ceil(math.log(size) / math.log(min(max(radius, 0.5), 1 - 1e-7)))


def filtered(rec: DataFrame, sections: list[np.ndarray], zero_phase: bool = True, by: tuple[str, ...] = ("channel",), chunk: int = 1 << 16) -> DataFrame:
    """rec (by, n, v) through second-order sections, forward only or forward and backward over reflected ends."""
    if not sections:
        return rec.select(*by, "n", "v")
    halo = run_in(sections)
    chunk = max(chunk, 2 * halo)
    at, place = F.floor(F.col("n") / chunk), F.col("n") % chunk
    near = F.array_compact(F.array(at, F.when(place < halo, at - 1), F.when(place >= chunk - halo, at + 1)))
    packed = rec.withColumn("_c", F.explode(near)).where("_c >= 0").groupBy(*by, "_c").agg(F.array_sort(F.collect_list(F.struct("n", F.col("v").cast("double").alias("v")))).alias("x"))
    packed = packed.where(F.element_at("x", -1)["n"] >= F.col("_c") * chunk)  # not those that a channel doesn't reach

    def run(x: pa.Array) -> pa.Array:
        rows = [r.values.to_numpy(zero_copy_only=False) for r in x]
        out: list = [None] * len(rows)
        sizes = np.array([len(r) for r in rows])
        for size in np.unique(sizes):
            same = np.flatnonzero(sizes == size)
            block = np.stack([rows[i] for i in same])
            y = kernels.zero_phase_rows(block, sections) if zero_phase else kernels.sections(block, sections)
            for i, row in zip(same, y, strict=True):
                out[i] = row.astype(float)
        return pa.array(out, pa.list_(pa.float64()))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    done = packed.select(*by, "_c", F.col("x.n").alias("n"), F.arrow_udf(run, "array<double>")(F.col("x.v")).alias("y"))
    rows = done.select(*by, "_c", F.inline(F.arrays_zip("n", "y")))
    return rows.where(F.floor(F.col("n") / chunk) == F.col("_c")).select(*by, "n", F.col("y").alias("v"))


def preprocessed(rec: DataFrame, fs: float, average: bool = True, notch: float = 0.0, low: float = 0.0, high: float = 0.0, notch_q: float = 30.0, zero_phase: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Average reference, then the filters; causal (zero_phase false), a recording's pieces give what the whole gives."""
    rec = recordings.average_reference(rec, by) if average else rec
    return filtered(rec, stages(fs, notch, low, high, notch_q), zero_phase, (*by, "channel"))


def spectrogram(rec: DataFrame, fs: float, nperseg: int, hop: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(channel, frame, t, k, freq, p): the density of each complete segment; t is its middle."""
    hop = hop or max(1, nperseg // 2)
    nfft = 1 << (nperseg - 1).bit_length()
    side = F.when((F.col("k") == 0) | (F.col("k") == nfft // 2), 1.0).otherwise(2.0)
    power = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    bins = spectra.transforms(rec, nperseg, hop, by).select(*by, "channel", F.col("seg").alias("frame"), F.posexplode(power).alias("k", "p"))
    return bins.select(*by, "channel", "frame", ((F.col("frame") * hop + 0.5 * nperseg) / fs).alias("t"), F.col("k").cast("long").alias("k"), (F.col("k") * (fs / nfft)).alias("freq"), (F.col("p") * side * spectra._scale(fs, nperseg)).alias("p"))


def in_db(p: Column, least: float = 1e-20) -> Column:
    return 10 * F.log10(F.greatest(p, F.lit(least)))


def display_limits(grid: DataFrame, by: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(by, lo, hi): quantiles of finite values; of fewer than eight the extremes."""
    ok = grid.where(F.col(value).isNotNull() & ~F.isnan(value))
    out = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
    out = out.join(selection.quantiles(ok, by, value, {"q0": low, "q1": high}), by)
    return out.select(*by, F.when(F.col("n") < 8, F.col("a")).otherwise(F.col("q0")).alias("lo"), F.when(F.col("n") < 8, F.col("b")).otherwise(F.col("q1")).alias("hi"))


def band_average(spectrum: DataFrame, by: list[str], value: str, bands: list[tuple[str, float, float]]) -> DataFrame:
    """(by, band, mean): a spectrum's (by, k, freq, value) area in a band over the width it covers, linear between bins."""
    names = spectrum.sparkSession.createDataFrame(bands, "band string, lo double, hi double")
    w = Window.partitionBy(*by).orderBy("k")
    iv = spectrum.select(*by, F.col("freq").alias("f0"), F.lead("freq").over(w).alias("f1"), F.col(value).alias("v0"), F.lead(value).over(w).alias("v1")).where("f1 is not null")
    x = iv.join(F.broadcast(names), (F.col("f1") > F.col("lo")) & (F.col("f0") < F.col("hi")))
    a, b = F.greatest("f0", "lo"), F.least("f1", "hi")
    at = lambda f: F.col("v0") + (F.col("v1") - F.col("v0")) / (F.col("f1") - F.col("f0")) * (f - F.col("f0"))
    return x.groupBy(*by, "band").agg((F.sum(0.5 * (at(a) + at(b)) * (b - a)) / F.sum(b - a)).alias("mean"))


def line_noise_decision(psd: DataFrame, channels: int = 8, least: float = 3.0) -> DataFrame:
    """One row (ratio_50, ratio_60, recommended_hz, strength): medians over the first channels; 60 Hz only if strictly stronger; 0 if neither reaches `least`."""
    first = psd.select("channel").distinct().orderBy("channel").limit(channels)
    rows = psd.join(F.broadcast(first), "channel")
    one = lambda hz: spectra.line_noise(rows, hz).where("ratio > 0").agg(F.coalesce(F.expr("percentile(ratio, 0.5)"), F.lit(0.0)).alias(f"ratio_{int(hz)}"))
    both = one(50.0).crossJoin(one(60.0))  # one row each
    best = F.greatest("ratio_50", "ratio_60")
    found = (best >= least) & (best > 0)
    return both.select("ratio_50", "ratio_60", F.when(found & (F.col("ratio_60") > F.col("ratio_50")), 60.0).when(found, 50.0).otherwise(0.0).alias("recommended_hz"), F.when(found, best).otherwise(0.0).alias("strength"))


def mean_correlation(rec: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(channel, corr): the size of a channel's correlation with the mean over channels; 0 where either doesn't vary."""
    means = rec.groupBy(*by, "n").agg(F.avg("v").alias("m"))
    out = rec.join(means, [*by, "n"]).groupBy(*by, "channel").agg(F.var_pop("v").alias("a"), F.var_pop("m").alias("b"), F.covar_pop("v", "m").alias("c"))
    ok = (F.col("a") > 1e-18) & (F.col("b") > 1e-18)
    return out.select(*by, "channel", F.when(ok, F.least(F.lit(1.0), F.abs("c") / F.sqrt(F.col("a") * F.col("b")))).otherwise(0.0).alias("corr"))


def downsampled(rec: DataFrame, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Every ceil(n / most)-th sample of each channel."""
    sizes = rec.groupBy(*by, "channel").agg(F.ceil((F.max("n") + 1) / most).alias("_stride"))
    return rec.join(sizes, [*by, "channel"]).where("n % _stride = 0").drop("_stride")


def channel_quality(rec: DataFrame, flags: DataFrame, flat_ptp: float = 1.0, flat: float = 0.02, noisy: float = 10.0, often: float = 0.3, least_corr: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Per channel: flatline, noisy, artifact_often_bad, corr_low, bad and reasons; flags has the bad windows of each channel."""
    rec = shared.written(rec.select(*by, "channel", "n", "v"), "samples")  # several passes read it
    scales = recordings.robust(rec, [*by, "channel"], kept=True)
    base = recordings.quality(recordings.statistics(rec, by), scales, flat_ptp, flat, noisy, by).drop("bad", "reasons")
    share = flags.groupBy(*by, "channel").agg(F.avg(F.col("bad").cast("double")).alias("bad_fraction"))
    out = base.join(share, [*by, "channel"], "left").join(mean_correlation(rec, by), [*by, "channel"], "left").fillna(0.0, ["bad_fraction"])
    out = out.withColumn("artifact_often_bad", F.col("bad_fraction") >= often).withColumn("corr_low", (F.col("corr") < least_corr) if least_corr > 0 else F.lit(False))
    names = [("flatline", "flatline"), ("noisy", "noisy"), ("artifact_often_bad", "artifact_often_bad"), ("corr_low", "low_corr")]
    return out.withColumn("bad", F.greatest(*(F.col(c) for c, _ in names))).withColumn("reasons", F.concat_ws(";", *(F.when(F.col(c), n) for c, n in names)))


def masked(rec: DataFrame, bad: DataFrame) -> DataFrame:
    """rec with the samples of bad channels as null."""
    return rec.join(bad.select("channel", F.lit(True).alias("_bad")), "channel", "left").withColumn("v", F.when(F.col("_bad").isNull(), F.col("v"))).drop("_bad")


def on_sphere(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unit vectors of montage points: the disk is the sphere's upper half seen from above."""
    r2 = np.minimum(x * x + y * y, 1.0)
    size = np.sqrt(np.maximum(x * x + y * y, 1.0))
    return np.stack([x / size, y / size, np.sqrt(1 - r2)], 1)


def interpolated(rec: DataFrame, bad: list[str], montage: DataFrame) -> DataFrame:
    """rec with bad channels that have a place in the montage replaced by spherical splines over the good ones that have one.

    Weights are a small table from the montage; samples meet them in a broadcast join and are summed by sample. With
    fewer than three good channels rec stays as it is.
    """
    places = {r["key"]: (r["x"], r["y"]) for r in montage.collect()}
    names = {r[0]: r[1] for r in rec.select("channel", naming.normalize(F.col("channel")).alias("key")).distinct().collect()}
    good = sorted(c for c, k in names.items() if c not in bad and k in places)
    wanted = sorted(c for c in bad if names.get(c) in places)
    if len(good) < 3 or not wanted:
        return rec
    at = lambda cs: on_sphere(*np.array([places[names[c]] for c in cs]).T)
    w = kernels.spline_weights(at(good), at(wanted))
    weights = rec.sparkSession.createDataFrame([(g, b, float(w[j, i])) for i, g in enumerate(good) for j, b in enumerate(wanted)], "channel string, target string, w double")
    new = rec.join(F.broadcast(weights), "channel").groupBy("n", "target").agg(F.sum(F.col("v") * F.col("w")).alias("v")).select(F.col("target").alias("channel"), "n", "v")
    return rec.where(~F.col("channel").isin(wanted)).select("channel", "n", "v").unionByName(new)


def analytic(rec: DataFrame, fs: float, low: float, high: float, by: list[str], trim: float = 0.1) -> DataFrame:
    """(by, channel, n, re, im): band-passed analytic signals, less a share of either end. The transform needs a channel as a whole."""

    def run(batch: pd.Series) -> pd.DataFrame:
        out = []
        for x in batch:
            z = kernels.analytic(kernels.bandpass(np.asarray(x, float), fs, low, high))[kernels.trimmed(len(x), trim)]
            out.append((z.real, z.imag))
        return pd.DataFrame(out, columns=["re", "im"])

    run.__annotations__ = {"batch": pd.Series, "return": pd.DataFrame}
    z = kernels.pack(rec, [*by, "channel"]).select(*by, "channel", F.pandas_udf(run, "re array<double>, im array<double>")("x").alias("z"))
    return z.select(*by, "channel", F.posexplode(F.arrays_zip("z.re", "z.im")).alias("n", "a")).select(*by, "channel", "n", F.col("a.re").alias("re"), F.col("a.im").alias("im"))


def phase_pairs(rec: DataFrame, fs: float, low: float, high: float, by: list[str], trim: float = 0.1) -> DataFrame:
    """(by, channel_a, channel_b, plv, pli, wpli, wpli2) of band-passed analytic signals: channels are filtered once."""
    return locked(analytic(rec, fs, low, high, by, trim), by)


def locked(z: DataFrame, by: list[str]) -> DataFrame:
    """(by, channel_a, channel_b, plv, pli, wpli, wpli2) of complex samples (by, channel, n, re, im): pairs meet by sample, sums are combined before the shuffle."""
    a = z.select(*by, "n", F.col("channel").alias("channel_a"), F.col("re").alias("ra"), F.col("im").alias("ia"))
    b = z.select(*by, "n", F.col("channel").alias("channel_b"), F.col("re").alias("rb"), F.col("im").alias("ib"))
    x = a.join(b, [*by, "n"]).where("channel_a < channel_b")
    re, im = F.col("ra") * F.col("rb") + F.col("ia") * F.col("ib"), F.col("ia") * F.col("rb") - F.col("ra") * F.col("ib")
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    x = x.withColumns({"re": re, "im": im}).withColumn("size", size)
    sums = x.groupBy(*by, "channel_a", "channel_b").agg(
        F.avg(F.when(F.col("size") > 0, F.col("re") / F.col("size"))).alias("ur"), F.avg(F.when(F.col("size") > 0, F.col("im") / F.col("size"))).alias("ui"),
        F.avg(F.signum("im")).alias("sign"), F.sum("im").alias("im"), F.sum(F.abs("im")).alias("abs"), F.sum(F.col("im") * F.col("im")).alias("square"),
    )
    den = F.col("abs") * F.col("abs") - F.col("square")
    return sums.select(
        *by, "channel_a", "channel_b",
        F.coalesce(F.least(F.lit(1.0), F.sqrt(F.col("ur") * F.col("ur") + F.col("ui") * F.col("ui"))), F.lit(0.0)).alias("plv"),
        F.abs("sign").alias("pli"),
        F.when(F.col("abs") > 1e-20, F.abs("im") / F.col("abs")).otherwise(0.0).alias("wpli"),
        F.when(den > 1e-20, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("im") * F.col("im") - F.col("square")) / den))).otherwise(0.0).alias("wpli2"),
    )


def alpha_peaks(psd: DataFrame, low: float = 7.0, high: float = 13.0) -> DataFrame:
    """(channel, iaf, cog, found) from spectra (channel, k, freq, p): a channel's few bins go through the peak search at once."""
    packed = psd.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("freq", "p"))).alias("s"))

    def run(freq: pd.Series, p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.peak_frequency(np.asarray(f), np.asarray(x), low, high) for f, x in zip(freq, p, strict=True)], columns=["iaf", "cog", "found"])

    run.__annotations__ = {"freq": pd.Series, "p": pd.Series, "return": pd.DataFrame}
    return packed.select("channel", F.pandas_udf(run, "iaf double, cog double, found boolean")(F.col("s.freq"), F.col("s.p")).alias("r")).select("channel", "r.*")


# The channels over which an alpha peak is taken by default.
OCCIPITAL = ["o1", "o2", "oz", "pz", "p3", "p4"]


def alpha_summary(peaks: DataFrame, channels: list[str] | None = None, how: str = "median") -> DataFrame:
    """One row (iaf, cog) over channels by name, or all if none of them is there: mean or median of what was found."""
    rows = peaks.withColumn("_in", naming.normalize(F.col("channel")).isin(channels) if channels else F.lit(True))
    some = rows.agg(F.bool_or("_in").alias("_some"))
    rows = rows.crossJoin(F.broadcast(some)).where("_in or not _some")  # one row
    one = lambda c, ok: F.avg(F.when(ok, F.col(c))) if how == "mean" else F.expr(f"percentile(CASE WHEN {ok} THEN {c} END, 0.5)")
    if how == "mean":
        return rows.agg(F.avg(F.when(F.col("found"), F.col("iaf"))).alias("iaf"), F.avg(F.when(~F.isnan("cog"), F.col("cog"))).alias("cog"))
    return rows.agg(one("iaf", "found").alias("iaf"), one("cog", "NOT isnan(cog)").alias("cog"))
