"""Welch spectra and what is read off them.

A spectrum is a long table (channel, k, freq, p), with further keys before the channel where `by` names them (recordings). Samples meet in their segments by one shuffle; Arrow batches of whole
segments go through numpy's transform, and all else is column expressions over its few numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(signal: DataFrame, nperseg: int, hop: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(channel, seg, x) of all complete segments; signal is (channel, n, v), n from 0."""
    copies = -(-nperseg // hop)
    first = F.floor(F.col("n") / hop)
    rows = signal.select(*by, "channel", "n", "v", F.explode(F.sequence(F.greatest(first - (copies - 1), F.lit(0)), first)).alias("seg")).withColumn("i", F.col("n") - F.col("seg") * hop).where(F.col("i") < nperseg)
    packed = rows.groupBy(*by, "channel", "seg").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))  # a segment's samples
    return packed.where(F.size("x") == nperseg).select(*by, "channel", "seg", F.col("x.v").alias("x"))


def rfft(nperseg: int):
    """The transform (re, im) of segments less their means under a symmetric Hann window, padded to a power of two."""
    nfft, window = 1 << (nperseg - 1).bit_length(), np.hanning(nperseg)

    def run(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, nperseg)
        out = np.fft.rfft((rows - rows.mean(1, keepdims=True)) * window, nfft)
        ends = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(part.ravel())) for part in (out.real.copy(), out.imag.copy())], names=["re", "im"])

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "re array<double>, im array<double>")


def transforms(signal: DataFrame, nperseg: int, hop: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(channel, seg, re, im): arrays over bins."""
    return segments(signal, nperseg, hop, by).select(*by, "channel", "seg", rfft(nperseg)("x").alias("t")).select(*by, "channel", "seg", "t.re", "t.im")


def _scale(fs: float, nperseg: int) -> float:
    return 1 / (fs * sum((0.5 - 0.5 * math.cos(2 * math.pi * i / (nperseg - 1))) ** 2 for i in range(nperseg)))


def welch(signal: DataFrame, fs: float, nperseg: int, hop: int, by: tuple[str, ...] = ()) -> DataFrame:
    """One-sided power spectral density: all but the first and last bin count twice."""
    nfft = 1 << (nperseg - 1).bit_length()
    side = F.when((F.col("k") == 0) | (F.col("k") == nfft // 2), 1.0).otherwise(2.0)
    power = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    bins = transforms(signal, nperseg, hop, by).select(*by, "channel", F.posexplode(power).alias("k", "p"))
    return bins.groupBy(*by, "channel", F.col("k").cast("long").alias("k")).agg(F.avg("p").alias("p")).select(*by, "channel", "k", (F.col("k") * (fs / nfft)).alias("freq"), (F.col("p") * side * _scale(fs, nperseg)).alias("p"))


def intervals(psd: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(channel, f0, f1, p0, p1) between neighbouring bins."""
    w = Window.partitionBy(*by, "channel").orderBy("k")
    return psd.select(*by, "channel", F.col("freq").alias("f0"), F.lead("freq").over(w).alias("f1"), F.col("p").alias("p0"), F.lead("p").over(w).alias("p1")).where("f1 IS NOT NULL")


def band_power(psd: DataFrame, bands: list[tuple[str, float, float]], by: tuple[str, ...] = ()) -> DataFrame:
    """(channel, band, power): trapezoids, cut at a band's edges with linear interpolation."""
    names = psd.sparkSession.createDataFrame(bands, "band string, lo double, hi double")
    x = intervals(psd, by).join(F.broadcast(names), (F.col("f1") > F.col("lo")) & (F.col("f0") < F.col("hi")))
    a, b = F.greatest("f0", "lo"), F.least("f1", "hi")
    slope = (F.col("p1") - F.col("p0")) / (F.col("f1") - F.col("f0"))
    at = lambda f: F.col("p0") + slope * (f - F.col("f0"))
    return x.groupBy(*by, "channel", "band").agg(F.sum(0.5 * (at(a) + at(b)) * (b - a)).alias("power"))


def relative(psd: DataFrame, bands: list[tuple[str, float, float]], total: tuple[float, float] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(channel, band, power, rel, log_power): each band's power, its share of a range (that which the bands span) and its logarithm; the range is one more band of the same pass."""
    lo, hi = total or (min(b[1] for b in bands), max(b[2] for b in bands))
    power = band_power(psd, [*bands, ("", lo, hi)], by)
    whole = F.max(F.when(F.col("band") == "", F.col("power"))).over(Window.partitionBy(*by, "channel"))
    share = F.when(F.col("total") > 1e-20, F.col("power") / F.col("total")).otherwise(0.0)
    return power.withColumn("total", whole).where("band <> ''").select(*by, "channel", "band", "power", share.alias("rel"), F.log10(F.greatest("power", F.lit(1e-20))).alias("log_power"))


def band_ratios(power: DataFrame, ratios: list[tuple[str, str, str]], eps: float = 1e-20, by: tuple[str, ...] = ()) -> DataFrame:
    """(channel, name, ratio); null where the denominator is about 0."""
    named = power.sparkSession.createDataFrame(ratios, "name string, num string, den string")
    top = power.select(*by, "channel", F.col("band").alias("num"), F.col("power").alias("a"))
    low = power.select(*by, "channel", F.col("band").alias("den"), F.col("power").alias("b"))
    out = F.broadcast(named).join(top, "num").join(low, [*by, "channel", "den"])
    return out.select(*by, "channel", "name", F.when(F.abs("b") > eps, F.col("a") / F.col("b")).alias("ratio"))


def pieces(psd: DataFrame, lo: float, hi: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(channel, a, b, pa, pb, area): the intervals of a spectrum cut to a range."""
    x = intervals(psd, by).withColumn("a", F.greatest("f0", F.lit(lo))).withColumn("b", F.least("f1", F.lit(hi))).where("b > a")
    at = lambda f: F.col("p0") + (F.col("p1") - F.col("p0")) * (f - F.col("f0")) / (F.col("f1") - F.col("f0"))
    x = x.withColumn("pa", at(F.col("a"))).withColumn("pb", at(F.col("b")))
    return x.select(*by, "channel", "a", "b", "pa", "pb", (0.5 * (F.col("pa") + F.col("pb")) * (F.col("b") - F.col("a"))).alias("area"))


def features(psd: DataFrame, lo: float, hi: float, edge: float = 0.95, eps: float = 1e-20, by: tuple[str, ...] = ()) -> DataFrame:
    """Per channel, of a spectrum that is linear between bins: total_power, entropy, mean_freq, bandwidth, skewness, kurtosis (excess), flatness, edge_freq, peak_freq, peak_refined, peak_db and fwhm.

    Three Gauss points an interval give its moments up to the fourth exactly. A width at half the peak needs a crossing
    on either side; without one it is null. Sums are partial ones before their shuffle; windows hold a channel's bins.
    """
    x = pieces(psd, lo, hi, by)
    half, mid = (F.col("b") - F.col("a")) / 2, (F.col("a") + F.col("b")) / 2
    nodes = [(-math.sqrt(0.6), 5 / 9), (0.0, 8 / 9), (math.sqrt(0.6), 5 / 9)]

    def moment(k: int):
        return F.sum(sum(w * half * F.pow(mid + half * t, F.lit(k)) * ((F.col("pa") + F.col("pb")) / 2 + (F.col("pb") - F.col("pa")) / 2 * t) for t, w in nodes))

    w = Window.partitionBy(*by, "channel")
    x = x.withColumn("total", F.sum("area").over(w)).withColumn("sum", F.sum("area").over(w.orderBy("a")))
    q = F.when(F.col("area") > 0, F.col("area") / F.col("total"))
    log = F.sum(0.5 * (F.log(F.greatest("pa", F.lit(eps))) + F.log(F.greatest("pb", F.lit(eps)))) * (F.col("b") - F.col("a")))
    target = edge * F.col("total")
    slope, rem = (F.col("pb") - F.col("pa")) / (F.col("b") - F.col("a")), target - (F.col("sum") - F.col("area"))
    dx = F.when(F.abs(slope) < 1e-15, rem / F.greatest("pa", F.lit(eps))).otherwise((F.sqrt(F.greatest(F.col("pa") * F.col("pa") + 2 * slope * rem, F.lit(0.0))) - F.col("pa")) / slope)
    cross = F.when((F.col("sum") >= target) & (F.col("sum") - F.col("area") < target), F.col("a") + F.least(F.greatest(dx, F.lit(0.0)), F.col("b") - F.col("a")))
    sums = x.groupBy(*by, "channel").agg(
        F.first("total").alias("total_power"), (-F.sum(q * F.log(q)) / F.nullif(F.log(F.count(q).cast("double")), F.lit(0.0))).alias("entropy"),
        *(moment(k).alias(f"m{k}") for k in range(1, 5)), log.alias("log"), F.sum(F.col("b") - F.col("a")).alias("width"), F.min(cross).alias("edge_freq"),
    )
    m = [None, *(F.col(f"m{k}") / F.col("total_power") for k in range(1, 5))]
    var = m[2] - m[1] * m[1]
    third, fourth = m[3] - 3 * m[1] * m[2] + 2 * F.pow(m[1], F.lit(3)), m[4] - 4 * m[1] * m[3] + 6 * m[1] * m[1] * m[2] - 3 * F.pow(m[1], F.lit(4))
    moments = sums.select(
        *by, "channel", "total_power", F.coalesce("entropy", F.lit(0.0)).alias("entropy"), m[1].alias("mean_freq"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("bandwidth"),
        F.when(var > eps, third / (F.sqrt(var) * var)).otherwise(0.0).alias("skewness"), F.when(var > eps, fourth / (var * var) - 3).otherwise(0.0).alias("kurtosis"),
        F.least(F.lit(1.0), F.exp(F.col("log") / F.col("width")) / (F.col("total_power") / F.col("width"))).alias("flatness"), "edge_freq",
    )
    by_bin = w.orderBy("k")
    bins = psd.withColumn("y", F.log10(F.greatest("p", F.lit(eps)))).withColumns({"y0": F.lag("y").over(by_bin), "y2": F.lead("y").over(by_bin), "g0": F.lag("freq").over(by_bin), "g2": F.lead("freq").over(by_bin)})
    top = bins.where((F.col("freq") >= lo) & (F.col("freq") <= hi)).groupBy(*by, "channel").agg(F.max_by(F.struct("freq", "p", "y0", "y", "y2", "g0", "g2"), F.struct("p", -F.col("freq"))).alias("t")).select(*by, "channel", "t.*")
    bend = F.col("y0") - 2 * F.col("y") + F.col("y2")
    shift = 0.5 * (F.col("y0") - F.col("y2")) / bend
    inside = (F.col("g0") >= lo) & (F.col("g2") <= hi) & (F.abs(bend) >= 1e-18) & (F.abs(shift) <= 1)
    refined = F.when(F.coalesce(inside, F.lit(False)), F.col("freq") + shift * (F.col("g2") - F.col("g0")) / 2).otherwise(F.col("freq"))
    peaks = top.select(*by, "channel", F.col("freq").alias("peak_freq"), refined.alias("peak_refined"), F.when(F.col("p") > 0, 10 * F.log10(F.greatest("p", F.lit(eps)))).alias("peak_db"), (F.col("p") / 2).alias("half"))
    both = x.select(*by, "channel", "a", "b", "pa", "pb").join(peaks.select(*by, "channel", "peak_freq", "half"), [*by, "channel"]).where((F.col("pa") - F.col("half")) * (F.col("pb") - F.col("half")) <= 0)
    at = F.col("a") + F.when(F.abs(F.col("pb") - F.col("pa")) < 1e-30, 0.0).otherwise((F.col("half") - F.col("pa")) / (F.col("pb") - F.col("pa"))) * (F.col("b") - F.col("a"))
    sides = both.groupBy(*by, "channel").agg(F.max(F.when(F.col("b") <= F.col("peak_freq"), at)).alias("left"), F.min(F.when(F.col("a") >= F.col("peak_freq"), at)).alias("right"))
    return moments.join(peaks.drop("half"), [*by, "channel"]).join(sides.select(*by, "channel", (F.col("right") - F.col("left")).alias("fwhm")), [*by, "channel"], "left")


def entropy(psd: DataFrame, lo: float, hi: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(channel, total_power, entropy, mean_freq): Shannon entropy of the intervals' powers over the logarithm of their number."""
    x = intervals(psd, by).where((F.col("f0") >= lo) & (F.col("f1") <= hi)).withColumn("a", 0.5 * (F.col("p0") + F.col("p1")) * (F.col("f1") - F.col("f0"))).where("a > 0")
    x = x.withColumn("q", F.col("a") / F.sum("a").over(Window.partitionBy(*by, "channel")))
    # the mean of f under a line from p0 to p1 lies at the middle, moved by a sixth of the width times the line's relative tilt
    mid = F.sum(F.col("q") * ((F.col("f0") + F.col("f1")) / 2 + (F.col("f1") - F.col("f0")) * (F.col("p1") - F.col("p0")) / (6 * (F.col("p0") + F.col("p1")))))
    return x.groupBy(*by, "channel").agg(F.sum("a").alias("total_power"), (-F.sum(F.col("q") * F.log("q")) / F.log(F.count(F.lit(1)).cast("double"))).alias("entropy"), mid.alias("mean_freq"))


def coherence(signal: DataFrame, nperseg: int, hop: int, eps: float = 1e-24, by: tuple[str, ...] = ()) -> DataFrame:
    """(channel_a, channel_b, k, msc, imcoh): each channel is transformed once, pairs meet by segment and bin."""
    t = transforms(signal, nperseg, hop, by)
    a = t.select(*by, "seg", F.col("channel").alias("channel_a"), F.col("re").alias("ra"), F.col("im").alias("ia"))
    b = t.select(*by, "seg", F.col("channel").alias("channel_b"), F.col("re").alias("rb"), F.col("im").alias("ib"))
    both = a.join(b, [*by, "seg"]).where("channel_a < channel_b").select(*by, "channel_a", "channel_b", F.posexplode(F.arrays_zip("ra", "ia", "rb", "ib")).alias("k", "x"))
    pair = both.select(*by, "channel_a", "channel_b", F.col("k").cast("long").alias("k"), "x.*")
    sums = pair.groupBy(*by, "channel_a", "channel_b", "k").agg(
        F.sum(F.col("ra") * F.col("rb") + F.col("ia") * F.col("ib")).alias("re"),
        F.sum(F.col("ia") * F.col("rb") - F.col("ra") * F.col("ib")).alias("im"),
        F.sum(F.col("ra") * F.col("ra") + F.col("ia") * F.col("ia")).alias("pa"),
        F.sum(F.col("rb") * F.col("rb") + F.col("ib") * F.col("ib")).alias("pb"),
    )
    den = F.col("pa") * F.col("pb")
    one = lambda x: F.when(den > eps, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return sums.select(*by, "channel_a", "channel_b", "k", one((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / den).alias("msc"), one(F.abs("im") / F.sqrt(den)).alias("imcoh"))


def line_noise(psd: DataFrame, center: float, half: float = 0.5, guard: float = 1.5, reach: float = 5.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(channel, peak, base, ratio): the mean around a mains frequency against its sidebands."""
    gap = F.abs(F.col("freq") - center)
    out = psd.groupBy(*by, "channel").agg(F.avg(F.when(gap <= half, F.col("p"))).alias("peak"), F.avg(F.when((gap >= guard) & (gap <= reach), F.col("p"))).alias("base"))
    return out.withColumn("ratio", F.when(F.col("base") > 1e-20, F.col("peak") / F.col("base")))
