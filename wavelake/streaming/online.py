"""Sliding frames of a recording (channel, n, v) and what is measured in them: band power, coherence, phase, coupling, artifacts.

A frame holds the last `window` seconds at its end. In a table, samples are dealt to their frames by arithmetic; in a stream, a
state for each channel keeps the last samples and gives the same frames. Measures are functions of frames, so they are
the same on both; measures of pairs take rows with all channels of a frame (`matrices` of a table, `live.frames` of a stream).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, specs
from ..operators import kernels, recordings, scans, selection
from ..sources import shared

EPS = 1e-12
#: Samples that are measured at once.
BLOCK = 1 << 18


def sizes(fs: float, window: float, update: float, clamp: bool = True) -> tuple[int, int]:
    """Samples in a window and between updates; updates longer than a window are shortened, or refused."""
    w, u = max(8, scalar.samples(window, fs)), max(1, scalar.samples(update, fs))
    if u > w and not clamp:
        raise ValueError("an update is longer than its window")
    return w, min(u, w)


def dealt(rec: DataFrame, size: int, step: int, burst: bool = True) -> DataFrame:
    """rec with end_n: each sample once for every frame (`recordings.frames`) that holds it, frames past a channel's last sample included.

    The frames are computed from the sample's place, so nothing is joined: a table of frames' places is as long as their
    samples, but Spark takes it for as small as the channels that it was exploded from, and would broadcast it.
    """
    n = F.col("n")
    low, high = F.ceil((n + 1) / step), F.floor((n + size) / step)
    low = F.greatest(F.least(n + (2 - size), low), F.lit(1)) if burst else F.greatest(low, F.lit(-(-size // step)))
    high = F.least(n + 1, high) if burst else high
    rows = rec.withColumn("_j", F.explode(F.when(low <= high, F.sequence(low.cast("long"), high.cast("long")))))
    end = F.greatest(F.col("_j") + (size - 1), F.col("_j") * step) if burst else F.col("_j") * step
    return rows.withColumn("end_n", end.cast("long")).drop("_j")


def frames(rec: DataFrame, size: int, step: int, burst: bool = True) -> DataFrame:
    """(channel, end_n, x): the samples of each complete frame, in order."""
    packed = dealt(rec, size, step, burst).groupBy("channel", "end_n").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("x"))
    return packed.where(F.size("x") == size).select("channel", "end_n", F.col("x.v").alias("x"))


def streamed(rows: DataFrame, size: int, step: int, burst: bool = True) -> DataFrame:
    """As frames, for a stream of samples: the state is a channel's last `size` samples and its counters; samples at or before the last one are dropped."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, count, held = state.get if state.exists else (-1, 0, [])
        ring = list(held)
        for batch in batches:
            out = []
            for n, v in batch.sort_values("n")[["n", "v"]].itertuples(index=False):
                if n <= last:
                    continue
                last, count = int(n), count + 1
                ring.append(float(v))
                del ring[:-size]
                if count >= step and (len(ring) == size or not burst):
                    count -= step
                    if len(ring) == size:
                        out.append((key[0], last + 1, list(ring)))
            yield pd.DataFrame(out, columns=["channel", "end_n", "x"])
        state.update((last, count, ring))

    return rows.groupBy("channel").applyInPandasWithState(run, "channel string, end_n long, x array<double>", "last long, count long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def band_frames(frames: DataFrame, fs: float, nperseg: int, bands: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """(channel, end_n, band, power): the frame's Welch spectrum under each band."""
    bands = bands or specs.bands()

    def powers(x: np.ndarray) -> tuple:
        f, p = kernels.welch(x, fs, nperseg)
        return tuple(kernels.area(f, p, lo, hi) for _, lo, hi in bands)

    schema = ", ".join(f"b{i} double" for i in range(len(bands)))
    rows = frames.select("channel", "end_n", measured1(powers, schema)("x").alias("p"))
    return rows.select("channel", "end_n", F.explode(F.array(*(F.struct(F.lit(b[0]).alias("band"), F.col(f"p.b{i}").alias("power")) for i, b in enumerate(bands)))).alias("r")).select("channel", "end_n", "r.*")


def measured1(f, schema: str):
    """A pandas UDF that gives f's tuple for each array."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(np.asarray(v, float)) for v in x], columns=names)

    run.__annotations__ = {"x": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, schema)


def measured2(f, schema: str):
    """The same for pairs of arrays."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(x, y, strict=True)], columns=names)

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, schema)


def matrices(frames: DataFrame) -> DataFrame:
    """(end_n, channels, xs) of a table's frames, channels in order; a stream has them from `live.frames`."""
    packed = frames.groupBy("end_n").agg(F.array_sort(F.collect_list(F.struct("channel", "x"))).alias("m"))  # a frame's channels
    return packed.select("end_n", F.col("m.channel").alias("channels"), F.col("m.x").alias("xs"))


def measured_pairs(rows: DataFrame, prepare, measure, names: list[str]) -> DataFrame:
    """(channel_a, channel_b, keys, names): a measure of all pairs of channels of (keys, channels, xs), each channel prepared once. Row by row, so for tables and streams alike."""
    keys = [c for c in rows.columns if c not in ("channels", "xs")]
    kinds = dict(rows.dtypes)
    schema = ", ".join(["channel_a string", "channel_b string", *(f"`{c}` {kinds[c]}" for c in keys), *(f"{n} double" for n in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, channels, xs in zip(batch[keys].itertuples(index=False), batch["channels"], batch["xs"], strict=True):
                ready = [(c, prepare(np.asarray(v, float))) for c, v in sorted(zip(channels, xs, strict=True), key=lambda p: p[0])]
                out += [(a, b, *key, *measure(p, q)) for i, (a, p) in enumerate(ready) for b, q in ready[i + 1 :]]
            yield pd.DataFrame(out, columns=["channel_a", "channel_b", *keys, *names])

    return rows.mapInPandas(run, schema)


def paired(frames: DataFrame) -> DataFrame:
    a = frames.select("end_n", F.col("channel").alias("channel_a"), F.col("x").alias("x"))
    b = frames.select("end_n", F.col("channel").alias("channel_b"), F.col("x").alias("y"))
    return a.join(b, "end_n").where("channel_a < channel_b")


def coherence_frames(frames: DataFrame, fs: float, nperseg: int, low: float, high: float) -> DataFrame:
    """(channel_a, channel_b, end_n, msc, imcoh): a pair's mean coherence in a band of the frame's spectra; frames by channel (of a table) or with all channels in a row (also of a stream)."""

    def mean(x: np.ndarray, y: np.ndarray) -> tuple:
        f, msc, im = kernels.coherence(x, y, fs, nperseg)
        width = kernels.covered(f, low, high)
        return tuple(kernels.area(f, v, low, high) / width if width > 0 else 0.0 for v in (msc, im))

    if "xs" in frames.columns:
        return measured_pairs(frames, lambda x: x, mean, ["msc", "imcoh"])
    return paired(frames).select("channel_a", "channel_b", "end_n", measured2(mean, "msc double, imcoh double")("x", "y").alias("r")).select("channel_a", "channel_b", "end_n", "r.*")


def phase_frames(frames: DataFrame, fs: float, low: float, high: float, trim: float = 0.1) -> DataFrame:
    """(channel_a, channel_b, end_n, plv, pli, wpli, wpli2)."""

    def one(x: np.ndarray) -> np.ndarray:
        return kernels.analytic(kernels.bandpass(x, fs, low, high))[kernels.trimmed(len(x), trim)]

    if "xs" in frames.columns:
        return measured_pairs(frames, one, lambda a, b: kernels.phase_measures(a, b).values(), ["plv", "pli", "wpli", "wpli2"])
    schema = "plv double, pli double, wpli double, wpli2 double"
    return paired(frames).select("channel_a", "channel_b", "end_n", measured2(lambda x, y: tuple(kernels.phase_measures(one(x), one(y)).values()), schema)("x", "y").alias("r")).select("channel_a", "channel_b", "end_n", "r.*")


def pac_frames(frames: DataFrame, fs: float, phase: tuple[float, float], amplitude: tuple[float, float]) -> DataFrame:
    """(channel, end_n, mi, mvl)."""

    def one(x: np.ndarray) -> tuple:
        r = kernels.pac(x, fs, phase, amplitude)
        return r["mi"], r["mvl"]

    return frames.select("channel", "end_n", measured1(one, "mi double, mvl double")("x").alias("r")).select("channel", "end_n", "r.*")


def coupling_summary(frames: DataFrame, fs: float, phase: tuple[float, float], amplitude: tuple[float, float], bins: int = 18) -> DataFrame:
    """(channel, n_frames, mean, median, min, max, distribution): the modulation index over a channel's finite frames, and the mean of their amplitude shares by phase bin.

    Frames of one length are measured together, and all once: the index and the shares of a frame are written to the
    shared folder for the passes over them. The shares are summed by bin before the shuffle, so what meets by channel
    is a number for each bin.
    """

    def run(x: pd.Series) -> pd.DataFrame:
        mi, shares = np.full(len(x), np.nan), np.full((len(x), bins), np.nan)
        sizes = x.map(len).to_numpy()
        for size in np.unique(sizes[sizes > 0]):
            same, most = np.flatnonzero(sizes == size), max(1, BLOCK // int(size))
            for i in range(0, len(same), most):
                part = same[i : i + most]
                mi[part], _, shares[part] = kernels.pac_rows(np.stack([np.asarray(x.iloc[j], float) for j in part]), fs, phase, amplitude, bins)
        return pd.DataFrame({"mi": mi, "bins": list(shares)})

    run.__annotations__ = {"x": pd.Series, "return": pd.DataFrame}
    measured = F.pandas_udf(run, "mi double, bins array<double>")
    rows = frames.select("channel", measured("x").alias("r")).select("channel", "r.mi", "r.bins")
    rows = shared.written(rows, "coupling").where("mi is not null and not isnan(mi)")
    middle = selection.quantiles(rows, ["channel"], "mi", {"median": 0.5})
    sums = rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n_frames"), F.avg("mi").alias("mean"), F.min("mi").alias("min"), F.max("mi").alias("max"))
    shares = rows.select("channel", F.posexplode("bins").alias("bin", "share")).groupBy("channel", "bin").agg(F.avg("share").alias("share"))
    shares = shares.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("bin", "share"))).alias("d"))
    return sums.join(middle, "channel").join(shares, "channel").select("channel", "n_frames", "mean", "median", "min", "max", F.col("d.share").alias("distribution"))


def artifact_gate(rec: DataFrame, fs: float, size: int, step: int, baseline: float, limit: float = 6.0, least: int = 1, ignore: list[str] | None = None) -> DataFrame:
    """(end_n, ready, bad_channels, artifact, max_ptp_z, max_rms_z, max_kurtosis_z) of each frame.

    Medians and scales come from the frames that end within the baseline; later frames are ready. Without such frames
    nothing is subtracted and the scale is 1. At most as many bad channels are asked for as there are.
    """
    rec = rec.where(~F.col("channel").isin(ignore)) if ignore else rec
    lasts = rec.groupBy("channel").agg((F.max("n") + 1).alias("last"))
    rows = dealt(rec, size, step)
    names = ["ptp", "rms", "kurtosis"]
    features = rows.groupBy("channel", "end_n").agg((F.max("v") - F.min("v")).alias("ptp"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.when(F.var_pop("v") > 1e-24, F.kurtosis("v")).otherwise(0.0).alias("kurtosis"))
    features = features.join(lasts, "channel").where("end_n <= last").drop("last")
    long = features.unpivot(["channel", "end_n"], names, "feature", "x")
    last = scalar.samples(baseline, fs)
    base = recordings.robust(long.where(F.col("end_n") <= last), ["channel", "feature"], "x", small=True)
    z = long.join(base, ["channel", "feature"], "left").withColumn("z", (F.col("x") - F.coalesce("median", F.lit(0.0))) / F.coalesce("scale", F.lit(1.0)))
    per = z.groupBy("end_n", "channel").agg(*(F.max(F.when(F.col("feature") == n, F.col("z"))).alias(n) for n in names), F.max("z").alias("top"))
    out = per.groupBy("end_n").agg(F.count_if(F.col("top") > limit).alias("bad_channels"), F.count(F.lit(1)).alias("have"), *(F.greatest(F.lit(0.0), F.max(n)).alias(f"max_{n}_z") for n in names))
    ready = F.col("end_n") > last
    return out.select("end_n", ready.alias("ready"), F.when(ready, F.col("bad_channels")).otherwise(0).alias("bad_channels"), (ready & (F.col("bad_channels") >= F.least(F.lit(least), F.col("have")))).alias("artifact"), *(F.when(ready, F.col(f"max_{n}_z")).otherwise(0.0).alias(f"max_{n}_z") for n in names))


def metric_values(bands: DataFrame, spec: str, log10: bool = False) -> DataFrame:
    """(end_n, metric) of a band, ratio or asymmetry over (channel, end_n, band, power); powers may be logarithms already."""
    m = specs.metric(spec)
    power = lambda channel, band: F.max(F.when((F.lower("channel") == channel.lower()) & (F.lower("band") == band.lower()), F.col("power")))
    if m.kind == "band":
        value: Column = power(m.channel, m.band)
    else:
        a, b = (power(m.channel, m.band), power(m.channel, m.other_band)) if m.kind == "ratio" else (power(m.channel, m.band), power(m.other_channel, m.band))
        value = a - b if log10 else (a + EPS) / (b + EPS)
        value = F.log10(value) if m.kind == "asymmetry" and not log10 else value
    return bands.groupBy("end_n").agg(value.alias("metric"))


def rolling_quantile(rows: DataFrame, by: list[str], seconds: str, value: str, window: float, q: float) -> DataFrame:
    """rows with `quantile`, over values less than `window` seconds old (those just that old are out)."""
    reach = int(round(window * 1e6))
    w = Window.partitionBy(*by, "_chunk").orderBy("_us").rangeBetween(1 - reach, 0)
    dealt = scans.overlapped(rows.withColumn("_us", scalar.micros(F.col(seconds))), "_us", reach, scans.SECONDS * 1_000_000)
    return dealt.withColumn("quantile", F.expr(f"percentile({value}, {q})").over(w)).where("_own").drop("_us", "_chunk", "_own")
