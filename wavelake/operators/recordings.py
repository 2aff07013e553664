"""Recordings as long tables (channel, n, v), of several recordings with their key in `by`: references, statistics, artifacts, quality, labels, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources import shared
from . import scans, selection


#: Values of all groups together that exact aggregates may hold.
EXACT_ROWS = 1 << 22


def numbered(rows: DataFrame, by: list[str], time: str, order: list[str], span: str = "hour") -> DataFrame:
    """rows with n, their place from 0 within `by` in an order that begins with a time.

    Rows are numbered within spans of time (hours here), and each span starts where the counts of those before it end:
    a task holds a span of a channel, and only the counts of spans meet by channel.
    """
    cell = F.date_trunc(span, F.col(time).cast("timestamp")).alias("span")
    rows = rows.withColumn("span", cell)
    counts = rows.groupBy(*by, "span").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy(*by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "span", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    within = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by, "span").orderBy(*order)) - 1)
    same = [within[c].eqNullSafe(starts[c]) for c in [*by, "span"]]
    keep = [within[c] for c in rows.columns if c != "span"]
    return within.join(starts, same).select(*keep, (within["n"] + starts["before"]).alias("n"))


def numbered_within(rows: DataFrame, block: str, order: str, by: str | None = None) -> DataFrame:
    """rows with n, their place from 0 by blocks and then by an order within them, as a file's splits have their lines; `by`: each has its own count."""
    keys = [by] if by else []
    counts = rows.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_held"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = counts.select(*keys, block, F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    within = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys, block).orderBy(order)) - 1)
    return within.join(starts, [*keys, block]).withColumn("n", F.col("n") + F.col("_before")).drop("_before")


def filled(rows: DataFrame, by: list[str], block: str, order: str, value: str) -> DataFrame:
    """As forward_fill, within blocks; a block's first nulls take the last value of the blocks before it."""
    w = Window.partitionBy(*by, block).orderBy(order)
    last = rows.groupBy(*by, block).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    carry = last.select(*by, block, F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    out = rows.withColumn(value, F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).join(carry, [*by, block])
    return out.withColumn(value, F.coalesce(value, "_carry", F.lit(0.0))).drop("_carry")


def average_reference(rec: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each sample less its mean over channels: one shuffle by sample, means are combined before it."""
    means = rec.groupBy(*by, "n").agg(F.avg("v").alias("m"))
    return rec.join(means, [*by, "n"]).select(*by, "channel", "n", (F.col("v") - F.col("m")).alias("v"))


def field_power(rec: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(n, gfp): population deviation over channels."""
    return rec.groupBy(*by, "n").agg(F.stddev_pop("v").alias("gfp"))


def peaks(series: DataFrame, value: str, order: str, chunk: int = 65536) -> DataFrame:
    """Interior local maxima of a series (above the value before, not below that after); chunks with one row of overlap keep tasks bounded."""
    at = F.floor(F.col(order) / chunk)
    edge = F.when(F.col(order) % chunk == chunk - 1, F.array(at, at + 1)).when(F.col(order) % chunk == 0, F.array(at, at - 1)).otherwise(F.array(at))
    w = Window.partitionBy("chunk").orderBy(order)
    rows = series.withColumn("chunk", F.explode(edge)).withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))
    return rows.where((F.col("chunk") == at) & (F.col(value) > F.col("before")) & (F.col(value) >= F.col("after"))).drop("chunk", "before", "after")


def statistics(rec: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per channel, of finite values: n, min, max, ptp, mean, population and sample deviation; and how many are not finite."""
    ok = scalar.finite(F.col("v"))
    v = F.when(ok, F.col("v"))
    return rec.groupBy(*by, "channel").agg(
        F.count(v).alias("n"), F.count_if(~ok).alias("n_bad"), F.min(v).alias("min_v"), F.max(v).alias("max_v"), (F.max(v) - F.min(v)).alias("ptp"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd_pop"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd_samp")
    )


def robust(rec: DataFrame, by: list[str], value: str = "v", scale=scalar.robust_scale, small: bool = False, kept: bool = False) -> DataFrame:
    """by, median and scale: exact quantiles in two rounds; `small` says that groups are known to be short, so that an exact aggregate may hold them.

    Otherwise the rounds read the values from a table in the shared folder; `kept` says that rec is one already. Its rows
    are counted, as files tell, and up to EXACT_ROWS of them one aggregate holds as well.
    """
    if not small:
        rec = rec if kept else shared.written(rec.select(*by, value), "values")
        small = rec.count() <= EXACT_ROWS
    if small:
        med = rec.groupBy(*by).agg(F.expr(f"percentile({value}, 0.5)").alias("median"), F.stddev_samp(value).alias("sd"))
        out = rec.join(med, by).groupBy(*by).agg(F.expr(f"percentile(abs({value} - median), 0.5)").alias("mad"), F.first("median").alias("median"), F.first("sd").alias("sd"))
    else:
        med = selection.quantiles(rec, by, value, {"median": 0.5})
        far = rec.join(med, by).withColumn("_far", F.abs(F.col(value) - F.col("median")))
        # the deviation rides along with the second round; groups without a value have neither
        out = rec.groupBy(*by).agg(F.stddev_samp(value).alias("sd")).join(med, by, "left").join(selection.quantiles(far, by, "_far", {"mad": 0.5}), by, "left")
    args = (F.col("mad"), F.col("sd")) if scale is scalar.robust_scale else (F.col("mad"), F.col("sd"), F.col("median"))
    return out.select(*by, "median", scale(*args).alias("scale"))


def windows(rec: DataFrame, size: int, step: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(channel, w, ptp, rms, kurtosis) of complete windows; kurtosis is excess, 0 where the variance is about 0."""
    last = F.floor(F.col("n") / step)
    first = F.greatest(F.ceil((F.col("n") - (size - 1)) / step), F.lit(0))
    rows = rec.withColumn("w", F.explode(F.when(first <= last, F.sequence(first, last))))
    out = rows.groupBy(*by, "channel", "w").agg(
        F.count(F.lit(1)).alias("size"), (F.max("v") - F.min("v")).alias("ptp"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.when(F.var_pop("v") > 1e-24, F.kurtosis("v")).otherwise(0.0).alias("kurtosis")
    )
    return out.where(F.col("size") == size).drop("size")


def artifacts(features: DataFrame, baseline_windows: int, limit: float = 6.0, low: float | None = None, least_channels: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """features with z scores against each channel's first windows (all of them if there are none), and a flag of the channel's window.

    window_bad holds where at least `least_channels` channels are bad in one window; `low` flags windows that are too quiet as well.
    """
    names = ["ptp", "rms", "kurtosis"]
    long = features.unpivot([*by, "channel", "w"], names, "feature", "x")
    use = long.withColumn("early", F.col("w") < baseline_windows)
    some = use.groupBy(*by, "channel").agg(F.bool_or("early").alias("some"))
    base = use.join(some, [*by, "channel"]).where("early or not some")
    z = long.join(robust(base, [*by, "channel", "feature"], "x", scalar.artifact_scale, small=True), [*by, "channel", "feature"], "left").withColumn("z", (F.col("x") - F.coalesce("median", F.lit(0.0))) / F.coalesce("scale", F.lit(1.0)))
    wide = z.groupBy(*by, "channel", "w").agg(*(F.max(F.when(F.col("feature") == n, F.col("z"))).alias(f"{n}_z") for n in names))
    bad = (F.col("ptp_z") > limit) | (F.col("rms_z") > limit) | (F.col("kurtosis_z") > limit)
    if low is not None:
        bad = bad | (F.col("ptp_z") < -low) | (F.col("rms_z") < -low)
    wide = wide.withColumn("bad", bad)
    if least_channels <= 1:
        return wide
    windows = wide.groupBy(*by, "w").agg(F.count_if("bad").alias("n_bad"))
    return wide.join(windows, [*by, "w"]).withColumn("window_bad", F.col("n_bad") >= least_channels)


def quality(stats: DataFrame, scales: DataFrame, flat_ptp: float = 1.0, flat: float = 0.02, noisy: float = 10.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Per channel: flat and noisy flags against the typical scale, and reasons. There is a row for each channel only."""
    typical = scales.groupBy(*by).agg(F.expr("percentile(scale, 0.5)").alias("t")).select(*by, F.when(F.col("t") > 1e-12, F.col("t")).otherwise(1.0).alias("t"))
    rows = stats.join(scales.select(*by, "channel", "scale"), [*by, "channel"])
    rows = rows.join(typical, list(by)) if by else rows.crossJoin(F.broadcast(typical))
    is_flat = (F.col("ptp") < flat_ptp) | (F.col("scale") < flat * F.col("t"))
    is_noisy = F.col("scale") > noisy * F.col("t")
    return rows.select(*by, "channel", "ptp", "scale", is_flat.alias("flatline"), is_noisy.alias("noisy"), (is_flat | is_noisy).alias("bad"), F.concat_ws(";", F.when(is_flat, "flatline"), F.when(is_noisy, "noisy")).alias("reasons"))


def runs(rows: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """(by, label, first, last, n): runs of equal labels at consecutive places, by chunks of places."""
    return scans.runs(rows, by, order, label)


def transitions(rows: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """(from, to, n) between neighbouring different labels."""
    pairs = scans.neighbour(rows, by, order, label, "from_label").select("from_label", F.col(label).alias("to_label"))
    return pairs.where("from_label <> to_label").groupBy("from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))


def forward_fill(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Nulls take the last value before them; the first ones 0."""
    return scans.forward_filled(rows, by, order, value)


def reward_rate(rows: DataFrame, by: list[str], order: str, hit: Column, reach: int) -> DataFrame:
    """rows with `rate`, the share of hits among the last `reach` places (fewer at the start)."""
    w = Window.partitionBy(*by, "_chunk").orderBy(order).rangeBetween(1 - reach, 0)
    dealt = scans.overlapped(rows, order, reach - 1, scans.PLACES)
    return dealt.withColumn("rate", F.avg(hit.cast("double")).over(w)).where("_own").drop("_chunk", "_own")


def resample(rec: DataFrame, length: int, hold: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Each channel at `length` places, by linear interpolation or by holding."""
    sizes = rec.groupBy(*by, "channel").agg((F.max("n") + 1).alias("size"))
    grid = sizes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    at = F.col("j") * ((F.col("size") - 1) / max(1, length - 1)) if not hold else F.floor(F.col("j") * F.col("size") / length)
    grid = grid.withColumn("x", at.cast("double")).withColumn("n", F.least(F.floor("x"), F.col("size") - 1))
    nxt = rec.select(*by, "channel", (F.col("n") - 1).alias("n"), F.col("v").alias("v1"))
    both = grid.join(rec, [*by, "channel", "n"]).join(nxt, [*by, "channel", "n"], "left")
    t = F.col("x") - F.col("n")
    value = F.col("v") if hold else F.col("v") + t * (F.coalesce("v1", "v") - F.col("v"))
    return both.select(*by, "channel", F.col("j").alias("n"), value.alias("v"))


def frames(rows: DataFrame, last: str, size: int, step: int, burst: bool, chunk: int = 8192) -> DataFrame:
    """rows with end_n, the ends (samples so far) of the online frames up to `last` samples, exploded a chunk at a time.

    With burst, steps counted while the window fills are paid out one by one: frame j ends at max(size + j - 1, j * step).
    """
    first = F.lit(1) if burst else F.lit(-(-size // step))
    top = F.floor(F.col(last) / step)
    top = F.least(top, F.col(last) - size + 1) if burst else top
    some = rows.withColumn("low", first.cast("long")).withColumn("high", top.cast("long")).where("high >= low")
    some = some.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low")) / chunk)))).withColumn("from", F.col("low") + F.col("at") * chunk)
    some = some.withColumn("j", F.explode(F.sequence("from", F.least("high", F.col("from") + (chunk - 1)))))
    end = F.greatest(F.col("j") + (size - 1), F.col("j") * step) if burst else F.col("j") * step
    return some.select(*rows.columns, end.cast("long").alias("end_n"))


def topomap(values: DataFrame, montage: DataFrame, size: int, power: float = 2.0, eps: float = 1e-6) -> DataFrame:
    """(gx, gy, v) inside the unit disk: inverse-distance weights of the channels found in the montage (a table of fixed size)."""
    points = values.join(F.broadcast(montage.select("key", "x", "y")), "key").select("x", "y", "v")
    axis = lambda name, other: values.sparkSession.range(size).select(F.col("id").alias(name), (-1 + 2 * F.col("id") / (size - 1)).alias(other))
    grid = axis("gx", "px").crossJoin(axis("gy", "py")).where("px * px + py * py <= 1")
    d2 = (F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2
    rows = points.crossJoin(F.broadcast(grid)).withColumn("d2", d2)
    weight = 1 / F.pow(F.sqrt("d2"), F.lit(power))
    near = F.max(F.when(F.col("d2") <= eps * eps, F.col("v")))
    far = F.col("d2") > eps * eps
    return rows.groupBy("gx", "gy").agg(F.coalesce(near, F.sum(F.when(far, weight * F.col("v"))) / F.sum(F.when(far, weight))).alias("v"))
