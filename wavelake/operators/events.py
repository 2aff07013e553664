"""Event tables (onset, duration, text): order, merging, slicing, overlaps, and events read off label or trigger columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming, scalar
from . import scans


def normalized(events: DataFrame) -> DataFrame:
    """Onsets that aren't finite become 0; durations that aren't, or are negative, too."""
    good = scalar.finite(F.col("duration")) & (F.col("duration") >= 0)
    return events.withColumns({"onset": F.when(scalar.finite(F.col("onset")), F.col("onset")).otherwise(0.0), "duration": F.when(good, F.col("duration")).otherwise(0.0)})


def keys() -> list[Column]:
    """What makes two events equal: microseconds and trimmed text."""
    return [scalar.micros(F.col("onset")), scalar.micros(F.col("duration")), F.trim("text")]


def in_order(events: DataFrame, reader: bool = False) -> DataFrame:
    """By onset, longer ones first, then text; as readers have it, shorter ones first, by exact seconds."""
    if reader:
        return events.orderBy("onset", "duration", "text")
    onset, duration, text = keys()
    return events.orderBy(onset, duration.desc(), text)


def deduplicated(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of equal events of `by` the one with the least ordinal stays, with all its columns: an aggregate, so repeats meet before the shuffle."""
    names = ["_onset_us", "_duration_us", "_trimmed"]
    rest = [c for c in events.columns if c not in by]
    rows = events.select(*events.columns, *(k.alias(n) for k, n in zip(keys(), names, strict=True)))
    return rows.groupBy(*by, *names).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*by, "r.*").select(*events.columns)


def merged(first: DataFrame, second: DataFrame, by: list[str], order: str) -> DataFrame:
    """Both tables' events once each; the first table's stay where both have one."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    both = both.withColumn("_at", F.struct("_side", order))
    return deduplicated(both, by, "_at").drop("_side", "_at")


def slice_samples(rec: DataFrame, start: int, end: int) -> DataFrame:
    """Samples [start, end) of a recording, numbered from 0."""
    start = max(0, start)
    return rec.where((F.col("n") >= start) & (F.col("n") < end)).withColumn("n", F.col("n") - start)


def slice_seconds(rec: DataFrame, fs: float, start: float, end: float) -> DataFrame:
    return slice_samples(rec, scalar.samples(start, fs), scalar.samples(end, fs))


def overlaps(spans: DataFrame, events: DataFrame, by: list[str], width: float) -> DataFrame:
    """spans (by, start, end, ...) with each event of `by` that touches them, cut to the span: (..., onset, duration, text).

    Both sides are dealt into cells of `width`, so the join is by equality; a pair is kept in the first cell that both reach.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    stop = F.col("onset") + F.greatest("duration", F.lit(0.0))
    left = spans.select("*", cells(F.col("start"), F.col("end")).alias("_cell"))
    right = events.select(*by, F.col("onset").alias("_onset"), stop.alias("_stop"), "text", cells(F.col("onset"), stop).alias("_cell"))
    both = left.join(right, [*by, "_cell"])
    touch = (F.col("_onset") < F.col("end")) & ((F.col("_stop") > F.col("start")) | ((F.col("_stop") == F.col("_onset")) & (F.col("_onset") >= F.col("start"))))
    first = F.col("_cell") == F.floor(F.greatest("start", "_onset") / width)
    a, b = F.greatest("_onset", "start"), F.least("_stop", "end")
    return both.where(touch & first).withColumns({"onset": a, "duration": b - a}).drop("_cell", "_onset", "_stop")


def as_of(frames: DataFrame, gates: DataFrame, by: list[str], fs: float) -> DataFrame:
    """frames (by, t) with the gate row of the same sample, that is within half a sample of t; others get nulls. Both ends emit at whole samples, so the join is by equality."""
    at = F.round(F.col("t") * fs).cast("long")
    return frames.withColumn("_n", at).join(gates.withColumn("_n", at).drop("t"), [*by, "_n"], "left").drop("_n")


def as_of_once(frames: DataFrame, gates: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """frames (by, t, ...) with the columns of the first gate (by, t, ...) not yet taken that is at most `tolerance` seconds away; others get nulls.

    Frames take gates in order of time, and each gate serves one frame, whatever the two grids are. Where neighbours of
    the merged times are further apart than the tolerance nothing passes, so each stretch between such gaps is walked by
    itself: times and numbers only, the rows follow by their times. Times of a key differ within frames and within gates
    (at a microsecond).
    """
    us = lambda t: F.round(t * 1_000_000).cast("long")
    key = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    both = frames.select(*key, (us(F.col("t")) * 2 + 1).alias("_at")).unionByName(gates.select(*key, (us(F.col("t")) * 2).alias("_at")))
    reach = round(tolerance * 1_000_000)
    size = scans.SECONDS * 2_000_000
    near = scans.neighbour(both, names, "_at", "_at", "_was", size=size)
    heads = near.withColumn("_head", F.when(F.col("_was").isNull() | (F.floor(F.col("_at") / 2) - F.floor(F.col("_was") / 2) > reach), F.col("_at")))
    stretch = scans.forward_filled(heads, names, "_at", "_head", None, size)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        at = pdf["_at"].to_numpy()
        waiting, out, low = [int(a) // 2 for a in at if a % 2 == 0], [], 0
        for t in (int(a) // 2 for a in at if a % 2):
            while low < len(waiting) and waiting[low] < t - reach:
                low += 1
            if low < len(waiting) and waiting[low] <= t + reach:
                out.append((t, waiting[low]))
                low += 1
        keys = pdf.iloc[0][names]
        return pd.DataFrame([(*keys, *x) for x in out], columns=[*names, "_frame", "_gate"])

    kinds = dict(both.dtypes)
    pairs = stretch.groupBy(*names, "_head").applyInPandas(walk, ", ".join([*(f"{n} {kinds[n]}" for n in names), "_frame long", "_gate long"]))
    rest = [c for c in gates.columns if c not in (*by, "t")]
    right = gates.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), us(F.col("t")).alias("_gate"), *rest)
    taken = pairs.join(right.withColumnRenamed("_gate", "_right"), [F.col("_gate") == F.col("_right"), *(F.col(f"_k{i}").eqNullSafe(F.col(f"_g{i}")) for i in range(len(by)))]).select(*names, "_frame", *rest)
    same = [us(F.col("t")) == F.col("_frame"), *(F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by))]
    return frames.join(taken, same, "left").select(*frames.columns, *rest)


def true_segments(frames: DataFrame, by: list[str], time: str, flag: str) -> DataFrame:
    """(by, onset, duration) of runs of true frames; a run ends at the first false frame after it, or at the last frame; runs without length go."""
    rows = scans.neighbour(frames, by, time, flag, "_was", size=scans.SECONDS).where(F.col(flag) != F.coalesce("_was", F.lit(False)))
    last = frames.groupBy(*by).agg(F.max(time).alias("_last"))
    edges = scans.neighbour(rows, by, time, time, "_next", back=False, size=scans.SECONDS).where(F.col(flag)).join(last, by)
    out = edges.select(*by, F.col(time).alias("onset"), (F.coalesce("_next", "_last") - F.col(time)).alias("duration"))
    return out.where("duration > 0")


def marker_events(rows: DataFrame, by: list[str], time: str, label: str) -> DataFrame:
    """(by, onset, duration, text): a point event where a label changes into one that isn't empty (or 0)."""
    text = F.trim(F.coalesce(F.col(label).cast("string"), F.lit("")))
    text = F.when(text.rlike(r"^[+-]?0+(\.0*)?$"), "").otherwise(text)
    out = scans.neighbour(rows.withColumn("_text", text), by, time, "_text", "_before", size=scans.SECONDS).where("_text <> '' and _text <> coalesce(_before, '')")
    return out.select(*by, F.col(time).alias("onset"), F.lit(0.0).alias("duration"), F.col("_text").alias("text"))


def segment_events(rows: DataFrame, by: list[str], time: str, label: str, step: float) -> DataFrame:
    """(by, onset, duration, text): an event from where a label begins to the sample after its last one."""
    rows = rows.select(*by, time, F.trim(F.coalesce(F.col(label).cast("string"), F.lit(""))).alias("_text"))
    out = scans.runs(rows, by, time, "_text", scans.SECONDS).where("_text <> ''")
    return out.select(*by, F.col("first").alias("onset"), (F.col("last") - F.col("first") + step).alias("duration"), F.col("_text").alias("text"))


def codes(v: Column, mask: int = 0, zero: float = 0.5) -> Column:
    """Trigger codes of samples: rounded, masked, 0 where they are about 0 or not finite."""
    code = F.when(scalar.finite(v), F.round(v).cast("long")).otherwise(0)
    code = code.bitwiseAND(F.lit(mask)) if mask else code
    return F.when(F.abs(code) > zero, code).otherwise(0)


def trigger_events(rec: DataFrame, by: list[str], fs: float, mask: int = 0, ignore_zero: bool = True) -> DataFrame:
    """(by, onset, duration, text) of runs of one code in (by, n, v); the run at sample 0 is a state, no event."""
    rows = rec.withColumn("_code", codes(F.col("v"), mask))
    starts = scans.neighbour(rows, by, "n", "_code", "_was").where("_was is null or _was <> _code")
    total = rec.groupBy(*by).agg((F.max("n") + 1).alias("_total"))
    runs = scans.neighbour(starts, by, "n", "n", "_end", back=False).join(total, by).where("n > 0")
    runs = runs.where("_code <> 0") if ignore_zero else runs
    return runs.select(*by, (F.col("n") / fs).alias("onset"), ((F.coalesce("_end", "_total") - F.col("n")) / fs).alias("duration"), F.col("_code").cast("string").alias("text"))


def debounced(events: DataFrame, by: list[str], least: float) -> DataFrame:
    """Events of which none of the same text was kept less than `least` seconds before: of each text's chain of close events every one that is far enough from the last kept one.

    An event `least` seconds or more after the one before it is kept whatever came earlier, so each stretch of closer
    events is walked by itself.
    """
    keys = [*by, "text"]
    rows = events.groupBy(*keys, "onset").agg(F.min("duration").alias("duration"))  # of one time the first is kept
    near = scans.neighbour(rows, keys, "onset", "onset", "_was", size=scans.SECONDS)
    heads = near.withColumn("_head", F.when(F.col("_was").isNull() | (F.col("onset") - F.col("_was") >= least), F.col("onset")))
    stretch = scans.forward_filled(heads, keys, "onset", "_head", None, scans.SECONDS)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("onset")
        keep, last = [], None
        for t in pdf["onset"]:
            keep.append(last is None or t - last >= least)
            last = t if keep[-1] else last
        return pdf[keep]

    kinds = dict(events.dtypes)
    out = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "onset", "duration", "text"])
    return stretch.groupBy(*keys, "_head").applyInPandas(lambda pdf: walk(pdf)[[*by, "onset", "duration", "text"]], out)


def trigger_scores(rec: DataFrame, mask: int = 0) -> DataFrame:
    """(channel, near_integer, nonzero, unique, score): how much a channel looks like one of trigger codes: whole numbers, few of them, mostly 0."""
    ok = rec.where(scalar.finite(F.col("v"))).withColumn("_code", codes(F.col("v"), mask))
    few = ok.groupBy("channel", "_code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("v") - F.round("v")) <= 1e-3).alias("whole"))
    sums = few.groupBy("channel").agg(
        (F.sum("whole") / F.sum("n")).alias("near_integer"),
        (F.sum(F.when(F.col("_code") != 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("nonzero"),
        F.count(F.lit(1)).alias("unique"),
        (F.max("_code") - F.min("_code")).alias("span"),
    )
    good = (F.col("span") > 0) & (F.col("near_integer") >= 0.98) & F.col("unique").between(2, 1024)
    score = F.col("near_integer") * (1 - F.col("nonzero")) * F.log(F.col("span") + 1.0) / F.log(F.col("unique") + 2.0)
    return sums.select("channel", "near_integer", "nonzero", "unique", F.when(good, score).otherwise(0.0).alias("score"))


def trigger_channel(rec: DataFrame, mask: int = 0) -> DataFrame:
    """The channel with the best score among those named like triggers, or else like auxiliary ones; no row if none scores."""
    key = naming.normalize(F.col("channel"))
    rank = F.when(key.rlike("^(trig|sti|marker|event|status|din|digital)"), 0).when(key.rlike("^(aux|misc)"), 1)
    scores = trigger_scores(rec, mask).withColumn("_rank", rank).where("_rank is not null and score > 0")
    return scores.orderBy("_rank", F.desc("score"), "channel").limit(1).drop("_rank")


def epochs(rec: DataFrame, events: DataFrame, fs: float, start: float, end: float) -> DataFrame:
    """(event_id, channel, at, v): samples from `start` to `end` seconds around each onset, numbered from the epoch's first; only whole epochs.

    Epochs are exploded into the samples they want and meet the recording by equality; sorted, as what was exploded looks
    small enough to be broadcast.
    """
    size = scalar.samples(end - start, fs)
    want = events.select("event_id", F.round((F.col("onset") + start) * fs).cast("long").alias("_first")).where("_first >= 0")
    want = want.select("event_id", "_first", F.explode(F.sequence("_first", F.col("_first") + size - 1)).alias("n"))
    rows = want.join(rec.hint("merge"), "n").select("event_id", "channel", (F.col("n") - F.col("_first")).alias("at"), "v")
    whole = rows.groupBy("event_id", "channel").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).drop("_n")
    return rows.join(whole, ["event_id", "channel"], "left_semi")
