"""Registered queries of channels and their files: phase locking, filters, alpha peaks, microstate labels, loops, maps, sidecars, tables that are written and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import epochs, microstates, recordings, signals, spectra, tables
from ..sources import shared, tabular, writers
from ..streaming import feedback, online
from .more import BANDS
from .queries import FLAGS, FS, HOP, PSD, SEG, SIGNAL, TRANSFORM, psd, r6, read, signal
from .recorded import subjects

#: Three maps over the five event types, in order of their names.
MAPS = np.array([[1.0, -1.0, 0.5, 0.0, 0.0], [0.0, 1.0, 1.0, -1.0, -1.0], [2.0, 0.0, -1.0, -1.0, 0.5]])


def names(spark, sf_dir) -> list[str]:
    return [r[0] for r in read(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]  # the channels


def phase_locking(spark, sf_dir):
    """PLV, PLI and wPLI of all pairs of channels at each bin, over the segments of the transforms."""
    t = spectra.transforms(signal(spark, sf_dir), SEG, HOP)
    z = t.select("channel", F.col("seg").alias("n"), F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select("k", "channel", "n", "z.re", "z.im").where("k between 1 and 31")  # the first and last are real
    return r6(signals.locked(z, ["k"]), "plv", "pli", "wpli", "wpli2")


def causal_filter(spark, sf_dir):
    """A highpass at 1 Hz and a lowpass at 12 Hz, forward only, single precision between them."""
    rows = signals.filtered(signal(spark, sf_dir), signals.stages(FS, low=1.0, high=12.0), zero_phase=False)
    return rows.select("channel", "n", F.round("v", 3).alias("v"))


def zero_phase_filter(spark, sf_dir):
    """Notch and band pass, forward and backward, of every subject."""
    rows = signals.preprocessed(subjects(spark, sf_dir), FS, True, 50.0, 1.0, 30.0, by=("recording",))
    return rows.select("recording", "channel", "n", F.round("v", 3).alias("v"))


def phase_measures(spark, sf_dir):
    """PLV, PLI and wPLI of band-passed analytic signals."""
    rec = subjects(spark, sf_dir)
    return r6(signals.phase_pairs(rec, FS, 8.0, 12.0, ["recording"]), "plv", "pli", "wpli", "wpli2")


def alpha_peaks(spark, sf_dir):
    """The alpha peak over a trend fitted outside it, and the centre of gravity."""
    return r6(signals.alpha_peaks(psd(spark, sf_dir)).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("iaf", "cog")}), "iaf", "cog")


def microstate_labels(spark, sf_dir):
    """Each sample's best of three maps."""
    return r6(microstates.assigned(signal(spark, sf_dir), MAPS, names(spark, sf_dir)), "corr", "gfp")


def feedback_loop(spark, sf_dir):
    """The loop over every event's value, a session for each type, with the quantile threshold."""
    frames = signal(spark, sf_dir).select(F.col("channel").alias("session"), (F.col("n") / 4).alias("t"), F.col("v").alias("metric"), (F.col("v") > 60).alias("artifact"))
    return r6(feedback.replay(frames, feedback.Settings(adapt="quantile", eta=0.5, hysteresis=0.5, on_count=2)), "metric", "threshold", "rate", "feedback")


def coherence_frames(spark, sf_dir):
    """Coherence of all pairs in every frame of four segments."""
    f = online.matrices(online.frames(signal(spark, sf_dir), 160, HOP))
    return r6(online.coherence_frames(f, FS, SEG, 8.0, 12.0), "msc", "imcoh")


def phase_frames(spark, sf_dir):
    f = online.matrices(online.frames(signal(spark, sf_dir), 160, HOP))
    return r6(online.phase_frames(f, FS, 8.0, 12.0), "plv", "pli", "wpli", "wpli2")


def coupling_frames(spark, sf_dir):
    """Coupling of phase at 4 to 8 Hz and amplitude at 20 to 40 Hz in every frame."""
    return r6(online.pac_frames(online.frames(signal(spark, sf_dir), 160, 64), FS, (4.0, 8.0), (20.0, 40.0)), "mi", "mvl")


def coupling_summary(spark, sf_dir):
    rows = online.coupling_summary(online.frames(signal(spark, sf_dir), 160, 64), FS, (4.0, 8.0), (20.0, 40.0))
    return r6(rows, "mean", "median", "min", "max").withColumn("distribution", F.transform("distribution", lambda x: F.round(x, 6)))


def loop_counters(spark, sf_dir):
    frames = signal(spark, sf_dir).select(F.col("channel").alias("session"), (F.col("n") / 4).alias("t"), F.col("v").alias("metric"), (F.col("v") > 60).alias("artifact"))
    o = feedback.Settings(eta=0.0)  # a threshold that stays: that of the baseline
    return r6(feedback.counters(frames, feedback.replay(frames, o), o), "threshold_init", "threshold_final", "reward_rate")


def clean_padded(spark, sf_dir):
    """What the bad windows leave, 10 samples off them, in pieces of at least 40."""
    flags = recordings.artifacts(recordings.windows(signal(spark, sf_dir), 50, 25), 10, 2.0).where("bad")
    bad = flags.select("channel", (F.col("w") * 25).alias("start"), (F.col("w") * 25 + 50).alias("end"))
    total = signal(spark, sf_dir).groupBy("channel").agg(F.count(F.lit(1)).alias("total"))
    return tables.clean_segments(bad, ["channel"], total, 10, 40).withColumnsRenamed({"start": "start_n", "end": "end_n"})


def half_seconds(spark, sf_dir):
    """Band power of half a second from every 96th sample on, in decibels against half a second that ends a quarter before it."""
    rec = signal(spark, sf_dir)
    sizes = rec.groupBy("channel").agg((F.max("n") + 1).alias("m")).agg(F.min("m").alias("total"))
    on = sizes.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 64) / 96))).alias("event_id")).select("event_id", (F.col("event_id") * 96 / FS).alias("onset"), F.lit(0.0).alias("duration"))
    return epochs.powers(rec, epochs.spans(on, sizes, FS, window=0.5, baseline=0.5, gap=0.25), FS, SEG, BANDS, "db")


def epoch_powers(spark, sf_dir):
    return half_seconds(spark, sf_dir).select("event_id", "channel", "band", F.round(F.log10("epoch_power"), 6).alias("log_power"), F.round("norm", 5).alias("norm"))


def epoch_summary(spark, sf_dir):
    rows = epochs.summary(half_seconds(spark, sf_dir))
    return rows.select("channel", "band", F.round(F.log10("mean_power"), 6).alias("log_power"), "n_epochs", F.round("mean_norm", 5).alias("mean_norm"), "n_norm")


def picked_channels(spark, sf_dir):
    """Two channels by names as users write them."""
    return writers.picked(signal(spark, sf_dir), ["EEG Click-REF", "VIEW"]).select("channel", "n", "v")


def segment_counts(spark, sf_dir):
    """The bad windows of each channel's artifact segments, joined over gaps of 25 samples."""
    flags = recordings.artifacts(recordings.windows(signal(spark, sf_dir), 50, 25), 10, 2.0).where("bad")
    rows = tables.merge_segments(flags.select("channel", (F.col("w") * 25).alias("start"), (F.col("w") * 25 + 50).alias("end")), ["channel"], 25, counted=True)
    return rows.select("channel", F.col("start").alias("start_n"), F.col("end").alias("end_n"), "n_ranges")


def mapped_channels(spark, sf_dir):
    """Samples under the names of a map: two renamed, one dropped, others kept."""
    mapping = spark.createDataFrame([("click", "Fz"), ("view", "Cz"), ("error", None)], "key string, target string")
    return writers.apply_map(signal(spark, sf_dir), mapping).select("channel", "n", "v")


def sample_table(spark, sf_dir):
    """A row of time and channels for each sample, as text tables have them."""
    return writers.recording_table(signal(spark, sf_dir), FS).withColumnRenamed("time", "t")


def channel_sidecar(spark, sf_dir):
    bad = recordings.statistics(signal(spark, sf_dir)).where("mean > 20.2").select("channel")
    return writers.bids_channels(signal(spark, sf_dir), FS, bad)


def event_file(spark, sf_dir):
    """Every event as a row of a tab-separated table, written and read back."""
    path = shared.scratch(spark, "events")
    e = read(spark, sf_dir, "events")
    tabular.write_events(e.select((F.col("event_id") / 8).alias("onset"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("duration"), F.concat_ws(" ", "event_type", "user_id").alias("text")), path)
    return tabular.read_events(spark, path)


def reference_file(spark, sf_dir):
    """The reference of every user and type as a table, written and read back."""
    path = shared.scratch(spark, "reference")
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("U"), "user_id").alias("channel"), F.upper("event_type").alias("band"), F.col("value").alias("v"))
    tables.reference(rows, ["channel", "band"]).write.option("header", True).csv(path)
    return r6(tabular.read_reference(spark, path).withColumn("n", F.col("n").cast("long")), "mean", "std")


CHANNELS = {f.__name__: f for f in (phase_locking, causal_filter, zero_phase_filter, phase_measures, alpha_peaks, microstate_labels, feedback_loop, coherence_frames, phase_frames, coupling_frames, coupling_summary, loop_counters, clean_padded, epoch_powers, epoch_summary, picked_channels, segment_counts, mapped_channels, sample_table, channel_sidecar, event_file, reference_file)}

SECTIONS = ", ".join(f"({i}, {', '.join(f'{float(x)!r}::DOUBLE' for x in s)})" for i, s in enumerate(signals.stages(FS, low=1.0, high=12.0)))
UNIT = MAPS - MAPS.mean(1, keepdims=True)
UNIT = UNIT / np.sqrt((UNIT * UNIT).sum(1, keepdims=True))
WEIGHTS = ", ".join(f"({j}, {i + 1}, {float(w)!r}::DOUBLE)" for j, row in enumerate(UNIT) for i, w in enumerate(row))
EPOCHS = f"""{SIGNAL}, o AS (SELECT k, k * 96 AS i0 FROM range(0, 1000000) r(k) WHERE k * 96 + 64 <= (SELECT min(m) FROM (SELECT max(n) + 1 AS m FROM sig GROUP BY channel))),
pt AS (SELECT k, 'e' AS part, i0 FROM o UNION ALL SELECT k, 'b', i0 - 96 FROM o WHERE k >= 1),
x AS (SELECT k, part, channel, n - i0 AS i, v - avg(v) OVER (PARTITION BY k, part, channel) AS v FROM pt JOIN sig ON n >= i0 AND n < i0 + 64),
ft AS (SELECT k, part, channel, q, sum(v * h * cos(2 * pi() * q * i / 64)) AS re, sum(v * h * sin(2 * pi() * q * i / 64)) AS im FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / 63) AS h FROM x), range(0, 33) r(q) GROUP BY ALL),
fp AS (SELECT k, part, channel, q * 2.0 AS f0, q * 2.0 + 2 AS f1, p AS p0, lead(p) OVER (PARTITION BY k, part, channel ORDER BY q) AS p1 FROM (SELECT *, (re * re + im * im) * CASE WHEN q IN (0, 32) THEN 1 ELSE 2 END / (128.0 * (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 63), 2)) FROM range(0, 64) h(i))) AS p FROM ft)),
fb AS (SELECT k, part, channel, band, sum(0.5 * (2 * p0 + (p1 - p0) / 2 * (greatest(f0, lo) - f0 + least(f1, hi) - f0)) * (least(f1, hi) - greatest(f0, lo))) AS power FROM fp, (VALUES ('alpha', 8.0, 12.0), ('beta', 13.0, 30.0)) b(band, lo, hi) WHERE p1 IS NOT NULL AND f1 > lo AND f0 < hi GROUP BY ALL),
ep AS (SELECT a.k AS event_id, a.channel, a.band, a.power, 10 * log10(a.power / b.power) AS norm FROM (SELECT * FROM fb WHERE part = 'e') a LEFT JOIN (SELECT * FROM fb WHERE part = 'b') b ON a.k = b.k AND a.channel = b.channel AND a.band = b.band)"""
CHANNELS_SQL = {
    "phase_locking": f"""WITH {TRANSFORM}, x AS (SELECT a.channel AS channel_a, b.channel AS channel_b, k, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM tr a JOIN tr b USING (seg, k) WHERE a.channel < b.channel),
s AS (SELECT channel_a, channel_b, k, avg(re / sqrt(re * re + im * im)) AS ur, avg(im / sqrt(re * re + im * im)) AS ui, avg(sign(im)) AS sg, sum(im) AS im, sum(abs(im)) AS ab, sum(im * im) AS sq FROM x WHERE k BETWEEN 1 AND 31 GROUP BY ALL)
SELECT k, channel_a, channel_b, round(least(1, sqrt(ur * ur + ui * ui)), 6) AS plv, round(abs(sg), 6) AS pli, round(abs(im) / ab, 6) AS wpli, round(greatest(0, least(1, (im * im - sq) / (ab * ab - sq))), 6) AS wpli2 FROM s""",
    "causal_filter": f"""WITH RECURSIVE {SIGNAL}, se(i, b0, b1, b2, a1, a2) AS (VALUES {SECTIONS}),
hp AS (SELECT channel, 0::BIGINT AS n, b0 * v::FLOAT AS y, b1 * v::FLOAT - a1 * (b0 * v::FLOAT) AS s1, b2 * v::FLOAT - a2 * (b0 * v::FLOAT) AS s2 FROM sig, se WHERE n = 0 AND i = 0
  UNION ALL SELECT sig.channel, sig.n, b0 * v::FLOAT + s1, b1 * v::FLOAT - a1 * (b0 * v::FLOAT + s1) + s2, b2 * v::FLOAT - a2 * (b0 * v::FLOAT + s1) FROM hp JOIN sig ON sig.channel = hp.channel AND sig.n = hp.n + 1 JOIN se ON i = 0),
h AS (SELECT channel, n, y::FLOAT AS v FROM hp),
lp AS (SELECT channel, 0::BIGINT AS n, b0 * v AS y, b1 * v - a1 * (b0 * v) AS s1, b2 * v - a2 * (b0 * v) AS s2 FROM h, se WHERE n = 0 AND i = 1
  UNION ALL SELECT h.channel, h.n, b0 * v + s1, b1 * v - a1 * (b0 * v + s1) + s2, b2 * v - a2 * (b0 * v + s1) FROM lp JOIN h ON h.channel = lp.channel AND h.n = lp.n + 1 JOIN se ON i = 1)
SELECT channel, n, round(y::FLOAT::DOUBLE, 3) AS v FROM lp""",
    "alpha_peaks": f"""WITH {PSD}, l AS (SELECT channel, freq AS f, log10(freq) AS x, 10 * log10(p) AS y FROM psd WHERE freq BETWEEN 2 AND 40),
g AS (SELECT channel, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l WHERE f < 7 OR f > 13 GROUP BY channel), d AS (SELECT channel, f, y - a - b * x AS y FROM l JOIN g USING (channel)),
w AS (SELECT *, lag(y) OVER u AS y0, lead(y) OVER u AS y2 FROM d WINDOW u AS (PARTITION BY channel ORDER BY f)), b AS (SELECT *, median(y) OVER (PARTITION BY channel) AS fl FROM w WHERE f BETWEEN 7 AND 13),
c AS (SELECT channel, sum(f * greatest(y - fl, 0)) / sum(greatest(y - fl, 0)) AS cog, arg_max(struct_pack(f := f, y := y, y0 := y0, y2 := y2, fl := fl), y) AS t FROM b GROUP BY channel),
r AS (SELECT channel, cog, t, t.y - t.fl >= 0.5 AND t.y >= t.y0 AND t.y >= t.y2 AS found FROM c)
SELECT channel, round(CASE WHEN found THEN t.f + 0.5 * (t.y0 - t.y2) / (t.y0 - 2 * t.y + t.y2) * 2 END, 6) AS iaf, round(cog, 6) AS cog, found FROM r""",
    "microstate_labels": f"""WITH {SIGNAL}, nm AS (SELECT channel, row_number() OVER (ORDER BY channel) AS c FROM (SELECT DISTINCT channel FROM sig)), w(j, c, w) AS (VALUES {WEIGHTS}),
f AS (SELECT channel, n, v - avg(v) OVER (PARTITION BY n) AS v FROM sig), d AS (SELECT n, j, abs(sum(v * w)) AS dot, sum(v * v) AS sq, count(*) AS c FROM f JOIN nm USING (channel) JOIN w USING (c) GROUP BY n, j),
b AS (SELECT n, any_value(sq) AS sq, any_value(c) AS c, arg_max(j, dot) AS j, max(dot) AS dot FROM d GROUP BY n)
SELECT n, CASE WHEN sq <= 1e-24 THEN -1 ELSE j END AS label, round(CASE WHEN sq <= 1e-24 THEN 0 ELSE dot / sqrt(sq) END, 6) AS corr, round(sqrt(sq / c), 6) AS gfp FROM b""",
    "clean_padded": f"""WITH {FLAGS}, tt AS (SELECT channel, count(*) AS total FROM sig GROUP BY channel),
bd AS (SELECT channel, greatest(w * 25 - 10, 0) AS s, least(w * 25 + 60, total) AS e FROM fl JOIN tt USING (channel) WHERE greatest(ptp_z, rms_z, kurtosis_z) > 2),
il AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY channel ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM bd),
mg AS (SELECT channel, min(s) AS s, max(e) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY channel ORDER BY s, e) AS g FROM il) GROUP BY channel, g),
ed AS (SELECT channel, s, e FROM mg UNION ALL SELECT channel, total, total FROM tt), c AS (SELECT channel, coalesce(lag(e) OVER (PARTITION BY channel ORDER BY s, e), 0) AS start_n, s AS end_n FROM ed)
SELECT * FROM c WHERE end_n - start_n >= 40""",
    "loop_counters": f"""WITH {SIGNAL}, f AS (SELECT channel AS session, n / 4 AS t, v, v > 60 AS bad FROM sig), b AS (SELECT session, quantile_cont(v, 0.4) AS th FROM f WHERE t <= 10 AND NOT bad GROUP BY session),
a AS (SELECT session, count(*) FILTER (t <= 10) AS baseline, count(*) FILTER (t > 10) AS training, count(*) FILTER (bad) AS artifact, count(*) FILTER (t > 10 AND NOT bad) AS valid, count(*) FILTER (t > 10 AND NOT bad AND v > th) AS reward, any_value(th) AS th FROM f JOIN b USING (session) GROUP BY session)
SELECT session, baseline, training, artifact, valid, reward, round(th, 6) AS threshold_init, round(th, 6) AS threshold_final, round(reward / valid, 6) AS reward_rate FROM a""",
    "epoch_powers": f"WITH {EPOCHS} SELECT event_id, channel, band, round(log10(power), 6) AS log_power, round(norm, 5) AS norm FROM ep",
    "epoch_summary": f"WITH {EPOCHS} SELECT lower(channel) AS channel, band, round(log10(avg(power)), 6) AS log_power, count(*) AS n_epochs, round(avg(norm), 5) AS mean_norm, count(norm) AS n_norm FROM ep GROUP BY 1, 2",
    "picked_channels": f"WITH {SIGNAL} SELECT CASE channel WHEN 'click' THEN 'EEG Click-REF' ELSE 'VIEW' END AS channel, n, v FROM sig WHERE channel IN ('click', 'view')",
    "segment_counts": f"""WITH {FLAGS}, bad AS (SELECT channel, w * 25 AS s, w * 25 + 50 AS e FROM fl WHERE greatest(ptp_z, rms_z, kurtosis_z) > 2),
isl AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY channel ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 25 THEN 1 ELSE 0 END AS nw FROM bad)
SELECT channel, min(s) AS start_n, max(e) AS end_n, count(*) AS n_ranges FROM (SELECT *, sum(nw) OVER (PARTITION BY channel ORDER BY s, e) AS g FROM isl) GROUP BY channel, g""",
    "mapped_channels": f"WITH {SIGNAL} SELECT CASE channel WHEN 'click' THEN 'Fz' WHEN 'view' THEN 'Cz' ELSE channel END AS channel, n, v FROM sig WHERE channel <> 'error'",
    "channel_sidecar": f"WITH {SIGNAL} SELECT channel AS name, 'EEG' AS type, 'uV' AS units, 128.0::DOUBLE AS sampling_frequency, CASE WHEN avg(v) > 20.2 THEN 'bad' ELSE 'good' END AS status FROM sig GROUP BY channel",
    "event_file": "SELECT round(event_id / 8, 6) AS onset, CASE WHEN event_id % 3 > 0 THEN round(value, 6) ELSE 0 END AS duration, event_type || ' ' || user_id AS text FROM events",
    "reference_file": "SELECT 'u' || user_id AS channel, lower(event_type) AS band, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2 AND stddev_samp(value) > 0",
    "sample_table": f"WITH {SIGNAL} SELECT round(n / 128.0::DOUBLE, 6) AS t, * EXCLUDE (n) FROM (PIVOT (SELECT channel, n, round(v, 6) AS v FROM sig) ON channel USING any_value(v) GROUP BY n)",
}
