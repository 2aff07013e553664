"""Registered queries over several recordings at once (a subject for each remainder of user_id), in tables and in files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, specs
from ..operators import backgrounds, events, recordings, signals, spectra, tables
from ..sources import records, shared
from ..streaming import online
from .more import BANDS, FRAMES
from .queries import FLAGS, FS, HOP, PSD, SEG, SIGNAL, TRANSFORM, psd, r6, read, signal

BY = ("recording",)


def subjects(spark, sf_dir):
    """(recording, channel, n, v) of all events."""
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id") % 3).alias("recording"), F.col("event_type").alias("channel"), "ts", "event_id", F.col("value").alias("v"))
    return recordings.numbered(rows, ["recording", "channel"], "ts", ["ts", "event_id"]).select("recording", "channel", "n", "v")


def files(spark, sf_dir, kind="bdf", events=None, **how):
    """The folder of all subjects' samples in hundredths, which 24 bits hold exactly, 16 a second."""
    path = shared.scratch(spark, "recordings")
    rec = subjects(spark, sf_dir).withColumns({"fs": F.lit(16.0), "v": F.round(F.col("v") * 100)})
    records.write(rec, path, kind, events, **how)
    return path


def subject_power(spark, sf_dir):
    psd = spectra.welch(subjects(spark, sf_dir), FS, SEG, HOP, BY)
    rows = spectra.relative(psd, specs.bands(), by=BY)
    return rows.select("recording", "channel", "band", F.round("rel", 6).alias("rel"), F.round(F.log10("power"), 6).alias("log_power"))


def subject_coherence(spark, sf_dir):
    return r6(spectra.coherence(subjects(spark, sf_dir), SEG, HOP, by=BY), "msc", "imcoh")


def subject_reference(spark, sf_dir):
    return r6(recordings.average_reference(subjects(spark, sf_dir), BY), "v")


def subject_artifacts(spark, sf_dir):
    rows = recordings.artifacts(recordings.windows(subjects(spark, sf_dir), 50, 25, BY), 10, 2.0, by=BY)
    return r6(rows, "ptp_z", "rms_z", "kurtosis_z").select("recording", "channel", "w", "ptp_z", "rms_z", "kurtosis_z", "bad")


def subject_quality(spark, sf_dir):
    rec = subjects(spark, sf_dir)
    scales = recordings.robust(rec, ["recording", "channel"])
    rows = recordings.quality(recordings.statistics(rec, BY), scales, 5000.0, 0.02, 1.02, BY)
    return r6(rows, "ptp", "scale")


def subject_spectrogram(spark, sf_dir):
    rows = signals.spectrogram(subjects(spark, sf_dir), FS, SEG, HOP, BY)
    return rows.select("recording", "channel", "frame", "t", "k", F.round(signals.in_db(F.col("p")), 5).alias("db"))


def recording_files(spark, sf_dir):
    """Written as 24-bit files and read back: samples and their sums."""
    rows = records.read(spark, files(spark, sf_dir), partition_bytes=1 << 20)
    return rows.groupBy("recording", "channel", "fs").agg(F.count("*").alias("n_samples"), F.sum(F.round("v")).alias("total"), F.sum(F.round("v") * F.col("n")).alias("moment"))


def recording_spans(spark, sf_dir):
    """Two channels' samples 20 to 49 of every recording: the files' other bytes stay unread."""
    rows = records.read(spark, files(spark, sf_dir), partition_bytes=1 << 20).where("n between 20 and 49 and channel in ('click', 'view')")
    return rows.select("recording", "channel", "n", F.round("v").alias("v"))


def recording_marks(spark, sf_dir):
    """Every event as a mark of a file, read back."""
    marks = read(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id") % 3).alias("recording"), (F.col("event_id") / 8).alias("onset"), (F.col("event_id") % 3 / 4).alias("duration"), F.col("event_type").alias("text"))
    rows = records.read(spark, files(spark, sf_dir, "edf", marks, record_seconds=2.0), "events")
    return rows.select("recording", F.round("onset", 6).alias("onset"), F.round("duration", 6).alias("duration"), "text")


def recording_signals(spark, sf_dir):
    """The headers of the files."""
    return records.read(spark, files(spark, sf_dir), "signals").select("recording", "channel", "unit", "fs", "samples", "kind")


#: Least squares over 3 to 41 Hz without 23 to 27 Hz.
PLAIN = backgrounds.Settings(3.0, 41.0, excluded=((23.0, 27.0),), knee_model=False, rounds=(0, 0, 0))


def background_line(spark, sf_dir):
    """The line through the bins, and what stands out of it."""
    t = backgrounds.table(psd(spark, sf_dir), PLAIN)
    names = ["aperiodic_slope", "aperiodic_offset", "aperiodic_r2", "aperiodic_rmse", "aperiodic_n_points", "aperiodic_aic", "aperiodic_bic", "periodic_rel", "prominent_peak_hz", "prominent_peak_prominence_db"]
    return r6(t.select("channel", *names), *names)


def background_two_slope(spark, sf_dir):
    """Two lines that meet at a bin, and the two models' scores and weights."""
    t = backgrounds.table(psd(spark, sf_dir), PLAIN)
    names = ["aperiodic_knee_hz", "aperiodic_slope_low", "aperiodic_slope_high", "aperiodic_rmse_two_slope", "aperiodic_aic_two_slope", "aperiodic_delta_aic_loglog", "aperiodic_aic_weight_two_slope"]
    return r6(t.select("channel", "aperiodic_best_model_bic", *names), *names)


def spectral_table(spark, sf_dir):
    """The whole feature table of every subject, with robust fits and the background of the least BIC."""
    bands = tuple(specs.bands())
    o = backgrounds.Settings(1.0, 60.0, 2.0, 58.0, edges=(0.9, 0.95), bands=bands, ratios=(("theta_beta", "theta", "beta"),), background="auto_bic")
    return backgrounds.table(spectra.welch(subjects(spark, sf_dir), FS, SEG, HOP, BY), o, BY)


def reservoir_sample(spark, sf_dir):
    """At most 40 events of each user and type, fixed by a seed."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return tables.reservoir(rows, ["event_type"], ["event_id"], 40, 7)


def robust_reference(spark, sf_dir):
    """Median and scale of the frames' band powers of each channel."""
    f = online.band_frames(online.frames(signal(spark, sf_dir), SEG, HOP), FS, SEG, BANDS)
    rows = f.select("channel", "band", F.log10("power").alias("v"))
    return r6(tables.robust_reference(rows, ["channel", "band"]), "mean", "std")


def gates_once(spark, sf_dir):
    """Frames of every 32 samples take gates of every 48, a third of a sample late, each once."""
    rec = signal(spark, sf_dir)
    frames = rec.where("n % 32 = 0").select("channel", "n", (F.col("n") / FS).alias("t"))
    gates = rec.where("n % 48 = 0").select("channel", ((F.col("n") + 1 / 3) / FS).alias("t"), (F.col("v") > 20).alias("artifact"))
    return events.as_of_once(frames, gates, ["channel"], 0.5 / FS).select("channel", "n", "artifact")


RECORDED = {f.__name__: f for f in (reservoir_sample, robust_reference, gates_once, background_line, background_two_slope, spectral_table, subject_power, subject_coherence, subject_reference, subject_artifacts, subject_quality, subject_spectrogram, recording_files, recording_spans, recording_marks, recording_signals)}

SUBJECTS = "sig AS (SELECT 's' || (user_id % 3) || '/' || event_type AS channel, row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY ts, event_id) - 1 AS n, value AS v FROM events)"
APART = "split_part(channel, '/', 1) AS recording, split_part(channel, '/', 2) AS channel"


def by_subject(text: str) -> str:
    """SQL over `sig` with a channel's recording in its name."""
    return text.replace(SIGNAL, SUBJECTS)


#: The scale of a baseline of few windows: the deviation, or a part of the median, where the median deviation is nothing.
MAD = "1.4826 * median(abs(x - md)) AS s"
SCALE = "CASE WHEN 1.4826 * median(abs(x - md)) > 1e-12 THEN 1.4826 * median(abs(x - md)) WHEN stddev_samp(x) > 1e-12 THEN stddev_samp(x) WHEN 0.05 * abs(any_value(md)) > 1e-12 THEN 0.05 * abs(any_value(md)) ELSE 1 END AS s"
CELLS = "c AS (SELECT split_part(channel, '/', 1) AS recording, split_part(channel, '/', 2) AS channel, n, round(v * 100) AS v FROM sig), z AS (SELECT recording, CAST(ceil((max(n) + 1) / 16) * 16 AS BIGINT) AS n_samples FROM c GROUP BY recording)"
POINTS = PSD + """,
pt AS (SELECT channel, freq AS f, p FROM psd WHERE freq > 3 AND freq < 41 UNION ALL SELECT channel, 3.0, avg(p) FROM psd WHERE k IN (1, 2) GROUP BY channel UNION ALL SELECT channel, 41.0, avg(p) FROM psd WHERE k IN (20, 21) GROUP BY channel),
xy AS (SELECT channel, f, log10(f) AS x, log10(p) AS y, row_number() OVER (PARTITION BY channel ORDER BY f) AS i, count(*) OVER (PARTITION BY channel) AS n FROM pt WHERE f NOT BETWEEN 23 AND 27),
ln AS (SELECT channel, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2 FROM xy GROUP BY channel),
er AS (SELECT channel, any_value(n) AS n, avg(pow(y - a - b * x, 2)) AS mse FROM xy JOIN ln USING (channel) GROUP BY channel)"""
RECORDED_SQL = {
    "reservoir_sample": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id), event_id) <= 40",
    "robust_reference": f"WITH {FRAMES}, l AS (SELECT channel, band, log10(power) AS v FROM fb), m AS (SELECT *, median(v) OVER (PARTITION BY channel, band) AS md FROM l) SELECT channel, band, round(any_value(md), 6) AS mean, round(1.4826 * median(abs(v - md)), 6) AS std, count(*) AS n FROM m GROUP BY channel, band",
    "gates_once": f"WITH {SIGNAL} SELECT channel, n, CASE WHEN n % 48 = 0 THEN v > 20 END AS artifact FROM sig WHERE n % 32 = 0",
    "background_line": f"""WITH {POINTS},
rs AS (SELECT channel, f, p, greatest(p - pow(10, a + b * log10(f)), 0) AS r, 10 * (log10(p) - a - b * log10(f)) AS d FROM pt JOIN ln USING (channel)),
nx AS (SELECT *, lead(f) OVER w AS f1, lead(p) OVER w AS p1, lead(r) OVER w AS r1 FROM rs WINDOW w AS (PARTITION BY channel ORDER BY f)),
ar AS (SELECT channel, sum((r + r1) * (f1 - f)) / sum((p + p1) * (f1 - f)) AS rel FROM nx GROUP BY channel),
pk AS (SELECT channel, f, d FROM (SELECT channel, f, d, lag(d) OVER w AS d0, lead(d) OVER w AS d1 FROM rs WHERE f NOT IN (3, 41) WINDOW w AS (PARTITION BY channel ORDER BY f)) WHERE d >= d0 AND d >= d1),
tp AS (SELECT channel, arg_max(f, d) AS hz, max(d) AS db FROM pk GROUP BY channel HAVING max(d) > 1e-12)
SELECT channel, round(b, 6) AS aperiodic_slope, round(a, 6) AS aperiodic_offset, round(r2, 6) AS aperiodic_r2, round(sqrt(mse), 6) AS aperiodic_rmse, n::DOUBLE AS aperiodic_n_points,
  round(n * ln(mse) + 4, 6) AS aperiodic_aic, round(n * ln(mse) + 2 * ln(n), 6) AS aperiodic_bic, round(rel, 6) AS periodic_rel, hz::DOUBLE AS prominent_peak_hz, round(db, 6) AS prominent_peak_prominence_db
FROM ln JOIN er USING (channel) JOIN ar USING (channel) LEFT JOIN tp USING (channel)""",
    "background_two_slope": f"""WITH {POINTS},
cd AS (SELECT c.channel, c.f AS kf, c.x AS kx, v.x, v.y, least(v.x - c.x, 0) AS d1, greatest(v.x - c.x, 0) AS d2 FROM xy c JOIN xy v USING (channel) WHERE c.i BETWEEN 6 AND c.n - 5),
sm AS (SELECT channel, kf, kx, count(*) AS n, sum(d1) AS s1, sum(d2) AS s2, sum(d1 * d1) AS s11, sum(d2 * d2) AS s22, sum(y) AS sy, sum(d1 * y) AS s1y, sum(d2 * y) AS s2y FROM cd GROUP BY ALL),
lv AS (SELECT *, (sy - s1 * s1y / s11 - s2 * s2y / s22) / (n - s1 * s1 / s11 - s2 * s2 / s22) AS a FROM sm),
sl AS (SELECT *, (s1y - s1 * a) / s11 AS b1, (s2y - s2 * a) / s22 AS b2 FROM lv),
fe AS (SELECT channel, kf, any_value(b1) AS b1, any_value(b2) AS b2, avg(pow(y - a - b1 * d1 - b2 * d2, 2)) AS mse2 FROM cd JOIN sl USING (channel, kf) GROUP BY channel, kf),
bs AS (SELECT channel, arg_min(kf, mse2) AS kf, arg_min(b1, mse2) AS b1, arg_min(b2, mse2) AS b2, min(mse2) AS mse2 FROM fe GROUP BY channel),
sc AS (SELECT *, n * ln(mse) + 4 AS a1, n * ln(mse2) + 8 AS a2, n * ln(mse) + 2 * ln(n) AS q1, n * ln(mse2) + 4 * ln(n) AS q2 FROM bs JOIN er USING (channel))
SELECT channel, CASE WHEN q1 <= q2 THEN 'loglog' ELSE 'two_slope' END AS aperiodic_best_model_bic, round(kf::DOUBLE, 6) AS aperiodic_knee_hz, round(b1, 6) AS aperiodic_slope_low, round(b2, 6) AS aperiodic_slope_high, round(sqrt(mse2), 6) AS aperiodic_rmse_two_slope,
  round(a2, 6) AS aperiodic_aic_two_slope, round(a1 - least(a1, a2), 6) AS aperiodic_delta_aic_loglog, round(exp(-0.5 * (a2 - least(a1, a2))) / (exp(-0.5 * (a1 - least(a1, a2))) + exp(-0.5 * (a2 - least(a1, a2)))), 6) AS aperiodic_aic_weight_two_slope FROM sc""",
    "subject_power": f"WITH {by_subject(PSD)} SELECT {APART}, band, round(rel, 6) AS rel, round(log10(power), 6) AS log_power FROM bp",
    "subject_coherence": f"WITH {by_subject(TRANSFORM)}, ta AS (SELECT {APART}, seg, k, re, im FROM tr), pr AS (SELECT a.recording, a.channel AS channel_a, b.channel AS channel_b, k, sum(a.re * b.re + a.im * b.im) AS re, sum(a.im * b.re - a.re * b.im) AS im, sum(a.re * a.re + a.im * a.im) AS pa, sum(b.re * b.re + b.im * b.im) AS pb FROM ta a JOIN ta b USING (recording, seg, k) WHERE a.channel < b.channel GROUP BY ALL) SELECT recording, channel_a, channel_b, k, round((re * re + im * im) / (pa * pb), 6) AS msc, round(abs(im) / sqrt(pa * pb), 6) AS imcoh FROM pr",
    "subject_reference": f"WITH {SUBJECTS} SELECT {APART}, n, round(v - avg(v) OVER (PARTITION BY split_part(channel, '/', 1), n), 6) AS v FROM sig",
    "subject_artifacts": f"WITH {by_subject(FLAGS).replace(MAD, SCALE)} SELECT {APART}, w, round(ptp_z, 6) AS ptp_z, round(rms_z, 6) AS rms_z, round(kurtosis_z, 6) AS kurtosis_z, greatest(ptp_z, rms_z, kurtosis_z) > 2 AS bad FROM fl",
    "subject_quality": f"""WITH {SUBJECTS}, md AS (SELECT channel, median(v) AS m, max(v) - min(v) AS ptp FROM sig GROUP BY channel), sc AS (SELECT channel, any_value(ptp) AS ptp, 1.4826 * median(abs(v - m)) AS scale FROM sig JOIN md USING (channel) GROUP BY channel),
q AS (SELECT {APART}, ptp, scale, median(scale) OVER (PARTITION BY split_part(channel, '/', 1)) AS t FROM sc), f AS (SELECT *, ptp < 5000 OR scale < 0.02 * t AS flatline, scale > 1.02 * t AS noisy FROM q)
SELECT recording, channel, round(ptp, 6) AS ptp, round(scale, 6) AS scale, flatline, noisy, flatline OR noisy AS bad, concat_ws(';', CASE WHEN flatline THEN 'flatline' END, CASE WHEN noisy THEN 'noisy' END) AS reasons FROM f""",
    "subject_spectrogram": f"WITH {by_subject(TRANSFORM)} SELECT {APART}, seg AS frame, (seg * 32 + 32) / 128.0::DOUBLE AS t, k, round(10 * log10(greatest((re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / (128.0 * (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 63), 2)) FROM range(0, 64) h(i))), 1e-20)), 5) AS db FROM tr",
    "recording_files": f"WITH {SUBJECTS}, {CELLS} SELECT c.recording, channel, 16.0::DOUBLE AS fs, any_value(n_samples) AS n_samples, sum(v) AS total, sum(v * n) AS moment FROM c JOIN z USING (recording) GROUP BY c.recording, channel",
    "recording_spans": f"WITH {SUBJECTS}, {CELLS}, g AS (SELECT z.recording, channel, k AS n FROM z JOIN (SELECT DISTINCT recording, channel FROM c WHERE channel IN ('click', 'view')) USING (recording), range(20, 50) r(k) WHERE k < n_samples) SELECT g.recording, g.channel, g.n, coalesce(v, 0.0) AS v FROM g LEFT JOIN c USING (recording, channel, n)",
    "recording_marks": "SELECT 's' || (user_id % 3) AS recording, round(event_id / 8, 6) AS onset, round(event_id % 3 / 4, 6) AS duration, event_type AS text FROM events",
    "recording_signals": f"WITH {SUBJECTS}, {CELLS} SELECT DISTINCT recording, channel, 'uV' AS unit, 16.0::DOUBLE AS fs, n_samples AS samples, 'signal' AS kind FROM c JOIN z USING (recording)",
}
