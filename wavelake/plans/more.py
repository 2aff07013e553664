"""Further registered queries: event tables, triggers, matrices, spectrograms, quality, microstates and online frames, with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import scalar, specs
from ..operators import events, matrices, microstates, recordings, signals, spectra
from ..streaming import online
from .queries import FS, HOP, SEG, SIGNAL, TRANSFORM, nation_edges, psd, r6, read, signal
from .queries import EDGES, PSD, WINDOWS

BANDS = [("alpha", 8.0, 12.0), ("beta", 13.0, 30.0)]
NOT_A_NUMBER = float("nan")


def own_events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    onset = F.when(F.col("event_id") % 5 == 0, NOT_A_NUMBER).otherwise(F.round("value", 1))
    return e.select("user_id", "event_id", onset.alias("onset"), (F.col("event_id") % 4 - 1).cast("double").alias("duration"), F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("text"))


def events_normalize(spark, sf_dir):
    return events.normalized(own_events(spark, sf_dir)).select("event_id", "onset", "duration")


def events_first_kept(spark, sf_dir):
    rows = events.normalized(own_events(spark, sf_dir)).withColumn("onset", F.floor(F.col("onset") / 50).cast("double"))
    return events.deduplicated(rows, ["user_id"], "event_id").select("user_id", "event_id", F.trim("text").alias("text"))


def events_merge(spark, sf_dir):
    rows = events.normalized(own_events(spark, sf_dir)).withColumn("onset", F.floor(F.col("onset") / 50).cast("double"))
    return events.merged(rows.where("event_id % 2 = 0"), rows, ["user_id"], "event_id").select("user_id", "event_id")


def slice_samples(spark, sf_dir):
    return events.slice_seconds(signal(spark, sf_dir), FS, 0.5, 1.25)


def event_overlaps(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select("user_id", F.col("value").alias("onset"), (F.col("event_id") % 9).cast("double").alias("duration"), F.col("event_id").cast("string").alias("text"))
    spans = e.select("user_id", F.col("event_id").alias("span_id"), F.col("value").alias("start"), (F.col("value") + 40).alias("end"))
    return r6(events.overlaps(spans, rows, ["user_id"], 25.0).select("user_id", "span_id", "text", "onset", "duration"), "onset", "duration")


def frame_gates(spark, sf_dir):
    """The gate of the same sample for frames every 32 samples, from gates every 48."""
    rows = signal(spark, sf_dir)
    t = (F.col("n") / FS).alias("t")
    return events.as_of(rows.where("n % 32 = 0").select("channel", t, "n"), rows.where("n % 48 = 0").select("channel", t, (F.col("v") > 20).alias("artifact")), ["channel"], FS).select("channel", "n", "artifact")


def true_segments(spark, sf_dir):
    return r6(events.true_segments(signal(spark, sf_dir).withColumn("t", F.col("n") / FS).withColumn("on", F.col("v") > 25), ["channel"], "t", "on"), "onset", "duration")


def marker_events(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise(" 0 ").alias("label"))
    return events.marker_events(e, ["user_id"], "event_id", "label").select("user_id", F.col("onset").alias("event_id"), "text")


def segment_events(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.row_number().over(events.Window.partitionBy("user_id").orderBy("event_id")).cast("double").alias("t"), F.when(F.col("value") > 20, F.col("event_type")).alias("label"))
    return events.segment_events(e, ["user_id"], "t", "label", 1.0)


def trigger_events(spark, sf_dir):
    rows = signal(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 40) * 65536 + F.floor(F.col("v") / 20))
    return r6(events.trigger_events(rows, ["channel"], FS, 0xFFFF), "onset", "duration")


def trigger_scores(spark, sf_dir):
    rows = signal(spark, sf_dir).withColumn("v", F.when(F.col("n") % 10 == 0, F.floor(F.col("v") / 25)).otherwise(0.0))
    return r6(events.trigger_scores(rows), "near_integer", "nonzero", "score")


def epoch_means(spark, sf_dir):
    """Mean square by channel over whole epochs from half a second before to one second after an onset every 0.17 s, as long as there are samples."""
    rec = signal(spark, sf_dir)
    on = rec.agg(F.max("n").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / FS / 0.17))).alias("event_id")).withColumn("onset", F.col("event_id") * 0.17)
    ep = events.epochs(rec, on, FS, -0.5, 1.0).groupBy("event_id", "channel").agg(F.avg(F.col("v") * F.col("v")).alias("e"))
    return r6(ep.groupBy(F.lower("channel").alias("channel")).agg(F.avg("e").alias("mean_power"), F.count(F.lit(1)).alias("n_epochs")), "mean_power")


def place():
    """A row's place in its table, by which ties of a line's number (some come twice) are settled: the first one stays, as in SQL over one run of rows."""
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")


def roi_metrics(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_brand").alias("roi"), "p_partkey", F.col("p_size").cast("string").alias("size_alpha"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("price_beta_2"))
    long = matrices.long_metrics(p, "roi", "p_partkey")
    return long.select("roi", "metric", "value", matrices.band_of(F.col("metric")).alias("band"), matrices.is_z(F.col("metric")).alias("is_z"))


def roi_banded(spark, sf_dir):
    p = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("roi"), F.lit("coherence").alias("metric"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("band"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), *place())
    return matrices.keyed_metrics(p, "ord", ties=("file", "row")).withColumn("kind", matrices.kind_of(F.col("metric")))


def matrix_cells(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 12).alias("a"), (F.col("l_partkey") % 12).alias("b"), F.col("l_extendedprice").alias("w"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), *place()).where("a < b")
    return matrices.matrix_cells(li, "ord", ties=("file", "row"))


def triangle_stats(spark, sf_dir):
    return r6(matrices.triangle_stats(nation_edges(spark, sf_dir)), "mean", "std", "min_w", "max_w")


def edge_filter(spark, sf_dir):
    e = nation_edges(spark, sf_dir).withColumn("w", F.when(F.col("a") % 2 == 0, -F.col("w")).otherwise(F.col("w")))
    return r6(matrices.filtered_edges(e, True, 50.0, 5000.0), "w")


def wide_matrix(spark, sf_dir):
    """Pairs above the diagonal of a five by five table."""
    names = [f"n{i}" for i in range(5)]
    li = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("n"), F.col("l_suppkey") % 5).alias("a")).agg(*(F.sum(F.when(F.col("l_partkey") % 5 == i, F.col("l_quantity"))).alias(n) for i, n in enumerate(names)))
    return matrices.upper_triangle(li)


def column_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", matrices.column_name(F.concat(F.col("p_size"), F.lit(" "), "p_type")).alias("name"))


def spectral_features(spark, sf_dir):
    f = spectra.features(psd(spark, sf_dir), 3.0, 41.0)
    names = [c for c in f.columns if c not in ("channel", "total_power")]
    return r6(f.withColumn("total_power", F.log10("total_power")), "total_power", *names)


def spectrogram_db(spark, sf_dir):
    s = signals.spectrogram(signal(spark, sf_dir), FS, SEG, HOP)
    return s.select("channel", F.round("t", 6).alias("t"), "freq", F.round(signals.in_db(F.col("p")), 5).alias("db"))


def spectrogram_limits(spark, sf_dir):
    s = signals.spectrogram(signal(spark, sf_dir), FS, SEG, HOP).withColumn("db", signals.in_db(F.col("p")))
    return r6(signals.display_limits(s, ["channel"], "db"), "lo", "hi")


def band_coherence(spark, sf_dir):
    c = spectra.coherence(signal(spark, sf_dir), SEG, HOP).withColumn("freq", F.col("k") * (FS / SEG))
    return r6(signals.band_average(c, ["channel_a", "channel_b"], "msc", BANDS), "mean")


def line_noise_decision(spark, sf_dir):
    return r6(signals.line_noise_decision(psd(spark, sf_dir).where("freq < 64"), 3, 0.5), "ratio_50", "ratio_60", "strength")


def mean_correlation(spark, sf_dir):
    return r6(signals.mean_correlation(signal(spark, sf_dir)), "corr")


def downsampled(spark, sf_dir):
    return signals.downsampled(signal(spark, sf_dir), 30)


def quality_flags(spark, sf_dir):
    rec = signal(spark, sf_dir)
    flags = recordings.artifacts(recordings.windows(rec, 50, 25), 10, 2.0)
    return r6(signals.channel_quality(rec, flags, noisy=1.05, often=0.5, least_corr=0.45).drop("ptp", "scale"), "bad_fraction", "corr")


def masked(spark, sf_dir):
    rec = signal(spark, sf_dir)
    return signals.masked(rec, rec.groupBy("channel").agg(F.avg("v").alias("m")).where("channel < 'd'")).groupBy("channel").agg(F.count("v").alias("n_good"), F.count(F.lit(1)).alias("n_all"))


def artifact_channels(spark, sf_dir):
    """Windows by how many channels are bad at once, against every window where no baseline is left."""
    flags = recordings.artifacts(recordings.windows(signal(spark, sf_dir), 50, 25), 0, 2.0, least_channels=2)
    return flags.groupBy("w").agg(F.count_if("bad").alias("n_bad"), F.bool_or("window_bad").alias("window_bad"))


def bad_window_counts(spark, sf_dir):
    flags = recordings.artifacts(recordings.windows(signal(spark, sf_dir), 50, 25), 10, 2.0)
    return r6(flags.groupBy("channel").agg(F.count_if("bad").alias("bad_windows"), F.avg(F.col("bad").cast("double")).alias("fraction")), "fraction")


def states(spark, sf_dir):
    return signal(spark, sf_dir).select("channel", "n", F.when(F.col("v") > 60, -1).otherwise(F.floor(F.col("v") / 7) % 4).cast("int").alias("label"), (F.col("v") / 100).alias("corr"), F.col("v").alias("gfp"))


def microstate_stats(spark, sf_dir):
    return r6(microstates.statistics(states(spark, sf_dir), ["channel"], FS), "coverage", "mean_duration", "occurrence", "gev")


def microstate_segments(spark, sf_dir):
    return r6(microstates.segments(states(spark, sf_dir), ["channel"], FS).select("channel", "label", "first", "last", "duration", "mean_corr", "mean_gfp").withColumnsRenamed({"first": "first_n", "last": "last_n"}), "duration", "mean_corr", "mean_gfp")


def top_peaks(spark, sf_dir):
    rows = recordings.field_power(signal(spark, sf_dir))
    return r6(microstates.top_fraction(recordings.peaks(rows, "gfp", "n"), 0.1, 5, 50), "gfp")


def online_bandpower(spark, sf_dir):
    f = online.band_frames(online.frames(signal(spark, sf_dir), SEG, HOP), FS, SEG, BANDS)
    return f.select("channel", "end_n", "band", F.round(F.log10("power"), 6).alias("log_power"))


def online_ratio(spark, sf_dir):
    f = online.band_frames(online.frames(signal(spark, sf_dir), SEG, HOP), FS, SEG, BANDS)
    names = [r[0] for r in read(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]  # the channels
    each = [online.metric_values(f.where(F.col("channel") == c), f"ratio:alpha/beta:{c}").withColumn("channel", F.lit(c)) for c in names]
    return r6(functools.reduce(lambda a, b: a.unionByName(b), each), "metric")


def online_artifacts(spark, sf_dir):
    return r6(online.artifact_gate(signal(spark, sf_dir), FS, 50, 25, 1.5, 2.0, 2), "max_ptp_z", "max_rms_z", "max_kurtosis_z")


def rolling_quantile(spark, sf_dir):
    rows = signal(spark, sf_dir).withColumn("t", F.col("n") / FS)
    return r6(online.rolling_quantile(rows, ["channel"], "t", "v", 0.25, 0.6).select("channel", "n", "quantile"), "quantile")


def iso_times(spark, sf_dir):
    text = F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+02:00"))
    return read(spark, sf_dir, "events").select("event_id", scalar.iso_millis(text).alias("ms"))


def json_values(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


MORE = {f.__name__: f for f in (events_normalize, events_first_kept, events_merge, slice_samples, event_overlaps, frame_gates, true_segments, marker_events, segment_events, trigger_events, trigger_scores, epoch_means, roi_metrics, roi_banded, matrix_cells, triangle_stats, edge_filter, wide_matrix, column_names, spectral_features, spectrogram_db, spectrogram_limits, band_coherence, line_noise_decision, mean_correlation, downsampled, quality_flags, masked, artifact_channels, bad_window_counts, microstate_stats, microstate_segments, top_peaks, online_bandpower, online_ratio, online_artifacts, rolling_quantile, iso_times, json_values)}

OWN = "own AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE round(value, 1) END AS onset, greatest(event_id % 4 - 1, 0)::DOUBLE AS duration, event_type AS text FROM events)"
STATES = SIGNAL + ", st AS (SELECT channel, n, CASE WHEN v > 60 THEN -1 ELSE floor(v / 7)::INT % 4 END AS label, v / 100 AS corr, v AS gfp FROM sig)"
RUNS = STATES + ", ru AS (SELECT channel, label, min(n) AS a, max(n) AS b, avg(corr) AS c, avg(gfp) AS g FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n) - row_number() OVER (PARTITION BY channel, label ORDER BY n) AS i FROM st) WHERE label >= 0 GROUP BY channel, label, i)"
SPECTRUM = TRANSFORM + ", sp AS (SELECT channel, seg, k, (re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / (128.0 * (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 63), 2)) FROM range(0, 64) h(i))) AS p FROM tr)"
FRAMES = SIGNAL + """,
fr AS (SELECT channel, greatest(64 + j - 1, j * 32) AS e FROM (SELECT channel, max(n) + 1 AS size FROM sig GROUP BY channel), range(1, 100000) r(j) WHERE greatest(64 + j - 1, j * 32) <= size),
cn AS (SELECT fr.channel, e, n - e + 64 AS i, v - avg(v) OVER (PARTITION BY fr.channel, e) AS v FROM fr JOIN sig ON sig.channel = fr.channel AND n >= e - 64 AND n < e),
ft AS (SELECT channel, e, k, sum(v * h * cos(2 * pi() * k * i / 64)) AS re, sum(v * h * sin(2 * pi() * k * i / 64)) AS im FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / 63) AS h FROM cn), range(0, 33) q(k) GROUP BY ALL),
fp AS (SELECT channel, e, k * 2.0 AS f0, k * 2.0 + 2 AS f1, p AS p0, lead(p) OVER (PARTITION BY channel, e ORDER BY k) AS p1 FROM (SELECT channel, e, k, (re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / (128.0 * (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 63), 2)) FROM range(0, 64) h(i))) AS p FROM ft)),
fb AS (SELECT channel, e, band, sum(0.5 * (2 * p0 + (p1 - p0) / 2 * (greatest(f0, lo) - f0 + least(f1, hi) - f0)) * (least(f1, hi) - greatest(f0, lo))) AS power FROM fp, (VALUES ('alpha', 8.0, 12.0), ('beta', 13.0, 30.0)) b(band, lo, hi) WHERE p1 IS NOT NULL AND f1 > lo AND f0 < hi GROUP BY ALL)"""


def flags(baseline: str, limit: float) -> str:
    """CTEs up to fl (channel, w, bad)."""
    return WINDOWS + f""",
lng AS (SELECT channel, w, 'ptp' AS f, ptp AS x FROM win UNION ALL SELECT channel, w, 'rms', rms FROM win UNION ALL SELECT channel, w, 'kurtosis', kurtosis FROM win),
md AS (SELECT channel, f, median(x) AS md FROM lng WHERE {baseline} GROUP BY ALL),
sc AS (SELECT channel, f, any_value(md) AS md, 1.4826 * median(abs(x - md)) AS s FROM lng JOIN md USING (channel, f) WHERE {baseline} GROUP BY ALL),
fl AS (SELECT channel, w, max((x - md) / s) > {limit} AS bad FROM lng JOIN sc USING (channel, f) GROUP BY channel, w)"""


MORE_SQL = {
    "events_normalize": f"WITH {OWN} SELECT event_id, onset, duration FROM own",
    "events_first_kept": f"WITH {OWN} SELECT user_id, min(event_id) AS event_id, text FROM own GROUP BY user_id, floor(onset / 50), duration, text",
    "events_merge": f"WITH {OWN} SELECT user_id, coalesce(min(event_id) FILTER (event_id % 2 = 0), min(event_id)) AS event_id FROM own GROUP BY user_id, floor(onset / 50), duration, text",
    "slice_samples": f"WITH {SIGNAL} SELECT channel, n - 64 AS n, v FROM sig WHERE n >= 64 AND n < 160",
    "event_overlaps": "WITH e AS (SELECT user_id, event_id, value AS a, value + event_id % 9 AS b FROM events), s AS (SELECT user_id, event_id AS span_id, value AS s, value + 40 AS t FROM events) SELECT user_id, span_id, event_id::VARCHAR AS text, round(greatest(a, s), 6) AS onset, round(least(b, t) - greatest(a, s), 6) AS duration FROM s JOIN e USING (user_id) WHERE a < t AND (b > s OR (a = b AND a >= s))",
    "frame_gates": f"WITH {SIGNAL} SELECT channel, n, CASE WHEN n % 48 = 0 THEN v > 20 END AS artifact FROM sig WHERE n % 32 = 0",
    "true_segments": f"WITH {SIGNAL}, c AS (SELECT channel, n, v > 25 AS f, coalesce(lag(v > 25) OVER (PARTITION BY channel ORDER BY n), FALSE) AS p FROM sig), d AS (SELECT *, lead(n) OVER (PARTITION BY channel ORDER BY n) AS x FROM c WHERE f <> p), m AS (SELECT channel, max(n) AS last FROM sig GROUP BY channel) SELECT channel, round(n / 128.0, 6) AS onset, round((coalesce(x, last) - n) / 128.0, 6) AS duration FROM d JOIN m USING (channel) WHERE f AND coalesce(x, last) > n",
    "marker_events": "WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 3 > 0 THEN event_type ELSE '' END AS t FROM events), p AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY event_id), '') AS b FROM l) SELECT user_id, event_id, t AS text FROM p WHERE t <> '' AND t <> b",
    "segment_events": "WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::DOUBLE AS t, CASE WHEN value > 20 THEN event_type ELSE '' END AS x FROM events), g AS (SELECT *, t - row_number() OVER (PARTITION BY user_id, x ORDER BY t) AS i FROM l) SELECT user_id, min(t) AS onset, max(t) - min(t) + 1 AS duration, x AS text FROM g WHERE x <> '' GROUP BY user_id, x, i",
    "trigger_events": f"WITH {SIGNAL}, c AS (SELECT channel, n, floor(v / 20)::BIGINT AS code FROM sig), g AS (SELECT *, n - row_number() OVER (PARTITION BY channel, code ORDER BY n) AS i FROM c), r AS (SELECT channel, code, min(n) AS a, max(n) + 1 AS b FROM g GROUP BY channel, code, i) SELECT channel, round(a / 128.0, 6) AS onset, round((b - a) / 128.0, 6) AS duration, code::VARCHAR AS text FROM r WHERE a > 0 AND code <> 0",
    "trigger_scores": f"WITH {SIGNAL}, c AS (SELECT channel, CASE WHEN n % 10 = 0 THEN floor(v / 25) ELSE 0 END AS c FROM sig), s AS (SELECT channel, 1.0 AS near_integer, avg((c <> 0)::INT) AS nonzero, count(DISTINCT c) AS \"unique\", max(c) - min(c) AS span FROM c GROUP BY channel) SELECT channel, near_integer::DOUBLE AS near_integer, round(nonzero, 6) AS nonzero, \"unique\", round(CASE WHEN span > 0 AND \"unique\" BETWEEN 2 AND 1024 THEN (1 - nonzero) * ln(span + 1) / ln(\"unique\" + 2) ELSE 0 END, 6) AS score FROM s",
    "epoch_means": f"WITH {SIGNAL}, o AS (SELECT id, round((id * 0.17::DOUBLE - 0.5) * 128)::BIGINT AS f FROM range(0, 1000000) r(id) WHERE id <= floor((SELECT max(n) FROM sig) / 128.0::DOUBLE / 0.17::DOUBLE)), e AS (SELECT id, channel, avg(v * v) AS e FROM o JOIN sig ON n >= f AND n < f + 192 WHERE f >= 0 GROUP BY id, channel HAVING count(*) = 192) SELECT lower(channel) AS channel, round(avg(e), 6) AS mean_power, count(*) AS n_epochs FROM e GROUP BY 1",
    "roi_metrics": "SELECT p_brand AS roi, 'size_alpha' AS metric, arg_max(p_size, p_partkey)::DOUBLE AS value, 'alpha' AS band, FALSE AS is_z FROM part GROUP BY p_brand UNION ALL SELECT p_brand, 'price_beta_2', arg_max(p_retailprice, p_partkey), 'beta2', FALSE FROM part WHERE p_partkey % 3 > 0 GROUP BY p_brand",
    "roi_banded": "SELECT l_suppkey::VARCHAR AS roi, CASE WHEN l_returnflag = 'N' THEN 'coherence' ELSE 'coherence_' || l_returnflag END AS metric, arg_max(l_quantity, l_orderkey * 10 + l_linenumber)::DOUBLE AS value, 'connectivity' AS kind FROM lineitem GROUP BY 1, 2",
    "matrix_cells": "WITH e AS (SELECT l_suppkey % 12 AS a, l_partkey % 12 AS b, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS w FROM lineitem WHERE l_suppkey % 12 < l_partkey % 12 GROUP BY 1, 2) SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e",
    "triangle_stats": f"WITH {EDGES} SELECT count(*) AS n, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, round(min(w), 6) AS min_w, round(max(w), 6) AS max_w FROM ed",
    "edge_filter": f"WITH {EDGES} SELECT a, b, round(w, 6) AS w FROM ed WHERE w BETWEEN 50 AND 5000",
    "wide_matrix": "SELECT 'n' || l_suppkey % 5 AS a, 'n' || l_partkey % 5 AS b, sum(l_quantity) AS w FROM lineitem WHERE l_suppkey % 5 < l_partkey % 5 GROUP BY 1, 2",
    "column_names": "SELECT p_partkey, 'r_' || regexp_replace(p_size || ' ' || p_type, '[^A-Za-z0-9_]', '_', 'g') AS name FROM part",
    "spectral_features": f"WITH {PSD}, x0 AS (SELECT channel, greatest(f0, 3) AS a, least(f1, 41) AS b, f0, f1, p0, p1 FROM iv WHERE f1 > 3 AND f0 < 41), x AS (SELECT channel, a, b, p0 + (p1 - p0) * (a - f0) / (f1 - f0) AS pa, p0 + (p1 - p0) * (b - f0) / (f1 - f0) AS pb FROM x0), y AS (SELECT *, 0.5 * (pa + pb) * (b - a) AS area, (pb - pa) / (b - a) AS s, pa - (pb - pa) / (b - a) * a AS c FROM x), z AS (SELECT *, sum(area) OVER (PARTITION BY channel) AS t, sum(area) OVER (PARTITION BY channel ORDER BY a) AS u FROM y), g AS (SELECT channel, any_value(t) AS t, -sum(area / t * ln(area / t)) / ln(count(*)) AS entropy, sum(c * (b ** 2 - a ** 2) / 2 + s * (b ** 3 - a ** 3) / 3) / any_value(t) AS e1, sum(c * (b ** 3 - a ** 3) / 3 + s * (b ** 4 - a ** 4) / 4) / any_value(t) AS e2, sum(c * (b ** 4 - a ** 4) / 4 + s * (b ** 5 - a ** 5) / 5) / any_value(t) AS e3, sum(c * (b ** 5 - a ** 5) / 5 + s * (b ** 6 - a ** 6) / 6) / any_value(t) AS e4, exp(sum(0.5 * (ln(pa) + ln(pb)) * (b - a)) / 38) / (any_value(t) / 38) AS flat, min(CASE WHEN u >= 0.95 * t AND u - area < 0.95 * t THEN a + (sqrt(pa * pa + 2 * s * (0.95 * t - u + area)) - pa) / s END) AS edge FROM z GROUP BY channel), n AS (SELECT channel, freq, p, lag(log10(p)) OVER w AS y0, log10(p) AS y1, lead(log10(p)) OVER w AS y2 FROM psd WINDOW w AS (PARTITION BY channel ORDER BY k)), k AS (SELECT channel, freq AS pf, p, CASE WHEN freq - 2 >= 3 AND freq + 2 <= 41 THEN freq + (y0 - y2) / (y0 - 2 * y1 + y2) ELSE freq END AS pr FROM n WHERE freq BETWEEN 3 AND 41 QUALIFY row_number() OVER (PARTITION BY channel ORDER BY p DESC, freq) = 1), h AS (SELECT channel, max(CASE WHEN b <= pf THEN a + (p / 2 - pa) / (pb - pa) * (b - a) END) AS l, min(CASE WHEN a >= pf THEN a + (p / 2 - pa) / (pb - pa) * (b - a) END) AS r FROM y JOIN k USING (channel) WHERE (pa - p / 2) * (pb - p / 2) <= 0 GROUP BY channel) SELECT channel, round(log10(t), 6) AS total_power, round(entropy, 6) AS entropy, round(e1, 6) AS mean_freq, round(sqrt(e2 - e1 * e1), 6) AS bandwidth, round((e3 - 3 * e1 * e2 + 2 * e1 ** 3) / (e2 - e1 * e1) ** 1.5, 6) AS skewness, round((e4 - 4 * e1 * e3 + 6 * e1 * e1 * e2 - 3 * e1 ** 4) / (e2 - e1 * e1) ** 2 - 3, 6) AS kurtosis, round(flat, 6) AS flatness, round(edge, 6) AS edge_freq, pf::DOUBLE AS peak_freq, round(pr, 6) AS peak_refined, round(10 * log10(p), 6) AS peak_db, round(r - l, 6) AS fwhm FROM g JOIN k USING (channel) LEFT JOIN h USING (channel)",
    "spectrogram_db": f"WITH {SPECTRUM} SELECT channel, round((seg * 32 + 32) / 128.0, 6) AS t, k * 2.0::DOUBLE AS freq, round(10 * log10(greatest(p, 1e-20)), 5) AS db FROM sp",
    "spectrogram_limits": f"WITH {SPECTRUM} SELECT channel, round(quantile_cont(10 * log10(greatest(p, 1e-20)), 0.05), 6) AS lo, round(quantile_cont(10 * log10(greatest(p, 1e-20)), 0.95), 6) AS hi FROM sp GROUP BY channel",
    "band_coherence": f"WITH {TRANSFORM}, c AS (SELECT a.channel AS channel_a, b.channel AS channel_b, k, (pow(sum(a.re * b.re + a.im * b.im), 2) + pow(sum(a.im * b.re - a.re * b.im), 2)) / (sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)) AS v FROM tr a JOIN tr b USING (seg, k) WHERE a.channel < b.channel GROUP BY ALL), i AS (SELECT *, k * 2.0 AS f0, k * 2.0 + 2 AS f1, lead(v) OVER (PARTITION BY channel_a, channel_b ORDER BY k) AS w FROM c), x AS (SELECT *, greatest(f0, lo) AS s, least(f1, hi) AS t FROM i, (VALUES ('alpha', 8.0, 12.0), ('beta', 13.0, 30.0)) b(band, lo, hi) WHERE w IS NOT NULL AND f1 > lo AND f0 < hi) SELECT channel_a, channel_b, band, round(sum(0.5 * (2 * v + (w - v) / 2 * (s - f0 + t - f0)) * (t - s)) / sum(t - s), 6) AS mean FROM x GROUP BY ALL",
    "line_noise_decision": f"WITH {PSD}, f AS (SELECT * FROM psd WHERE freq < 64 AND channel IN (SELECT DISTINCT channel FROM psd ORDER BY channel LIMIT 3)), r AS (SELECT channel, avg(p) FILTER (abs(freq - 50) <= 0.5) / avg(p) FILTER (abs(freq - 50) BETWEEN 1.5 AND 5) AS a, avg(p) FILTER (abs(freq - 60) <= 0.5) / avg(p) FILTER (abs(freq - 60) BETWEEN 1.5 AND 5) AS b FROM f GROUP BY channel), m AS (SELECT median(a) AS a, median(b) AS b FROM r) SELECT round(a, 6) AS ratio_50, round(b, 6) AS ratio_60, CASE WHEN greatest(a, b) < 0.5 THEN 0 WHEN b > a THEN 60 ELSE 50 END::DOUBLE AS recommended_hz, round(CASE WHEN greatest(a, b) < 0.5 THEN 0 ELSE greatest(a, b) END, 6) AS strength FROM m",
    "mean_correlation": f"WITH {SIGNAL}, m AS (SELECT n, avg(v) AS m FROM sig GROUP BY n) SELECT channel, round(abs(corr(v, m)), 6) AS corr FROM sig JOIN m USING (n) GROUP BY channel",
    "downsampled": f"WITH {SIGNAL}, z AS (SELECT channel, ceil((max(n) + 1) / 30.0)::BIGINT AS s FROM sig GROUP BY channel) SELECT channel, n, v FROM sig JOIN z USING (channel) WHERE n % s = 0",
    "quality_flags": f"WITH {flags('w < 10', 2.0)}, m AS (SELECT n, avg(v) AS m FROM sig GROUP BY n), c AS (SELECT channel, abs(corr(v, m)) AS corr FROM sig JOIN m USING (n) GROUP BY channel), d AS (SELECT channel, median(v) AS md FROM sig GROUP BY channel), s AS (SELECT channel, max(v) - min(v) AS ptp, 1.4826 * median(abs(v - md)) AS scale FROM sig JOIN d USING (channel) GROUP BY channel), t AS (SELECT median(scale) AS t FROM s), b AS (SELECT channel, avg(bad::INT) AS bad_fraction FROM fl GROUP BY channel), q AS (SELECT channel, ptp < 1 OR scale < 0.02 * t AS flatline, scale > 1.05 * t AS noisy, coalesce(bad_fraction, 0) AS bad_fraction, corr, coalesce(bad_fraction, 0) >= 0.5 AS artifact_often_bad, corr < 0.45 AS corr_low FROM s JOIN c USING (channel) LEFT JOIN b USING (channel), t) SELECT channel, flatline, noisy, round(bad_fraction, 6) AS bad_fraction, round(corr, 6) AS corr, artifact_often_bad, corr_low, flatline OR noisy OR artifact_often_bad OR corr_low AS bad, concat_ws(';', CASE WHEN flatline THEN 'flatline' END, CASE WHEN noisy THEN 'noisy' END, CASE WHEN artifact_often_bad THEN 'artifact_often_bad' END, CASE WHEN corr_low THEN 'low_corr' END) AS reasons FROM q",
    "masked": f"WITH {SIGNAL} SELECT channel, count(*) FILTER (channel >= 'd') AS n_good, count(*) AS n_all FROM sig GROUP BY channel",
    "artifact_channels": f"WITH {flags('TRUE', 2.0)} SELECT w, count(*) FILTER (bad) AS n_bad, count(*) FILTER (bad) >= 2 AS window_bad FROM fl GROUP BY w",
    "bad_window_counts": f"WITH {flags('w < 10', 2.0)} SELECT channel, count(*) FILTER (bad) AS bad_windows, round(avg(bad::INT), 6) AS fraction FROM fl GROUP BY channel",
    "microstate_stats": f"WITH {RUNS}, t AS (SELECT channel, count(*) AS n, sum(gfp * gfp) AS w FROM st GROUP BY channel), o AS (SELECT channel, label, count(*) AS c, sum(gfp * gfp * corr * corr) AS x FROM st WHERE label >= 0 GROUP BY ALL), l AS (SELECT channel, label, count(*) AS r, avg(len) AS m FROM (SELECT channel, label, count(*) AS len FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n) - row_number() OVER (PARTITION BY channel, label ORDER BY n) AS i FROM st WHERE label >= 0) GROUP BY channel, label, i) GROUP BY ALL) SELECT channel, label, round(c / n, 6) AS coverage, round(m / 128, 6) AS mean_duration, round(r / (n / 128.0), 6) AS occurrence, round(x / w, 6) AS gev FROM o JOIN l USING (channel, label) JOIN t USING (channel)",
    "microstate_segments": f"WITH {RUNS} SELECT channel, label, a AS first_n, b AS last_n, round((b + 1 - a) / 128.0, 6) AS duration, round(c, 6) AS mean_corr, round(g, 6) AS mean_gfp FROM ru",
    "top_peaks": f"WITH {SIGNAL}, g AS (SELECT n, stddev_pop(v) AS v FROM sig GROUP BY n), l AS (SELECT n, v, lag(v) OVER (ORDER BY n) AS b, lead(v) OVER (ORDER BY n) AS a FROM g), p AS (SELECT n, v AS gfp FROM l WHERE v > b AND v >= a) SELECT n, round(gfp, 6) AS gfp FROM p ORDER BY gfp DESC, n LIMIT (SELECT least(50, least(count(*), greatest(5, ceil(0.1 * count(*)))))::BIGINT FROM p)",
    "online_bandpower": f"WITH {FRAMES} SELECT channel, e AS end_n, band, round(log10(power), 6) AS log_power FROM fb",
    "online_ratio": f"WITH {FRAMES} SELECT channel, a.e AS end_n, round((a.power + 1e-12) / (b.power + 1e-12), 6) AS metric FROM fb a JOIN fb b USING (channel, e) WHERE a.band = 'alpha' AND b.band = 'beta'",
    "online_artifacts": f"WITH {SIGNAL}, fr AS (SELECT channel, greatest(50 + j - 1, j * 25) AS e FROM (SELECT channel, max(n) + 1 AS size FROM sig GROUP BY channel), range(1, 100000) r(j) WHERE greatest(50 + j - 1, j * 25) <= size), w AS (SELECT fr.channel, e, max(v) - min(v) AS ptp, sqrt(avg(v * v)) AS rms, kurtosis_pop(v) AS kurtosis FROM fr JOIN sig ON sig.channel = fr.channel AND n >= e - 50 AND n < e GROUP BY ALL), g AS (SELECT channel, e, 'ptp' AS f, ptp AS x FROM w UNION ALL SELECT channel, e, 'rms', rms FROM w UNION ALL SELECT channel, e, 'kurtosis', kurtosis FROM w), md AS (SELECT channel, f, median(x) AS md FROM g WHERE e <= 192 GROUP BY ALL), sc AS (SELECT channel, f, any_value(md) AS md, 1.4826 * median(abs(x - md)) AS s FROM g JOIN md USING (channel, f) WHERE e <= 192 GROUP BY ALL), z AS (SELECT e, channel, f, (x - md) / s AS z FROM g JOIN sc USING (channel, f)), c AS (SELECT e, channel, max(z) AS top, max(z) FILTER (f = 'ptp') AS p, max(z) FILTER (f = 'rms') AS r, max(z) FILTER (f = 'kurtosis') AS k FROM z GROUP BY e, channel), o AS (SELECT e, count(*) FILTER (top > 2) AS bad, count(*) AS have, greatest(0, max(p)) AS p, greatest(0, max(r)) AS r, greatest(0, max(k)) AS k FROM c GROUP BY e) SELECT e AS end_n, e > 192 AS ready, CASE WHEN e > 192 THEN bad ELSE 0 END AS bad_channels, e > 192 AND bad >= least(2, have) AS artifact, round(CASE WHEN e > 192 THEN p ELSE 0 END, 6) AS max_ptp_z, round(CASE WHEN e > 192 THEN r ELSE 0 END, 6) AS max_rms_z, round(CASE WHEN e > 192 THEN k ELSE 0 END, 6) AS max_kurtosis_z FROM o",
    "rolling_quantile": f"WITH {SIGNAL} SELECT channel, n, round(quantile_cont(v, 0.6) OVER (PARTITION BY channel ORDER BY n ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), 6) AS quantile FROM sig",
    "iso_times": "SELECT event_id, epoch_ms(date_trunc('milliseconds', ts)) - CASE WHEN event_id % 2 = 0 THEN 0 ELSE 7200000 END AS ms FROM events",
    "json_values": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
}
