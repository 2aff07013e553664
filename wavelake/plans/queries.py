"""The registered signal queries over the driver's tables, and their SQL.

`events` plays an irregular recording (a channel per event_type, samples in time order), `embeddings` a rectangular one
(a sample per vec_id, a channel per array position).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import naming, scalar, specs
from ..operators import recordings, spectra, tables

FS, SEG, HOP = 128.0, 64, 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, n, v): events carry no sample number, so they are numbered by channel in time order."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), "ts", "event_id", F.col("value").alias("v"))
    return recordings.numbered(rows, ["channel"], "ts", ["ts", "event_id"]).select("channel", "n", "v")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, n, v) of the embeddings."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.posexplode("embedding").alias("channel", "x")).select("channel", "n", F.col("x").cast("double").alias("v"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def psd(spark, sf_dir):
    return spectra.welch(signal(spark, sf_dir), FS, SEG, HOP)


def power(spark, sf_dir):
    return spectra.band_power(psd(spark, sf_dir), specs.bands())


def welch_psd(spark, sf_dir):
    return psd(spark, sf_dir).select("channel", "k", F.round(F.log10("p"), 6).alias("log_p"))


def band_power(spark, sf_dir):
    return power(spark, sf_dir).select("channel", "band", F.round(F.log10("power"), 6).alias("log_power"))


def relative_power(spark, sf_dir):
    return r6(spectra.relative(psd(spark, sf_dir), specs.bands()).select("channel", "band", "rel", "log_power"), "rel", "log_power")


def band_ratio(spark, sf_dir):
    return r6(spectra.band_ratios(power(spark, sf_dir), specs.ratios()), "ratio")


def alpha_zscore(spark, sf_dir):
    alpha = spectra.relative(psd(spark, sf_dir), specs.bands()).where("band = 'alpha'").select("channel", "band", F.col("rel").alias("v"))
    return r6(tables.z_scores(alpha, tables.reference(alpha, ["band"]), ["band"]).select("channel", F.col("v").alias("rel"), "z"), "rel", "z")


def spectral_entropy(spark, sf_dir):
    out = spectra.entropy(psd(spark, sf_dir), 0.0, 64.0)
    return r6(out.select("channel", F.log10("total_power").alias("log_total"), "entropy", "mean_freq"), "log_total", "entropy", "mean_freq")


def coherence_pairs(spark, sf_dir):
    return r6(spectra.coherence(signal(spark, sf_dir), SEG, HOP), "msc", "imcoh")


def line_noise(spark, sf_dir):
    return r6(spectra.line_noise(psd(spark, sf_dir), 50.0, 1.0, 1.5, 5.0).select("channel", "ratio"), "ratio")


def car(spark, sf_dir):
    return r6(recordings.average_reference(matrix(spark, sf_dir)), "v")


def gfp(spark, sf_dir):
    return r6(recordings.field_power(matrix(spark, sf_dir)), "gfp")


def gfp_peaks(spark, sf_dir):
    return r6(recordings.peaks(recordings.field_power(matrix(spark, sf_dir)), "gfp", "n"), "gfp")


def channel_stats(spark, sf_dir):
    return r6(recordings.statistics(signal(spark, sf_dir)), "mean", "sd_pop", "sd_samp", "ptp", "min_v", "max_v")


def robust_scale(spark, sf_dir):
    return r6(recordings.robust(signal(spark, sf_dir), ["channel"]), "median", "scale")


def artifact_windows(spark, sf_dir):
    return r6(recordings.windows(signal(spark, sf_dir), 50, 25), "ptp", "rms", "kurtosis")


def artifact_flags(spark, sf_dir):
    return r6(recordings.artifacts(recordings.windows(signal(spark, sf_dir), 50, 25), 10, 3.0), "ptp_z", "rms_z", "kurtosis_z")


def artifact_segments(spark, sf_dir):
    flags = recordings.artifacts(recordings.windows(signal(spark, sf_dir), 50, 25), 10, 2.0).where("bad")
    return tables.merge_segments(flags.select("channel", (F.col("w") * 25).alias("start"), (F.col("w") * 25 + 50).alias("end")), ["channel"]).withColumnsRenamed({"start": "start_n", "end": "end_n"})


def clean_segments(spark, sf_dir):
    flags = recordings.artifacts(recordings.windows(signal(spark, sf_dir), 50, 25), 10, 2.0).where("bad")
    bad = tables.merge_segments(flags.select("channel", (F.col("w") * 25).alias("start"), (F.col("w") * 25 + 50).alias("end")), ["channel"])
    total = signal(spark, sf_dir).groupBy("channel").agg(F.count(F.lit(1)).alias("total"))
    return tables.complement(bad, ["channel"], total).withColumnsRenamed({"start": "start_n", "end": "end_n"})


def channel_qc(spark, sf_dir):
    rec = signal(spark, sf_dir)
    return r6(recordings.quality(recordings.statistics(rec), recordings.robust(rec, ["channel"]), noisy=1.05), "ptp", "scale")


def merge_shipments(spark, sf_dir):
    day = F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("start"), (day + F.col("l_linenumber")).alias("end"))
    return tables.merge_segments(rows, ["l_suppkey"], 1).withColumnsRenamed({"start": "start_day", "end": "end_day"})


def events_dedup(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.round(F.col("value"), 0).alias("onset"), (F.col("value") * 0 + 0.5).alias("duration"), F.concat(F.lit(" "), "event_type").alias("text"))
    return tables.deduplicate_events(rows, ["user_id"])


def events_clip(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.col("value").alias("onset"), (F.col("event_id") % 7).cast("double").alias("duration"))
    return r6(tables.clip_events(rows, 100.0, 200.0), "onset", "duration")


def event_glob(spark, sf_dir):
    return read(spark, sf_dir, "events").where(tables.text_matches(F.col("event_type"), glob="*c*k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def reference_build(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").alias("v"))
    return r6(tables.reference(rows, ["user_id", "event_type"]), "mean", "std")


def zscore_join(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("v"))
    return r6(tables.z_scores(rows, tables.reference(rows, ["user_id"]), ["user_id"]), "z")


def electrode_values(spark, sf_dir):
    """A value per channel of the 10-20 montage: the means of the embedding positions, dealt to its 19 channels in turn."""
    names = [line.split()[0] for line in naming.MONTAGE_1020.split("\n") if line]
    named = spark.createDataFrame(list(enumerate(names)), "channel_no int, name string")
    means = matrix(spark, sf_dir).groupBy((F.col("channel") % 19).alias("channel")).agg(F.avg("v").alias("v"))
    return means.join(F.broadcast(named), F.col("channel") == F.col("channel_no")).select(F.col("name").alias("channel"), naming.normalize(F.col("name")).alias("key"), "v")


def region_summary(spark, sf_dir):
    return r6(tables.regions(electrode_values(spark, sf_dir)), "mean")


def idw_topomap(spark, sf_dir):
    return r6(recordings.topomap(electrode_values(spark, sf_dir), naming.montage(spark), 16), "v")


def nation_edges(spark, sf_dir):
    """Edges between customers' and suppliers' nations, by traded quantity."""
    li, o, c, s = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    sums = rows.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.sum("l_quantity").alias("w"))
    return tables.edges(sums.withColumn("ord", F.col("a") * 100 + F.col("b")))


def graph_nodes(spark, sf_dir):
    return r6(tables.nodes(nation_edges(spark, sf_dir)), "strength", "mean_weight", "max_weight")


def graph_region_pairs(spark, sf_dir):
    return r6(tables.region_pairs(nation_edges(spark, sf_dir), F.col("node") % 5), "sum_weight", "mean_weight")


def top_edges(spark, sf_dir):
    return r6(nation_edges(spark, sf_dir).orderBy(F.desc("w"), "a", "b").limit(10), "w")


def protocol_rank(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("roi"), "p_size", "p_retailprice")
    long = rows.select("roi", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot(["roi"], ["p_size", "p_retailprice"], "metric", "v")
    return tables.ranked(long, 25)


def roi_last_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return tables.last_wins(rows, ["l_suppkey", "l_returnflag"], "ord").select("l_suppkey", "l_returnflag", "l_extendedprice")


def run_length_segments(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return recordings.runs(rows, ["user_id"], "event_id", "event_type").withColumnsRenamed({"first": "first_id", "last": "last_id"})


def label_transitions(spark, sf_dir):
    return recordings.transitions(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


def forward_fill(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return recordings.forward_fill(rows, ["user_id"], "event_id", "v")


def fs_infer(spark, sf_dir):
    """Median positive spacing per user, in seconds, and the rate."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = read(spark, sf_dir, "events").select("user_id", (t - F.lag(t).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("dt")).where("dt > 0")
    return r6(rows.groupBy("user_id").agg(F.expr("percentile(dt, 0.5)").alias("dt")).select("user_id", "dt", (1 / F.col("dt")).alias("fs")), "dt", "fs")


def resample_linear(spark, sf_dir):
    return r6(recordings.resample(signal(spark, sf_dir), 500), "v")


def resample_hold(spark, sf_dir):
    return r6(recordings.resample(signal(spark, sf_dir), 500, hold=True), "v")


def frames_rule_a(spark, sf_dir):
    sizes = signal(spark, sf_dir).groupBy("channel").agg(F.max("n").alias("n"))
    return recordings.frames(sizes.withColumn("n", F.col("n") + 1), "n", 100, 13, True).select("channel", "end_n")


def frames_rule_b(spark, sf_dir):
    sizes = signal(spark, sf_dir).groupBy("channel").agg(F.max("n").alias("n"))
    return recordings.frames(sizes.withColumn("n", F.col("n") + 1), "n", 100, 13, False).select("channel", "end_n")


def reward_rate(spark, sf_dir):
    return r6(recordings.reward_rate(signal(spark, sf_dir), ["channel"], "n", F.col("v") > 30, 20).drop("v"), "rate")


def epoch_baseline(spark, sf_dir):
    """Mean square of 20 samples from each multiple of 100 on, against the 20 before."""
    rows = signal(spark, sf_dir).withColumn("epoch", F.floor((F.col("n") + 20) / 100)).withColumn("at", F.col("n") - F.col("epoch") * 100).where("epoch > 0 AND at >= -20 AND at < 20")
    sums = rows.groupBy("channel", "epoch").agg(F.avg(F.when(F.col("at") >= 0, F.col("v") * F.col("v"))).alias("e"), F.avg(F.when(F.col("at") < 0, F.col("v") * F.col("v"))).alias("b"))
    return r6(sums.select("channel", "epoch", scalar.baseline(F.col("e"), F.col("b"), "db").alias("db"), scalar.baseline(F.col("e"), F.col("b"), "rel").alias("rel")), "db", "rel")


def table_filter(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    return df.where(specs.row_filter(df, "c_mktsegment:build c_acctbal>=1000 -c_nationkey=3")).select("c_custkey")


def phase_schedule(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", scalar.phase(F.col("value"), 10.0, 30.0).alias("phase"), F.round(scalar.feedback(F.col("value"), F.lit(50.0), 40.0), 6).alias("feedback"))


def channel_names(spark, sf_dir):
    c = F.concat(F.lit("EEG "), F.col("p_name"), F.lit("-Ref"))
    return read(spark, sf_dir, "part").select("p_partkey", naming.normalize(c).alias("key"))


QUERIES = {f.__name__: f for f in (alpha_zscore, welch_psd, band_power, relative_power, band_ratio, spectral_entropy, coherence_pairs, line_noise, car, gfp, gfp_peaks, channel_stats, robust_scale, artifact_windows, artifact_flags, artifact_segments, clean_segments, channel_qc, merge_shipments, events_dedup, events_clip, event_glob, reference_build, zscore_join, region_summary, idw_topomap, graph_nodes, graph_region_pairs, top_edges, protocol_rank, roi_last_wins, run_length_segments, label_transitions, forward_fill, fs_infer, resample_linear, resample_hold, frames_rule_a, frames_rule_b, reward_rate, epoch_baseline, table_filter, phase_schedule, channel_names)}

SIGNAL = "sig AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, value AS v FROM events)"
MATRIX = "m AS (SELECT vec_id AS n, generate_subscripts(embedding, 1) - 1 AS channel, unnest(embedding)::DOUBLE AS v FROM embeddings)"
TRANSFORM = SIGNAL + """,
seg AS (SELECT channel, s AS seg, n - s * 32 AS i, v FROM sig, range(0, 100000) r(s) WHERE n >= s * 32 AND n < s * 32 + 64 AND s * 32 <= (SELECT max(n) FROM sig)),
cent AS (SELECT channel, seg, i, v - avg(v) OVER w AS v, count(*) OVER w AS c FROM seg WINDOW w AS (PARTITION BY channel, seg)),
tr AS (SELECT channel, seg, k, sum(v * h * cos(2 * pi() * k * i / 64)) AS re, -sum(v * h * sin(2 * pi() * k * i / 64)) AS im
  FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / 63) AS h FROM cent WHERE c = 64), range(0, 33) q(k) GROUP BY ALL)"""
PSD = TRANSFORM + """,
psd AS (SELECT channel, k, k * 2.0 AS freq, avg(re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END
  / (128.0 * (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 63), 2)) FROM range(0, 64) h(i))) AS p FROM tr GROUP BY channel, k),
iv AS (SELECT * FROM (SELECT channel, freq AS f0, lead(freq) OVER w AS f1, p AS p0, lead(p) OVER w AS p1 FROM psd WINDOW w AS (PARTITION BY channel ORDER BY k)) WHERE f1 IS NOT NULL),
bands(band, lo, hi) AS (VALUES ('delta', 0.5, 4.0), ('theta', 4.0, 7.0), ('alpha', 8.0, 12.0), ('beta', 13.0, 30.0), ('gamma', 30.0, 80.0), ('total', 0.5, 80.0)),
cut AS (SELECT *, greatest(f0, lo) AS a, least(f1, hi) AS b FROM iv, bands WHERE f1 > lo AND f0 < hi),
allp AS (SELECT channel, band, sum(0.5 * (2 * p0 + (p1 - p0) / (f1 - f0) * (a - f0 + b - f0)) * (b - a)) AS power FROM cut GROUP BY ALL),
bp AS (SELECT x.channel, x.band, x.power, x.power / t.power AS rel FROM allp x JOIN allp t ON t.channel = x.channel AND t.band = 'total' WHERE x.band <> 'total')"""
WINDOWS = SIGNAL + """,
win AS (SELECT channel, w, max(v) - min(v) AS ptp, sqrt(avg(v * v)) AS rms, kurtosis_pop(v) AS kurtosis FROM sig, range(0, 100000) r(w)
  WHERE n >= w * 25 AND n < w * 25 + 50 AND w * 25 <= (SELECT max(n) FROM sig) GROUP BY channel, w HAVING count(*) = 50)"""
FLAGS = WINDOWS + """,
lng AS (SELECT channel, w, 'ptp' AS f, ptp AS x FROM win UNION ALL SELECT channel, w, 'rms', rms FROM win UNION ALL SELECT channel, w, 'kurtosis', kurtosis FROM win),
med AS (SELECT channel, f, median(x) AS md FROM lng WHERE w < 10 GROUP BY ALL),
sc AS (SELECT channel, f, any_value(md) AS md, 1.4826 * median(abs(x - md)) AS s FROM lng JOIN med USING (channel, f) WHERE w < 10 GROUP BY ALL),
zz AS (SELECT channel, w, f, (x - md) / s AS z FROM lng JOIN sc USING (channel, f)),
fl AS (SELECT channel, w, max(z) FILTER (f = 'ptp') AS ptp_z, max(z) FILTER (f = 'rms') AS rms_z, max(z) FILTER (f = 'kurtosis') AS kurtosis_z FROM zz GROUP BY channel, w)"""
SEGS = FLAGS + """,
bad AS (SELECT channel, w * 25 AS s, w * 25 + 50 AS e FROM fl WHERE greatest(ptp_z, rms_z, kurtosis_z) > 2),
isl AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY channel ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM bad),
mg AS (SELECT channel, min(s) AS s, max(e) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY channel ORDER BY s, e) AS g FROM isl) GROUP BY channel, g)"""
NAMES = ", ".join(f"({i}, '{line.split()[0]}', {line.split()[1]}, {line.split()[2]})" for i, line in enumerate(x for x in naming.MONTAGE_1020.split("\n") if x))
ELECTRODES = MATRIX + f""",
nm(no, name, x, y) AS (VALUES {NAMES}),
el AS (SELECT name, x::DOUBLE AS x, y::DOUBLE AS y, avg(v) AS v FROM m JOIN nm ON no = channel % 19 GROUP BY ALL)"""
EDGES = """e0 AS (SELECT c_nationkey AS a, s_nationkey AS b, sum(l_quantity) AS w, c_nationkey * 100 + s_nationkey AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
ed AS (SELECT least(a, b) AS a, greatest(a, b) AS b, arg_min(w, ord) AS w FROM e0 WHERE a <> b GROUP BY 1, 2)"""

ORACLES = {
    "welch_psd": f"WITH {PSD} SELECT channel, k, round(log10(p), 6) AS log_p FROM psd",
    "band_power": f"WITH {PSD} SELECT channel, band, round(log10(power), 6) AS log_power FROM bp",
    "relative_power": f"WITH {PSD} SELECT channel, band, round(rel, 6) AS rel, round(log10(power), 6) AS log_power FROM bp",
    "band_ratio": f"WITH {PSD}, rt(name, num, den) AS (VALUES ('theta_beta', 'theta', 'beta'), ('alpha_theta', 'alpha', 'theta')) SELECT a.channel, name, round(a.power / b.power, 6) AS ratio FROM rt JOIN bp a ON a.band = num JOIN bp b ON b.band = den AND a.channel = b.channel",
    "alpha_zscore": f"WITH {PSD} SELECT channel, round(rel, 6) AS rel, round((rel - avg(rel) OVER ()) / stddev_samp(rel) OVER (), 6) AS z FROM bp WHERE band = 'alpha'",
    "spectral_entropy": f"WITH {PSD}, ar AS (SELECT channel, f0, f1, 0.5 * (p0 + p1) * (f1 - f0) AS a, (p0 * (2 * f0 + f1) + p1 * (f0 + 2 * f1)) * (f1 - f0) / 6 AS fa FROM iv), q AS (SELECT *, a / sum(a) OVER (PARTITION BY channel) AS q FROM ar WHERE a > 0) SELECT channel, round(log10(sum(a)), 6) AS log_total, round(-sum(q * ln(q)) / ln(count(*)), 6) AS entropy, round(sum(fa) / sum(a), 6) AS mean_freq FROM q GROUP BY channel",
    "coherence_pairs": f"WITH {TRANSFORM}, pr AS (SELECT a.channel AS channel_a, b.channel AS channel_b, k, sum(a.re * b.re + a.im * b.im) AS re, sum(a.im * b.re - a.re * b.im) AS im, sum(a.re * a.re + a.im * a.im) AS pa, sum(b.re * b.re + b.im * b.im) AS pb FROM tr a JOIN tr b USING (seg, k) WHERE a.channel < b.channel GROUP BY ALL) SELECT channel_a, channel_b, k, round((re * re + im * im) / (pa * pb), 6) AS msc, round(abs(im) / sqrt(pa * pb), 6) AS imcoh FROM pr",
    "line_noise": f"WITH {PSD} SELECT channel, round(avg(p) FILTER (abs(freq - 50) <= 1) / avg(p) FILTER (abs(freq - 50) BETWEEN 1.5 AND 5), 6) AS ratio FROM psd GROUP BY channel",
    "car": f"WITH {MATRIX} SELECT channel, n, round(v - avg(v) OVER (PARTITION BY n), 6) AS v FROM m",
    "gfp": f"WITH {MATRIX} SELECT n, round(stddev_pop(v), 6) AS gfp FROM m GROUP BY n",
    "gfp_peaks": f"WITH {MATRIX}, g AS (SELECT n, stddev_pop(v) AS gfp FROM m GROUP BY n), l AS (SELECT *, lag(gfp) OVER (ORDER BY n) AS b, lead(gfp) OVER (ORDER BY n) AS a FROM g) SELECT n, round(gfp, 6) AS gfp FROM l WHERE gfp > b AND gfp >= a",
    "channel_stats": f"WITH {SIGNAL} SELECT channel, count(v) AS n, 0 AS n_bad, round(min(v), 6) AS min_v, round(max(v), 6) AS max_v, round(max(v) - min(v), 6) AS ptp, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd_pop, round(stddev_samp(v), 6) AS sd_samp FROM sig GROUP BY channel",
    "robust_scale": f"WITH {SIGNAL}, md AS (SELECT channel, median(v) AS md FROM sig GROUP BY channel) SELECT channel, round(any_value(md), 6) AS median, round(1.4826 * median(abs(v - md)), 6) AS scale FROM sig JOIN md USING (channel) GROUP BY channel",
    "artifact_windows": f"WITH {WINDOWS} SELECT channel, w, round(ptp, 6) AS ptp, round(rms, 6) AS rms, round(kurtosis, 6) AS kurtosis FROM win",
    "artifact_flags": f"WITH {FLAGS} SELECT channel, w, round(ptp_z, 6) AS ptp_z, round(rms_z, 6) AS rms_z, round(kurtosis_z, 6) AS kurtosis_z, greatest(ptp_z, rms_z, kurtosis_z) > 3 AS bad FROM fl",
    "artifact_segments": f"WITH {SEGS} SELECT channel, s AS start_n, e AS end_n FROM mg",
    "clean_segments": f"WITH {SEGS}, ed AS (SELECT channel, s, e FROM mg UNION ALL SELECT channel, count(*), count(*) FROM sig GROUP BY channel), c AS (SELECT channel, coalesce(lag(e) OVER (PARTITION BY channel ORDER BY s, e), 0) AS start_n, s AS end_n FROM ed) SELECT * FROM c WHERE end_n > start_n",
    "channel_qc": f"WITH {SIGNAL}, md AS (SELECT channel, median(v) AS md FROM sig GROUP BY channel), s AS (SELECT channel, max(v) - min(v) AS ptp, 1.4826 * median(abs(v - md)) AS scale FROM sig JOIN md USING (channel) GROUP BY channel), t AS (SELECT median(scale) AS t FROM s), f AS (SELECT *, ptp < 1 OR scale < 0.02 * t AS flatline, scale > 1.05 * t AS noisy FROM s, t) SELECT channel, round(ptp, 6) AS ptp, round(scale, 6) AS scale, flatline, noisy, flatline OR noisy AS bad, concat_ws(';', CASE WHEN flatline THEN 'flatline' END, CASE WHEN noisy THEN 'noisy' END) AS reasons FROM f",
    "merge_shipments": "WITH r AS (SELECT l_suppkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_linenumber AS e FROM lineitem), i AS (SELECT *, CASE WHEN s > 1 + max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM r) SELECT l_suppkey, min(s) AS start_day, max(e) AS end_day FROM (SELECT *, sum(nw) OVER (PARTITION BY l_suppkey ORDER BY s, e) AS g FROM i) GROUP BY l_suppkey, g",
    "events_dedup": "SELECT DISTINCT user_id, (round(value) * 1000000)::BIGINT AS onset_us, 500000 AS duration_us, event_type AS text FROM events",
    "events_clip": "SELECT event_id, round(greatest(value, 100) - 100, 6) AS onset, round(least(value + event_id % 7, 200) - greatest(value, 100), 6) AS duration FROM events WHERE value < 200 AND (value + event_id % 7 > 100 OR (event_id % 7 = 0 AND value >= 100))",
    "event_glob": "SELECT event_type, count(*) AS n FROM events WHERE event_type ILIKE '%c%k' GROUP BY event_type",
    "reference_build": "SELECT user_id, event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2 AND stddev_samp(value) > 0",
    "zscore_join": "SELECT event_id, user_id, value AS v, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS z FROM events WINDOW w AS (PARTITION BY user_id)",
    "region_summary": f"WITH {ELECTRODES}, g AS (SELECT v, CASE WHEN name[1] = 'F' THEN 'Frontal' WHEN name[1] = 'T' THEN 'Temporal' WHEN name[1] = 'C' THEN 'Central' WHEN name[1] = 'P' THEN 'Parietal' ELSE 'Occipital' END AS lobe, CASE WHEN name LIKE '%z' THEN 'Midline' WHEN right(name, 1)::INT % 2 = 1 THEN 'Left' ELSE 'Right' END AS hemi FROM el) SELECT CASE WHEN grouping(lobe) = 1 AND grouping(hemi) = 1 THEN 'all' WHEN grouping(hemi) = 1 THEN 'lobe' WHEN grouping(lobe) = 1 THEN 'hemisphere' ELSE 'lobe_hemi' END AS group_type, CASE WHEN grouping(lobe) = 1 AND grouping(hemi) = 1 THEN 'All' ELSE concat_ws('_', lobe, hemi) END AS group_name, count(*) AS n_channels, round(avg(v), 6) AS mean FROM g GROUP BY GROUPING SETS ((), (lobe), (hemi), (lobe, hemi))",
    "idw_topomap": f"WITH {ELECTRODES}, gr AS (SELECT gx, gy, -1 + 2 * gx / 15.0 AS px, -1 + 2 * gy / 15.0 AS py FROM range(0, 16) a(gx), range(0, 16) b(gy)), d AS (SELECT gx, gy, v, (px - x) ** 2 + (py - y) ** 2 AS d2 FROM gr, el WHERE px * px + py * py <= 1) SELECT gx, gy, round(coalesce(max(v) FILTER (d2 <= 1e-12), sum(v / d2) FILTER (d2 > 1e-12) / sum(1 / d2) FILTER (d2 > 1e-12)), 6) AS v FROM d GROUP BY gx, gy",
    "graph_nodes": f"WITH {EDGES}, bo AS (SELECT a AS node, w FROM ed UNION ALL SELECT b, w FROM ed) SELECT node, count(*) AS degree, round(sum(w), 6) AS strength, round(avg(w), 6) AS mean_weight, round(max(w), 6) AS max_weight FROM bo GROUP BY node",
    "graph_region_pairs": f"WITH {EDGES} SELECT least(a % 5, b % 5) AS region_a, greatest(a % 5, b % 5) AS region_b, count(*) AS edge_count, round(sum(w), 6) AS sum_weight, round(avg(w), 6) AS mean_weight FROM ed GROUP BY 1, 2",
    "top_edges": f"WITH {EDGES} SELECT a, b, round(w, 6) AS w FROM ed ORDER BY w DESC, a, b LIMIT 10",
    "protocol_rank": "WITH l AS (SELECT p_partkey::VARCHAR AS roi, 'p_size' AS metric, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey::VARCHAR, 'p_retailprice', p_retailprice FROM part) SELECT roi, metric, v, row_number() OVER (ORDER BY abs(v) DESC, metric, roi) AS rank FROM l ORDER BY rank LIMIT 25",
    "roi_last_wins": "SELECT l_suppkey, l_returnflag, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS l_extendedprice FROM lineitem GROUP BY ALL",
    "run_length_segments": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) SELECT user_id, event_type, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM r GROUP BY user_id, event_type, g",
    "label_transitions": "WITH l AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_label, event_type AS to_label FROM events) SELECT from_label, to_label, count(*) AS n FROM l WHERE from_label <> to_label GROUP BY ALL",
    "forward_fill": "SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS v FROM events",
    "fs_infer": "WITH d AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dt FROM events) SELECT user_id, round(median(dt), 6) AS dt, round(1 / median(dt), 6) AS fs FROM d WHERE dt > 0 GROUP BY user_id",
    "resample_linear": f"WITH {SIGNAL}, z AS (SELECT channel, max(n) + 1 AS size FROM sig GROUP BY channel), g AS (SELECT channel, j, j * ((size - 1) / 499.0::DOUBLE) AS x, size FROM z, range(0, 500) r(j)), f AS (SELECT channel, j, x, least(floor(x), size - 1)::BIGINT AS n FROM g) SELECT f.channel, j AS n, round(a.v + (x - f.n) * (coalesce(b.v, a.v) - a.v), 6) AS v FROM f JOIN sig a ON a.channel = f.channel AND a.n = f.n LEFT JOIN sig b ON b.channel = f.channel AND b.n = f.n + 1",
    "resample_hold": f"WITH {SIGNAL}, z AS (SELECT channel, max(n) + 1 AS size FROM sig GROUP BY channel), f AS (SELECT channel, j, (j * size) // 500 AS n FROM z, range(0, 500) r(j)) SELECT f.channel, j AS n, round(v, 6) AS v FROM f JOIN sig USING (channel, n)",
    "frames_rule_a": f"WITH {SIGNAL}, z AS (SELECT channel, max(n) + 1 AS size FROM sig GROUP BY channel) SELECT channel, greatest(100 + j - 1, j * 13) AS end_n FROM z, range(1, 200000) r(j) WHERE greatest(100 + j - 1, j * 13) <= size",
    "frames_rule_b": f"WITH {SIGNAL}, z AS (SELECT channel, max(n) + 1 AS size FROM sig GROUP BY channel) SELECT channel, j * 13 AS end_n FROM z, range(1, 200000) r(j) WHERE j * 13 BETWEEN 100 AND size",
    "reward_rate": f"WITH {SIGNAL} SELECT channel, n, round(avg((v > 30)::INT) OVER (PARTITION BY channel ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rate FROM sig",
    "epoch_baseline": f"WITH {SIGNAL}, r AS (SELECT channel, (n + 20) // 100 AS epoch, n - (n + 20) // 100 * 100 AS pos, v FROM sig), a AS (SELECT channel, epoch, avg(v * v) FILTER (pos >= 0) AS e, avg(v * v) FILTER (pos < 0) AS b FROM r WHERE epoch > 0 AND pos BETWEEN -20 AND 19 GROUP BY ALL) SELECT channel, epoch, round(10 * log10(e / b), 6) AS db, round((e - b) / b, 6) AS rel FROM a",
    "table_filter": "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%build%' AND c_acctbal >= 1000 AND c_nationkey <> 3",
    "phase_schedule": "SELECT event_id, CASE WHEN value % 40 < 30 THEN 'train' ELSE 'rest' END AS phase, round(least(greatest((value - 50) / 40, 0), 1), 6) AS feedback FROM events",
    "channel_names": "WITH k AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part), s AS (SELECT p_partkey, CASE WHEN regexp_matches(k, '^[a-z]') THEN k ELSE 'eeg' || k END AS k FROM k) SELECT p_partkey, CASE k WHEN 't3' THEN 't7' WHEN 't4' THEN 't8' WHEN 't5' THEN 'p7' WHEN 't6' THEN 'p8' ELSE k END AS key FROM s",
}
