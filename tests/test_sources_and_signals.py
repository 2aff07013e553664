"""Delimited recordings, sinks, filters, triggers, microstates, interpolation and online frames on small made-up inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.functions import naming
from wavelake.operators import events, kernels, microstates, recordings, signals
from wavelake.sources import delimited, edf, writers
from wavelake.streaming import online


def channel(rec, name):
    return [r["v"] for r in rec.samples.where(F.col("channel") == name).orderBy("n").collect()]


def marks(rec):
    return sorted((round(r["onset"], 6), round(r["duration"], 6), r["text"]) for r in rec.events.collect())


CASES = {
    "seconds": ("time,C1,C2\n0,1,2\n0.004,3,4\n0.008,5,6\n", 250.0, {"C1": [1, 3, 5], "C2": [2, 4, 6]}),
    "milliseconds": ("# a comment\ntime_ms;C1;C2\n0;1;2\n4;3;4\n8;5;6\n", 250.0, {"C1": [1, 3, 5]}),
    "quoted": ('time_ms;"Ch,1,2";"Ch,3,4"\n0;1;2\n10;3;4\n', 100.0, {"Ch,1,2": [1, 3]}),
    "mark": ("﻿time,C1\n0,1\n0.01,2\n", 100.0, {"C1": [1, 2]}),
    "comma": ("time;C1;C2\n0,000;1,5;2,5\n0,004;1,1;2,1\n", 250.0, {"C1": [1.5, 1.1]}),
    "thousands": ("time;C1;C2\n0,000;1.234,5;2\n0,004;2.000,5;3\n", 250.0, {"C1": [1234.5, 2000.5]}),
    "preamble": ("Vendor export\nPatient: x\n\ntime,C1,C2\n0,1,2\n0.01,2,3\n", 100.0, {"C1": [1, 2]}),
    "units": ("time (ms),C1 (mV),C1 [uV],X [V]\n0,1,2,3\n4,2,3,4\n", 250.0, {"C1": [1000, 2000], "C1_2": [2, 3], "X": [3e6, 4e6]}),
    "clock": ("time,C1,C2\n00:00:00.000,1,1\n00:00:00.010,2,1\n00:00:00.020,3,1\n", 100.0, {"C1": [1, 2, 3]}),
    "blanks": ("time_ms;EEG;Temp\n0;1;\n4;2;36.5\n8;;\n12;4;\n", 250.0, {"EEG": [1, 2, 2, 4], "Temp": [0, 36.5, 36.5, 36.5]}),
    "axes": ("Sample;Time;C1;C2\n1;0;1;2\n2;0.004;3;4\n", 250.0, {"C1": [1, 3], "C2": [2, 4]}),
    "short": ("time,C1,C2\n0,1,2\n0.01,3\n0.02,5,6,\n", 100.0, {"C1": [1, 3, 5], "C2": [2, 2, 6]}),
}


@pytest.mark.parametrize("name", CASES)
def test_delimited_recordings(spark, tmp_path, name):
    text, fs, want = CASES[name]
    path = tmp_path / f"{name}.csv"
    path.write_text(text, encoding="utf-8")
    rec = delimited.read_any(spark, str(path)) if name == "seconds" else delimited.read(spark, str(path))
    assert abs(rec.fs - fs) < 1e-6
    for c, values in want.items():
        assert np.allclose(channel(rec, c), values), c


def test_delimited_encodings_and_refusals(spark, tmp_path):
    for encoding in ("utf-16", "utf-16-be", "latin-1"):
        path = tmp_path / f"{encoding}.txt"
        path.write_bytes((("﻿" if encoding == "utf-16-be" else "") + "time,Höhe\n0,1\n0.01,2\n").encode(encoding))
        assert channel(delimited.read(spark, str(path)), "Höhe") == [1, 2]
    for data in (b"PK\x03\x04 zip", bytes(range(1, 9)) * 50):
        path = tmp_path / f"bad{len(data)}.csv"
        path.write_bytes(data)
        with pytest.raises(ValueError):
            delimited.read(spark, str(path))
    path = tmp_path / "index.csv"
    path.write_text("sample,C1\n0,5\n1,6\n2,7\n")
    with pytest.raises(ValueError):
        delimited.read(spark, str(path))
    assert channel(delimited.read(spark, str(path), fs=10), "C1") == [5, 6, 7]
    with pytest.raises(ValueError):
        delimited.format_of("a.bcd")


def test_delimited_events(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("time_ms;C1;Marker;Phase\n0;1;0;\n10;2;5;rest\n20;3;5;rest\n30;4;0;task\n40;5;7;task\n50;6;7;\n")
    rec = delimited.read(spark, str(path))
    assert marks(rec) == [(0.01, 0.0, "5"), (0.01, 0.02, "rest"), (0.03, 0.02, "task"), (0.04, 0.0, "7")]


def test_edf_through_dispatch_takes_triggers(spark, tmp_path):
    x = np.sin(np.arange(200))
    trig = np.zeros(200)
    trig[50:53], trig[120] = 5, 2
    (tmp_path / "a.edf").write_bytes(edf.encode([("Cz", 100 * x), ("TRIG", trig)], 100))
    rec = delimited.read_any(spark, str(tmp_path / "a.edf"))
    assert rec.fs == 100 and marks(rec) == [(0.5, 0.03, "5"), (1.2, 0.01, "2")]


def test_trigger_rules(spark):
    v = [7] * 3 + [0] * 2 + [5] * 3 + [0] + [5] + [0] * 3 + [float("nan")] + [9] * 2
    rec = spark.createDataFrame([("Status", i, float(x)) for i, x in enumerate(v)], "channel string, n long, v double")
    found = events.trigger_events(rec, ["channel"], 10.0)
    assert sorted((r["onset"], round(r["duration"], 6), r["text"]) for r in found.collect()) == [(0.5, 0.3, "5"), (0.9, 0.1, "5"), (1.4, 0.2, "9")]
    kept = events.debounced(found, ["channel"], 0.5)
    assert sorted((r["onset"], r["text"]) for r in kept.collect()) == [(0.5, "5"), (1.4, "9")]
    assert events.trigger_channel(rec).first()["channel"] == "Status"
    wide = rec.withColumn("v", F.col("v") + 2.0**20)
    assert [r["text"] for r in events.trigger_events(wide.where("n < 13"), ["channel"], 10.0, 0xFFFF).orderBy("onset").collect()] == ["5", "5"]


def test_writers_round_trip(spark, tmp_path):
    rec = spark.createDataFrame([(r, c, 50.0, n, float(np.sin(n) * (i + 1))) for r in ("a", "b") for i, c in enumerate(("C3", "C4")) for n in range(100)], "recording string, channel string, fs double, n long, v double")
    marks_of = spark.createDataFrame([("a", 0.5, 0.0, "go")], "recording string, onset double, duration double, text string")
    for kind in ("edf", "bdf", "brainvision"):
        done = writers.write_recordings(rec, f"file://{tmp_path}/{kind}", kind, marks_of).collect()
        assert {r["recording"] for r in done} == {"a", "b"} and all(r["bytes"] > 0 for r in done)
        back = delimited.read_any(spark, str(tmp_path / kind / ("a.vhdr" if kind == "brainvision" else f"a.{kind}")))
        assert np.allclose(channel(back, "C4")[:100], 2 * np.sin(np.arange(100)), atol=1e-3) and marks(back) == [(0.5, 0.0, "go")]
    wide = writers.recording_table(rec.where("recording = 'a'"), 50.0)
    assert wide.columns == ["time", "C3", "C4"] and wide.first()["time"] == 0


def test_sidecars_maps_and_lists(spark, tmp_path):
    rec = spark.createDataFrame([("Fp1", 0, 1.0), ("VEOG", 0, 1.0), ("TRIG", 0, 1.0)], "channel string, n long, v double")
    table = {r["name"]: (r["type"], r["units"], r["status"]) for r in writers.bids_channels(rec, 250.0, spark.createDataFrame([("VEOG",)], "channel string")).collect()}
    assert table == {"Fp1": ("EEG", "uV", "good"), "VEOG": ("VEOG", "uV", "bad"), "TRIG": ("TRIG", "n/a", "good")}
    texts = writers.bids_sidecars("d", "rest", 250.0, writers.bids_channels(rec, 250.0))
    assert json.loads(texts["task-rest_eeg.json"])["SamplingFrequency"] == 250.0
    z = {r["name"]: r["z"] for r in writers.bids_electrodes(naming.montage(spark, naming.MONTAGE_1010)).collect()}
    assert len(z) == 61 and z["Cz"] == 1.0
    (tmp_path / "map.csv").write_text("﻿old,new\nFp1,AF7\nTRIG,DROP\nVEOG,\n")
    mapped = writers.apply_map(rec, writers.channel_map(spark, str(tmp_path / "map.csv")))
    assert sorted(r["channel"] for r in mapped.collect()) == ["AF7", "VEOG"]
    (tmp_path / "twice.txt").write_text("Fp1=X\nVEOG=X\n")
    with pytest.raises(ValueError):
        writers.apply_map(rec, writers.channel_map(spark, str(tmp_path / "twice.txt")))
    (tmp_path / "bad.txt").write_text("Fp1, C3 # noisy\nO1\n")
    assert sorted(r["channel"] for r in writers.bad_channels(spark, str(tmp_path / "bad.txt")).collect()) == ["C3", "Fp1", "O1"]
    (tmp_path / "qc.csv").write_text("channel,bad,reasons\nFp1,1,flatline\nC3,0,\n")
    assert [r["channel"] for r in writers.bad_channels(spark, str(tmp_path / "qc.csv")).collect()] == ["Fp1"]
    (tmp_path / "run.json").write_text(json.dumps({"Tool": "t", "Outputs": ["a.csv", "./a.csv", "../x", "/etc", "b\\c.csv"], "Input": {"Path": "in.edf"}}))
    meta = writers.run_meta(spark, str(tmp_path / "run.json")).first()
    assert meta["outputs"] == ["a.csv", "b/c.csv"] and meta["input_path"] == "in.edf"
    (tmp_path / "m.csv").write_text("# x\nname,x,y\nA1,0.1,0.2\n")
    assert [(r["name"], r["x"]) for r in naming.read_montage(spark, str(tmp_path / "m.csv")).collect()] == [("A1", 0.1)]
    writers.reshaped(spark, str(tmp_path / "qc.csv"), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("part*")).read_text().split("\n")[0] == "channel\tbad\treasons"


def test_chunked_filters_equal_whole_ones(spark):
    rng = np.random.default_rng(1)
    x = {c: np.cumsum(rng.normal(size=6000)) for c in ("a", "b")}
    rec = spark.createDataFrame([(c, n, float(v)) for c, y in x.items() for n, v in enumerate(y)], "channel string, n long, v double")
    chain = signals.stages(250.0, 50.0, 4.0, 40.0)
    for zero in (True, False):
        out = signals.filtered(rec, chain, zero, chunk=1500)
        assert out.count() == 12000
        for c, y in x.items():
            got = np.array([r["v"] for r in out.where(F.col("channel") == c).orderBy("n").collect()])
            want = kernels.zero_phase(y, chain) if zero else kernels.sections(y, chain)
            assert np.abs(got - want).max() < 1e-3 * np.abs(want).max()
    both = signals.preprocessed(rec, 250.0, True, 0.0, 0.0, 0.0).groupBy("n").agg(F.sum("v").alias("s"))
    assert both.agg(F.max(F.abs("s"))).first()[0] < 1e-9


def test_phase_pairs_equal_kernels(spark):
    rng = np.random.default_rng(2)
    t = np.arange(1000) / 256
    x = {"a": np.sin(2 * np.pi * 10 * t), "b": np.sin(2 * np.pi * 10 * t + 0.7) + 0.1 * rng.normal(size=1000), "c": rng.normal(size=1000)}
    rec = spark.createDataFrame([("r", c, n, float(v)) for c, y in x.items() for n, v in enumerate(y)], "recording string, channel string, n long, v double")
    got = {(r["channel_a"], r["channel_b"]): r for r in signals.phase_pairs(rec, 256.0, 8.0, 12.0, ["recording"]).collect()}
    z = {c: kernels.analytic(kernels.bandpass(y, 256.0, 8.0, 12.0))[kernels.trimmed(1000, 0.1)] for c, y in x.items()}
    assert len(got) == 3 and got["a", "b"]["plv"] > 0.9 > got["a", "c"]["plv"]
    for (a, b), r in got.items():
        for name, value in kernels.phase_measures(z[a], z[b]).items():
            assert abs(r[name] - value) < 1e-6


def test_interpolation_and_alpha(spark):
    rec = spark.createDataFrame([(c, n, float(n + i) if c != "Cz" else 1e6) for i, c in enumerate(("Fp1", "Fp2", "C3", "C4", "Pz", "Cz")) for n in range(5)], "channel string, n long, v double")
    out = signals.interpolated(rec, ["Cz"], naming.montage(spark))
    got = [r["v"] for r in out.where("channel = 'Cz'").orderBy("n").collect()]
    assert out.count() == 30 and all(0 <= v - n <= 5 for n, v in enumerate(got))
    assert signals.interpolated(rec.where("channel in ('Fp1', 'Cz')"), ["Cz"], naming.montage(spark)).where("v > 1000").count() == 5
    rng = np.random.default_rng(3)
    t = np.arange(7500) / 250
    wave = spark.createDataFrame([(c, n, float(v)) for c, f in (("O1", 10.0), ("Fz", 9.0)) for n, v in enumerate(3 * np.sin(2 * np.pi * f * t) + rng.normal(size=7500))], "channel string, n long, v double")
    from wavelake.operators import spectra

    peaks = signals.alpha_peaks(spectra.welch(wave, 250.0, 1024, 512))
    assert abs({r["channel"]: r["iaf"] for r in peaks.collect()}["Fz"] - 9.0) < 1
    assert abs(signals.alpha_summary(peaks, signals.OCCIPITAL).first()["iaf"] - 10.0) < 0.5
    assert 9 < signals.alpha_summary(peaks, None, "mean").first()["iaf"] < 10
    assert signals.alpha_bands(10.0)[1] == ("theta", 4.0, 8.0) and signals.alpha_bands(float("nan")) == [] and signals.alpha_bands(5.0)[0] == ("delta", 0.5, 0.5)


def smooth_by_samples(labels, least):
    """Sample by sample, as the rule is told."""
    x = list(labels)
    for _ in range(10):
        changed, i = False, 0
        while i < len(x):
            j = i
            while j < len(x) and x[j] == x[i]:
                j += 1
            if x[i] >= 0 and j - i < least and (i or j < len(x)):
                before = after = 0
                while i - before - 1 >= 0 and x[i - before - 1] == x[i - 1]:
                    before += 1
                while j + after < len(x) and x[j + after] == x[j]:
                    after += 1
                new = x[j] if not i or (j < len(x) and after > before) else x[i - 1]
                if new >= 0 and new != x[i]:
                    x[i:j] = [new] * (j - i)
                    changed = True
            i = j
        if not changed:
            break
    return x


def test_microstates(spark):
    rng = np.random.default_rng(4)
    for _ in range(60):
        labels = np.repeat(rng.integers(-1, 4, 30), rng.integers(1, 6, 30))
        assert microstates.smooth(labels, 4).tolist() == smooth_by_samples(labels, 4)
    maps = rng.normal(size=(4, 5))
    state = np.repeat(rng.integers(0, 4, 40), 20)
    data = maps[state] * np.sin(2 * np.pi * 10 * np.arange(800) / 100)[:, None] + 0.05 * rng.normal(size=(800, 5))
    rec = spark.createDataFrame([(f"C{c}", n, float(data[n, c])) for n in range(800) for c in range(5)], "channel string, n long, v double")
    peaks = microstates.thinned(recordings.peaks(recordings.field_power(rec), "gfp", "n"), 3)
    kept = sorted(r["n"] for r in peaks.collect())
    assert kept and min(np.diff(kept)) >= 3
    found = microstates.templates(rec, microstates.top_fraction(peaks, 0.9), 4)
    centred = maps - maps.mean(1, keepdims=True)
    unit = centred / np.linalg.norm(centred, axis=1, keepdims=True)
    assert (np.abs(found @ unit.T).max(1) > 0.8).all()
    labels = microstates.assigned(rec, found, [f"C{c}" for c in range(5)]).withColumn("recording", F.lit("r"))
    smoothed = microstates.smoothed(labels, ["recording"], 3)
    stats = microstates.statistics(smoothed, ["recording"], 100.0).toPandas()
    assert stats.gev.sum() > 0.5 and abs(stats.coverage.sum() - 1) < 1e-9
    assert microstates.segments(smoothed, ["recording"], 100.0).agg(F.sum("duration")).first()[0] == pytest.approx(8.0)


def test_thinning_is_greedy(spark):
    rng = np.random.default_rng(5)
    places = np.unique(rng.integers(0, 3000, 400))
    gfp = rng.permutation(len(places)).astype(float)
    kept = []
    for i in np.argsort(-gfp):
        if all(abs(int(places[i]) - k) >= 7 for k in kept):
            kept.append(int(places[i]))
    rows = spark.createDataFrame(list(zip(places.tolist(), gfp.tolist(), strict=True)), "n long, gfp double")
    assert sorted(r["n"] for r in microstates.thinned(rows, 7).collect()) == sorted(kept)


def test_online_measures(spark):
    rng = np.random.default_rng(6)
    t = np.arange(512) / 128
    x = {"a": np.sin(2 * np.pi * 10 * t), "b": np.sin(2 * np.pi * 10 * t + 0.5) + 0.1 * rng.normal(size=512), "c": rng.normal(size=512)}
    rec = spark.createDataFrame([(c, n, float(v)) for c, y in x.items() for n, v in enumerate(y)], "channel string, n long, v double")
    size, step = online.sizes(128.0, 2.0, 0.5)
    fr = online.frames(rec, size, step, burst=False)
    c = {(r["channel_a"], r["channel_b"]): r["m"] for r in online.coherence_frames(fr, 128.0, 64, 8.0, 12.0).groupBy("channel_a", "channel_b").agg(F.avg("msc").alias("m")).collect()}
    assert c["a", "b"] > 0.8 > c["a", "c"]
    p = {(r["channel_a"], r["channel_b"]): r["m"] for r in online.phase_frames(fr, 128.0, 8.0, 12.0).groupBy("channel_a", "channel_b").agg(F.avg("plv").alias("m")).collect()}
    assert p["a", "b"] > 0.9 > p["a", "c"]
    assert online.pac_frames(fr, 128.0, (4.0, 8.0), (20.0, 40.0)).where("mi >= 0 and mvl >= 0").count() == fr.count()
    bands = online.band_frames(fr, 128.0, 64)
    ratio = online.metric_values(bands, "alpha/beta:a").toPandas()
    asym = online.metric_values(bands, "asym:alpha:a:c").toPandas()
    assert (ratio.metric > 1).all() and (asym.metric > 0).all() and len(ratio) == len(asym) == 5
    with pytest.raises(ValueError):
        online.sizes(128.0, 1.0, 2.0, clamp=False)


def test_streamed_frames_equal_batch(spark, tmp_path):
    rec = spark.createDataFrame([(c, n, float(n * (i + 1))) for i, c in enumerate("ab") for n in range(60)], "channel string, n long, v double")
    for i in range(3):
        rec.where(f"n >= {20 * i} and n < {20 * i + 20}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(rec.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = online.streamed(stream, 16, 5).writeStream.format("memory").queryName("frames").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["channel"], r["end_n"], tuple(r["x"])) for r in spark.table("frames").collect())
    assert got == sorted((r["channel"], r["end_n"], tuple(r["x"])) for r in online.frames(rec, 16, 5).collect())
