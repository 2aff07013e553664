"""Kernels against closed forms and the SQL forms, sources round trip, the feedback loop in batch and stream."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavelake.functions import naming, scalar, specs
from wavelake.operators import kernels, recordings, spectra, tables
from wavelake.sources import edf, tabular
from wavelake.streaming import feedback


def long(spark, signals):
    rows = [(c, i, float(v)) for c, x in signals.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "channel string, n long, v double")


def test_welch_sql_equals_numpy(spark):
    x = np.random.default_rng(1).normal(size=400) + np.sin(2 * np.pi * 10 * np.arange(400) / 128)
    got = spectra.welch(long(spark, {"a": x}), 128.0, 64, 32).orderBy("k").toPandas()
    freqs, p = kernels.welch(x, 128.0, 64)
    assert np.allclose(got.freq, freqs) and np.allclose(got.p, p)
    power = {r["band"]: r["power"] for r in spectra.band_power(spectra.welch(long(spark, {"a": x}), 128.0, 64, 32), specs.bands()).collect()}
    assert power["alpha"] > power["theta"] and power["alpha"] > power["beta"]


def test_coherence_separates(spark):
    rng = np.random.default_rng(2)
    s = np.sin(2 * np.pi * 10 * np.arange(1500) / 128)
    got = spectra.coherence(long(spark, {"x": s + 0.2 * rng.normal(size=1500), "y": s + 0.2 * rng.normal(size=1500), "z": rng.normal(size=1500)}), 64, 32).where("k = 5").toPandas().set_index(["channel_a", "channel_b"])
    assert got.msc["x", "y"] > got.msc["x", "z"] + 0.1 and got.msc.between(0, 1).all()


def test_filters_pass_and_stop():
    t = np.arange(2560) / 256
    ten, fifty = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 50 * t)
    out = kernels.zero_phase(ten + fifty, [kernels.biquad("notch", 256, 50, 30)])[500:-500]
    assert np.abs(out - ten[500:-500]).max() < 0.05
    assert np.abs(kernels.bandpass(fifty, 256, 8, 12)[300:-300]).max() < 0.1


def test_phase_measures(spark):
    rng = np.random.default_rng(3)
    t = np.arange(2560) / 256
    rows = [("r", "a", np.sin(2 * np.pi * 10 * t).tolist()), ("r", "b", (np.sin(2 * np.pi * 10 * t + 1) + 0.1 * rng.normal(size=2560)).tolist()), ("r", "c", rng.normal(size=2560).tolist())]
    got = kernels.phase_pairs(spark.createDataFrame(rows, "recording string, channel string, x array<double>"), 256, 8, 12).toPandas().set_index(["channel_a", "channel_b"])
    assert got.plv["a", "b"] > 0.95 > 0.7 > got.plv["a", "c"] and got.wpli["a", "b"] > 0.9


def test_pac_and_alpha(spark):
    rng = np.random.default_rng(4)
    t = np.arange(6000) / 500
    slow = np.sin(2 * np.pi * 6 * t)
    coupled = slow + (1 + slow) * 0.5 * np.sin(2 * np.pi * 60 * t) + 0.05 * rng.normal(size=6000)
    flat = slow + 0.5 * np.sin(2 * np.pi * 60 * t) + 0.05 * rng.normal(size=6000)
    table = spark.createDataFrame([("a", coupled.tolist()), ("b", flat.tolist())], "channel string, x array<double>")
    got = {r["channel"]: r["p"] for r in table.select("channel", kernels.pac_of(F.col("x"), 500, (4, 8), (50, 70)).alias("p")).collect()}
    assert got["a"]["mi"] > got["b"]["mi"] + 0.02 and got["a"]["mvl"] > got["b"]["mvl"] + 0.05
    x = np.sin(2 * np.pi * 10 * np.arange(7500) / 250) + 0.5 * rng.normal(size=7500)
    peak, cog, found = kernels.peak_frequency(*kernels.welch(x, 250, 1024))
    assert found and abs(peak - 10) < 1 and abs(cog - 10) < 1


def test_microstates_find_templates():
    rng = np.random.default_rng(5)
    true = rng.normal(size=(4, 6))
    true -= true.mean(1, keepdims=True)
    true /= np.linalg.norm(true, axis=1, keepdims=True)
    maps = true[rng.integers(4, size=800)] * rng.choice([-1, 1], size=(800, 1)) * 3 + 0.1 * rng.normal(size=(800, 6))
    best = max((kernels.microstates(maps, 4, seed=s) for s in range(5)), key=lambda c: np.abs(maps @ c.T).max(1).sum())
    assert (np.abs(true @ best.T).max(1) > 0.8).all()


def test_spline_reproduces_constants():
    rng = np.random.default_rng(6)
    p = rng.normal(size=(12, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    assert np.allclose(kernels.spline_weights(p[:9], p[9:]).sum(1), 1, atol=1e-6)


@pytest.mark.parametrize(("size", "step"), [(8, 1), (50, 7), (50, 62), (100, 13)])
def test_frames_equal_a_literal_loop(spark, size, step):
    def loop(total, burst):
        out, count = [], 0
        for n in range(1, total + 1):
            count += 1
            if count >= step and (n >= size or not burst):
                count -= step
                if n >= size:
                    out.append(n)
        return out

    for burst in (True, False):
        got = sorted(r["end_n"] for r in recordings.frames(spark.range(1).withColumn("last", F.lit(600)), "last", size, step, burst, chunk=16).collect())
        assert got == loop(600, burst)


def test_segments(spark):
    rows = spark.createDataFrame([("a", 0, 3), ("a", 2, 5), ("a", 7, 8), ("b", 1, 1)], "k string, start long, end long")
    merged = tables.merge_segments(rows, ["k"])
    assert sorted(map(tuple, merged.collect())) == [("a", 0, 5), ("a", 7, 8)]
    total = spark.createDataFrame([("a", 10), ("b", 4)], "k string, total long")
    assert sorted(map(tuple, tables.complement(merged, ["k"], total).collect())) == [("a", 5, 7), ("a", 8, 10), ("b", 0, 4)]


def test_names_and_specs(spark):
    rows = spark.createDataFrame([("EEG Fp1-Ref",), (" T5 ",), ("Cz",), ("PO8",), ("eeg1",), (None,)], "c string")
    got = [tuple(r) for r in rows.select(naming.normalize(F.col("c")), naming.lobe(F.col("c")), naming.hemisphere(F.col("c"))).collect()]
    assert got[:5] == [("fp1", "Frontal", "Left"), ("p7", "Parietal", "Left"), ("cz", "Central", "Midline"), ("po8", "Occipital", "Right"), ("eeg1", "Other", "Left")]
    assert specs.bands("a:1-2, b:3-4.5") == [("a", 1, 2), ("b", 3, 4.5)] and len(specs.bands()) == 5
    assert [r[0] for r in specs.ratios("x=a/b,x=b/a")] == ["x", "x_2"]
    assert specs.metric("alpha/beta:Pz").kind == "ratio" and specs.metric("coh:imcoh:alpha:C3:C4").measure == "imcoh" and specs.metric("asym:alpha:F3:F4").other_channel == "F4"
    with pytest.raises(ValueError):
        specs.bands("a:2-1")
    assert spark.range(1).select(scalar.micros(F.lit(-0.0000025))).first()[0] == -3


@pytest.mark.parametrize("bdf", [False, True])
def test_edf_round_trip(spark, tmp_path, bdf):
    x = np.sin(np.arange(500) / 10) * 50
    (tmp_path / "a.edf").write_bytes(edf.encode([("Fz", x), ("Cz", -x)], 100, [(1.5, 0.25, "go"), (3.0, 0, "stop")], bdf))
    got = {r["channel"]: r for r in edf.read_signals(spark, str(tmp_path)).collect()}
    assert set(got) == {"Fz", "Cz"} and got["Fz"]["fs"] == 100 and np.abs(np.array(got["Fz"]["x"]) - x).max() < (0.01 if bdf else 0.1)
    assert [(r["onset"], r["duration"], r["text"]) for r in edf.read_events(spark, str(tmp_path)).orderBy("onset").collect()] == [(1.5, 0.25, "go"), (3.0, 0.0, "stop")]


def test_delimited_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text("time_ms;C1;C2\n0;1,5;2\n4;1.234,5;3\n", encoding="utf-8")
    got = {(r["channel"], r["t"]): r["v"] for r in tabular.read_recording(spark, str(tmp_path / "r.csv")).collect()}
    assert got == {("C1", 0.0): 1.5, ("C1", 0.004): 1234.5, ("C2", 0.0): 2.0, ("C2", 0.004): 3.0}
    (tmp_path / "e.tsv").write_text("onset\tduration\ttrial_type\n1.0\tn/a\tgo\n2\t0.5\tn/a\n")
    assert [tuple(r) for r in tabular.read_events(spark, str(tmp_path / "e.tsv")).orderBy("onset").collect()] == [(1.0, 0.0, "go"), (2.0, 0.5, "")]
    (tmp_path / "ref.csv").write_text("channel,band,mean,std\nPz,Alpha,1,2\nPz,alpha,3,4\nCz,beta,1,0\n")
    assert [tuple(r)[:4] for r in tabular.read_reference(spark, str(tmp_path / "ref.csv")).collect()] == [("pz", "alpha", 3.0, 4.0)]


def test_feedback_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    frames = pd.DataFrame({"session": "s", "t": np.arange(1, 201) * 0.25, "metric": rng.normal(size=200), "artifact": rng.random(200) < 0.05})
    o = feedback.Settings(hysteresis=0.05, dwell_sec=0.25, on_count=2, off_count=2, tau_sec=0.5)
    batch = feedback.replay(spark.createDataFrame(frames), o).orderBy("t").toPandas()
    assert len(batch) == 160 and 0 < batch.reward.mean() < 1 and batch.rate.between(0, 1).all()
    src = tmp_path / "in"
    schema = "session string, t double, metric double, artifact boolean"
    for i in range(0, 200, 50):
        spark.createDataFrame(frames[i : i + 50], schema).coalesce(1).write.mode("append").parquet(str(src))
        q = feedback.live(spark.readStream.schema(schema).parquet(str(src)), o).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    stream = spark.read.parquet(str(tmp_path / "out")).orderBy("t").toPandas()
    pd.testing.assert_frame_equal(batch, stream)


def test_quality_and_topomap(spark):
    rng = np.random.default_rng(8)
    rec = long(spark, {"good": rng.normal(size=300), "more": rng.normal(size=300), "flat": np.zeros(300), "noisy": 50 * rng.normal(size=300)})
    got = {r["channel"]: r["reasons"] for r in recordings.quality(recordings.statistics(rec), recordings.robust(rec, ["channel"])).collect()}
    assert got == {"good": "", "more": "", "flat": "flatline", "noisy": "noisy"}
    values = naming.montage(spark).select("key", F.lit(2.5).alias("v"))
    grid = recordings.topomap(values, naming.montage(spark), 9)
    assert all(math.isclose(r["v"], 2.5) for r in grid.collect()) and grid.count() > 40


def test_brainvision_and_bids(spark, tmp_path):
    from wavelake.sources import bids, brainvision

    x = np.arange(50) / 7
    for name, data in brainvision.encode("sub-01_ses-a_task-rest_eeg", [("C3", x), ("a,b", -x)], 100.0, [(0.1, 0.2, "go"), (0.3, 0, "stop")]).items():
        (tmp_path / name).write_bytes(data)
    signals, events = brainvision.read(spark, f"{tmp_path}/sub-01_ses-a_task-rest_eeg.vhdr")
    got = {r["channel"]: r for r in signals.collect()}
    assert np.allclose(got["C3"]["x"], x, atol=1e-5) and np.allclose(got["a,b"]["x"], -x, atol=1e-5) and got["C3"]["fs"] == 100
    assert [(round(r["onset"], 6), round(r["duration"], 6), r["text"]) for r in events.orderBy("onset").collect()] == [(0.1, 0.2, "go"), (0.3, 0.0, "stop")]
    rows = bids.index(spark, str(tmp_path)).collect()
    assert {(r["sub"], r["ses"], r["task"], r["run"], r["suffix"]) for r in rows} == {("01", "a", "rest", None, "eeg")} and {r["extension"] for r in rows} == {".vhdr", ".vmrk", ".eeg"}


def test_aperiodic(spark):
    from wavelake.operators import aperiodic

    f = np.arange(1, 101) * 0.5
    p = 10 ** (1 - 1.5 * np.log10(f)) * (1 + 4 * np.exp(-((f - 10) ** 2)))
    knee = 10 ** (2 - np.log10(50 + f**2))
    table = spark.createDataFrame([("a", f.tolist(), p.tolist()), ("k", f.tolist(), knee.tolist()), ("e", [1.0], [1.0])], "c string, f array<double>, p array<double>")
    got = {r["c"]: r["x"] for r in table.select("c", aperiodic.of(F.col("f"), F.col("p")).alias("x")).collect()}
    assert abs(got["a"]["slope"] + 1.5) < 0.15 and abs(got["a"]["peak_hz"] - 10) < 1 and got["a"]["peak_db"] > 3
    assert got["k"]["best"] == "knee" and abs(got["k"]["exponent"] - 2) < 0.1 and got["e"]["best"] is None
