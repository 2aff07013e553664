"""Streams with states against the table forms, under any cut into batches; thresholds and gates of different grids."""

import math
import pickle
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavelake.operators import events, signals, tables
from wavelake.streaming import feedback, live, online

CHANNELS = ["C3", "C4", "Fz"]
FS = 64.0


def samples(seed, n=700, gaps=True):
    rng = np.random.default_rng(seed)
    rows = [(c, k, float(10 * np.sin(k / (3 + i)) + rng.normal() + (40 if i == 0 and 500 < k < 520 else 0))) for i, c in enumerate(CHANNELS) for k in range(n) if not (gaps and i == 1 and k in (90, 333))]
    return pd.DataFrame(rows, columns=["channel", "n", "v"])


def cut(pdf, seed, most):
    """Batches as a stream may bring them: channels ahead of one another, rows in any order within a batch."""
    rng = random.Random(seed)
    left = {c: g.sort_values("n") for c, g in pdf.groupby("channel")}
    while any(len(g) for g in left.values()):
        some = []
        for c in left:
            k = rng.randrange(0, most)
            some.append(left[c][:k])
            left[c] = left[c][k:]
        batch = pd.concat(some).sample(frac=1, random_state=rng.randrange(10**6))
        if len(batch):
            yield batch


def through(make, pdf, seed, most):
    machine, out = make(), []
    for batch in cut(pdf, seed, most):
        out += machine.run("r", batch)
        machine = pickle.loads(pickle.dumps(machine))  # as the state store does
    return out


@pytest.mark.parametrize("burst", [True, False])
def test_frames_are_those_of_the_table(spark, burst):
    pdf = samples(1)
    want = {(r["channel"], r["end_n"]): tuple(r["x"]) for r in online.frames(spark.createDataFrame(pdf), 48, 20, burst).collect()}
    for seed, most in ((1, 3), (2, 40), (3, 400), (4, 5000)):
        rows = through(lambda: live.Frames(CHANNELS, 48, 20, burst), pdf, seed, most)
        assert {(c, end): tuple(x) for _, end, names, xs in rows for c, x in zip(names, xs, strict=True)} == want
        assert [r[1] for r in rows] == sorted(r[1] for r in rows)


def test_late_and_foreign_samples_are_dropped():
    machine = live.Frames(["a", "b"], 4, 2, True)
    rows = lambda *x: pd.DataFrame(x, columns=["channel", "n", "v"])
    assert machine.run("r", rows(*(("a", n, 1.0) for n in range(6)))) == []
    assert [r[1] for r in machine.run("r", rows(*(("b", n, 2.0) for n in range(5)), ("x", 0, 9.0)))] == [4, 5]
    assert machine.run("r", rows(("a", 2, 7.0), ("b", 1, 7.0))) == []
    got = machine.run("r", rows(("b", 5, 3.0)))
    assert got == [("r", 6, ["a", "b"], [[1.0] * 4, [2.0, 2.0, 2.0, 3.0]])] and machine.rings.values.shape[1] == 4


@pytest.mark.parametrize("average", [True, False])
def test_causal_filters_keep_their_delays(spark, average):
    pdf = samples(2)
    want = {(r["channel"], r["n"]): r["v"] for r in signals.preprocessed(spark.createDataFrame(pdf), FS, average, 20.0, 1.0, 12.0, zero_phase=False).collect()}
    sections = signals.stages(FS, 20.0, 1.0, 12.0)
    for seed, most in ((5, 2), (6, 90), (7, 5000)):
        got = {(c, n): v for _, c, n, v in through(lambda: live.Filter(CHANNELS, sections, average), pdf, seed, most)}
        assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-9
    plain = through(lambda: live.Filter(CHANNELS, [], False), pdf, 1, 50)
    assert {(c, n): v for _, c, n, v in plain} == {(r.channel, r.n): r.v for r in pdf.itertuples()}


@pytest.mark.parametrize(("baseline", "least"), [(3.0, 1), (0.0, 2), (3.0, 9)])
def test_artifact_gate_is_that_of_the_table(spark, baseline, least):
    pdf = samples(3)
    want = {r["end_n"]: tuple(r)[1:] for r in online.artifact_gate(spark.createDataFrame(pdf), FS, 32, 16, baseline, 4.0, least).collect()}
    assert any(w[2] for w in want.values()) or least == 9
    for seed, most in ((8, 7), (9, 300)):
        rows = through(lambda: live.Gate(CHANNELS, 32, 16, round(baseline * FS), 4.0, least), pdf, seed, most)
        got = {r[1]: r[2:] for r in rows}
        assert set(got) == set(want)
        for end, w in want.items():
            assert got[end][:3] == w[:3] and np.allclose(got[end][3:], w[3:], atol=1e-9), (end, got[end], w)
    assert live.Gate(CHANNELS, 32, 16, 0, 4.0, 1).base == []


def test_streams_of_spark(spark, tmp_path):
    """Two recordings through all three operators, three micro-batches each; pairs measured on the stream equal the table's."""
    one, two = samples(11, 300, False), samples(12, 260, False)
    rec = spark.createDataFrame(pd.concat([one.assign(recording="a"), two.assign(recording="b")])).select("recording", "channel", "n", "v")
    for i, (low, high) in enumerate(((0, 77), (77, 180), (180, 999))):
        rec.where(f"n >= {low} and n < {high}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = lambda: spark.readStream.schema(rec.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).toPandas()

    pairs = run(online.coherence_frames(live.frames(stream(), CHANNELS, 64, 32), FS, 16, 8.0, 12.0), "pairs")
    phase = run(online.phase_frames(live.frames(stream(), CHANNELS, 64, 32), FS, 8.0, 12.0), "phase")
    gate = run(live.artifact_gate(stream(), CHANNELS, FS, 32, 16, 1.0, 3.0), "gate")
    clean = run(live.preprocessed(stream(), CHANNELS, FS, high=10.0), "clean")
    for name in "ab":
        own = rec.where(F.col("recording") == name).drop("recording")
        f = online.frames(own, 64, 32)
        for got, want, keys in ((pairs, online.coherence_frames(f, FS, 16, 8.0, 12.0), ["channel_a", "channel_b", "end_n"]), (phase, online.phase_frames(f, FS, 8.0, 12.0), ["channel_a", "channel_b", "end_n"]), (pairs, online.coherence_frames(online.matrices(f), FS, 16, 8.0, 12.0), ["channel_a", "channel_b", "end_n"]), (gate, online.artifact_gate(own, FS, 32, 16, 1.0, 3.0), ["end_n"]), (clean, signals.preprocessed(own, FS, high=10.0, zero_phase=False), ["channel", "n"])):
            a = got[got.recording == name].drop(columns="recording").sort_values(keys).reset_index(drop=True)
            b = want.toPandas().sort_values(keys).reset_index(drop=True)[list(a.columns)]
            assert len(a) and len(a) == len(b)
            pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-9, rtol=1e-9)


def observe(o, values):
    s = feedback.State()
    for t, v in values:
        feedback.observed(s, t, v, o)
    return s


def test_quantile_threshold():
    ten = [(float(i), float(i)) for i in range(10)]
    o = feedback.Settings(target=0.5, eta=1.0, adapt="quantile", quantile_sec=100.0, quantile_least=1)
    assert feedback.adapted(observe(o, ten), 0.0, 0.0, 9.0, o) == 4.5
    short = feedback.Settings(target=0.5, eta=1.0, adapt="quantile", quantile_sec=5.0, quantile_least=1)
    assert feedback.adapted(observe(short, ten), 0.0, 0.0, 9.0, short) == 7.0
    slow = feedback.Settings(target=0.5, eta=1.0, adapt="quantile", quantile_sec=100.0, quantile_least=1, update_sec=10.0)
    s = observe(slow, ten)
    first = feedback.adapted(s, 0.0, 0.0, 9.0, slow)
    feedback.observed(s, 10.0, 1000.0, slow)
    assert first == 4.5 and feedback.adapted(s, first, 0.0, 12.0, slow) == first and feedback.adapted(s, first, 0.0, 20.0, slow) != first
    part = feedback.Settings(target=0.25, eta=0.5, adapt="quantile", quantile_least=3, above=False)
    s = observe(part, [(0.0, 1.0), (1.0, 3.0)])
    assert feedback.adapted(s, 9.0, 0.0, 1.0, part) == 9.0
    feedback.observed(s, 2.0, 2.0, part)
    assert feedback.adapted(s, 9.0, 0.0, 2.0, part) == 9.0 + 0.5 * (1.5 - 9.0)
    rng = random.Random(6)
    s, all_ = feedback.State(), []
    for i in range(400):
        t, v = i * 0.1, rng.choice([1.0, 2.0, rng.random()])
        feedback.observed(s, t, v, short)
        all_.append((t, v))
        assert s.ordered == sorted(x for u, x in all_ if t - u < 5.0)


def test_quantile_loop_in_batches(spark):
    rng = np.random.default_rng(7)
    frames = pd.DataFrame({"session": "s", "t": np.arange(1, 161) * 0.25, "metric": rng.normal(size=160), "artifact": rng.random(160) < 0.05})
    o = feedback.Settings(adapt="quantile", quantile_least=5, quantile_sec=8.0, eta=0.3)
    whole = feedback.run("s", frames, feedback.State(), o)
    s = feedback.State()
    parts = pd.concat([x for i in range(0, 160, 7) if len(x := feedback.run("s", frames[i : i + 7], s, o))], ignore_index=True)
    pd.testing.assert_frame_equal(whole, parts)
    assert whole.threshold.nunique() > 50 and abs(whole.reward[60:].mean() - 0.6) < 0.2


def taken_once(frames, gates, eps):
    out, low = {}, 0
    for t in sorted(frames):
        while low < len(gates) and gates[low][0] < t - eps:
            low += 1
        if low < len(gates) and gates[low][0] <= t + eps:
            out[t], low = gates[low][1], low + 1
    return out


@pytest.mark.parametrize("eps", [0.0, 0.004, 0.03, 0.2])
def test_gates_are_taken_once(spark, eps):
    rng = random.Random(int(1000 * eps))
    frames = {k: sorted({rng.randrange(90_000) * 0.01 for _ in range(300)}) for k in "ab"}
    gates = {k: sorted((t, i) for i, t in enumerate({rng.randrange(90_000) * 0.01 + rng.choice([0, 0.003, 0.02]) for _ in range(300)} | set(frames[k][::7]))) for k in "ab"}
    left = spark.createDataFrame([(k, float(t), int(t)) for k in frames for t in frames[k]], "k string, t double, own int")
    right = spark.createDataFrame([(k, float(t), i) for k in gates for t, i in gates[k]], "k string, t double, gate int")
    got = {(r["k"], r["t"]): r["gate"] for r in events.as_of_once(left, right, ["k"], eps).collect()}
    assert len(got) == sum(map(len, frames.values()))
    for k in "ab":
        us = lambda t: round(t * 1_000_000)
        want = taken_once([us(t) for t in frames[k]], [(us(t), i) for t, i in gates[k]], us(eps))
        assert {t: g for (key, t), g in got.items() if key == k} == {t: want.get(us(t)) for t in frames[k]}
    assert eps == 0 or sum(g is not None for g in got.values()) > 80


def test_reservoirs(spark):
    rows = spark.range(5000).select((F.col("id") % 4).alias("g"), F.col("id"), F.rand(1).alias("v")).where("g < 3 or id < 40")
    a = tables.reservoir(rows, ["g"], ["id"], 100, 3)
    got = {r["g"]: r["n"] for r in a.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 100, 1: 100, 2: 100, 3: 10}
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(a) == ids(tables.reservoir(rows.repartition(7), ["g"], ["id"], 100, 3)) != ids(tables.reservoir(rows, ["g"], ["id"], 100, 4))
    mean = a.where("g = 0").agg(F.avg("id")).first()[0]
    assert abs(mean - 2500) < 5 * 5000 / math.sqrt(12 * 100)
    ref = tables.robust_reference(rows.withColumn("v", F.when(F.col("g") == 1, 2.0).otherwise(F.col("v"))), ["g"], ["id"], 10**6)
    got = {r["g"]: r for r in ref.collect()}
    want = np.array([r["v"] for r in rows.where("g = 0").collect()])
    assert abs(got[0]["mean"] - np.median(want)) < 1e-12 and abs(got[0]["std"] - 1.4826 * np.median(np.abs(want - np.median(want)))) < 1e-9 and got[0]["n"] == 1250


def test_coupling_summary_and_counters(spark):
    from wavelake.operators import kernels

    rng = np.random.default_rng(4)
    n = np.arange(1200)
    x = np.sin(2 * np.pi * 6 * n / 128) + (1 + np.sin(2 * np.pi * 6 * n / 128)) * np.sin(2 * np.pi * 30 * n / 128) + 0.1 * rng.normal(size=1200)
    rec = spark.createDataFrame([("a", int(k), float(v)) for k, v in enumerate(x)], "channel string, n long, v double")
    f = online.frames(rec, 384, 128)
    got = online.coupling_summary(f, 128.0, (4.0, 8.0), (20.0, 40.0)).first()
    each = [kernels.pac(np.array(r["x"]), 128.0, (4.0, 8.0), (20.0, 40.0)) for r in f.collect()]
    assert got["n_frames"] == len(each) and abs(got["median"] - np.median([e["mi"] for e in each])) < 1e-9 and np.allclose(got["distribution"], np.mean([e["bins"] for e in each], 0)) and abs(sum(got["distribution"]) - 1) < 1e-9
    frames = spark.createDataFrame([("s", float(t), 1.0 + (t % 4), t == 30) for t in range(1, 41)], "session string, t double, metric double, artifact boolean")
    o = feedback.Settings(eta=0.0)
    row = feedback.counters(frames, feedback.replay(frames, o), o).first()
    assert (row["baseline"], row["training"], row["artifact"], row["valid"]) == (10, 30, 1, 29) and row["threshold_init"] == row["threshold_final"] and 0 < row["reward_rate"] < 1
    bad = spark.createDataFrame([("c", 10, 20), ("c", 24, 30), ("c", 95, 99)], "channel string, start long, end long")
    total = spark.createDataFrame([("c", 100), ("d", 50)], "channel string, total long")
    got = sorted(tuple(r) for r in tables.clean_segments(bad, ["channel"], total, 3, 6).select("channel", "start", "end").collect())
    assert got == [("c", 0, 7), ("c", 33, 92), ("d", 0, 50)]
