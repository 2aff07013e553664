"""Steps whose cost must not grow faster than their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import events, matrices, recordings
from wavelake.streaming import online


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("size", "step", "burst"), [(16, 4, True), (16, 4, False), (10, 7, True), (8, 8, True), (8, 1, True), (6, 4, False)])
def test_frames_without_a_join(spark, size, step, burst):
    have = {"a": [n for n in range(61) if n != 40], "b": list(range(size - 1)), "c": list(range(size))}
    rec = spark.createDataFrame([(c, n, float(n * n)) for c, ns in have.items() for n in ns], "channel string, n long, v double")
    got = {(r["channel"], r["end_n"]): r["x"] for r in online.frames(rec, size, step, burst).collect()}
    lasts = rec.groupBy("channel").agg((F.max("n") + 1).alias("last"))
    ends = [(r["channel"], r["end_n"]) for r in recordings.frames(lasts, "last", size, step, burst).collect()]
    assert got == {(c, e): [float(n * n) for n in range(e - size, e)] for c, e in ends if set(range(e - size, e)) <= set(have[c])}
    assert "Join" not in plan(online.frames(rec, size, step, burst))  # the frames' samples went to the driver to be broadcast


def test_gate_has_frames_up_to_the_last_sample(spark):
    x = np.random.default_rng(3).normal(size=203)
    rec = spark.createDataFrame([("a", n, float(v)) for n, v in enumerate(x)], "channel string, n long, v double")
    got = sorted(r["end_n"] for r in online.artifact_gate(rec, 128.0, 50, 25, 1.0).collect())
    assert got == sorted(max(50 + j - 1, 25 * j) for j in range(1, 9))
    assert "BroadcastExchange" not in plan(online.dealt(rec, 50, 25))


def test_coupling_measures_each_frame_once_and_together(spark):
    from wavelake.operators import kernels

    rng = np.random.default_rng(8)
    x = np.sin(np.arange(1500) / 3.0) + rng.normal(size=1500)
    rec = spark.createDataFrame([("a", n, float(v)) for n, v in enumerate(x)] + [("b", n, float("nan") if n == 700 else float(v)) for n, v in enumerate(x)] + [("c", n, 0.0) for n in range(200)], "channel string, n long, v double")
    frames = online.frames(rec, 160, 64)
    out = online.coupling_summary(frames, 128.0, (4.0, 8.0), (20.0, 40.0))
    assert "EvalPython" not in plan(out)  # four passes measured every frame again
    one = {e: pac_by_hand(x[e - 160 : e]) for e in (r["end_n"] for r in frames.where("channel = 'a'").collect())}
    got = {r["channel"]: r for r in out.collect()}
    clean = [v for e, v in one.items() if not e - 160 <= 700 < e]  # a frame with a sample that isn't finite has no index
    for c, want in (("a", list(one.values())), ("b", clean)):
        mi = np.array([m for m, _ in want])
        assert got[c]["n_frames"] == len(want) and np.allclose([got[c]["mean"], got[c]["median"], got[c]["min"], got[c]["max"]], [mi.mean(), np.median(mi), mi.min(), mi.max()])
        assert np.allclose(got[c]["distribution"], np.mean([p for _, p in want], 0))
    assert len(clean) < len(one) and np.allclose(got["c"]["distribution"], 1 / 18) and abs(got["c"]["mean"]) < 1e-12
    mi, mvl, p = kernels.pac_rows(np.stack([x[:160], x[5:165]]), 128.0, (4.0, 8.0), (20.0, 40.0))
    each = [kernels.pac(v, 128.0, (4.0, 8.0), (20.0, 40.0)) for v in (x[:160], x[5:165])]
    assert np.allclose(mi, [e["mi"] for e in each]) and np.allclose(mvl, [e["mvl"] for e in each]) and np.allclose(p, [e["bins"] for e in each])


def pac_by_hand(x, bins=18):
    from wavelake.operators import kernels

    cut = kernels.trimmed(len(x), 0.1)
    angle, amp = (f(kernels.analytic(kernels.bandpass(x, 128.0, *band)))[cut] for f, band in ((np.angle, (4.0, 8.0)), (np.abs, (20.0, 40.0))))
    at = np.minimum(((angle + np.pi) / (2 * np.pi) * bins).astype(int), bins - 1)
    mean = np.array([amp[at == i].astype(float).mean() if (at == i).any() else 0.0 for i in range(bins)])
    p = mean / mean.sum()
    return 1 + (p[p > 0] * np.log(p[p > 0])).sum() / np.log(bins), p


def test_robust_reference_takes_all_values(spark, monkeypatch):
    from wavelake.operators import tables

    rng = np.random.default_rng(5)
    have = {"a": rng.normal(size=30_000), "b": rng.exponential(size=20_001), "c": np.array([1.0, 4.0, 2.0]), "d": np.array([3.0])}
    rows = spark.createDataFrame([(g, "x", float(v)) for g, x in have.items() for v in x] + [("c", "x", float("nan")), ("c", "x", None)], "g string, band string, v double")
    for exact in (recordings.EXACT_ROWS, 1000):  # both ways of the quantiles
        monkeypatch.setattr(recordings, "EXACT_ROWS", exact)
        got = {r["g"]: (r["mean"], r["std"], r["n"]) for r in tables.robust_reference(rows, ["g", "band"]).collect()}
        assert set(got) == {"a", "b", "c"}
        for g, (mean, std, n) in got.items():  # groups of over 20,000 values gave a sample's
            middle = np.median(have[g])
            assert n == len(have[g]) and abs(mean - middle) < 1e-12 and abs(std - 1.4826 * np.median(np.abs(have[g] - middle))) < 1e-9


def test_epochs_are_not_broadcast(spark):
    rec = spark.range(5000).select(F.lit("a").alias("channel"), F.col("id").alias("n"), F.col("id").cast("double").alias("v"))
    on = rec.agg(F.max("n").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))).toDF("event_id").withColumn("onset", F.col("event_id") * 0.01)
    df = events.epochs(rec, on, 100.0, 0.0, 0.2)
    assert df.count() == 20 * (5000 - 19)
    assert "BroadcastHashJoin [n" not in plan(df)


def test_ties_of_cells_take_the_first_row(spark, tmp_path):
    from wavelake.plans import more

    rows = [(1, 1, 0, 1, 5.0), (1, 1, 0, 1, 7.0), (1, 1, 0, 1, 6.0), (0, 7, 0, 1, 9.0), (2, 1, 2, 3, 4.0), (2, 1, 2, 3, 3.0), (3, 1, 2, 3, None)]
    names = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"]
    spark.createDataFrame([dict(zip(names, r, strict=True)) for r in rows], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {(r["a"], r["b"]): r["w"] for r in more.matrix_cells(spark, str(tmp_path)).collect()} == {(0, 1): 5.0, (1, 0): 5.0, (2, 3): 4.0, (3, 2): 4.0}
    loose = spark.createDataFrame([("a", "b", 1.0, 1), ("a", "b", 2.0, 2), ("a", "b", None, 3)], "a string, b string, w double, ord int")
    assert {r["w"] for r in matrices.matrix_cells(loose, "ord").collect()} == {2.0}


def test_marks_after_the_last_sample_dont_widen_all_records(spark, tmp_path):
    from wavelake.sources import edf, records

    rec = spark.range(4000).select(F.lit("a").alias("recording"), F.lit("C3").alias("channel"), F.lit(10.0).alias("fs"), F.col("id").alias("n"), (F.col("id") % 7).cast("double").alias("v"))
    marks = spark.range(6000).select(F.lit("a").alias("recording"), (F.col("id") / 4).alias("onset"), F.lit(0.5).alias("duration"), F.concat(F.lit("m"), F.col("id")).alias("text"))
    records.write(rec, str(tmp_path), "edf", marks.unionByName(marks.where("text = 'm5000'")))
    assert (tmp_path / "a.edf").stat().st_size < 500_000  # tens of MB if the last record keeps all marks after it
    got = sorted((r["onset"], r["duration"], r["text"]) for r in records.read(spark, str(tmp_path), "events").collect())
    assert got == sorted([(i / 4, 0.5, f"m{i}") for i in range(6000)] + [(1250.0, 0.5, "m5000")])
    few = marks.where("onset < 400 and text like '%7'")
    records.write(rec, str(tmp_path / "few"), "edf", few)
    data = (tmp_path / "few" / "a.edf").read_bytes()
    head = edf.header(data)
    per = 2 * sum(s["samples"] for s in head["signals"])
    held = [edf.annotations(data[head["bytes"] + r * per + 2 * head["signals"][0]["samples"] : head["bytes"] + (r + 1) * per]) for r in range(head["records"])]
    assert all(int(t) == r for r, m in enumerate(held) for t, _, _ in m) and sum(map(len, held)) == few.count()


def test_runs_take_one_order_and_no_aggregate_of_the_rows(spark):
    from wavelake.operators import scans

    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("n"), F.when(F.col("id") % 14 < 8, F.floor(F.col("id") / 40)).alias("label"))
    _, edges, inner = scans.local_runs(rows, ["k"], "n", "label", 64)
    text = plan(inner)
    assert text.count("Sort [") == 1 and "HashAggregate" not in text and plan(edges).count("_chunk") > 0
    got = sorted((r["k"], r["first"], r["last"], r["n"]) for r in scans.runs(rows, ["k"], "n", "label", 64).collect())
    want = []
    for k in (0, 1):
        for n in range(1500):
            i = 2 * n + k
            x = i // 40 if i % 14 < 8 else None
            if n and x == was:
                want[-1] = (k, want[-1][1], n, want[-1][3] + 1)
            else:
                want.append((k, n, n, 1))
            was = x
    assert got == sorted(want)


def test_replay_holds_a_batch_not_a_session(spark):
    from wavelake.streaming import feedback

    o = feedback.Settings(baseline_sec=2.0, eta=0.3, rate_frames=5)
    rows = [(s, n / 4, float((n * 37 + i) % 101), n % 11 == 0) for i, s in enumerate(("a", "b", None)) for n in range(700)]
    df = spark.createDataFrame(rows, "session string, t double, metric double, artifact boolean").repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = feedback.replay(df, o)
        assert "MapInPandas" in plan(out) and "FlatMapGroups" not in plan(out)
        got = sorted(((r["session"] or "", *tuple(r)[1:]) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    state, want = {}, []
    for s, t, m, bad in rows:
        step = feedback.step(state.setdefault(s, feedback.State()), t, m, bad, o)
        want += [(s or "", t, *step)] if step else []
    assert got == sorted(want)
