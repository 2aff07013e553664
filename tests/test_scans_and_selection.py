"""Chunked scans against windows over whole keys, and selection against the exact aggregate."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavelake.operators import events, microstates, recordings, scans, selection

SIZE = 7  # places of a chunk


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = []
    for key in ("a", "b", None):
        n, label = 0, 0
        for _ in range(300):
            n += rng.choice([1, 1, 1, 2, 9, 40])
            label = rng.choice([label, label, label, rng.randrange(3), None])
            out.append((key, n, label, rng.choice([None, None, float(n)]), rng.random()))
    return spark.createDataFrame(out, "k string, n long, label int, v double, w double").repartition(3).cache()


def table(df, *names):
    return sorted(map(tuple, df.select(*names).toPandas().astype(object).where(lambda x: x.notna(), None).values.tolist()), key=str)


def test_neighbours(rows):
    w = Window.partitionBy("k").orderBy("n")
    for back, f in ((True, F.lag), (False, F.lead)):
        got = scans.neighbour(rows, ["k"], "n", "label", "near", back, SIZE)
        assert got.columns == [*rows.columns, "near"]
        assert table(got, "k", "n", "near") == table(rows.withColumn("near", f("label").over(w)), "k", "n", "near")


def test_forward_fill(rows):
    w = Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("v", F.coalesce(F.last("v", ignorenulls=True).over(w), F.lit(0.0)))
    assert table(scans.forward_filled(rows, ["k"], "n", "v", size=SIZE), "k", "n", "v") == table(want, "k", "n", "v")
    none = rows.withColumn("v", F.lit(None).cast("double"))
    assert scans.forward_filled(none, ["k"], "n", "v", None, SIZE).where("v is not null").count() == 0


def runs_by_force(pdf):
    out = []
    for k, g in pdf.groupby("k", dropna=False):
        last = object()
        for r in g.sort_values("n").itertuples():
            label = None if pd.isna(r.label) else int(r.label)
            if label == last and out:
                out[-1][3], out[-1][4] = r.n, out[-1][4] + 1
            else:
                out.append([None if pd.isna(k) else k, label, r.n, r.n, 1])
            last = label
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("size", [1, 7, 50, 10**6])
def test_runs(rows, size):
    want = runs_by_force(rows.toPandas())
    assert table(scans.runs(rows, ["k"], "n", "label", size), "k", "label", "first", "last", "n") == want
    marked = scans.with_runs(rows, ["k"], "n", "label", size)
    assert marked.columns == [*rows.columns, "run"] and marked.count() == rows.count()
    assert table(marked.groupBy("k", "label", F.col("run").alias("first")).agg(F.max("n").alias("last"), F.count("*").alias("n")), "k", "label", "first", "last", "n") == want


def test_one_run_over_many_chunks(spark):
    df = spark.range(1000).select(F.lit("x").alias("k"), F.col("id").alias("n"), F.when(F.col("id") == 999, 2).otherwise(1).alias("label"))
    assert table(scans.runs(df, ["k"], "n", "label", 10), "label", "first", "last", "n") == [(1, 0, 998, 999), (2, 999, 999, 1)]
    assert scans.runs(df.limit(0), ["k"], "n", "label").count() == 0


def test_without_keys(spark):
    df = spark.createDataFrame([(float(t), "a" if t % 40 < 25 else "") for t in range(0, 3000)], "t double, label string")
    marks = events.marker_events(df, [], "t", "label")
    assert marks.count() == 75 and {r["onset"] % 40 for r in marks.collect()} == {0.0}
    spans = events.segment_events(df, [], "t", "label", 1.0).collect()
    assert len(spans) == 75 and {r["duration"] for r in spans} == {25.0}


def test_transitions_and_rates(rows):
    w = Window.partitionBy("k").orderBy("n")
    pairs = rows.where("label is not null").withColumn("b", F.lag("label").over(w)).where("b <> label").groupBy(F.col("b").alias("from_label"), F.col("label").alias("to_label")).agg(F.count("*").alias("n"))
    assert table(recordings.transitions(rows.where("label is not null"), ["k"], "n", "label"), "from_label", "to_label", "n") == table(pairs, "from_label", "to_label", "n")
    for size in (3, 30, 10**6):
        trailing = Window.partitionBy("k").orderBy("n").rangeBetween(-19, 0)
        want = rows.withColumn("rate", F.round(F.sum("w").over(trailing), 9))
        dealt = scans.overlapped(rows, "n", 19, size)
        got = dealt.withColumn("rate", F.round(F.sum("w").over(Window.partitionBy("k", "_chunk").orderBy("n").rangeBetween(-19, 0)), 9)).where("_own")
        assert table(got, "k", "n", "rate") == table(want, "k", "n", "rate")


def test_smoothing_by_stretches(spark, monkeypatch):
    rng = np.random.default_rng(2)
    held = []
    inner = microstates.smooth
    for trial in range(4):
        labels = np.repeat(rng.integers(-1, 3, 400), rng.integers(1, [2, 4, 8, 12][trial] + 1, 400))
        df = spark.createDataFrame([("r", int(n), int(x), 0.5) for n, x in enumerate(labels)], "k string, n long, label int, gfp double")
        got = microstates.smoothed(df, ["k"], 3, size=64)
        assert got.columns == df.columns
        assert [r["label"] for r in got.orderBy("n").collect()] == inner(labels, 3).tolist()
        held.append(len(labels))
    assert microstates.smoothed(df.limit(0), ["k"], 3).count() == 0


def test_debounce(spark):
    rng = random.Random(3)
    marks = [(rng.choice("ab"), round(rng.random() * 1500, 2), 0.1 * i, rng.choice(["x", "y"])) for i in range(800)]
    df = spark.createDataFrame(marks, "k string, onset double, duration double, text string")
    want, last = [], {}
    for k, t, d, x in sorted(marks, key=lambda m: (m[1], m[2])):
        if (k, x) not in last or t - last[k, x] >= 2.5:
            want.append((k, t, d, x))
            last[k, x] = t
    assert table(events.debounced(df, ["k"], 2.5), "k", "onset", "duration", "text") == sorted(want, key=str)


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_selection_is_exact(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    groups = {"normal": rng.normal(size=5000), "ties": rng.integers(0, 3, 3000).astype(float), "skew": np.exp(8 * rng.normal(size=4000)), "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "sorted": np.arange(2500.0), "same": np.ones(999), "wide": np.concatenate([[-1e300], rng.normal(size=500), [1e300]])}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None), ("void", None), (None, 3.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(11)
    wanted = {"lo": 0.0, "q1": 0.25, "md": 0.5, "q9": 0.93, "hi": 1.0}
    got = {r["g"]: r for r in selection.quantiles(df, ["g"], "v", wanted, accuracy).collect()}
    assert set(got) == {*groups, None} and got[None]["md"] == 3.0
    for g, xs in groups.items():
        assert np.allclose([got[g][k] for k in wanted], np.quantile(xs, list(wanted.values())), rtol=1e-12, atol=1e-12), g
    whole = selection.quantiles(df, [], "v", {"md": 0.5}, accuracy).collect()
    assert len(whole) == 1 and np.isclose(whole[0]["md"], np.median([x for _, x in data if x is not None]))
    assert selection.quantiles(df.limit(0), ["g"], "v", {"md": 0.5}).count() == 0


def test_largest(spark):
    rng = random.Random(1)
    data = [(i, float(rng.randrange(40))) for i in range(500)] + [(1000, None)]
    df = spark.createDataFrame(data, "n long, gfp double")
    for n in (1, 2, 17, 250, 499, 500, 900):
        want = sorted((x for x in data if x[1] is not None), key=lambda x: (-x[1], x[0]))[:n]
        assert sorted(tuple(r) for r in selection.largest(df, "gfp", "n", n).collect()) == sorted(want)
    assert selection.largest(df, "gfp", "n", 0).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 22])
def test_robust_keeps_all_groups(spark, most, monkeypatch):
    monkeypatch.setattr(recordings, "EXACT_ROWS", most)
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("b", None)], "k string, v double")
    got = {r["k"]: r for r in recordings.robust(df, ["k"]).collect()}
    assert got["a"]["median"] == 50 and abs(got["a"]["scale"] - 1.4826 * 25) < 1e-9 and got["b"]["median"] is None
