"""Epochs, their baselines and spectra against plain numpy."""

import math

import numpy as np
from pyspark.sql import functions as F

from wavelake.operators import epochs, kernels

FS, BANDS = 100.0, [("alpha", 8.0, 12.0), ("Beta", 13.0, 30.0)]


def test_epoch_powers(spark):
    rng = np.random.default_rng(1)
    data = {(r, c): rng.normal(size=700 if c != "short" else 300) for r in "ab" for c in ("C3", "short")}
    rec = spark.createDataFrame([(r, c, n, float(v)) for (r, c), x in data.items() for n, v in enumerate(x)], "recording string, channel string, n long, v double")
    marks = [(0, 0.0, 1.0), (1, 1.234, 0.5), (2, 2.5, 0.0), (3, 6.5, 2.0), (4, -0.3, 1.0), (5, 9.0, 1.0), (6, 3.0, 0.1), (7, -2.0, 1.0)]
    events = spark.createDataFrame([(r, *m) for r in "ab" for m in marks], "recording string, event_id int, onset double, duration double")
    total = rec.groupBy("recording").agg((F.max("n") + 1).alias("total"))
    spans = epochs.spans(events, total, FS, ("recording",), baseline=0.8, gap=0.1)
    got = {(r["recording"], r["event_id"]): r for r in spans.collect()}
    assert {e for _, e in got} == {0, 1, 3, 4, 6}  # without a length, outside, or before the recording: no epoch
    assert got["a", 3]["end"] == 7.0 and got["a", 4]["start"] == 0.0 and got["a", 0]["base_first"] is None and got["a", 1]["base_last"] == 114
    rows = {(r["recording"], r["event_id"], r["channel"], r["band"]): r for r in epochs.powers(rec, spans, FS, 64, BANDS, "db", ("recording",)).collect()}
    want = 0
    for (r, e), s in got.items():
        for c in ("C3", "short"):
            x = data[r, c]
            if s["last"] > len(x):
                assert (r, e, c, "alpha") not in rows
                continue
            power = lambda a, b: [kernels.area(*kernels.welch(x[a:b], FS, 64), lo, hi) for _, lo, hi in BANDS]  # noqa: E731, B023
            own = power(s["first"], s["last"])
            base = power(s["base_first"], s["base_last"]) if s["base_first"] is not None else [None, None]
            for (name, _, _), p, q in zip(BANDS, own, base, strict=True):
                row, want = rows[r, e, c, name], want + 1
                assert math.isclose(row["epoch_power"], p) and (row["baseline_power"] is None if q is None else math.isclose(row["baseline_power"], q))
                if q:
                    assert p == 0 or math.isclose(row["norm"], 10 * math.log10(p / q), abs_tol=1e-9)
                else:
                    assert row["norm"] is None
    assert len(rows) == want > 10
    means = {(r["recording"], r["channel"], r["band"]): r for r in epochs.summary(epochs.powers(rec, spans, FS, 64, BANDS, "db", ("recording",)), ("recording",)).collect()}
    own = [v["epoch_power"] for k, v in rows.items() if k[0] == "a" and k[2] == "C3" and k[3] == "Beta"]
    assert math.isclose(means["a", "c3", "beta"]["mean_power"], np.mean(own)) and means["a", "c3", "beta"]["n_epochs"] == len(own) and means["a", "c3", "beta"]["n_norm"] == 3
    whole = epochs.spans(spark.createDataFrame([(1, 1.0, 0.0)], "event_id int, onset double, duration double"), spark.createDataFrame([(700,)], "total long"), FS, offset=0.5, window=1.0)
    assert [(r["first"], r["last"], r["base_first"]) for r in whole.collect()] == [(150, 250, None)]


def test_picked_channels(spark):
    import pytest

    from wavelake.sources import writers

    rec = spark.createDataFrame([(c, n, float(n)) for c in ("EEG Fp1", "C3-Ref", "t3", "T7") for n in range(3)], "channel string, n long, v double")
    assert sorted({r["channel"] for r in writers.picked(rec, ["c3", "FP1"]).collect()}) == ["FP1", "c3"]
    for names in (["Cz"], ["T7"]):  # none, and two under one key
        with pytest.raises(ValueError):
            writers.picked(rec, names)
