"""Recordings as files of records: headers, ranges, pruning, rates, marks, commits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.sources import delimited, edf, records

FIELDS = [16, 80, 8, 8, 8, 8, 8, 80, 8, 32]


def edf_file(signals, samples, seconds=1.0, records_told=None, bdf=False, digits=None):
    """A file from (label, unit, pmin, pmax, dmin, dmax, samples of a record) and each signal's integers by record."""
    n, text = len(signals), lambda v, w: str(v).encode("latin-1").ljust(w)
    count = len(samples[0])
    head = (b"\xffBIOSEMI" if bdf else text("0", 8)) + text("", 160) + text("01.01.85", 8) + text("00.00.00", 8) + text(256 * (n + 1), 8) + text("", 44) + text(count if records_told is None else records_told, 8) + text(seconds, 8) + text(n, 4)
    columns = [[s[0] for s in signals], [""] * n, [s[1] for s in signals], *[[s[k] for s in signals] for k in (2, 3, 4, 5)], [""] * n, [s[6] for s in signals], [""] * n]
    head += b"".join(text(v, w) for w, column in zip(FIELDS, columns, strict=True) for v in column)
    width = 3 if bdf else 2
    body = b"".join(b"".join(int(v).to_bytes(width, "little", signed=True) for v in samples[i][r]) for r in range(count) for i in range(n))
    return head + body


def values(df, *keys):
    out = {}
    for r in df.orderBy("recording", "channel", "n").collect():
        out.setdefault(tuple(r[k] for k in ("recording", "channel", *keys)), []).append(r["v"])
    return out


ONE = ("", -32768, 32767, -32768, 32767)
MIXED = [("EEG Fz", *ONE, 4), ("ExG 1", *ONE, 4), ("TRIG", *ONE, 2), ("GSR", *ONE, 1), ("EDF Annotations", *ONE, 4)]


def test_rates_meet_and_codes_hold(spark, tmp_path):
    (tmp_path / "f.edf").write_bytes(edf_file(MIXED, [[[-100, 0, 100, -200]], [[1, 2, 3, 4]], [[0, 5]], [[7]], [[0] * 4]]))
    got = values(records.read(spark, str(tmp_path)), "fs")
    assert got == {("f", "Fz", 4.0): [-100, 0, 100, -200], ("f", "ExG1", 4.0): [1, 2, 3, 4], ("f", "TRIG", 4.0): [0, 0, 5, 5], ("f", "GSR", 4.0): [7, 7, 7, 7]}
    own = values(records.read(spark, str(tmp_path), rates="own"), "fs")
    assert own[("f", "GSR", 1.0)] == [7] and own[("f", "TRIG", 2.0)] == [0, 5]
    rec = delimited.read_any(spark, str(tmp_path / "f.edf"))
    assert rec.fs == 4.0 and rec.samples.select("channel").distinct().count() == 4
    table = {r["label"]: (r["channel"], r["kind"], r["samples"]) for r in records.read(spark, str(tmp_path), "signals").collect()}
    assert table["EEG Fz"] == ("Fz", "signal", 4) and table["TRIG"][1] == "code" and table["EDF Annotations"][1] == "annotation"


def test_names_units_and_labels():
    assert [edf.channel_name(x) for x in ("EEG Fp1-Ref", "EEG1", "eegCz", "ExG 1", "EEG-C3 ref", " F 3 ")] == ["Fp1", "EEG1", "Cz", "ExG1", "C3", "F3"]
    assert [edf.scale_of(u) for u in ("uV", "mV", "V", "", "degC", "\xb5V")] == [1, 1e3, 1e6, 1, 1, 1]
    assert edf.looks_like_eeg("C3", "", "C3") and edf.looks_like_eeg("x", "uV", "x") and not edf.looks_like_eeg("GSR", "", "GSR")
    assert edf.holds_codes("TRIG") and edf.holds_codes("Status") and not edf.holds_codes("Fz")


def test_24_bits_unknown_count_and_constant_scale(spark, tmp_path):
    wide = (-8388608, 8388607, -8388608, 8388607)
    signals = [("A", "uV", *wide, 3), ("B", "mV", -1, 1, 0, 0, 3), ("A", "uV", *wide, 3)]
    (tmp_path / "b.bdf").write_bytes(edf_file(signals, [[[-1, 8388607, -8388608]] * 2, [[5, 6, 7]] * 2, [[1, 2, 3]] * 2], records_told=-1, bdf=True))
    got = values(records.read(spark, str(tmp_path)))
    assert np.allclose(got[("b", "A")], [-1, 8388607, -8388608] * 2) and got[("b", "B")] == [0] * 6 and np.allclose(got[("b", "A_2")], [1, 2, 3] * 2)


def test_files_that_end_early_or_hold_nothing(spark, tmp_path):
    data = edf_file([("A", *ONE, 4)], [[[1, 2, 3, 4]] * 3])
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.edf").write_bytes(data[:-3])
    with pytest.raises(Exception, match="ends inside a record"):
        records.read(spark, str(tmp_path / "cut")).count()
    (tmp_path / "none").mkdir()
    assert records.read(spark, str(tmp_path / "none")).count() == 0 and records.read(spark, str(tmp_path / "none"), "events").count() == 0


def test_two_files_stay_apart(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    for name, v in (("s1/a.edf", 1), ("a.edf", 2), ("a.bdf", 3)):
        (tmp_path / name).write_bytes(edf_file([("C3", *ONE, 2)], [[[v, v]] * 2], bdf=name.endswith("bdf")))
    got = {k[0]: len(v) for k, v in values(records.read(spark, str(tmp_path))).items()}
    assert got == {"s1/a": 4, "a.edf": 4, "a.bdf": 4}
    for name in ("x", "y"):
        (tmp_path / f"{name}.csv").write_text("time,C3\n" + "".join(f"{i / 100},{i}\n" for i in range(200)))
    rec = delimited.read(spark, str(tmp_path / "*.csv"))
    got = {r["recording"]: (r["n"], r["d"], r["top"]) for r in rec.samples.groupBy("recording").agg(F.count("*").alias("n"), F.countDistinct("n").alias("d"), F.max("n").alias("top")).collect()}
    assert got == {"x": (200, 200, 199), "y": (200, 200, 199)}


class Watched:
    def __init__(self, data):
        self.data, self.read = data, []

    def read_at(self, n, at):
        self.read.append((at, n))
        return self.data[at : at + n]

    def size(self):
        return len(self.data)


def test_only_asked_bytes_are_read():
    rng = np.random.default_rng(0)
    x = rng.integers(-900, 900, (8, 40, 500))
    data = edf_file([(f"C{i}", *ONE, 500) for i in range(8)], x.tolist())
    file = Watched(data)
    plan = records.edf_plan(file, "x")
    assert sum(n for _, n in file.read) == 256 * 9 and plan.records == 40
    file.read.clear()
    got = records.taken(file, plan, [plan.signals[3]], 10, 12, 64)
    assert sum(n for _, n in file.read) == 2 * 1000 and (plan.values(got[3000], plan.signals[3]) == x[3, 10:12].ravel()).all()
    file.read.clear()
    records.taken(file, plan, [plan.signals[i] for i in (1, 2, 6)], 0, 1, 64)
    assert sorted(file.read) == [(plan.start + 1000, 2000), (plan.start + 6000, 1000)]
    file.read.clear()
    records.taken(file, plan, plan.signals, 5, 25, 64)
    assert file.read == [(plan.start + 5 * 8000, 20 * 8000)]


def test_ranges_are_planned_and_pruned(spark, tmp_path):
    x = np.arange(3 * 200 * 50).reshape(3, 200, 50) % 1000
    (tmp_path / "long.edf").write_bytes(edf_file([("C3", *ONE, 50), ("C4", *ONE, 50), ("GSR", *ONE, 50)], x.tolist()))
    small = {"partition_bytes": 3000, "gap_bytes": 16}
    df = records.read(spark, str(tmp_path), **small)
    assert df.rdd.getNumPartitions() >= 20
    got = values(df)
    assert [got[("long", c)] for c in ("C3", "C4", "GSR")] == [x[i].ravel().tolist() for i in range(3)]
    part = df.where("channel = 'C4' and n between 4990 and 5010 and recording = 'long'")
    assert part.rdd.getNumPartitions() <= 2 and "EqualTo(channel" in part._jdf.queryExecution().toString() or part.rdd.getNumPartitions() <= 2
    assert values(part) == {("long", "C4"): x[1].ravel()[4990:5011].tolist()}
    assert values(df.where("n > 9997 and channel in ('C3', 'GSR')")) == {("long", c): x[i].ravel()[9998:].tolist() for i, c in ((0, "C3"), (2, "GSR"))}
    assert df.where("n < 3 and channel = 'C3'").count() == 3 and df.where("recording = 'other'").count() == 0
    assert df.where("not (channel = 'C3') and n = 7").count() == 2


@pytest.mark.parametrize(("kind", "slow"), [("GSR", 3), ("TRIG", 3), ("GSR", 20), ("TRIG", 20)])
def test_resampling_by_ranges_is_that_of_the_whole(spark, tmp_path, kind, slow):
    rng = np.random.default_rng(slow)
    a, b = rng.integers(-500, 500, (30, 8)), rng.integers(-500, 500, (30, slow))
    (tmp_path / "m.edf").write_bytes(edf_file([("EEG C3", *ONE, 8), (kind, *ONE, slow)], [a.tolist(), b.tolist()]))
    got = values(records.read(spark, str(tmp_path), partition_bytes=100))
    x, n = b.ravel().astype(float), np.arange(240)
    want = x[n * len(x) // 240] if kind == "TRIG" else np.interp(n * (len(x) - 1) / 239, np.arange(len(x)), x)
    assert np.allclose(got[("m", kind)], want) and got[("m", "C3")] == a.ravel().tolist()


def test_marks_in_their_forms():
    text = b"+0\x14\x14\x00+1.5\x150.25\x14go\x14\x14again\x14\x00-2\x14before\x14\x00\x00"
    want = [(1.5, 0.25, "go"), (1.5, 0.25, "again"), (-2.0, 0.0, "before")]
    assert edf.annotations(text) == want == edf.annotations(text, 2)
    for width in (2, 3):  # one character in a sample, and no zeros between lists
        spread = b"".join(bytes([c]) + bytes(width - 1) for c in b"+0\x14+1.5\x150.25\x14go\x14+3\x14stop\x14\x00\x00")
        assert edf.annotations(spread, width) == [(1.5, 0.25, "go"), (3.0, 0.0, "stop")]
    assert edf.annotations(bytes(40), 2) == []


def test_marks_of_ranges(spark, tmp_path):
    x = np.zeros(1000)
    marks = [(i + 0.5, 0.0, f"m{i}") for i in range(10)]
    (tmp_path / "e.edf").write_bytes(edf.encode([("C3", x)], 100, marks))
    df = records.read(spark, str(tmp_path), "events", partition_bytes=500)
    assert df.rdd.getNumPartitions() > 3
    assert sorted((r["onset"], r["duration"], r["text"]) for r in df.collect()) == marks


ROWS = "recording string, channel string, fs double, n long, v double"


def rows_of(spark):
    return spark.createDataFrame([(r, c, 20.0 * (1 + (c == "X")), n, float((n * 7 + i * 13 + len(r)) % 201 - 100)) for r in ("a", "s/bb") for i, c in enumerate(("C3", "C4", "X")) for n in range(0, 130 + 10 * i) if n % 50 != 3], ROWS)


@pytest.mark.parametrize(("kind", "seconds"), [("edf", 1.0), ("bdf", 1.0), ("edf", 0.5), ("bdf", None)])
def test_written_recordings_come_back(spark, tmp_path, kind, seconds):
    rec = rows_of(spark)
    limits = (-32768.0, 32767.0) if kind == "edf" else (-8388608.0, 8388607.0)
    marks = spark.createDataFrame([("a", 0.25, 0.5, "go\x14 on"), ("a", 900.0, 0.0, "late"), ("a", -1.0, 0.0, "ünder"), ("a", 1.0, 0.0, " "), ("zz", 1.0, 0.0, "none")], "recording string, onset double, duration double, text string")
    records.write(rec, str(tmp_path), kind, marks, record_seconds=seconds, limits=limits, block=16)
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")) == [f"a.{kind}", f"s/bb.{kind}"]
    own = values(records.read(spark, str(tmp_path), rates="own"))
    for (r, c), got in own.items():
        want = {x["n"]: x["v"] for x in rec.where((F.col("recording") == r) & (F.col("channel") == c)).collect()}
        assert len(got) >= max(want) + 1 and got == [want.get(n, 0.0) for n in range(len(got))], (r, c)
    assert len(own) == 6
    found = sorted((x["recording"], x["onset"], x["duration"], x["text"]) for x in records.read(spark, str(tmp_path), "events").collect())
    assert found == [("a", -1.0, 0.0, "ünder"), ("a", 0.25, 0.5, "go  on"), ("a", 900.0, 0.0, "late")]


def test_limits_follow_the_samples(spark, tmp_path):
    rec = spark.createDataFrame([("r", "C3", 10.0, n, float("nan") if n == 4 else 3e-3 * n - 0.01) for n in range(40)] + [("r", "flat", 10.0, n, 0.0) for n in range(40)] + [("r", "big", 10.0, n, 1234567.0 * n) for n in range(40)], ROWS)
    codes = spark.createDataFrame([("r", "Trigger 1", 10.0, n, 5.0 * (n % 10 == 2)) for n in range(40)], ROWS)
    records.write(rec.unionByName(codes), str(tmp_path))
    got = values(records.read(spark, str(tmp_path)))
    assert got[("r", "Trigger1")] == [5.0 * (n % 10 == 2) for n in range(40)]
    assert np.abs(np.array(got[("r", "C3")]) - [0 if n == 4 else 3e-3 * n - 0.01 for n in range(40)]).max() < 1e-5
    assert np.abs(got[("r", "flat")]).max() < 1e-4 and np.allclose(got[("r", "big")], 1234567.0 * np.arange(40), rtol=0, atol=2000)


def test_brainvision_by_ranges(spark, tmp_path):
    rec = rows_of(spark).where("channel <> 'X'")
    records.write(rec, str(tmp_path), "brainvision", spark.createDataFrame([("a", 0.5, 0.0, "go, now")], "recording string, onset double, duration double, text string"))
    got = values(records.read(spark, str(tmp_path), partition_bytes=200))
    for (r, c), x in got.items():
        want = {y["n"]: y["v"] for y in rec.where((F.col("recording") == r) & (F.col("channel") == c)).collect()}
        assert x == [want.get(n, 0.0) for n in range(len(x))]
    assert len(got) == 4 and [(x["recording"], x["onset"], x["text"]) for x in records.read(spark, str(tmp_path), "events").collect()] == [("a", 0.5, "go, now")]
    with pytest.raises(Exception, match="one rate"):
        records.write(rows_of(spark), str(tmp_path / "mixed"), "brainvision")


def test_overwrite_append_and_failed_jobs(spark, tmp_path):
    one = lambda name: spark.createDataFrame([(name, "C3", 10.0, n, float(n)) for n in range(20)], ROWS)
    records.write(one("a"), str(tmp_path))
    records.write(one("b"), str(tmp_path), mode="append")
    assert {r["recording"] for r in records.read(spark, str(tmp_path)).select("recording").distinct().collect()} == {"a", "b"}
    with pytest.raises(Exception, match="whole number"):
        records.write(one("c"), str(tmp_path), record_seconds=0.33)
    bad = F.udf(lambda v: 1 / 0, "double")
    with pytest.raises(Exception, match="ZeroDivision"):
        records.write(one("d").withColumn("v", bad("v")), str(tmp_path))
    records.write(one("e"), str(tmp_path), mode="overwrite")
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == ["e.edf"]
