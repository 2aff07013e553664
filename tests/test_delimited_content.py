"""Delimited recordings whose columns their content tells: headerless exports, footers, rates before the header, markers by name and by value."""

import pytest

from wavelake.sources import delimited


def read(spark, tmp_path, text, fs=None, name="r.txt"):
    (tmp_path / name).write_bytes(text.encode())
    rec = delimited.read(spark, str(tmp_path / name), fs)
    values = {}
    for r in rec.samples.orderBy("channel", "n").collect():
        values.setdefault(r["channel"], []).append(r["v"])
    return rec.fs, values, sorted((round(r["onset"], 6), round(r["duration"], 6), r["text"]) for r in rec.events.collect())


FOOT = "<end of exported RAW data>\n"


def test_headerless_clock_and_footer(spark, tmp_path):
    fs, values, events = read(spark, tmp_path, "00:00:00\t2.276\n00:00:00\t2.476\n00:00:01\t2.482\n" + FOOT, 32.0)
    assert (fs, values, events) == (32.0, {"Ch1": [2.276, 2.476, 2.482]}, [])


def test_headerless_counter(spark, tmp_path):
    assert read(spark, tmp_path, "0\t2.276\n1\t2.476\n2\t2.482\n" + FOOT, 32.0)[1] == {"Ch1": [2.276, 2.476, 2.482]}
    assert read(spark, tmp_path, "Sample Rate\t64 Hz\n0\t1\n1\t2\n2\t3\n", name="told.txt")[:2] == (64.0, {"Ch1": [1, 2, 3]})
    with pytest.raises(ValueError):
        read(spark, tmp_path, "0\t1\n1\t2\n2\t3\n", name="untold.txt")


def test_headerless_segments_and_empty_columns(spark, tmp_path):
    text = "00:00:00\t1.0\t\tBaseline\n00:00:00\t2.0\t\tBaseline\n00:00:00\t3.0\t\tTrain\n00:00:00\t4.0\t\tTrain\n00:00:00\t5.0\t\t\n<Unbearbeitete Daten exportiert>\n"
    fs, values, events = read(spark, tmp_path, text, 4.0)
    assert values == {"Ch1": [1, 2, 3, 4, 5]} and events == [(0.0, 0.5, "Baseline"), (0.5, 0.5, "Train")]


def test_headerless_codes_among_zeros(spark, tmp_path):
    rows = [f"{i / 100:.2f};{i * 0.5 + 0.25};{7 if i in (30, 60) else 0};{i % 2}" for i in range(100)]
    fs, values, events = read(spark, tmp_path, "\n".join(rows) + "\n")
    assert abs(fs - 100) < 1e-6 and set(values) == {"Ch1", "Ch2"} and values["Ch2"][:3] == [0, 1, 0]
    assert events == [(0.3, 0.0, "7"), (0.6, 0.0, "7")]


def test_rates_before_the_header(spark, tmp_path):
    fs, values, _ = read(spark, tmp_path, "Sample Rate;250 Hz\nsample;C1;C2\n0;1;2\n1;3;4\n2;5;6\n")
    assert fs == 250 and values == {"C1": [1, 3, 5], "C2": [2, 4, 6]}
    assert [delimited.rate_of([x]) for x in ("Sampling frequency (Hz): 256", "Abtastrate; 0,5 kHz", "Client: 12", "fs=128", "Sample Rate;250;Hz")] == [256, 500, None, 128, 250]


def test_names_of_other_languages_and_decimal_commas(spark, tmp_path):
    fs, values, _ = read(spark, tmp_path, "X ASCII Export;TEST\nBeispiele;Zeit;C1;C2\n0;00:00:00,000;1;2\n1;00:00:00,004;1.1;2.1\n2;00:00:00,008;1.2;2.2\n")
    assert abs(fs - 250) < 1e-6 and values["C1"] == [1, 1.1, 1.2]


def test_markers_by_name(spark, tmp_path):
    head = "time,C1,trig,mrk,marker1,event_code,Segment2,stage,block\n"
    body = "".join(f"{i / 100},{i},{3 if i == 2 else 0},,,,{'a' if i in (3, 4) else ''},{i + 1},{9 - i}\n" for i in range(6))
    fs, values, events = read(spark, tmp_path, head + body)
    assert set(values) == {"C1", "stage", "block"} and values["block"] == [9, 8, 7, 6, 5, 4]  # such names alone make no events
    assert events == [(0.02, 0.0, "trig:3"), (0.03, 0.02, "a")]


def test_texts_are_labels_whatever_their_name(spark, tmp_path):
    body = "".join(f"{i / 100},{i},{'rest' if i < 3 else 'task'},{'x' if i == 4 else ''}\n" for i in range(6))
    _, values, events = read(spark, tmp_path, "time,C1,Condition,Note\n" + body)
    assert set(values) == {"C1"} and events == [(0.0, 0.03, "rest"), (0.03, 0.03, "task"), (0.04, 0.0, "x")]
    _, values, _ = read(spark, tmp_path, "time,C1,C2\n0,1,2\n0.01,2,n/a\n0.02,3,NaN\n0.03,4,5\n", name="gaps.txt")
    assert values["C2"] == [2, 2, 2, 5] or values["C2"][0] == 2
