"""The BrainVision format: a text header, a text marker file and a binary file of int16 or float32 samples. `records` reads and writes such files."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

UNITS = {"v": 1e6, "mv": 1e3, "µv": 1.0, "uv": 1.0, "": 1.0, "nv": 1e-3}


def sections(text: str) -> dict[str, dict[str, str]]:
    """Keys and values by section."""
    out: dict[str, dict[str, str]] = {}
    here: dict[str, str] = {}
    for line in text.lstrip("﻿").splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            here = out.setdefault(line[1:-1].lower(), {})
        elif "=" in line and not line.startswith(";"):
            k, _, v = line.partition("=")
            here[k.strip().lower()] = v.strip()
    return out


def channels(header: dict) -> list[tuple[str, float]]:
    """(name, microvolts a step) in order; `\\1` in a name is a comma."""
    info = header["channel infos"]
    out = []
    for i in range(1, int(header["common infos"]["numberofchannels"]) + 1):
        name, _, step, unit, *_ = [*info[f"ch{i}"].split(","), "", "", ""]
        out.append((name.replace("\\1", ","), float(step or 1) * UNITS.get(unit.strip().lower(), 1.0)))
    return out


def markers(text: str, fs: float) -> list[tuple[float, float, str]]:
    """(onset, duration, text): places count from 1, lengths of a sample or less are points; comments have no type before them."""
    out = []
    for key, value in sections(text).get("marker infos", {}).items():
        if re.fullmatch(r"mk\d+", key):
            kind, label, place, length, *_ = [*value.split(","), "", "", ""]
            name = label.replace("\\1", ",") if kind in ("Comment", "New Segment") or not kind else f"{kind}:{label}"
            out.append(((int(place) - 1) / fs, max(0, int(length or 0)) / fs if int(length or 0) > 1 else 0.0, name or kind))
    return sorted(out)


def read(spark: SparkSession, header_path: str) -> tuple[DataFrame, DataFrame]:
    """(path, channel, fs, x) and (path, onset, duration, text) of short recordings."""
    from . import edf

    return edf.read_signals(spark, header_path), edf.read_events(spark, header_path)


def encode(stem: str, signals: list[tuple[str, np.ndarray]], fs: float, events: list[tuple[float, float, str]] = ()) -> dict[str, bytes]:
    """The three files, by name, with float samples."""
    info = "\n".join(f"Ch{i}={n.replace(',', chr(92) + '1')},,1,µV" for i, (n, _) in enumerate(signals, 1))
    marks = "\n".join(f"Mk{i}=Comment,{t.replace(',', chr(92) + '1')},{int(round(o * fs)) + 1},{max(1, int(round(d * fs)))},0" for i, (o, d, t) in enumerate(events, 1))
    head = f"Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nCodepage=UTF-8\nDataFile={stem}.eeg\nMarkerFile={stem}.vmrk\nDataFormat=BINARY\nDataOrientation=MULTIPLEXED\nNumberOfChannels={len(signals)}\nSamplingInterval={1e6 / fs:g}\n[Binary Infos]\nBinaryFormat=IEEE_FLOAT_32\n[Channel Infos]\n{info}\n"
    return {f"{stem}.vhdr": head.encode(), f"{stem}.vmrk": f"Brain Vision Data Exchange Marker File, Version 1.0\n[Common Infos]\nDataFile={stem}.eeg\n[Marker Infos]\n{marks}\n".encode(), f"{stem}.eeg": np.stack([x for _, x in signals], 1).astype("<f4").tobytes()}
