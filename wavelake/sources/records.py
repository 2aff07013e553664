"""Recordings in files of fixed-size records (EDF, BDF, BrainVision) as a Spark data source `recordings`.

    register(spark)
    spark.read.format("recordings").load(folder)                          # (recording, channel, fs, n, v)
    spark.read.format("recordings").option("table", "events").load(...)   # (recording, onset, duration, text)
    spark.read.format("recordings").option("table", "signals").load(...)  # a row for each signal of each header
    write(rec, folder, "edf", events)

Reading. A file is named by its path below the loaded folder without its extension (with it, where two files would share
a name), and every row carries that name as `recording`. A record has the same bytes everywhere in a file, so a range of
records is an offset: files over `partition_bytes` are planned as several ranges from their headers, smaller ones are
packed together and their headers are read by the task. Predicates on recording, channel and n (=, in, <, <=, >, >=) are
taken over: ranges and records outside are not read, and of a record only the bytes of the asked channels, runs nearer
than `gap_bytes` together. Values are in microvolts where the unit is a voltage; channels that hold codes (triggers,
status words) keep their integers. The rate is the highest one of EEG-like channels, others are brought to it, by lines or
for codes by holding, from the records of their range and one on either side; option `rates` = `own` leaves them.

Writing. A file is one run of bytes, so one task writes it, a record (or a block of a channel) at a time, from rows sorted
by their place: memory is that of a record. Physical limits come from an aggregate beforehand. Files get their names when
the driver commits the job; a task that runs again or an aborted job leaves none. `record_seconds` = None makes one record
of a whole recording.

Defined results: an empty folder has no rows; a file that ends inside a record is an error; missing or non-finite samples
are written as 0; channels of different rates keep them; a name that repeats in a file gets a number.
"""

from __future__ import annotations

import json
import math
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators import scans
from . import brainvision, edf

SAMPLES = "recording string, channel string, fs double, n long, v double"
EVENTS = "recording string, onset double, duration double, text string"
SIGNALS = "recording string, place int, label string, channel string, unit string, fs double, samples long, kind string"
SUFFIXES = (".edf", ".rec", ".bdf", ".vhdr")
#: Samples of a batch of rows, and bytes read at once.
ROWS, CHUNK = 1 << 16, 8 << 20


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Signal:
    """A signal of a header: where its bytes lie in a record, and how they become values."""

    label: str
    name: str
    unit: str
    kind: str  # signal, code, annotation, none
    likely: bool  # looks like EEG
    samples: int  # in a record
    at: int  # byte in a record
    gain: float
    base: float


@dataclass
class Plan:
    """What a header says, whatever the format."""

    data: str  # the file that holds the samples
    start: int
    records: int
    bytes: int  # of a record
    width: int  # of a sample
    seconds: float
    dtype: str
    signals: list[Signal]
    marks: str | None = None
    target: int = 0  # samples of a record at the recording's rate

    def __post_init__(self):
        kept = [s for s in self.signals if s.kind in ("signal", "code")]
        # a rate and samples in a record are in proportion
        self.target = max((s.samples for s in kept if s.likely), default=0) or max((s.samples for s in kept), default=0)

    @property
    def fs(self) -> float:
        return self.target / self.seconds

    def values(self, raw: np.ndarray, s: Signal) -> np.ndarray:
        """Values of a signal's bytes."""
        x = edf.digital(raw.reshape(-1), True) if self.dtype == "i3" else np.ascontiguousarray(raw).reshape(-1).view(self.dtype)
        x = x.astype(np.float64)
        return x if s.kind == "code" else x * s.gain + s.base


def edf_plan(file, path: str) -> Plan:
    head = file.read_at(256, 0)
    h = edf.header(head + file.read_at(256 * edf.signals_of(head), 256))
    width = 3 if h["bdf"] else 2
    per = sum(s["samples"] for s in h["signals"]) * width
    if h["seconds"] <= 0 or per <= 0:
        raise ValueError(f"{path}: records of no length")
    held = (file.size() - h["bytes"]) // per
    records = h["records"] if h["records"] > 0 else held
    if records > held:
        raise ValueError(f"{path} ends inside a record")
    signals, at, seen = [], 0, {}
    for s in h["signals"]:
        name = edf.channel_name(s["label"])
        kind = "annotation" if "annotations" in s["label"].lower() else "none" if not name or s["samples"] <= 0 else "code" if edf.holds_codes(name) else "signal"
        if kind in ("signal", "code"):
            seen[name] = seen.get(name, 0) + 1
            name = name if seen[name] == 1 else f"{name}_{seen[name]}"
        signals.append(Signal(s["label"], name, s["unit"], kind, edf.looks_like_eeg(name, s["unit"], s["label"]), s["samples"], at, s["gain"] * s["scale"], s["base"] * s["scale"]))
        at += s["samples"] * width
    return Plan(path, h["bytes"], records, per, width, h["seconds"], "i3" if h["bdf"] else "<i2", signals)


def brainvision_plan(fs, file, path: str) -> Plan:
    head = brainvision.sections(file.read().decode("utf-8", "replace"))
    common, folder = head["common infos"], posixpath.dirname(path)
    names, seen = brainvision.channels(head), {}
    width, dtype = (4, "<f4") if "FLOAT" in head.get("binary infos", {}).get("binaryformat", "INT_16").upper() else (2, "<i2")
    data = posixpath.join(folder, common["datafile"])
    frames = fs.get_file_info(data).size // (width * len(names))
    whole = "VECTOR" in common.get("dataorientation", "").upper()
    each = frames if whole else 1
    signals = []
    for i, (name, step) in enumerate(names):
        seen[name] = seen.get(name, 0) + 1
        name = name if seen[name] == 1 else f"{name}_{seen[name]}"
        signals.append(Signal(name, name, "µV", "signal", True, each, i * each * width, step, 0.0))
    marks = common.get("markerfile")
    return Plan(data, 0, (1 if frames else 0) if whole else frames, each * width * len(names), width, float(common["samplinginterval"]) * 1e-6 * max(each, 1), dtype, signals, posixpath.join(folder, marks) if marks else None)


def plan_of(fs, path: str) -> Plan:
    with fs.open_input_file(path) as file:
        return brainvision_plan(fs, file, path) if path.lower().endswith(".vhdr") else edf_plan(file, path)


def spans(signals: list[Signal], width: int, gap: int) -> list[tuple[int, int]]:
    """The bytes of a record that some signals need, runs nearer than `gap` as one."""
    out: list[list[int]] = []
    for low, high in sorted((s.at, s.at + s.samples * width) for s in signals):
        if out and low - out[-1][1] < gap:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def taken(file, plan: Plan, signals: list[Signal], low: int, high: int, gap: int) -> dict[int, np.ndarray]:
    """By place in a record, the bytes (records, bytes) of signals in records low .. high - 1."""
    out = {}
    runs = spans(signals, plan.width, gap)
    for a, b in runs:
        if len(runs) == 1 and plan.bytes - (b - a) < gap:  # whole records, nearly
            raw = np.frombuffer(file.read_at((high - low) * plan.bytes, plan.start + low * plan.bytes), np.uint8).reshape(high - low, plan.bytes)[:, a:b]
        else:
            raw = np.frombuffer(b"".join(file.read_at(b - a, plan.start + r * plan.bytes + a) for r in range(low, high)), np.uint8).reshape(high - low, b - a)
        for s in signals:
            if a <= s.at < b or s.at == a:
                out[s.at] = raw[:, s.at - a : s.at - a + s.samples * plan.width]
    return out


@dataclass
class Piece:
    path: str
    recording: str
    low: int = 0
    high: int = -1  # -1: to the end


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece] = field(default_factory=list)


def names_of(paths: list[str], root: str) -> list[str]:
    """Each file's path below the root, without its extension where that is enough to tell it."""
    full = [posixpath.relpath(p, root) if p != root else posixpath.basename(p) for p in paths]
    short = [x.rsplit(".", 1)[0] for x in full]
    return [s if short.count(s) == 1 else f for s, f in zip(short, full, strict=True)] if len(set(short)) < len(short) else short


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.table = options.get("table", "samples")
        self.own = options.get("rates", "one") == "own"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.gap = int(options.get("gap_bytes", 8 << 10))
        self.recordings: set[str] | None = None
        self.channels: set[str] | None = None
        self.low, self.high = 0, math.inf  # of n

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            at = getattr(f, "attribute", ())
            name = at[0] if len(at) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name in ("recording", "channel", "n") and isinstance(f, IsNotNull):
                continue
            if name == "recording" and values is not None:
                self.recordings = values if self.recordings is None else self.recordings & values
            elif name == "channel" and values is not None and self.table == "samples":
                self.channels = values if self.channels is None else self.channels & values
            elif name == "n" and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif name == "n" and isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == "n" and isinstance(f, LessThanOrEqual | LessThan):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def files(self) -> list[tuple[str, int, str]]:
        """(path, bytes, recording) of the files that may be asked for."""
        from pyarrow import fs as pfs

        fs, at = filesystem(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.is_file else [f for f in fs.get_file_info(pfs.FileSelector(at, recursive=True)) if f.is_file]
        found = sorted((f for f in found if f.path.lower().endswith(SUFFIXES) and not posixpath.basename(f.path).startswith((".", "_"))), key=lambda f: f.path)
        sizes = {f.path: f.size for f in found}
        names = names_of(list(sizes), at)
        return [(p, s, name) for (p, s), name in zip(sizes.items(), names, strict=True) if self.recordings is None or name in self.recordings]

    def bounds(self, plan: Plan) -> tuple[int, int]:
        """The records that hold the asked samples."""
        if self.table != "samples" or self.own or not plan.target:
            return 0, plan.records
        return max(0, self.low // plan.target), plan.records if self.high == math.inf else min(plan.records, int(self.high) // plan.target + 1)

    def ranges(self, file: tuple[str, int, str]) -> list[Piece]:
        path, size, name = file
        if self.table == "signals" or size <= self.partition_bytes and not path.lower().endswith(".vhdr"):
            return [Piece(path, name)]
        fs, _ = filesystem(self.path)
        plan = plan_of(fs, path)
        low, high = self.bounds(plan)
        step = max(1, self.partition_bytes // plan.bytes) if plan.bytes else 1
        if self.table == "events" and plan.marks or high - low <= step:
            return [Piece(path, name)] if high > low or self.table == "events" else []
        return [Piece(path, name, a, min(a + step, high)) for a in range(low, high, step)]

    def partitions(self) -> list[InputPartition]:
        files = self.files()
        with ThreadPoolExecutor(16) as pool:
            pieces = list(pool.map(self.ranges, files))
        out, held = [Pieces()], 0
        for (_, size, _), some in zip(files, pieces, strict=True):
            if len(some) > 1:
                out += [Pieces([p]) for p in some]
            elif some:
                if not out[0].pieces or held + size > self.partition_bytes:
                    out.insert(0, Pieces())
                    held = 0
                out[0].pieces.append(some[0])
                held += size
        return out

    def read(self, part: Pieces) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        for piece in part.pieces:
            plan = plan_of(fs, piece.path)
            if self.table == "signals":
                rows = [(piece.recording, i, s.label, s.name, s.unit, s.samples / plan.seconds, plan.records * s.samples, s.kind) for i, s in enumerate(plan.signals)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SIGNALS.split(", ")])
            elif self.table == "events" and plan.marks:
                with fs.open_input_file(plan.marks) as file:
                    yield self.events(piece.recording, brainvision.markers(file.read().decode("utf-8", "replace"), plan.fs))
            elif plan.records:
                with fs.open_input_file(plan.data) as file:
                    low, high = self.bounds(plan)
                    low, high = max(low, piece.low), min(high, plan.records if piece.high < 0 else piece.high)
                    yield from self.annotations(file, plan, piece, low, high) if self.table == "events" else self.samples(file, plan, piece, low, high)

    @staticmethod
    def events(recording: str, rows: list[tuple[float, float, str]]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.string()))]
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(recording, pa.string()), len(rows)), *columns], names=["recording", "onset", "duration", "text"])

    def annotations(self, file, plan: Plan, piece: Piece, low: int, high: int) -> Iterator[pa.RecordBatch]:
        signals = [s for s in plan.signals if s.kind == "annotation"]
        step = max(1, CHUNK // plan.bytes)
        for a in range(low, high if signals else low, step):
            b = min(a + step, high)
            got = taken(file, plan, signals, a, b, self.gap)
            yield self.events(piece.recording, [e for s in signals for row in got[s.at] for e in edf.annotations(row.tobytes(), plan.width)])

    def samples(self, file, plan: Plan, piece: Piece, low: int, high: int) -> Iterator[pa.RecordBatch]:
        signals = [s for s in plan.signals if s.kind in ("signal", "code") and (self.channels is None or s.name in self.channels)]
        step = max(1, min(CHUNK // plan.bytes, ROWS // max(plan.target, 1)))
        for a in range(low, high if signals else low, step):
            b = min(a + step, high)
            near = [s for s in signals if self.own or s.samples == plan.target]
            far = [s for s in signals if not self.own and s.samples != plan.target]
            got = taken(file, plan, near, a, b, self.gap) if near else {}
            for s in near:
                yield from self.rows(piece, s, s.samples / plan.seconds, a * s.samples, plan.values(got[s.at], s))
            if far:
                c = max(a - 1, 0)
                got = taken(file, plan, far, c, min(b + 1, plan.records), self.gap)
                for s in far:
                    n = np.arange(a * plan.target, b * plan.target)
                    x = plan.values(got[s.at], s)
                    yield from self.rows(piece, s, plan.fs, a * plan.target, resampled(x, c * s.samples, n, plan.records * s.samples, plan.records * plan.target, s.kind == "code"))

    def rows(self, piece: Piece, s: Signal, fs: float, first: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = max(0, self.low - first)
        end = len(values) if self.high == math.inf else min(len(values), int(self.high) - first + 1)
        for i in range(begin, end, ROWS):
            x = values[i : min(i + ROWS, end)]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(piece.recording, pa.string()), len(x)), pa.repeat(pa.scalar(s.name, pa.string()), len(x)), pa.repeat(pa.scalar(fs, pa.float64()), len(x)), pa.array(np.arange(first + i, first + i + len(x))), pa.array(x)],
                names=["recording", "channel", "fs", "n", "v"],
            )


def resampled(x: np.ndarray, first: int, n: np.ndarray, have: int, want: int, hold: bool) -> np.ndarray:
    """Places n of a channel of `have` samples brought to `want`; x are its samples from `first` on."""
    if hold:
        return x[n * have // want - first]
    at = n * ((have - 1) / max(1, want - 1))
    i = np.minimum(np.floor(at).astype(np.int64), have - 1)
    j = np.minimum(i + 1, have - 1)
    a, b = x[i - first], x[np.minimum(j - first, len(x) - 1)]
    return a + (at - i) * (b - a)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # (part, name)


class Output:
    """One recording being written: cells come in order of their places, what is missing between them is 0."""

    def __init__(self, fs, at: str, stem: str, kind: str, head: dict, job: str):
        self.fs, self.at, self.stem, self.kind, self.head = fs, at, stem, kind, head
        self.files: list[tuple[str, str]] = []
        self.done = (0, 0, 0)  # record, signal, sample
        self.block: dict[int, np.ndarray] = {}
        self.marks: list[str] = []
        self.job = job
        self.out = self.open(".eeg" if kind == "brainvision" else f".{kind}")
        if kind != "brainvision":
            self.signals, text = edf.head_of(head, kind == "bdf")
            self.out.write(text)

    def open(self, suffix: str):
        name = f"{self.stem}{suffix}"
        part = posixpath.join(posixpath.dirname(name), f".{posixpath.basename(name)}.{self.job}.part")
        self.fs.create_dir(posixpath.dirname(f"{self.at}/{part}"), recursive=True)
        self.files.append((part, name))
        return self.fs.open_output_stream(f"{self.at}/{part}")

    def zeros(self, until: tuple[int, int, int]) -> None:
        """Fills from the last place written up to another."""
        record, signal, sample = self.done
        while (record, signal, sample) < until:
            stop = until[2] if (record, signal) == until[:2] else self.signals[signal]["samples"]
            if stop > sample:
                self.out.write(edf.digits(np.zeros(stop - sample), self.signals[signal]))
            if (record, signal) == until[:2]:
                break
            record, signal, sample = (record, signal + 1, 0) if signal + 1 < len(self.signals) else (record + 1, 0, 0)
        self.done = until

    def add(self, record: int, signal: int, first: int, values: np.ndarray) -> None:
        if self.kind == "brainvision":
            self.flush(record)
            self.block[signal] = values
            return
        self.zeros((record, signal, first))
        self.out.write(edf.digits(values, self.signals[signal]))
        self.step(record, signal, first + len(values))

    def step(self, record: int, signal: int, sample: int) -> None:
        if sample >= self.signals[signal]["samples"]:
            record, signal, sample = (record, signal + 1, 0) if signal + 1 < len(self.signals) else (record + 1, 0, 0)
        self.done = (record, signal, sample)

    def tal(self, record: int, text: str) -> None:
        if self.kind == "brainvision":
            self.marks += text.split("\x00")
            return
        signal = len(self.signals) - 1
        self.zeros((record, signal, 0))
        self.out.write(text.encode().ljust(self.signals[signal]["bytes"], b"\x00"))
        self.step(record, signal, self.signals[signal]["samples"])

    def flush(self, record: int) -> None:
        """BrainVision: the frames of the blocks before `record`."""
        size = self.head["samples"][0]
        while self.done[0] < record:
            rows = [np.pad(self.block.get(i, np.zeros(0)), (0, size))[:size] for i in range(len(self.head["channels"]))]
            held = min(size, self.head["size"] - self.done[0] * size)
            self.out.write(np.nan_to_num(np.stack(rows, 1)[:held], posinf=0, neginf=0).astype("<f4").tobytes())
            self.block = {}
            self.done = (self.done[0] + 1, 0, 0)

    def close(self) -> list[tuple[str, str]]:
        if self.kind == "brainvision":
            self.flush(self.head["records"])
            marks = [(float(m[1]), float(m[2] or 0), m[3]) for x in self.marks if (m := re.fullmatch(r"\+([0-9.]+)(?:\x15([0-9.]+))?\x14(.+)\x14", x, re.DOTALL))]
            texts = brainvision.encode(posixpath.basename(self.stem), [(c, np.zeros(0)) for c in self.head["channels"]], self.head["samples"][0] / self.head["seconds"], sorted(marks))
            for suffix in (".vmrk", ".vhdr"):
                with self.open(suffix) as out:
                    out.write(texts[f"{posixpath.basename(self.stem)}{suffix}"])
        else:
            self.zeros((self.head["records"], 0, 0))
        self.out.close()
        return self.files


class Writer(DataSourceArrowWriter):
    """Rows of `placed`, a recording's all in one task and in order."""

    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite, self.job = path.rstrip("/"), kind, overwrite, uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, at = filesystem(self.path)
        done, out, name = Written(), None, None
        tag = f"{self.job}-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            x, places = batch.column("x"), batch.column("at")
            rows = batch.select(["recording", "record", "signal", "first", "head", "tal"]).to_pylist()
            for i, row in enumerate(rows):
                if row["recording"] != name:
                    done.files += out.close() if out else []
                    name = row["recording"]
                    out = Output(fs, at, name, self.kind, json.loads(row["head"]), tag)
                elif row["tal"] is not None:
                    out.tal(row["record"], row["tal"])
                else:
                    values, place = x[i].values.to_numpy(zero_copy_only=False), places[i].values
                    if place is not None:  # some samples are missing
                        place = place.to_numpy(zero_copy_only=False) - row["first"]
                        values, known = np.zeros(place[-1] + 1), values
                        values[place] = known
                    out.add(row["record"], row["signal"], row["first"], values)
        if out:
            done.files += out.close()
        return done

    def listed(self, fs, at: str) -> list:
        from pyarrow import fs as pfs

        return [f for f in fs.get_file_info(pfs.FileSelector(at, recursive=True, allow_not_found=True)) if f.is_file]

    def commit(self, messages: list) -> None:
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        won = {name: part for m in messages if m for part, name in m.files}
        for name, part in won.items():
            fs.move(f"{at}/{part}", f"{at}/{name}")
        new = {f"{at}/{name}" for name in won}
        for f in self.listed(fs, at):
            old = self.overwrite and f.path.lower().endswith((*SUFFIXES, ".vmrk", ".eeg")) and f.path not in new
            if old or f".{self.job}-" in posixpath.basename(f.path):
                fs.delete_file(f.path)

    def abort(self, messages: list) -> None:
        fs, at = filesystem(self.path)
        for f in self.listed(fs, at):
            if f".{self.job}-" in posixpath.basename(f.path):
                fs.delete_file(f.path)


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return {"samples": SAMPLES, "events": EVENTS, "signals": SIGNALS}[self.options.get("table", "samples")]

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        kind = self.options.get("kind", "edf")
        if kind not in ("edf", "bdf", "brainvision"):
            raise ValueError(f"no writer of {kind}")
        return Writer(self.options["path"], kind, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known and lets Spark push predicates into Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)


def read(spark: SparkSession, path: str, table: str = "samples", **options) -> DataFrame:
    register(spark)
    return spark.read.format("recordings").options(table=table, **options).load(path)


def number(x) -> F.Column:
    """Up to six decimals, no zeros at the end."""
    return F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")


def dealt_marks(marks: DataFrame, least: int = 1 << 10) -> DataFrame:
    """marks with the record that keeps each: its own one, unless one record would hold over `least` bytes and four times the mean.

    All records of a file are as wide as the widest list of marks, so marks that crowd (those after the last sample all
    belong to the last record) would make a file of records times marks. In such a recording they are dealt to all
    records by their running bytes in time order, found in spans of onsets and summed over spans; readers take a mark's
    time from itself.
    """
    rows = marks.withColumns({"_bytes": F.octet_length("mark").cast("long"), "_chunk": scans.chunk_of("onset", scans.SECONDS)})
    full = rows.groupBy("recording", "record").agg(F.sum("_bytes").alias("b"), F.max("records").alias("r")).groupBy("recording").agg(F.max("b").alias("most"), F.sum("b").alias("all"), F.max("r").alias("r"))
    share = F.ceil(F.col("all") / F.col("r"))
    full = full.select("recording", share.alias("_share"), (F.col("most") > F.greatest(F.lit(least), 4 * share)).alias("_crowded"))
    earlier = Window.partitionBy("recording").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("recording", "_chunk").agg(F.sum("_bytes").alias("b")).select("recording", "_chunk", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("recording", "_chunk").orderBy("onset", "duration", "t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_before", F.sum("_bytes").over(within) - F.col("_bytes")).join(starts, ["recording", "_chunk"]).join(full, "recording")
    spread = F.least(F.floor((F.col("_start") + F.col("_before")) / F.col("_share")), F.col("records") - 1)
    return rows.withColumn("record", F.when(F.col("_crowded"), spread).otherwise(F.col("record"))).drop("_bytes", "_chunk", "_start", "_before", "_share", "_crowded")


def placed(rec: DataFrame, events: DataFrame | None, kind: str = "edf", record_seconds: float | None = 1.0, limits: tuple[float, float] | None = None, padding: float = 0.05, block: int = 1 << 14) -> DataFrame:
    """Rows for the writer, from (recording, channel, fs, n, v): a head, then cells of channels and lists of marks by place.

    limits: physical minimum and maximum of every channel; by default those of its samples and 0, widened by a share, and for channels of codes those of the
    integers, so that codes stay themselves.
    """
    record_seconds = record_seconds or (1.0 if kind == "brainvision" else None)
    seconds = F.lit(record_seconds) if record_seconds else F.col("size") / F.col("fs")
    v = F.when(F.isnan("v") | (F.abs("v") == float("inf")), None).otherwise(F.col("v"))
    stats = rec.groupBy("recording", "channel").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), (F.max("n") + 1).alias("size"), F.max("fs").alias("fs"))
    lo, hi = F.least(F.coalesce("lo", F.lit(-1.0)), F.lit(0.0)), F.greatest(F.coalesce("hi", F.lit(1.0)), F.lit(0.0))
    pad = F.when(hi > lo, (hi - lo) * padding).otherwise(1.0)
    top = float(1 << 23 if kind == "bdf" else 1 << 15)
    codes = F.regexp_replace(F.lower("channel"), "[^a-z0-9]", "").rlike("^(" + "|".join(edf.CODES) + ")")
    ends = [F.when(codes, exact).otherwise(x) for exact, x in ((-top, lo - pad), (top - 1, hi + pad))] if limits is None else list(map(F.lit, limits))
    spr = F.round(F.col("fs") * seconds)
    spr = F.when((F.abs(F.col("fs") * seconds - spr) <= 1e-6) & (spr >= 1), spr.cast("long")).otherwise(F.raise_error(F.lit("a rate times the seconds of a record must be a whole number")).cast("long"))
    stats = stats.withColumn("spr", spr).withColumn("records", F.ceil(F.col("size") / F.col("spr")))
    heads = stats.withColumn("c", F.struct("channel", ends[0].alias("lo"), ends[1].alias("hi"), "spr", "size")).groupBy("recording").agg(
        F.array_sort(F.collect_list("c")).alias("c"), F.max("records").alias("records"), F.max(F.col("spr") / F.col("fs")).alias("seconds"), F.max("size").alias("size")
    )
    if kind == "brainvision":  # one rate, and blocks of frames
        heads = heads.withColumn("c", F.when(F.size(F.array_distinct("c.spr")) == 1, F.col("c")).otherwise(F.raise_error(F.lit("BrainVision files have one rate")).cast(heads.schema["c"].dataType)))
    heads = heads.withColumn("seconds", F.lit(float(record_seconds)) if record_seconds else F.col("seconds"))
    places = heads.select("recording", F.posexplode("c").alias("signal", "c")).select("recording", "signal", "c.channel", "c.spr")
    cells = rec.join(places, ["recording", "channel"]).withColumn("record", F.floor(F.col("n") / F.col("spr"))).withColumn("i", F.col("n") % F.col("spr")).withColumn("first", F.floor(F.col("i") / block) * block)
    packed = cells.groupBy("recording", "record", "signal", "first").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce(v, F.lit(0.0)).alias("v")))).alias("s"))
    gaps = F.element_at("s", -1)["i"] - F.col("first") + 1 > F.size("s")
    no = lambda t: F.lit(None).cast(t)
    out = packed.select("recording", "record", F.col("signal").cast("int").alias("signal"), "first", no("string").alias("head"), F.col("s.v").alias("x"), F.when(gaps, F.col("s.i")).alias("at"), no("string").alias("tal"))
    width = F.lit(0)
    if events is not None:
        text = F.trim(F.regexp_replace("text", r"[\x00-\x1f]", " "))
        own = events.join(heads.select("recording", "records", "seconds"), "recording").where(~F.isnan("onset") & F.col("onset").isNotNull()).withColumn("t", text).where("t <> ''")
        record = F.least(F.greatest(F.floor(F.col("onset") / F.col("seconds")), F.lit(0)), F.col("records") - 1)
        mark = F.concat(F.when(F.col("onset") < 0, "").otherwise("+"), number(F.col("onset")), F.when(F.col("duration") > 0, F.concat(F.lit("\x15"), number(F.col("duration")))).otherwise(""), F.lit("\x14"), F.col("t"), F.lit("\x14\x00"))
        marks = dealt_marks(own.select("recording", "records", "seconds", "onset", "duration", "t", mark.alias("mark"), record.alias("record")))
        marks = marks.groupBy("recording", "record", "seconds").agg(F.array_sort(F.collect_list(F.struct("onset", "duration", "t", "mark"))).alias("m"))
        stamp = F.concat(F.lit("+"), number(F.col("record") * F.col("seconds")), F.lit("\x14\x14\x00"))
        texts = marks.withColumn("tal", F.concat(stamp, F.array_join("m.mark", "")))
        # every record tells its time; those of marks only once
        times = heads.select("recording", "seconds", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)).alias("record")).join(marks.select("recording").distinct(), "recording", "left_semi")
        tal = times.join(texts.select("recording", "record", "tal"), ["recording", "record"], "left").withColumn("tal", F.coalesce("tal", stamp))
        widths = tal.groupBy("recording").agg(F.max(F.octet_length("tal")).alias("width"))
        heads = heads.join(widths, "recording", "left")
        width = F.coalesce("width", F.lit(0))
        out = out.unionByName(tal.select("recording", "record", F.lit(1 << 30).alias("signal"), F.lit(0).cast("long").alias("first"), no("string").alias("head"), no("array<double>").alias("x"), no("array<long>").alias("at"), "tal"))
    head = F.to_json(F.struct(F.col("c.channel").alias("channels"), F.col("c.lo").alias("low"), F.col("c.hi").alias("high"), F.col("c.spr").alias("samples"), "records", "seconds", "size", width.alias("width")))
    first = heads.select("recording", F.lit(-1).cast("long").alias("record"), F.lit(-1).alias("signal"), F.lit(0).cast("long").alias("first"), head.alias("head"), no("array<double>").alias("x"), no("array<long>").alias("at"), no("string").alias("tal"))
    return first.unionByName(out).repartition("recording").sortWithinPartitions("recording", "record", "signal", "first")


def write(rec: DataFrame, folder: str, kind: str = "edf", events: DataFrame | None = None, mode: str = "append", **how) -> None:
    """Writes (recording, channel, fs, n, v) as files of a kind, under their recordings' names."""
    register(rec.sparkSession)
    placed(rec, events, kind, **how).write.format("recordings").options(path=folder, kind=kind).mode(mode).save()
