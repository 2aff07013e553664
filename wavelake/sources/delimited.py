"""Delimited recordings in the forms that recorders write: encodings, preambles, units in headers, axes, markers, blanks.

A few lines settle encoding, delimiter, header and columns on the driver; Spark reads, splits and converts all rows. Rows
keep the order of their files: each split's rows are numbered, and a split starts where those before it end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events, recordings
from . import tabular

# Names of time and sample axes, of marker and of segment columns, as lower-case letters and digits.
TIMES = {"time", "t", "timestamp", "times", "timesec", "timeseconds", "seconds", "sec", "timems", "ms", "msec", "milliseconds", "timestampms", "zeit"}
SAMPLES = {"sample", "samples", "sampleindex", "index", "sampleno", "samplenumber", "n", "beispiele"}
MARKERS = re.compile(r"(markers?|mark|mrk|events?|triggers?|trig|stim|stimulus|stimulation|annotations?)|(marker|event|trigger|trig|stim|annotation)([0-9]+|code)")
SEGMENTS = re.compile(r"segments?|segment([0-9]+|code)")
# What keys of lines before the header tell a rate.
RATES = re.compile(r"(samplerate|samplingrate|samplingfrequency|samplingfreq|abtastrate|abtastfrequenz).*|fs|fshz")
# Microvolts in a unit.
UNITS = {"v": 1e6, "mv": 1e3, "uv": 1.0, "µv": 1.0, "μv": 1.0, "nv": 1e-3}
UNIT = re.compile(r"^(.*?)\s*[(\[]\s*([a-zA-Zµμ]+)\s*[)\]]\s*$")


@dataclass
class Layout:
    encoding: str = "UTF-8"
    sep: str = ","
    names: list[str] = field(default_factory=list)  # of all columns
    scales: list[float] = field(default_factory=list)
    time: int | None = None
    sample: int | None = None
    milliseconds: bool = False
    markers: list[int] = field(default_factory=list)
    segments: list[int] = field(default_factory=list)
    headed: bool = True
    rate: float | None = None  # told before the header

    @property
    def channels(self) -> list[int]:
        return [i for i in range(len(self.names)) if i not in (self.time, self.sample, *self.markers, *self.segments)]


def key(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def reader(spark: SparkSession, encoding: str, returns: bool = False):
    """A reader of lines; two-byte encodings must be told what ends a line."""
    out = spark.read.option("encoding", encoding)
    return out.option("lineSep", "\r\n" if returns else "\n") if encoding.startswith("UTF-16") else out


def lines(spark: SparkSession, path: str, encoding: str, n: int) -> list[str]:
    rows = reader(spark, encoding).option("sep", "\x01").option("quote", "").option("ignoreLeadingWhiteSpace", False).csv(path, schema="line string")
    return [r["line"] or "" for r in rows.limit(n).collect()]


def encoding_of(sample: str) -> str:
    """From bytes read as Latin-1: a mark at the start, or zeros at one of every two places; archives and other binary files are refused."""
    if sample.startswith("PK\x03\x04"):
        raise ValueError("an archive is no delimited recording")
    if sample.startswith("\xff\xfe"):
        return "UTF-16LE"
    if sample.startswith("\xfe\xff"):
        return "UTF-16BE"
    zeros = [sample[i::2].count("\0") for i in (0, 1)]
    if max(zeros) * 2 > 0.3 * max(1, len(sample)):
        return "UTF-16BE" if zeros[0] > zeros[1] else "UTF-16LE"
    if "\0" in sample or sum(ord(c) < 9 or 13 < ord(c) < 32 and ord(c) != 27 for c in sample) > 0.02 * max(1, len(sample)):
        raise ValueError("a binary file is no delimited recording")
    try:
        sample.encode("latin-1").decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError as e:
        return "UTF-8" if e.start >= len(sample) - 4 else "ISO-8859-1"


def cells(line: str, sep: str) -> list[str]:
    out = [m[0].strip().strip('"').replace('""', '"').strip() for m in re.finditer(rf'"(?:[^"]|"")*"|[^{re.escape(sep)}"]+|(?<={re.escape(sep)})(?={re.escape(sep)}|$)|^(?={re.escape(sep)})', line)]
    return out


def numeric(cell: str) -> bool:
    return re.fullmatch(r"[+-]?[0-9][0-9.,:]*([eE][+-]?[0-9]+)?", cell) is not None


def layout(text: list[str], encoding: str) -> Layout:
    """The header is the first line of two or more cells, with a letter in the first two, whose next line of data has about as many, mostly numbers. Without one the first column is the axis."""
    text = [x.lstrip("﻿﻿").rstrip("\r") for x in text]
    body = [x for x in text if x.strip() and not x.lstrip().startswith("#")]
    for at, line in enumerate(body[:-1]):
        if rate_of([line]) is not None:
            continue
        for sep in sorted("\t;,", key=lambda s: -line.count(s)):
            head, data = cells(line, sep), cells(body[at + 1], sep)
            known = sum(c != "" and numeric(c) for c in data)
            if len(head) >= 2 and any(c.isalpha() for x in head[:2] for c in x) and abs(len(head) - len(data)) <= 1 and known * 2 >= len(data) - 1 and known:
                out = columns(head, sep, encoding)
                out.rate = rate_of(body[:at])
                return out
    return headless(body, encoding)


def rate_of(lines: list[str]) -> float | None:
    """A sampling rate that a line of a key and a value tells."""
    for line in lines:
        m = re.match(r'\s*"?([^;,\t:=]+?)"?\s*[;,\t:=]\s*"?([^"]*)', line)
        key_of, value = (m[1], m[2]) if m else (line, line)
        number = re.search(r"[0-9]+(?:[.,][0-9]+)?", value)
        if number and RATES.fullmatch(re.sub("[^a-z]", "", key_of.lower())):
            rate = float(number[0].replace(",", ".")) * (1000 if "khz" in value.lower() else 1)
            if 0 < rate <= 100_000:
                return rate
    return None


def headless(body: list[str], encoding: str) -> Layout:
    """Of lines without a header: the delimiter under which second cells are numbers most often; an axis that counts from 0 or 1 by ones is of samples."""
    rows = [x for x in body if not (x.strip().startswith("<") and x.strip().endswith(">"))]
    best: tuple = (0,)
    for sep in ",;\t":
        split = [c for c in (cells(x, sep) for x in rows) if len(c) >= 2 and numeric(c[0])]
        good, bad = sum(numeric(c[1]) for c in split), sum(c[1] != "" and not numeric(c[1]) for c in split)
        score = 1000 * good - 2000 * bad + 10 * max(map(len, split), default=0)
        if score > best[0]:
            best = (score, sep, split)
    if len(best) < 2:
        raise ValueError("no header was found, and no axis")
    _, sep, split = best
    width = max(map(len, split))
    out = Layout(encoding, sep, [f"c{i}" for i in range(width)], [1.0] * width, headed=False)
    axis = [c[0].replace(",", ".") for c in split]
    counts = len(axis) >= 2 and all(re.fullmatch(r"[0-9]+", x) for x in axis) and int(axis[0]) in (0, 1) and all(int(b) - int(a) == 1 for a, b in zip(axis, axis[1:]))
    out.time, out.sample = (None, 0) if counts else (0, None)
    out.rate = rate_of(rows[: rows.index(next(x for x in rows if len(cells(x, sep)) >= 2 and numeric(cells(x, sep)[0])))])
    return out


def by_content(plan: Layout, raw: DataFrame) -> Layout:
    """Which columns hold labels, by one pass over all rows: those of texts (a fifth of their cells or more), and without a header also those that are mostly 0 with at most 32 whole codes. A label that stays for two rows makes a segment of it."""
    asked = plan.channels
    if not asked:
        return plan
    w = Window.partitionBy("block").orderBy("ord")
    sums = []
    for i in asked:
        cell = F.nullif(F.trim(F.col(f"c{i}")), F.lit(""))
        cell = F.when(F.lower(cell).isin("nan", "n/a", "na"), None).otherwise(cell)
        v = tabular.number(cell)
        label = F.when(v.isNull() | (v != 0), cell)
        code = F.when(F.abs(v) > 1e-12, v)
        sums += [
            F.count(cell).alias(f"n{i}"), F.count(v).alias(f"v{i}"), F.count(code).alias(f"z{i}"), F.count_if(F.abs(code - F.round(code)) > 1e-6).alias(f"r{i}"),
            F.approx_count_distinct(F.round(code), 0.01).alias(f"d{i}"), F.bool_or(F.col(f"_l{i}") == F.col(f"_p{i}")).alias(f"s{i}"),
        ]
        raw = raw.withColumn(f"_l{i}", label).withColumn(f"_p{i}", F.lag(f"_l{i}").over(w))
    r = raw.agg(*sums).first()
    for i in asked:
        n, v = r[f"n{i}"], r[f"v{i}"]
        text = n > 0 and (n - v) / n >= 0.2
        sparse = not plan.headed and v > 0 and 0 < r[f"z{i}"] <= 0.1 * v and not r[f"r{i}"] and r[f"d{i}"] <= 32
        if text or sparse or (n == 0 and not plan.headed):
            (plan.segments if r[f"s{i}"] else plan.markers).append(i)
    if not plan.headed:
        plan.names = [f"Ch{plan.channels.index(i) + 1}" if i in plan.channels else x for i, x in enumerate(plan.names)]
    return plan


def columns(head: list[str], sep: str, encoding: str) -> Layout:
    out, seen = Layout(encoding, sep), {}
    while head and not head[-1]:
        head = head[:-1]
    for i, raw in enumerate(head):
        m = UNIT.match(raw)
        unit = m[2].lower() if m else ""
        name = m[1] if m and (unit in UNITS or unit in ("s", "sec", "ms", "msec")) else raw
        k = key(name)
        if out.time is None and k in TIMES:
            out.time, out.milliseconds = i, k.endswith(("ms", "msec", "milliseconds")) or unit in ("ms", "msec")
        elif out.sample is None and k in SAMPLES:
            out.sample = i
        elif MARKERS.fullmatch(k):
            out.markers.append(i)
        elif SEGMENTS.fullmatch(k):
            out.segments.append(i)
        name = name or f"ch{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
        out.scales.append(UNITS.get(unit, 1.0))
    return out


@dataclass
class Recording:
    samples: DataFrame  #: (recording, channel, n, t, v)
    events: DataFrame  #: (recording, onset, duration, text)
    fs: float


def read(spark: SparkSession, path: str, fs: float | None = None) -> Recording:
    """A recording (or several files of one layout, each a recording), its events and its rate (which must be given where the table has no usable time axis)."""
    encoding = encoding_of("\n".join(lines(spark, path, "ISO-8859-1", 50)))
    first = lines(spark, path, encoding, 400)
    plan = layout(first, encoding)
    width = len(plan.names)
    schema = ", ".join(f"c{i} string" for i in range(width + 1))
    raw = reader(spark, encoding, any(x.endswith("\r") for x in first)).option("sep", plan.sep).option("comment", "#").option("mode", "PERMISSIVE").option("quote", '"').schema(schema).csv(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    raw = raw.select("*", name.alias("recording"), F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"))
    cell = lambda i: tabular.number(F.col(f"c{i}"))
    clock = tabular.clock(F.col(f"c{plan.time}")) if plan.time is not None else None
    # the header and lines before it have no number where each row has one
    must = clock.isNotNull() if clock is not None else cell(plan.sample).isNotNull() if plan.sample is not None else F.coalesce(*(cell(i) for i in plan.channels)).isNotNull()
    plan = by_content(plan, raw.where(must))
    told, fs = fs is not None, fs if fs is not None else None if plan.time is not None else plan.rate
    rows = recordings.numbered_within(raw.where(must).withColumn("clock", clock if clock is not None else F.lit(None).cast("double")), "block", "ord", "recording")
    scale = 1e-3 if plan.milliseconds else 1.0
    if plan.time is not None:
        dt = rows.select((F.col("clock") - F.lag("clock").over(Window.partitionBy("block").orderBy("n"))).alias("dt")).where("dt > 0")
        middle = dt.agg(F.percentile("dt", F.lit(0.5))).first()[0]
        if middle is not None and not plan.milliseconds and middle > 1:
            scale = 1e-3
        if fs is None:
            if middle is None or (middle == 1 and not plan.milliseconds):
                if plan.rate is None:
                    raise ValueError("the time axis tells no rate; give one")
                fs, told = plan.rate, True
            else:
                fs = 1 / (middle * scale)
    elif fs is None:
        raise ValueError("without a time axis a rate must be given")
    t = F.col("clock") * scale if plan.time is not None and not told else F.col("n") / fs
    wide = rows.select("recording", "block", "n", t.alias("t"), *(F.col(f"c{i}") for i in range(width)))
    long = wide.unpivot(["recording", "block", "n", "t"], [f"c{i}" for i in plan.channels], "channel", "raw")
    scales, names = (F.create_map(*(F.lit(x) for i in plan.channels for x in (f"c{i}", of[i]))) for of in (plan.scales, plan.names))
    samples = recordings.filled(long.select("recording", "block", "channel", "n", "t", (tabular.number(F.col("raw")) * F.element_at(scales, F.col("channel"))).alias("v")), ["recording", "channel"], "block", "n", "v")
    found = [events.marker_events(wide.select("recording", "t", F.col(f"c{i}").alias("label")), ["recording"], "t", "label").withColumn("text", F.concat(F.lit(f"{plan.names[i]}:" if len(plan.markers) > 1 else ""), "text")) for i in plan.markers]
    found += [events.segment_events(wide.select("recording", "t", F.col(f"c{i}").alias("label")), ["recording"], "t", "label", 1 / fs) for i in plan.segments]
    table = spark.createDataFrame([], "recording string, onset double, duration double, text string")
    for f in found:
        table = table.unionByName(f)
    return Recording(samples.select("recording", F.element_at(names, F.col("channel")).alias("channel"), "n", "t", "v"), table, fs)


# Which reader a file's extension calls for.
READERS = {"edf": "edf", "rec": "edf", "bdf": "bdf", "vhdr": "brainvision", "csv": "delimited", "tsv": "delimited", "txt": "delimited", "asc": "delimited", "m2k": "delimited"}


def format_of(path: str) -> str:
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in READERS:
        raise ValueError(f"no reader for .{ext}: export the recording as EDF or text")
    return READERS[ext]


def read_any(spark: SparkSession, path: str, fs: float | None = None) -> Recording:
    """A recording by its file's extension; where a file has no events, those of its trigger channel."""
    from . import records

    kind = format_of(path)
    if kind == "delimited":
        out = read(spark, path, fs)
    else:  # the header tells 16 from 24 bits
        out = of_files(records.read(spark, path, "samples"), records.read(spark, path, "events"), records.read(spark, path, "signals"))
    if out.events.isEmpty():
        best = events.trigger_channel(out.samples, 0).first()
        if best is not None:
            mask = 0xFFFF if key(best["channel"]).startswith("status") else 0
            rec = out.samples.where(F.col("channel") == best["channel"])
            return Recording(out.samples, events.trigger_events(rec, ["recording", "channel"], out.fs, mask).select("recording", "onset", "duration", "text"), out.fs)
    return out


def of_files(samples: DataFrame, table: DataFrame, signals: DataFrame) -> Recording:
    """Of recordings of one rate (that of the samples)."""
    rates = [r["fs"] for r in samples.select("fs").distinct().limit(2).collect()] if signals.where("kind in ('signal', 'code')").select("fs").distinct().count() > 1 else [r["fs"] for r in signals.where("kind in ('signal', 'code')").select("fs").limit(1).collect()]
    if len(rates) != 1:
        raise ValueError("the recordings have no rate in common; read them apart")
    return Recording(samples.select("recording", "channel", "n", (F.col("n") / F.col("fs")).alias("t"), "v"), table, rates[0])
