"""Streams of samples (recording, channel, n, v) with a state for each recording: frames, causal filters, artifacts.

A recording's state holds the last samples of all its channels, so that what needs several channels (pairs, the average
reference, a count of bad channels) needs no join of streams. The channels are named, and a place n is closed when each of
them has a sample there or further on; closed places are worked in order, whatever micro-batches they came in, and samples
of closed places that come later are dropped. So any cut into batches gives the same rows as the table forms.

State is bounded by a window of samples of the channels, by what waits for the slowest channel, and for the artifact gate
by the frames of its baseline, which go when it ends.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalar
from ..operators import kernels, signals


class Rings:
    """The samples of a recording's channels by place, from the first that is still needed."""

    def __init__(self, channels: list[str], keep: int):
        self.channels, self.keep = channels, keep
        self.low = 0  # the place of the first column
        self.next = 0  # the first place that isn't closed
        self.top = np.full(len(channels), -1, np.int64)
        self.values = np.zeros((len(channels), 0))
        self.known = np.zeros((len(channels), 0), bool)

    def add(self, rows: pd.DataFrame) -> None:
        place = rows["channel"].map({c: i for i, c in enumerate(self.channels)})
        ok = place.notna() & (rows["n"] >= self.next)
        i, n, v = place[ok].to_numpy(np.int64), rows["n"][ok].to_numpy(np.int64), rows["v"][ok].to_numpy(float)
        if not len(n):
            return
        more = int(n.max()) + 1 - self.low - self.values.shape[1]
        if more > 0:
            self.values = np.pad(self.values, ((0, 0), (0, more)))
            self.known = np.pad(self.known, ((0, 0), (0, more)))
        self.values[i, n - self.low], self.known[i, n - self.low] = v, True
        np.maximum.at(self.top, i, n)

    def closed(self) -> tuple[int, int]:
        """The places that are closed since the last call."""
        first, self.next = self.next, max(self.next, int(self.top.min()) + 1)
        return first, self.next

    def window(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and which are known (channel, place)."""
        return self.values[:, low - self.low : high - self.low], self.known[:, low - self.low : high - self.low]

    def forget(self) -> None:
        low = max(self.low, self.next - self.keep)
        self.values, self.known, self.low = self.values[:, low - self.low :].copy(), self.known[:, low - self.low :].copy(), low


class Ends:
    """The ends of frames (samples so far) as they come due; with burst, steps counted while the window fills are paid out one by one."""

    def __init__(self, size: int, step: int, burst: bool):
        self.size, self.step, self.burst = size, step, burst
        self.j = 1 if burst else -(-size // step)

    def until(self, samples: int) -> Iterator[int]:
        while True:
            end = max(self.size + self.j - 1, self.j * self.step) if self.burst else self.j * self.step
            if end > samples:
                return
            self.j += 1
            yield end


class Frames:
    """Frames with all channels that have every sample of the window."""

    columns, schema = ["recording", "end_n", "channels", "xs"], "recording string, end_n long, channels array<string>, xs array<array<double>>"

    def __init__(self, channels: list[str], size: int, step: int, burst: bool):
        self.rings, self.ends = Rings(channels, size), Ends(size, step, burst)

    def run(self, recording: str, rows: pd.DataFrame) -> list[tuple]:
        self.rings.add(rows)
        out = []
        for end in self.ends.until(self.rings.closed()[1]):
            x, known = self.rings.window(end - self.ends.size, end)
            whole = np.flatnonzero(known.all(1))
            if len(whole):
                out.append((recording, end, [self.rings.channels[i] for i in whole], [x[i].tolist() for i in whole]))
        self.rings.forget()
        return out


class Filter:
    """Average reference and causal sections, with the sections' delays."""

    columns, schema = ["recording", "channel", "n", "v"], "recording string, channel string, n long, v double"

    def __init__(self, channels: list[str], sections: list[np.ndarray], average: bool):
        self.rings, self.sections, self.average = Rings(channels, 0), sections, average
        self.delays = np.zeros((len(channels), len(sections), 2, 1))

    def run(self, recording: str, rows: pd.DataFrame) -> list[tuple]:
        self.rings.add(rows)
        low, high = self.rings.closed()
        x, known = self.rings.window(low, high)
        if self.average and high > low:
            count = known.sum(0)
            x = x - np.where(known, x, 0.0).sum(0) / np.maximum(count, 1)
        out = []
        for i, channel in enumerate(self.rings.channels):
            at = np.flatnonzero(known[i])
            if len(at):
                y = kernels.sections(x[i : i + 1, at], self.sections, self.delays[i])[0] if self.sections else x[i, at]
                out += zip([recording] * len(at), [channel] * len(at), (low + at).tolist(), y.astype(float).tolist(), strict=True)
        self.rings.forget()
        return out


def robust_scale(v: np.ndarray, median: float) -> float:
    """As scalar.robust_scale."""
    mad, sd = 1.4826 * float(np.median(np.abs(v - median))), float(v.std(ddof=1)) if len(v) > 1 else 0.0
    return mad if mad > 1e-12 else sd if sd > 1e-12 else 1.0


class Gate:
    """Features of frames against medians and scales of those that end within the baseline, frozen at the first later frame."""

    columns = ["recording", "end_n", "ready", "bad_channels", "artifact", "max_ptp_z", "max_rms_z", "max_kurtosis_z"]
    schema = "recording string, end_n long, ready boolean, bad_channels long, artifact boolean, max_ptp_z double, max_rms_z double, max_kurtosis_z double"

    def __init__(self, channels: list[str], size: int, step: int, last: int, limit: float, least: int):
        self.rings, self.ends = Rings(channels, size), Ends(size, step, True)
        self.last, self.limit, self.least = last, limit, least
        self.base: list[np.ndarray] | None = []
        self.median = np.zeros((len(channels), 3))
        self.scale = np.ones((len(channels), 3))

    @staticmethod
    def features(x: np.ndarray, known: np.ndarray) -> np.ndarray:
        """(channel, 3) of the samples that are known; not-a-number of channels without any."""
        if not known.all():
            each = [Gate.features(v[None, k], k[None, k])[0] if k.any() else np.full(3, np.nan) for v, k in zip(x, known, strict=True)]
            return np.stack(each)
        d = x - x.mean(1, keepdims=True)
        var = (d * d).mean(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            kurtosis = np.where(var > 1e-24, (d**4).mean(1) / var**2 - 3, 0.0)
        return np.stack([x.max(1) - x.min(1), np.sqrt((x * x).mean(1)), kurtosis], 1)

    def freeze(self) -> None:
        if self.base:
            base = np.stack(self.base)
            for c in range(base.shape[1]):
                for f in range(3):
                    v = base[:, c, f][~np.isnan(base[:, c, f])]
                    if len(v):
                        self.median[c, f] = np.median(v)
                        self.scale[c, f] = robust_scale(v, self.median[c, f])
        self.base = None

    def run(self, recording: str, rows: pd.DataFrame) -> list[tuple]:
        self.rings.add(rows)
        out = []
        for end in self.ends.until(self.rings.closed()[1]):
            x, known = self.rings.window(end - self.ends.size, end)
            if not known.any():
                continue
            raw = self.features(x, known)
            if end <= self.last:
                self.base.append(raw)
                out.append((recording, end, False, 0, False, 0.0, 0.0, 0.0))
                continue
            if self.base is not None:
                self.freeze()
            z = (raw - self.median) / self.scale
            have = ~np.isnan(z[:, 0])
            bad = int((np.nanmax(z[have], 1) > self.limit).sum())
            top = np.maximum(np.nanmax(z[have], 0), 0.0)
            out.append((recording, end, True, bad, bad >= min(self.least, int(have.sum())), *map(float, top)))
        self.rings.forget()
        return out


def kept(rows: DataFrame, make: Callable[[], Frames | Filter | Gate], kind: type) -> DataFrame:
    """A stream of samples through a machine for each recording."""

    def one(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else make()
        out = machine.run(key[0], pd.concat(list(batches), ignore_index=True))
        state.update((pickle.dumps(machine),))
        yield pd.DataFrame(out, columns=kind.columns)

    return rows.groupBy("recording").applyInPandasWithState(one, kind.schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def frames(rows: DataFrame, channels: list[str], size: int, step: int, burst: bool = True) -> DataFrame:
    """(recording, end_n, channels, xs): each frame's channels in a row, for `online.coherence_frames` and `online.phase_frames`."""
    names = sorted(channels)
    return kept(rows, lambda: Frames(names, size, step, burst), Frames)


def preprocessed(rows: DataFrame, channels: list[str], fs: float, average: bool = True, notch: float = 0.0, low: float = 0.0, high: float = 0.0, notch_q: float = 30.0) -> DataFrame:
    """(recording, channel, n, v): as `signals.preprocessed` with zero_phase false."""
    sections = signals.stages(fs, notch, low, high, notch_q)
    return kept(rows, lambda: Filter(sorted(channels), sections, average), Filter)


def artifact_gate(rows: DataFrame, channels: list[str], fs: float, size: int, step: int, baseline: float, limit: float = 6.0, least: int = 1, ignore: list[str] | None = None) -> DataFrame:
    """(recording, end_n, ready, bad_channels, artifact, max z's) of each frame, as `online.artifact_gate`."""
    names = sorted(set(channels) - set(ignore or []))
    return kept(rows, lambda: Gate(names, size, step, scalar.samples(baseline, fs), limit, least), Gate)
