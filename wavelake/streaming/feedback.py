"""The neurofeedback loop as one keyed state machine, for batch replay and Structured Streaming alike.

A session's frames (t, metric, artifact) go in time order through: smoothing, hysteresis, dwell and refractory time,
debouncing, the rolling reward rate, and the adaptive threshold. A row shows the threshold it was judged by. Artifact
frames give no reward, reset the gates, count as 0 in the rate and leave the threshold alone.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "session string, t double, metric double, threshold double, reward int, rate double, feedback double"


@dataclass
class Settings:
    baseline_sec: float = 10.0
    target: float = 0.6
    eta: float = 0.1
    rate_frames: int = 20
    tau_sec: float = 0.0
    hysteresis: float = 0.0
    dwell_sec: float = 0.0
    refractory_sec: float = 0.0
    on_count: int = 1
    off_count: int = 1
    span: float = 1.0
    above: bool = True
    adapt: str = "exp"  # or quantile
    update_sec: float = 0.0
    quantile_sec: float = 30.0
    quantile_least: int = 20


@dataclass
class State:
    t: float | None = None
    smooth: float | None = None
    threshold: float | None = None
    gate: bool = False
    dwell: float = 0.0
    off_at: float | None = None
    shaped: bool = False
    steady: bool = False
    streak: int = 0
    rewards: list = field(default_factory=list)
    base: list = field(default_factory=list)
    recent: list = field(default_factory=list)  # (t, metric) by time
    ordered: list = field(default_factory=list)  # the same metrics by size
    updated: float | None = None


def quantile(values: list[float], q: float) -> float:
    v = sorted(values)
    at = min(max(q, 0.0), 1.0) * (len(v) - 1)
    i = int(at)
    return v[i] + (at - i) * (v[min(i + 1, len(v) - 1)] - v[i])


def observed(s: State, t: float, metric: float, o: Settings) -> None:
    """Adds a metric to the sliding window of the quantile mode."""
    s.recent.append([t, metric])
    insort(s.ordered, metric)
    expired(s, t, o)


def expired(s: State, t: float, o: Settings) -> None:
    """Drops what is as old as the window or older (0: nothing expires)."""
    n = 0
    while o.quantile_sec > 0 and n < len(s.recent) and t - s.recent[n][0] >= o.quantile_sec:
        del s.ordered[bisect_left(s.ordered, s.recent[n][1])]
        n += 1
    del s.recent[:n]


def adapted(s: State, used: float, rate: float, t: float, o: Settings) -> float:
    """The next threshold: moved by the error of the reward rate, or blended towards the quantile of recent metrics that would give the wanted rate."""
    if not o.eta > 0 or not math.isfinite(used):
        return used
    if o.update_sec > 0 and s.updated is not None and 0 <= t - s.updated < o.update_sec:
        return used
    if o.adapt == "exp":
        out = used * math.exp((1 if o.above else -1) * o.eta * (rate - o.target))
        s.updated = t if out != used else s.updated
        return out
    expired(s, t, o)
    if len(s.ordered) < max(1, o.quantile_least):
        return used
    q = min(1.0, max(0.0, 1 - o.target if o.above else o.target))
    at = q * (len(s.ordered) - 1)
    i = int(at)
    wanted = s.ordered[i] + (at - i) * (s.ordered[min(i + 1, len(s.ordered) - 1)] - s.ordered[i])
    s.updated = t
    return used + min(1.0, o.eta) * (wanted - used)


def step(s: State, t: float, metric: float | None, artifact: bool, o: Settings) -> tuple | None:
    """(metric, threshold, reward, rate, feedback) of a frame, or none while the baseline lasts. Frames not after the last are dropped."""
    if s.t is not None and t <= s.t:
        return None
    dt, s.t = (t - s.t if s.t is not None else 0.0), t
    fine = metric is not None and math.isfinite(metric)
    if fine and not artifact:
        s.smooth = metric if s.smooth is None or o.tau_sec <= 0 else s.smooth + (1 - math.exp(-dt / o.tau_sec)) * (metric - s.smooth)
    if s.threshold is None:
        if t <= o.baseline_sec:
            if fine and not artifact:
                s.base.append(s.smooth)
            return None
        s.threshold = quantile(s.base, 1 - o.target if o.above else o.target) if s.base else (s.smooth or 0.0)
        s.base = []
    used, reward = s.threshold, False
    if artifact or not fine:
        s.gate = s.shaped = s.steady = False
        s.dwell, s.streak = 0.0, 0
    else:
        gap = s.smooth - used if o.above else used - s.smooth
        s.gate = gap > (-o.hysteresis if s.gate else o.hysteresis)
        if not s.gate:
            if s.shaped:
                s.off_at = t
            s.dwell, s.shaped = 0.0, False
        elif not s.shaped and (s.off_at is None or t - s.off_at >= o.refractory_sec):
            s.dwell += dt
            s.shaped = s.dwell >= o.dwell_sec
        s.streak = s.streak + 1 if s.shaped != s.steady else 0
        if s.streak >= (o.off_count if s.steady else o.on_count):
            s.steady, s.streak = s.shaped, 0
        reward = s.steady
    s.rewards = [*s.rewards, int(reward)][-o.rate_frames :]
    rate = sum(s.rewards) / len(s.rewards)
    value = 0.0
    if fine and not artifact:
        gap = s.smooth - used if o.above else used - s.smooth
        value = min(1.0, max(0.0, gap / (o.span if o.span > 0 else 1.0)))
        if o.adapt == "quantile":
            observed(s, t, s.smooth, o)
        s.threshold = adapted(s, used, rate, t, o)
    return s.smooth, used, int(reward), rate, value


def run(session: str, frames: pd.DataFrame, state: State, o: Settings) -> pd.DataFrame:
    rows = []
    for r in frames.sort_values("t").itertuples(index=False):
        out = step(state, float(r.t), None if r.metric is None else float(r.metric), bool(r.artifact), o)
        if out:
            rows.append((session, float(r.t), *out))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])


def replay(frames: DataFrame, o: Settings) -> DataFrame:
    """A batch table (session, t, metric, artifact); a task walks its sessions in time order batch by batch, so it holds a batch and one state."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state, begun = None, State(), False
        for batch in batches:
            new = (batch["session"].ne(batch["session"].shift()) & ~(batch["session"].isna() & batch["session"].shift().isna())).cumsum()
            for _, part in batch.groupby(new, sort=False):
                name = part["session"].iloc[0]
                name = None if pd.isna(name) else name
                if not begun or name != session:
                    session, state, begun = name, State(), True
                yield run(session, part[["t", "metric", "artifact"]], state, o)

    rows = frames.select("session", "t", "metric", "artifact")
    return rows.repartition("session").sortWithinPartitions("session", "t").mapInPandas(walk, SCHEMA)


def counters(frames: DataFrame, rows: DataFrame, o: Settings) -> DataFrame:
    """A session's numbers of frames (in the baseline, in training, with artifacts, rewarded), its reward rate over valid training frames, and its first and last threshold, from frames and the rows that `replay` gave for them."""
    early = F.col("t") <= o.baseline_sec
    bad = F.col("artifact") | F.col("metric").isNull() | F.isnan("metric")
    all_ = frames.groupBy("session").agg(F.count_if(early).alias("baseline"), F.count_if(~early).alias("training"), F.count_if("artifact").alias("artifact"), F.count_if(~early & ~bad).alias("valid"))
    done = rows.groupBy("session").agg(F.sum("reward").alias("reward"), F.min_by("threshold", "t").alias("threshold_init"), F.max_by("threshold", "t").alias("threshold_final"))
    out = all_.join(done, "session", "left").fillna(0, ["reward"])
    return out.withColumn("reward_rate", F.when(F.col("valid") > 0, F.col("reward") / F.col("valid")))


def live(frames: DataFrame, o: Settings) -> DataFrame:
    """A stream of the same rows; a session's state is kept between micro-batches."""

    def one(key, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = State(**json.loads(kept.get[0])) if kept.exists else State()
        rows = pd.concat(list(batches), ignore_index=True)
        out = run(key[0], rows, state, o)
        kept.update((json.dumps(asdict(state)),))
        yield out

    return frames.groupBy("session").applyInPandasWithState(one, SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)
