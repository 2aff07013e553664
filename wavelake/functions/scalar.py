"""Scalar rules of the signal operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def micros(seconds: Column) -> Column:
    """Seconds as whole microseconds, half away from zero; 0 for what isn't finite."""
    return F.when(finite(seconds), F.round(seconds * 1e6).cast("long")).otherwise(0)


def iso_millis(text: Column) -> Column:
    """Milliseconds since 1970 in UTC of an ISO 8601 time, which is UTC if it names no offset; null where it is none."""
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(Z|z|[+-][0-9]{2}(:?[0-9]{2})?)$") & t.rlike("[Tt ]"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_millis(F.try_to_timestamp(zoned))


def samples(seconds: Column | float, fs: float):
    """Seconds as samples, half away from zero."""
    return F.round(seconds * fs).cast("long") if isinstance(seconds, Column) else int(abs(seconds * fs) + 0.5) * (1 if seconds >= 0 else -1)


def baseline(epoch: Column, base: Column, mode: str, eps: float = 1e-20) -> Column:
    """An epoch's power against its baseline's: ratio, rel, logratio or db; null where the baseline isn't positive."""
    ratio = epoch / base
    forms = {"ratio": ratio, "rel": (epoch - base) / base, "logratio": F.log10(F.greatest(ratio, F.lit(eps))), "db": 10 * F.log10(F.greatest(ratio, F.lit(eps)))}
    return F.when(finite(epoch) & finite(base) & (base > eps), forms[mode])


def clamp01(x: Column) -> Column:
    return F.when(finite(x), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def feedback(metric: Column, threshold: Column, span: float, above: bool = True) -> Column:
    """How far a metric is past its threshold, in parts of the span, from 0 to 1."""
    gap = metric - threshold if above else threshold - metric
    return clamp01(gap / (span if span > 0 else 1.0))


def robust_scale(mad: Column, sd: Column) -> Column:
    """1.4826 times the median deviation, else the sample deviation, else 1."""
    mad = 1.4826 * mad
    return F.when(mad > 1e-12, mad).when(sd > 1e-12, sd).otherwise(1.0)


def artifact_scale(mad: Column, sd: Column, median: Column) -> Column:
    """As robust_scale, with 5 % of the median's size before 1."""
    mad, rel = 1.4826 * mad, 0.05 * F.abs(median)
    return F.when(mad > 1e-12, mad).when(sd > 1e-12, sd).when(rel > 1e-12, rel).otherwise(1.0)


def phase(seconds: Column, rest: float, train: float) -> Column:
    """Rest or train, by a schedule that starts with training."""
    return F.when(F.pmod(seconds, F.lit(rest + train)) < train, "train").otherwise("rest")
