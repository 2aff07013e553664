"""The aperiodic background of a spectrum by three models, and the whole spectral feature table.

A background is a function from frequency to log10 of density: a line in log-log, two lines that meet at a bin, or
offset - log10(knee + f^exponent). All are fitted by Huber's reweighting (residuals beyond 1.345 x 1.4826 MAD count less)
over the bins of a range and its interpolated ends, without excluded ranges. What stands out of a background (prominence,
power above it, edges, peaks) is one set of functions for whichever model. A channel's bins, a few hundred numbers, are
gathered by one aggregate, and Arrow batches of channels go through numpy; nothing else is shuffled.

Undefined values are null: a fit of too few bins, a peak without neighbours, a width without a crossing on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS, NAN = 1e-20, float("nan")
HUBER, MAD = 1.345, 1.4826
MODELS = ("loglog", "two_slope", "knee")


class Spectrum:
    """Density at ascending frequencies, linear between them."""

    def __init__(self, freqs, power):
        f, p = np.asarray(freqs, float), np.asarray(power, float)
        ok = np.isfinite(f) & np.isfinite(p)
        self.f, self.p = f[ok], np.maximum(p[ok], 0.0)

    def at(self, f) -> np.ndarray:
        return np.interp(f, self.f, self.p)

    def span(self, lo: float, hi: float, positive: bool = False) -> tuple[float, float]:
        """A range within the spectrum's own; empty ranges have their ends the wrong way round."""
        if not len(self.f):
            return 1.0, 0.0
        return max(lo, self.f[0], 1e-9 if positive else -math.inf), min(hi, self.f[-1])

    def points(self, lo: float, hi: float, positive: bool = False) -> np.ndarray:
        """The ends of a range and the bins between."""
        lo, hi = self.span(lo, hi, positive)
        if not hi > lo:
            return np.zeros(0)
        return np.concatenate([[lo], self.f[(self.f > lo) & (self.f < hi)], [hi]])

    def peak(self, lo: float, hi: float) -> int:
        """The bin of the greatest density in a range, -1 if it has none."""
        inside = np.flatnonzero((self.f >= lo) & (self.f <= hi))
        return int(inside[self.p[inside].argmax()]) if len(inside) else -1


def areas(f: np.ndarray, v: np.ndarray) -> np.ndarray:
    return 0.5 * (v[1:] + v[:-1]) * np.diff(f)


def edge(f: np.ndarray, v: np.ndarray, share: float) -> float:
    """The frequency below which a share of the area under a piecewise line lies."""
    each = areas(f, v)
    sums = np.cumsum(each)
    if not len(each) or not sums[-1] > EPS:
        return NAN
    target = share * sums[-1]
    i = min(int(np.searchsorted(sums, target)), len(each) - 1)
    rest, width = target - (sums[i] - each[i]), f[i + 1] - f[i]
    slope = (v[i + 1] - v[i]) / width
    if abs(slope) < 1e-15:
        step = rest / max(v[i], EPS)
    else:  # of slope/2 x^2 + v x = rest the root with the sign of the area
        step = (math.sqrt(max(v[i] * v[i] + 2 * slope * rest, 0.0)) - v[i]) / slope
    return float(f[i] + min(max(step, 0.0), width))


def refined(x: np.ndarray, y: np.ndarray, i: int, lo: float, hi: float, flat: float) -> float:
    """The vertex of the parabola through a bin and its neighbours, or the bin."""
    bend = y[i - 1] - 2 * y[i] + y[i + 1]
    shift = 0.5 * (y[i - 1] - y[i + 1]) / bend if abs(bend) > flat else NAN
    if not abs(shift) <= 1:
        return float(x[i])
    return float(min(max(x[i] + shift * (x[i + 1] - x[i - 1]) / 2, lo), hi))


def width_at_half(s: Spectrum, at: float, lo: float, hi: float) -> float:
    """Between the crossings of half the density at a peak nearest to it on either side."""
    lo, hi = s.span(lo, hi)
    half = 0.5 * float(s.at(at))
    if not (lo <= at <= hi and half > 0):
        return NAN
    ends = []
    for side in (s.points(lo, at)[::-1], s.points(at, hi)):
        d = s.at(side) - half
        cross = np.flatnonzero((d[:-1] * d[1:] <= 0) & (d[:-1] != 0)) if len(side) > 1 else []
        if not len(cross):
            return NAN
        i = cross[0]
        ends.append(side[i] + d[i] / (d[i] - d[i + 1]) * (side[i + 1] - side[i]))
    return float(ends[1] - ends[0]) if ends[1] > ends[0] else NAN


@dataclass
class Background:
    """A fitted model; not `found` where there were too few bins."""

    kind: str
    parameters: dict[str, float] = field(default_factory=dict)
    free: int = 0
    n: int = 0
    r2: float = NAN
    rmse: float = NAN  # of the weighted residuals
    plain: float = NAN  # of the residuals

    @property
    def found(self) -> bool:
        return bool(self.parameters)

    def log10(self, f) -> np.ndarray:
        q, f = self.parameters, np.asarray(f, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.kind == "loglog":
                return q["intercept"] + q["slope"] * np.log10(f)
            if self.kind == "two_slope":
                d = np.log10(f) - math.log10(q["knee_hz"])
                return q["level"] + np.where(d <= 0, q["slope_low"], q["slope_high"]) * d
            return q["offset"] - np.log10(np.maximum(q["knee"] + f ** q["exponent"], EPS))

    def scores(self) -> tuple[float, float]:
        """AIC and BIC, up to a constant that all models share."""
        if not self.found or not np.isfinite(self.plain):
            return NAN, NAN
        fit = self.n * math.log(max(1e-24, max(1e-24, self.plain**2 * self.n) / self.n))
        return fit + 2 * self.free, fit + self.free * math.log(self.n)


def huber(r: np.ndarray) -> np.ndarray | None:
    """Weights of residuals; None where they are all alike."""
    scale = MAD * np.median(np.abs(r - np.median(r)))
    return np.minimum(1.0, HUBER * scale / np.maximum(np.abs(r), 1e-300)) if scale > 1e-12 else None


def solved(columns: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    root = np.sqrt(w)
    return np.linalg.lstsq(columns * root[:, None], y * root, rcond=None)[0]


def reweighted(columns: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and weights of a linear model after at most some rounds."""
    w = np.ones(len(y))
    c = solved(columns, y, w)
    for _ in range(rounds):
        new = huber(y - columns @ c)
        if new is None:
            break
        before, w = c, new
        c = solved(columns, y, w)
        if np.abs(c - before).max() < 1e-10:
            break
    return c, w


def judged(b: Background, y: np.ndarray, yhat: np.ndarray, w: np.ndarray) -> Background:
    e, mean = (y - yhat) ** 2, np.average(y, weights=w)
    sse, sst = float((w * e).sum()), float((w * (y - mean) ** 2).sum())
    b.r2 = min(1.0, max(-1.0, 1 - sse / sst)) if sst > 1e-24 else float(sse <= 1e-24)
    b.rmse, b.plain = math.sqrt(sse / w.sum()), math.sqrt(e.mean())
    return b


def fitted_points(s: Spectrum, lo: float, hi: float, excluded: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    f = s.points(lo, hi, positive=True)
    for a, b in excluded:
        f = f[(f < a) | (f > b)] if b > a else f
    return f, np.log10(np.maximum(s.at(f), EPS)) if len(f) else f


def line(s: Spectrum, lo: float, hi: float, excluded: list[tuple[float, float]] = (), rounds: int = 8) -> Background:
    f, y = fitted_points(s, lo, hi, excluded)
    out = Background("loglog", free=2, n=len(f))
    if len(f) < 2:
        return out
    columns = np.stack([np.ones(len(f)), np.log10(f)], 1)
    c, w = reweighted(columns, y, rounds)
    out.parameters = {"intercept": float(c[0]), "slope": float(c[1])}
    return judged(out, y, columns @ c, w)


def two_slopes(s: Spectrum, lo: float, hi: float, excluded: list[tuple[float, float]] = (), rounds: int = 8, least: int = 6) -> Background:
    """Lines that meet at the bin that leaves the least error, with at least `least` bins on a side (its own counted twice)."""
    f, y = fitted_points(s, lo, hi, excluded)
    least = max(least, 2)
    out = Background("two_slope", free=4, n=len(f))
    if len(f) < max(3, 2 * least - 1):
        return out
    x = np.log10(f)
    bent = lambda k: np.stack([np.ones(len(x)), np.minimum(x - x[k], 0), np.maximum(x - x[k], 0)], 1)
    places = np.arange(least - 1, len(x) - least + 1)
    errors = [((y - m @ solved(m, y, np.ones(len(y)))) ** 2).sum() for m in map(bent, places)]
    k = int(places[int(np.argmin(errors))])
    c, w = reweighted(bent(k), y, rounds)
    out.parameters = {"knee_hz": float(f[k]), "level": float(c[0]), "slope_low": float(c[1]), "slope_high": float(c[2])}
    return judged(out, y, bent(k) @ c, w)


def knee(s: Spectrum, lo: float, hi: float, excluded: list[tuple[float, float]] = (), rounds: int = 4) -> Background:
    """A grid of exponents and knee frequencies around the line's slope, then a finer one; of each pair the best offset is a mean."""
    f, y = fitted_points(s, lo, hi, excluded)
    out = Background("knee", n=len(f))
    if len(f) < 2:
        return out
    slope = line(s, lo, hi, excluded, 0).parameters["slope"]
    center = min(max(-slope, 0.05), 8.0) if slope < 0 else 2.0
    low, high = s.span(lo, hi, positive=True)

    def best(middle: float, reach: float, step: float, a: float, b: float, n: int, w: np.ndarray) -> tuple[float, float, float, float]:
        """(error, offset, exponent, knee frequency)"""
        exponents = np.arange(max(0.05, middle - reach), min(8.0, middle + reach) + 0.5 * step, step)
        knees = np.append(0.0, np.geomspace(max(a, 1e-6), max(b, max(a, 1e-6) * 1.000001), n))
        terms = np.log10(np.maximum(knees[None, :, None] ** exponents[:, None, None] + f ** exponents[:, None, None], EPS))
        offset = ((y + terms) * w).sum(-1) / w.sum()
        error = (w * (y + terms - offset[..., None]) ** 2).sum(-1)
        i, j = np.unravel_index(int(error.argmin()), error.shape)
        return float(error[i, j]), float(offset[i, j]), float(exponents[i]), float(knees[j])

    w, last = np.ones(len(f)), None
    for _ in range(max(1, rounds)):
        # The grids' steps and reaches.
        found = best(center, 1.5, 0.1, low, high, 28, w)
        a, b = (max(low, found[3] / 2), min(high, found[3] * 2)) if found[3] > 0 else (low, min(high, max(4 * low, low + 1e-6)))
        found = min(found, best(found[2], 0.5 if abs(found[2] - center) > 1.25 else 0.25, 0.02, *((a, b) if b > a else (low, high)), 32, w))
        offset, exponent, at = found[1:]
        yhat = offset - np.log10(np.maximum(at**exponent * (at > 0) + f**exponent, EPS))
        new = huber(y - yhat) if rounds else None
        if new is None:
            break
        w = new
        if last and abs(offset - last[0]) < 1e-6 and abs(exponent - last[1]) < 1e-3 and abs(at - last[2]) < 1e-3:
            break
        last = (offset, exponent, at)
    out.parameters = {"offset": offset, "exponent": exponent, "knee_hz": at, "knee": at**exponent if at > 0 else 0.0}
    out.free = 3 if at > 0 else 2
    return judged(out, y, yhat, w)


def prominence(s: Spectrum, b: Background, at: float) -> float:
    """Decibels of the density at a frequency above a background."""
    p = float(s.at(at)) if len(s.f) else 0.0
    return 10 * (math.log10(max(p, EPS)) - float(b.log10(at))) if b.found and at > 0 and p > 0 else NAN


def residual(s: Spectrum, b: Background, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    """What a range's density exceeds the background by, at its points."""
    f = s.points(lo, hi, positive=True)
    return f, np.maximum(s.at(f) - 10 ** b.log10(f), 0.0) if len(f) else f


def periodic_power(s: Spectrum, b: Background, lo: float, hi: float) -> float:
    return float(areas(*residual(s, b, lo, hi)).sum()) if b.found else NAN


def periodic_edge(s: Spectrum, b: Background, lo: float, hi: float, share: float) -> float:
    return edge(*residual(s, b, lo, hi), share) if b.found else NAN


def prominent_peak(s: Spectrum, b: Background, lo: float, hi: float) -> tuple[float, float, float] | None:
    """(frequency, refined, decibels) of the local maximum that stands out most, if one does."""
    lo, hi = s.span(lo, hi, positive=True)
    inside = (s.f >= lo) & (s.f <= hi)
    if not b.found or inside.sum() < 3:
        return None
    f = s.f[inside]
    d = 10 * (np.log10(np.maximum(s.p[inside], EPS)) - b.log10(f))
    top = np.flatnonzero((d[1:-1] >= d[:-2]) & (d[1:-1] >= d[2:])) + 1
    if not len(top):
        return None
    i = int(top[d[top].argmax()])
    return (float(f[i]), refined(f, d, i, lo, hi, 1e-12), float(d[i])) if d[i] > 1e-12 else None


@dataclass(frozen=True)
class Settings:
    """The range of the features, that of the fits, and what else the table has."""

    lo: float = 1.0
    hi: float = 40.0
    fit_lo: float | None = None
    fit_hi: float | None = None
    excluded: tuple[tuple[float, float], ...] = ()
    alpha: tuple[float, float] = (8.0, 12.0)
    edges: tuple[float, ...] = (0.95,)
    bands: tuple[tuple[str, float, float], ...] = ()
    ratios: tuple[tuple[str, str, str], ...] = ()  # name, band above, band below
    background: str = "loglog"  # a model, auto_aic or auto_bic
    two_slope: bool = True
    knee_model: bool = True
    least: int = 6
    rounds: tuple[int, int, int] = (8, 8, 4)  # of reweighting; 0: least squares


def share_name(x: float) -> str:
    return f"sef{round(100 * x)}_hz"


PEAK = ("hz", "hz_refined", "value_db", "fwhm_hz", "q", "prominence_db")


def columns(o: Settings) -> list[str]:
    """The table's columns in order; all are numbers but those of names in TEXTS."""
    out = "total_power entropy mean_hz bandwidth_hz skewness kurtosis_excess flatness peak_hz peak_hz_refined peak_value_db peak_fwhm_hz peak_q peak_prominence_db".split()
    out += [f"prominent_peak_{x}" for x in PEAK] + ["alpha_peak_hz", "alpha_peak_hz_refined", "alpha_peak_value_db", "alpha_fwhm_hz", "alpha_q", "alpha_prominence_db", "median_hz"]
    out += [share_name(e) for e in o.edges] + ["periodic_median_hz"] + [f"periodic_{share_name(e)}" for e in o.edges]
    out += "aperiodic_offset aperiodic_exponent aperiodic_r2 periodic_power periodic_rel aperiodic_rmse aperiodic_n_points aperiodic_slope aperiodic_offset_db aperiodic_aic aperiodic_bic".split()
    if o.two_slope:
        out += "aperiodic_knee_hz aperiodic_slope_low aperiodic_slope_high aperiodic_exponent_low aperiodic_exponent_high aperiodic_r2_two_slope aperiodic_rmse_two_slope aperiodic_aic_two_slope aperiodic_bic_two_slope".split()
    if o.knee_model:
        out += "aperiodic_offset_knee aperiodic_exponent_knee aperiodic_knee_param aperiodic_knee_freq_hz aperiodic_r2_knee aperiodic_rmse_knee aperiodic_n_points_knee aperiodic_aic_knee aperiodic_bic_knee".split()
    out += ["aperiodic_best_model_aic", "aperiodic_best_model_bic"]
    models = [m for m, on in zip(MODELS, (True, o.two_slope, o.knee_model), strict=True) if on]
    out += [f"aperiodic_{x}_{m}" for score in ("aic", "bic") for m in models for x in (f"delta_{score}", f"{score}_weight")] + ["aperiodic_background_used"]
    for name, _, _ in o.bands:
        out += [f"{name}_{x}" for x in ("power", "rel", "periodic_power", "periodic_rel", "periodic_frac")] + [f"{name}_prominent_peak_{x}" for x in PEAK]
    return out + [name for name, _, _ in o.ratios]


TEXTS = {"aperiodic_best_model_aic", "aperiodic_best_model_bic", "aperiodic_background_used"}


def moments(f: np.ndarray, v: np.ndarray) -> list[float]:
    """Integrals of f^k times a piecewise line, k from 0 to 4, by three Gauss points an interval (exact)."""
    half, mid = np.diff(f) / 2, (f[1:] + f[:-1]) / 2
    out = np.zeros(5)
    for t, w in ((-math.sqrt(0.6), 5 / 9), (0.0, 8 / 9), (math.sqrt(0.6), 5 / 9)):
        g, p = mid + half * t, (v[1:] + v[:-1]) / 2 + (v[1:] - v[:-1]) / 2 * t
        out += [(w * half * p * g**k).sum() for k in range(5)]
    return out.tolist()


def shape(s: Spectrum, lo: float, hi: float) -> dict[str, float]:
    """The features that no background enters."""
    f = s.points(lo, hi)
    if len(f) < 2:
        return {}
    v = s.at(f)
    m, width = moments(f, v), f[-1] - f[0]
    total = m[0]
    out = {"total_power": total, "entropy": 0.0, "flatness": 0.0}
    if total > EPS:
        a = areas(f, v)
        q = a[a > 0] / a[a > 0].sum()
        out["entropy"] = float(-(q * np.log(q)).sum() / math.log(len(q))) if len(q) > 1 else 0.0
        m1, m2, m3, m4 = (x / total for x in m[1:])
        var = m2 - m1 * m1
        out |= {"mean_hz": m1, "bandwidth_hz": math.sqrt(max(var, 0.0)), "skewness": 0.0, "kurtosis_excess": 0.0}
        if var > EPS:
            out["skewness"] = (m3 - 3 * m1 * m2 + 2 * m1**3) / var**1.5
            out["kurtosis_excess"] = (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1**4) / var**2 - 3
        logs = areas(f, np.log(np.maximum(v, EPS))).sum()
        out["flatness"] = min(1.0, math.exp(logs / width) / (total / width))
    return out


def peak_of(s: Spectrum, lo: float, hi: float, i: int) -> dict[str, float]:
    """The greatest bin of a range: place, vertex, level, width at half and their ratio."""
    at = float(s.f[i])
    a, b = s.span(lo, hi)
    y = np.log10(np.maximum(s.p, EPS))
    inside = 0 < i < len(s.f) - 1 and s.f[i - 1] >= a and s.f[i + 1] <= b
    width = width_at_half(s, at, lo, hi)
    return {"hz": at, "hz_refined": refined(s.f, y, i, a, b, 1e-18) if inside else at, "value_db": 10 * math.log10(max(s.p[i], EPS)) if s.p[i] > 0 else NAN, "fwhm_hz": width, "q": at / width if width > 1e-12 else NAN}


def outstanding(s: Spectrum, b: Background, lo: float, hi: float) -> dict[str, float]:
    """A range's prominent peak under the names of PEAK."""
    found = prominent_peak(s, b, lo, hi)
    if not found:
        return {}
    p, width = float(s.at(found[0])), width_at_half(s, found[0], lo, hi)
    return dict(zip(PEAK, (found[0], found[1], 10 * math.log10(max(p, EPS)) if p > 0 else NAN, width, found[0] / width if width > 1e-12 else NAN, found[2]), strict=True))


def compared(scores: dict[str, float]) -> tuple[str, dict[str, float], dict[str, float]]:
    """The model of the least score, and each one's distance from it and share of exp(-distance / 2)."""
    ok = {m: x for m, x in scores.items() if np.isfinite(x)}
    if not ok:
        return "na", {}, {}
    least = min(ok.values())
    delta = {m: x - least for m, x in ok.items()}
    total = sum(math.exp(-0.5 * d) for d in delta.values())
    return min(ok, key=lambda m: (ok[m], MODELS.index(m))), delta, {m: math.exp(-0.5 * delta[m]) / total if m in ok else 0.0 for m in scores}


def row(s: Spectrum, o: Settings) -> dict:
    """A channel's table row; columns that are left out are null."""
    out = shape(s, o.lo, o.hi)
    fit_lo, fit_hi = o.fit_lo if o.fit_lo is not None else o.lo, o.fit_hi if o.fit_hi is not None else o.hi
    fits = {"loglog": line(s, fit_lo, fit_hi, o.excluded, o.rounds[0])}
    if o.two_slope:
        fits["two_slope"] = two_slopes(s, fit_lo, fit_hi, o.excluded, o.rounds[1], o.least)
    if o.knee_model:
        fits["knee"] = knee(s, fit_lo, fit_hi, o.excluded, o.rounds[2])
    flat = fits["loglog"]
    scores = {m: b.scores() for m, b in fits.items()}
    out["aperiodic_n_points"] = flat.n
    if flat.found:
        q = flat.parameters
        out |= {"aperiodic_offset": q["intercept"], "aperiodic_offset_db": 10 * q["intercept"], "aperiodic_slope": q["slope"], "aperiodic_exponent": -q["slope"], "aperiodic_r2": flat.r2, "aperiodic_rmse": flat.rmse, "aperiodic_aic": scores["loglog"][0], "aperiodic_bic": scores["loglog"][1]}
    if o.two_slope and fits["two_slope"].found:
        b, q = fits["two_slope"], fits["two_slope"].parameters
        out |= {"aperiodic_knee_hz": q["knee_hz"], "aperiodic_slope_low": q["slope_low"], "aperiodic_slope_high": q["slope_high"], "aperiodic_exponent_low": -q["slope_low"], "aperiodic_exponent_high": -q["slope_high"], "aperiodic_r2_two_slope": b.r2, "aperiodic_rmse_two_slope": b.rmse}
        out |= dict(zip(("aperiodic_aic_two_slope", "aperiodic_bic_two_slope"), scores["two_slope"], strict=True))
    if o.knee_model:
        out["aperiodic_n_points_knee"] = fits["knee"].n
    if o.knee_model and fits["knee"].found:
        b, q = fits["knee"], fits["knee"].parameters
        out |= {"aperiodic_offset_knee": q["offset"], "aperiodic_exponent_knee": q["exponent"], "aperiodic_knee_param": q["knee"], "aperiodic_knee_freq_hz": q["knee_hz"], "aperiodic_r2_knee": b.r2, "aperiodic_rmse_knee": b.rmse}
        out |= dict(zip(("aperiodic_aic_knee", "aperiodic_bic_knee"), scores["knee"], strict=True))
    for k, score in enumerate(("aic", "bic")):
        best, delta, weight = compared({m: x[k] for m, x in scores.items()})
        out[f"aperiodic_best_model_{score}"] = best
        out |= {f"aperiodic_delta_{score}_{m}": x for m, x in delta.items()} | {f"aperiodic_{score}_weight_{m}": x for m, x in weight.items()}
    used = {"auto_aic": out["aperiodic_best_model_aic"], "auto_bic": out["aperiodic_best_model_bic"]}.get(o.background, o.background)
    used = used if used in fits and fits[used].found else "loglog"
    b = fits[used]
    out["aperiodic_background_used"] = used
    v = s.points(o.lo, o.hi)
    out["median_hz"] = edge(v, s.at(v), 0.5) if len(v) else NAN
    out["periodic_median_hz"] = periodic_edge(s, b, o.lo, o.hi, 0.5)
    for e in o.edges:
        out[share_name(e)], out[f"periodic_{share_name(e)}"] = edge(v, s.at(v), e) if len(v) else NAN, periodic_edge(s, b, o.lo, o.hi, e)
    out["periodic_power"] = above = periodic_power(s, b, o.lo, o.hi)
    own = s.points(o.lo, o.hi, positive=True)
    under = float(areas(own, s.at(own)).sum()) if len(own) else 0.0
    out["periodic_rel"] = above / under if under > EPS else 0.0 if b.found else NAN
    for prefix, (lo, hi), names in (("peak_", (o.lo, o.hi), {}), ("alpha_", (max(o.lo, o.alpha[0]), min(o.hi, o.alpha[1])), {"hz": "peak_hz", "hz_refined": "peak_hz_refined", "value_db": "peak_value_db"})):
        i = s.peak(lo, hi) if hi > lo else -1
        if i >= 0:
            out |= {prefix + names.get(x, x): y for x, y in peak_of(s, lo, hi, i).items()} | {f"{prefix}prominence_db": prominence(s, b, float(s.f[i]))}
    out |= {f"prominent_peak_{x}": y for x, y in outstanding(s, b, o.lo, o.hi).items()}
    total = out.get("total_power", NAN)
    for name, lo, hi in o.bands:
        lo, hi = max(lo, o.lo), min(hi, o.hi)
        v = s.points(lo, hi) if hi > lo else []
        if len(v):
            out[f"{name}_power"], out[f"{name}_periodic_power"] = p, q = float(areas(v, s.at(v)).sum()), periodic_power(s, b, lo, hi)
            if total > EPS:
                out[f"{name}_rel"], out[f"{name}_periodic_rel"] = p / total, q / total
            if above > EPS:
                out[f"{name}_periodic_frac"] = q / above
            out |= {f"{name}_prominent_peak_{x}": y for x, y in outstanding(s, b, lo, hi).items()}
    for name, top, low in o.ratios:
        a, c = out.get(f"{top}_power", NAN), out.get(f"{low}_power", NAN)
        out[name] = a / c if c > EPS else NAN
    return out


def table(psd: DataFrame, o: Settings = Settings(), by: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """A row of features for each channel of a spectrum (by, channel, k, freq, p)."""
    names = columns(o)
    types = {n: pa.string() if n in TEXTS else pa.float64() for n in names}

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for freqs, power in batches:
            rows = [row(Spectrum(f, p), o) for f, p in zip(freqs.to_pylist(), power.to_pylist(), strict=True)]
            clean = lambda v: None if v is None or isinstance(v, float) and not math.isfinite(v) else v
            yield pa.StructArray.from_arrays([pa.array([clean(r.get(n)) for r in rows], types[n]) for n in names], names=names)

    schema = ", ".join(f"`{n}` {'string' if n in TEXTS else 'double'}" for n in names)
    bins = F.array_sort(F.collect_list(F.struct("freq", "p")))  # a channel's bins: half a transform
    packed = psd.groupBy(*by, "channel").agg(bins.alias("b")).select(*by, "channel", F.col("b.freq").alias("f"), F.col("b.p").alias("p"))
    return packed.select(*by, "channel", F.arrow_udf(run, schema)("f", "p").alias("t")).select(*by, "channel", "t.*")
