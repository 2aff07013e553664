"""Numerical kernels over packed channels (recording, channel, fs, x array), run by Spark one recording or channel at a time.

Filters are recurrences and phase measures need transforms of whole channels, which column expressions can't say; each
task holds one channel, or one recording for pair measures.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(rec: DataFrame, by: list[str]) -> DataFrame:
    """(by, x) from long samples (by, n, v): a channel's samples in order."""
    return rec.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda s: s["v"]).alias("x"))


def welch(x: np.ndarray, fs: float, nperseg: int, overlap: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(freqs, psd): symmetric Hann, mean removed from each segment, padded to a power of two."""
    nperseg = int(min(max(8, nperseg), len(x)))
    hop = max(1, nperseg - int(nperseg * overlap))
    nfft = 1 << (nperseg - 1).bit_length()
    w = np.hanning(nperseg) if nperseg > 1 else np.ones(1)
    seg = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), nperseg)[::hop]
    spec = np.abs(np.fft.rfft((seg - seg.mean(1, keepdims=True)) * w, nfft)) ** 2
    p = spec.mean(0) / (fs * (w * w).sum())
    p[1:-1] *= 2
    return np.arange(len(p)) * fs / nfft, p


def welch_rows(x: np.ndarray, fs: float, nperseg: int, overlap: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """As welch, of rows of one length at once."""
    nperseg = int(min(max(8, nperseg), x.shape[1]))
    hop = max(1, nperseg - int(nperseg * overlap))
    nfft = 1 << (nperseg - 1).bit_length()
    w = np.hanning(nperseg) if nperseg > 1 else np.ones(1)
    seg = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), nperseg, 1)[:, ::hop]
    p = (np.abs(np.fft.rfft((seg - seg.mean(2, keepdims=True)) * w, nfft)) ** 2).mean(1) / (fs * (w * w).sum())
    p[:, 1:-1] *= 2
    return np.arange(p.shape[1]) * fs / nfft, p


def biquad(kind: str, fs: float, f0: float, q: float) -> np.ndarray:
    """b0 b1 b2 a1 a2 of a lowpass, highpass or notch section (the audio cookbook's bilinear forms)."""
    w = 2 * np.pi * f0 / fs
    alpha, c = np.sin(w) / (2 * q), np.cos(w)
    b = {"lowpass": [(1 - c) / 2, 1 - c, (1 - c) / 2], "highpass": [(1 + c) / 2, -(1 + c), (1 + c) / 2], "notch": [1, -2 * c, 1]}[kind]
    return np.array([*b, -2 * c, 1 - alpha]) / (1 + alpha)


def sections(x: np.ndarray, stages: list[np.ndarray], delays: np.ndarray | None = None) -> np.ndarray:
    """Rows of x through second-order sections in turn, single precision between them. delays (stage, 2, row) are the sections' memory, changed in place; from rest without."""
    out = np.atleast_2d(np.asarray(x, np.float32))
    for i, (b0, b1, b2, a1, a2) in enumerate(stages):
        s1, s2 = delays[i].copy() if delays is not None else np.zeros((2, len(out)))
        y = np.empty_like(out)
        for t in range(out.shape[1]):
            v = out[:, t].astype(float)
            r = b0 * v + s1
            s1, s2 = b1 * v - a1 * r + s2, b2 * v - a2 * r
            y[:, t] = r
        out = y
        if delays is not None:
            delays[i] = s1, s2
    return out.reshape(np.shape(x))


def zero_phase(x: np.ndarray, stages: list[np.ndarray]) -> np.ndarray:
    """Forward and backward over an odd reflection of up to six samples a stage."""
    x = np.asarray(x, np.float32)
    pad = min(6 * len(stages), len(x) - 1)
    if pad < 1 or not stages:
        return sections(x, stages)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return sections(sections(wide, stages)[::-1], stages)[::-1][pad : pad + len(x)].copy()


def zero_phase_rows(x: np.ndarray, stages: list[np.ndarray]) -> np.ndarray:
    """zero_phase for rows of one length."""
    x = np.asarray(x, np.float32)
    pad = min(6 * len(stages), x.shape[1] - 1)
    if pad < 1 or not stages:
        return sections(x, stages)
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], 1)
    return sections(sections(wide, stages)[:, ::-1], stages)[:, ::-1][:, pad : pad + x.shape[1]]


def covered(freqs: np.ndarray, lo: float, hi: float) -> float:
    return max(0.0, min(hi, float(freqs[-1])) - max(lo, float(freqs[0])))


def area(freqs: np.ndarray, values: np.ndarray, lo: float, hi: float) -> float:
    """The area under a curve from lo to hi, linear between points, within the points."""
    lo, hi = max(lo, float(freqs[0])), min(hi, float(freqs[-1]))
    if hi <= lo:
        return 0.0
    inside = (freqs > lo) & (freqs < hi)
    f = np.concatenate([[lo], freqs[inside], [hi]])
    v = np.concatenate([[np.interp(lo, freqs, values)], values[inside], [np.interp(hi, freqs, values)]])
    return float((0.5 * (v[1:] + v[:-1]) * np.diff(f)).sum())


def coherence(x: np.ndarray, y: np.ndarray, fs: float, nperseg: int, overlap: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(freqs, magnitude-squared coherence, size of the imaginary coherency), both from 0 to 1, 0 where there is no power."""
    nperseg = int(min(max(8, nperseg), len(x)))
    hop, nfft, w = max(1, nperseg - int(nperseg * overlap)), 1 << (nperseg - 1).bit_length(), np.hanning(nperseg)
    a, b = (np.fft.rfft((s - s.mean(1, keepdims=True)) * w, nfft) for s in (np.lib.stride_tricks.sliding_window_view(v, nperseg)[::hop] for v in (x, y)))
    cross, den = (a * np.conj(b)).mean(0), (np.abs(a) ** 2).mean(0) * (np.abs(b) ** 2).mean(0)
    ok = den > 1e-24
    safe = np.where(ok, den, 1.0)
    return np.arange(len(den)) * fs / nfft, np.where(ok, np.clip(np.abs(cross) ** 2 / safe, 0, 1), 0.0), np.where(ok, np.clip(np.abs(cross.imag) / np.sqrt(safe), 0, 1), 0.0)


def bandpass(x: np.ndarray, fs: float, lo: float, hi: float) -> np.ndarray:
    """Of a signal, or of rows of one length."""
    stages = ([biquad("highpass", fs, lo, np.sqrt(0.5))] if lo > 0 else []) + ([biquad("lowpass", fs, hi, np.sqrt(0.5))] if 0 < hi < fs / 2 else [])
    return (zero_phase_rows if np.ndim(x) == 2 else zero_phase)(x, stages)


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal, padded to a power of two and cut back; of a signal, or of rows of one length."""
    size = np.shape(x)[-1]
    n = 1 << max(0, size - 1).bit_length()
    f = np.fft.fft(x, n)
    f[..., 1 : n // 2] *= 2
    f[..., n // 2 + 1 :] = 0
    return np.fft.ifft(f)[..., :size]


def trimmed(n: int, part: float) -> slice:
    cut = min(int(part * n + 0.5), max(0, (n - 1) // 2))
    return slice(cut, n - cut)


def phase_measures(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """PLV, PLI, wPLI and debiased squared wPLI of two analytic signals."""
    ok = np.isfinite(a) & np.isfinite(b)
    cross = a[ok] * np.conj(b[ok])
    if not len(cross):
        return dict.fromkeys(("plv", "pli", "wpli", "wpli2"), float("nan"))
    im = cross.imag
    unit = cross[np.abs(cross) > 0] / np.abs(cross[np.abs(cross) > 0])
    size, square = np.abs(im).sum(), (im * im).sum()
    den = size * size - square
    return {
        "plv": float(min(1.0, np.abs(unit.mean()))) if len(unit) else 0.0,
        "pli": float(np.abs(np.sign(im).mean())),
        "wpli": float(np.abs(im.sum()) / size) if size > 1e-20 else 0.0,
        "wpli2": float(np.clip((im.sum() ** 2 - square) / den, 0, 1)) if den > 1e-20 else 0.0,
    }


def phase_pairs(packed: DataFrame, fs: float, lo: float, hi: float, trim: float = 0.1) -> DataFrame:
    """(recording, channel_a, channel_b, plv, pli, wpli, wpli2): each channel is filtered once, a recording's pairs in one task."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("channel")
        n = min(map(len, pdf["x"]))
        signals = [analytic(bandpass(np.asarray(x)[:n], fs, lo, hi))[trimmed(n, trim)] for x in pdf["x"]]
        names = list(pdf["channel"])
        rows = [(key[0], names[i], names[j], *phase_measures(signals[i], signals[j]).values()) for i in range(len(names)) for j in range(i + 1, len(names))]
        return pd.DataFrame(rows, columns=["recording", "channel_a", "channel_b", "plv", "pli", "wpli", "wpli2"])

    return packed.groupBy("recording").applyInPandas(run, "recording string, channel_a string, channel_b string, plv double, pli double, wpli double, wpli2 double")


def pac(x: np.ndarray, fs: float, phase: tuple[float, float], amplitude: tuple[float, float], bins: int = 18, trim: float = 0.1) -> dict:
    """Modulation index, mean vector length and amplitude by phase bin."""
    mi, mvl, p = pac_rows(np.asarray(x, float)[None], fs, phase, amplitude, bins, trim)
    return {"mi": float(mi[0]), "mvl": float(mvl[0]), "bins": p[0]}


def pac_rows(x: np.ndarray, fs: float, phase: tuple[float, float], amplitude: tuple[float, float], bins: int = 18, trim: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As pac, of rows of one length at once: (index, length, amplitude by phase bin), NaN for rows that aren't finite."""
    cut = trimmed(x.shape[1], trim)
    angle = np.angle(analytic(bandpass(x, fs, *phase))[:, cut])
    amp = np.abs(analytic(bandpass(x, fs, *amplitude))[:, cut])
    ok = np.isfinite(angle).all(1) & np.isfinite(amp).all(1)
    angle, amp = angle[ok], amp[ok]
    at = np.minimum(((angle + np.pi) / (2 * np.pi) * bins).astype(int), bins - 1) + bins * np.arange(len(angle))[:, None]
    n = np.bincount(at.ravel(), minlength=bins * len(angle)).reshape(-1, bins)
    mean = np.bincount(at.ravel(), amp.ravel(), bins * len(angle)).reshape(-1, bins) / np.maximum(n, 1)
    whole = mean.sum(1, keepdims=True)
    p = np.where(whole > 0, mean / np.where(whole > 0, whole, 1.0), 1 / bins)
    h = -(p * np.log(np.where(p > 0, p, 1.0))).sum(1)
    total = amp.sum(1)
    mi, mvl, shares = np.full(len(x), np.nan), np.full(len(x), np.nan), np.full((len(x), bins), np.nan)
    mi[ok], shares[ok] = (np.log(bins) - h) / np.log(bins), p
    mvl[ok] = np.where(total > 1e-12, np.abs((amp * np.exp(1j * angle)).sum(1)) / np.where(total > 1e-12, total, 1.0), 0.0)
    return mi, mvl, shares


def pac_of(x: Column, fs: float, phase: tuple[float, float], amplitude: tuple[float, float]) -> Column:
    """struct(mi, mvl, bins) of packed channels."""

    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pac(np.asarray(v, float), fs, phase, amplitude) for v in batch], columns=["mi", "mvl", "bins"])

    return F.pandas_udf(run, "mi double, mvl double, bins array<double>")(x)


def peak_frequency(freqs: np.ndarray, p: np.ndarray, lo: float = 7.0, hi: float = 13.0, least_db: float = 0.5) -> tuple[float, float, bool]:
    """(peak, centre of gravity, found): the alpha peak over a 1/f trend fitted outside the range."""
    ok = (freqs >= 2) & (freqs <= 40) & (p > 0)
    out = ok & ((freqs < lo) | (freqs > hi))
    x, y = np.log10(freqs[ok]), 10 * np.log10(p[ok])
    if out.sum() >= 3:
        slope, base = np.polyfit(np.log10(freqs[out]), 10 * np.log10(p[out]), 1)
        y = y - (slope * x + base)
    f = freqs[ok]
    band = np.flatnonzero((f >= lo) & (f <= hi))
    if len(band) < 3:
        return float("nan"), float("nan"), False
    floor = np.median(y[band])
    gain = np.maximum(y[band] - floor, 0)
    cog = float((f[band] * gain).sum() / gain.sum()) if gain.sum() > 0 else float("nan")
    i = band[y[band].argmax()]
    if y[i] - floor < least_db or not 0 < i < len(f) - 1 or y[i] < y[i - 1] or y[i] < y[i + 1]:
        return float("nan"), cog, False
    den = y[i - 1] - 2 * y[i] + y[i + 1]
    shift = 0.5 * (y[i - 1] - y[i + 1]) / den if den else 0.0
    return float(f[i] + shift * (f[1] - f[0])), cog, True


def microstates(maps: np.ndarray, k: int, rounds: int = 100, seed: int = 1) -> np.ndarray:
    """k unit maps by polarity-invariant k-means of average-referenced maps (rows)."""
    x = maps - maps.mean(1, keepdims=True)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    x = x[size[:, 0] > 0] / size[size[:, 0] > 0]
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    while len(c) < k:
        d = np.maximum(1 - np.abs(x @ np.array(c).T).max(1), 0)
        c.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
    c = np.array(c)
    for _ in range(rounds):
        near = np.abs(x @ c.T).argmax(1)
        new = c.copy()
        for j in range(k):
            own = x[near == j]
            if len(own):
                new[j] = np.linalg.eigh(own.T @ own)[1][:, -1]
        if np.allclose(np.abs((new * c).sum(1)), 1, atol=1e-10):
            break
        c = new
    return c


def spline_weights(good: np.ndarray, bad: np.ndarray, terms: int = 50, order: int = 4, ridge: float = 1e-5) -> np.ndarray:
    """Weights of good channels for each bad one, by spherical splines; rows of unit vectors."""

    def g(cos: np.ndarray) -> np.ndarray:
        out, p0, p1 = np.zeros_like(cos), np.ones_like(cos), cos
        for n in range(1, terms + 1):
            out += (2 * n + 1) / (n * (n + 1)) ** order * p1
            p0, p1 = p1, ((2 * n + 1) * cos * p1 - n * p0) / (n + 1)
        return out / (4 * np.pi)

    n = len(good)
    a = np.ones((n + 1, n + 1))
    a[:n, :n] = g(np.clip(good @ good.T, -1, 1)) + ridge * np.eye(n)
    a[n, n] = 0
    right = np.hstack([g(np.clip(bad @ good.T, -1, 1)), np.ones((len(bad), 1))])
    return np.linalg.solve(a.T, right.T).T[:, :n]
