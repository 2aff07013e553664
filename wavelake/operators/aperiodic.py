"""A short form of the backgrounds of a spectrum given as two arrays: the fits and what stands out of the best one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import backgrounds as b

FEATURES = "intercept double, slope double, r2 double, rmse double, knee_hz double, slope_low double, slope_high double, knee double, exponent double, best string, periodic_power double, periodic_fraction double, peak_hz double, peak_db double"
NAMES = {"loglog": "line", "two_slope": "two slopes", "knee": "knee"}


def features(freqs: np.ndarray, p: np.ndarray, lo: float = 2.0, hi: float = 40.0) -> tuple:
    """One row of FEATURES; not-a-number where there are fewer than eight usable bins. The best model is that of the least BIC."""
    ok = (freqs >= lo) & (freqs <= hi) & (p > 0) & np.isfinite(p)
    if ok.sum() < 8:
        return (*[b.NAN] * 9, None, *[b.NAN] * 4)
    s = b.Spectrum(freqs[ok], p[ok])
    fits = {"loglog": b.line(s, lo, hi), "two_slope": b.two_slopes(s, lo, hi, least=4), "knee": b.knee(s, lo, hi)}
    best = b.compared({m: f.scores()[1] for m, f in fits.items()})[0]
    flat, two, bend = (f.parameters for f in fits.values())
    power = b.periodic_power(s, fits[best], lo, hi)
    peak = b.prominent_peak(s, fits[best], lo, hi) or (b.NAN, b.NAN, b.NAN)
    return (flat["intercept"], flat["slope"], fits["loglog"].r2, fits["loglog"].plain, two["knee_hz"], two["slope_low"], two["slope_high"], bend["knee"], bend["exponent"], NAMES[best], power, power / max(float(b.areas(s.f, s.p).sum()), 1e-300), peak[0], peak[2])


def of(freqs: Column, p: Column) -> Column:
    """struct of FEATURES from a spectrum's two arrays."""

    def run(fs: pd.Series, ps: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        return pd.DataFrame([features(np.asarray(f, float), np.asarray(q, float)) for f, q in zip(fs, ps, strict=True)], columns=names)

    return F.pandas_udf(run, FEATURES)(freqs, p)
