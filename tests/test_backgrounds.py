"""Backgrounds of spectra: fits, what stands out, comparison, and the feature table against the column expressions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import backgrounds as b
from wavelake.operators import spectra

F10, F40 = np.arange(1.0, 11), np.arange(1.0, 41)


def background(kind, **q):
    return b.Background(kind, q, len(q), 0)


def test_line_of_a_power_law_and_what_stands_out():
    fit = b.line(b.Spectrum(F10, F10**-2.0), 1, 10)
    assert np.allclose([fit.parameters["slope"], fit.parameters["intercept"], fit.r2, fit.rmse, fit.plain], [-2, 0, 1, 0, 0], atol=1e-10)
    flat = b.line(b.Spectrum(np.arange(11.0), np.ones(11)), 0, 10)
    assert np.allclose([flat.parameters["slope"], flat.parameters["intercept"], flat.rmse], 0, atol=1e-12)
    s, plain = b.Spectrum(F10, np.where(F10 == 5, 100, 1) * F10**-2.0), b.Spectrum(F10, F10**-2.0)
    assert abs(b.prominence(plain, fit, 5)) < 1e-10 and abs(b.prominence(s, fit, 5) - 20) < 1e-8
    assert b.periodic_power(plain, fit, 1, 10) < 1e-12 and abs(b.periodic_power(s, fit, 1, 10) - 3.96) < 1e-8 and abs(b.periodic_power(s, fit, 4, 6) - 3.96) < 1e-8
    assert abs(b.periodic_edge(s, fit, 1, 10, 0.5) - 5) < 1e-9 and abs(b.periodic_edge(s, fit, 1, 10, 0.95) - (6 - math.sqrt(0.1))) < 1e-6
    assert math.isnan(b.edge(np.array([1.0, 2]), np.zeros(2), 0.5))
    assert np.allclose(b.prominent_peak(s, fit, 1, 10), (5, 5, 20)) and np.allclose(b.prominent_peak(s, fit, 4, 6), (5, 5, 20))
    assert b.prominent_peak(plain, background("loglog", slope=-2.0, intercept=1.0), 1, 10) is None and b.prominent_peak(s, fit, 6, 10) is None


def test_excluded_ranges_and_reweighting():
    bump = np.where((F40 >= 8) & (F40 <= 12), 1e6, 1) / F40
    base, off = (b.line(b.Spectrum(F40, p), 1, 40, rounds=0).parameters["slope"] for p in (1 / F40, bump))
    kept = b.line(b.Spectrum(F40, bump), 1, 40, [(8, 12)], 0)
    assert abs(base + 1) < 1e-12 and abs(off - base) > 0.05 and abs(kept.parameters["slope"] - base) < 1e-9 and kept.n == 35
    rng = np.random.default_rng(1)
    noisy = 10 ** (0.02 * rng.normal(size=40)) / F40 * np.where(F40 == 10, 50, 1)
    plain, robust = (abs(b.line(b.Spectrum(F40, noisy), 1, 40, rounds=r).parameters["slope"] + 1) for r in (0, 8))
    assert robust < plain / 3


def test_two_slopes_and_knee():
    s = b.Spectrum(F40, np.where(F40 <= 10, 1 / F40, 10 / F40**2))
    fit = b.two_slopes(s, 1, 40, rounds=0, least=5)
    assert np.allclose([fit.parameters[k] for k in ("knee_hz", "slope_low", "slope_high")], [10, -1, -2], atol=1e-6) and fit.plain < 1e-10
    assert not b.two_slopes(b.Spectrum(F10[:8], F10[:8]), 1, 8).found
    k = b.knee(b.Spectrum(F40, 10 / (25 + F40**2)), 1, 40, rounds=0)
    assert abs(k.parameters["offset"] - 1) < 0.05 and abs(k.parameters["exponent"] - 2) < 0.08 and abs(k.parameters["knee_hz"] - 5) < 0.4 and k.r2 > 0.999 and k.plain < 2e-3
    assert k.free == 3 and b.knee(b.Spectrum(F40, F40**-1.5), 1, 40).parameters["knee_hz"] < 1.01
    two = background("two_slope", knee_hz=10.0, level=-1.0, slope_low=-1.0, slope_high=-2.0)
    assert np.allclose(two.log10([5.0, 20.0]), [-math.log10(5), 1 - 2 * math.log10(20)])


@pytest.mark.parametrize("flat", [background("loglog", slope=0.0, intercept=0.0), background("two_slope", knee_hz=3.0, level=0.0, slope_low=0.0, slope_high=0.0), background("knee", offset=0.0, exponent=0.0, knee=0.0, knee_hz=0.0)])
def test_one_set_of_measures_for_all_backgrounds(flat):
    s = b.Spectrum([1, 2, 3, 4], [1, 2, 2, 1])
    assert abs(b.periodic_power(s, flat, 1, 4) - 2) < 1e-12 and abs(b.periodic_edge(s, flat, 1, 4, 0.5) - 2.5) < 1e-12
    assert abs(b.prominence(s, flat, 2) - 10 * math.log10(2)) < 1e-12 and abs(float(flat.log10(10.0))) < 1e-12
    assert abs(b.periodic_power(s, flat, 1, 4) / b.areas(s.f, s.p).sum() - 0.4) < 1e-12


def test_shapes_peaks_and_widths():
    f = np.arange(11.0)
    flat, ramp = b.shape(b.Spectrum(f, np.ones(11)), 0, 10), b.shape(b.Spectrum(f, f), 0, 10)
    want = {"total_power": 10, "entropy": 1, "bandwidth_hz": math.sqrt(100 / 12), "flatness": 1, "skewness": 0, "kurtosis_excess": -1.2, "mean_hz": 5}
    assert all(abs(flat[k] - v) < 1e-9 for k, v in want.items())
    assert abs(ramp["total_power"] - 50) < 1e-9 and abs(ramp["kurtosis_excess"] + 0.6) < 1e-9 and 0 < ramp["flatness"] < 1
    assert abs(b.edge(f, np.ones(11), 0.95) - 9.5) < 1e-12 and abs(b.edge(f, f, 0.5) - 10 / math.sqrt(2)) < 1e-9
    quad = b.Spectrum(f, 10 ** -((f - 5.3) ** 2))
    peak = b.peak_of(quad, 0, 10, quad.peak(0, 10))
    assert peak["hz"] == 5 and abs(peak["hz_refined"] - 5.3) < 1e-9 and abs(peak["value_db"] + 0.9) < 1e-9
    tri = b.Spectrum(np.arange(5.0), [0, 1, 2, 1, 0])
    assert b.width_at_half(tri, 2, 0, 4) == 2 and math.isnan(b.width_at_half(tri, 2, 1.5, 4))


def test_comparison():
    best, delta, weight = b.compared({"loglog": 10.0, "two_slope": 8.0, "knee": b.NAN})
    assert best == "two_slope" and delta == {"loglog": 2.0, "two_slope": 0.0} and weight["knee"] == 0 and abs(weight["loglog"] - math.exp(-1) / (1 + math.exp(-1))) < 1e-12
    assert b.compared({"loglog": 1.0, "knee": 1.0})[0] == "loglog" and b.compared({"loglog": b.NAN}) == ("na", {}, {})


def psd_of(spark, channels):
    rows = [(r, c, k, float(f), float(p)) for r, c, fs, ps in channels for k, (f, p) in enumerate(zip(fs, ps, strict=True))]
    return spark.createDataFrame(rows, "recording string, channel string, k long, freq double, p double")


def test_table_agrees_with_column_expressions(spark):
    rng = np.random.default_rng(3)
    f = np.arange(0, 60, 0.5)
    channels = [("r", f"c{i}", f, rng.gamma(2, size=len(f)) / (1 + f) + (i == 1) * np.exp(-((f - 10) ** 2))) for i in range(4)]
    psd = psd_of(spark, channels)
    o = b.Settings(1.3, 40.2, bands=(("alpha", 8.0, 12.0), ("wide", 0.0, 90.0)), ratios=(("aw", "alpha", "wide"),), background="auto_bic")
    got = {r["channel"]: r for r in b.table(psd, o, ("recording",)).collect()}
    names = {"total_power": "total_power", "entropy": "entropy", "mean_freq": "mean_hz", "bandwidth": "bandwidth_hz", "skewness": "skewness", "kurtosis": "kurtosis_excess", "flatness": "flatness", "edge_freq": "sef95_hz", "peak_freq": "peak_hz", "peak_refined": "peak_hz_refined", "peak_db": "peak_value_db", "fwhm": "peak_fwhm_hz"}
    for r in spectra.features(psd.drop("recording"), 1.3, 40.2).collect():
        for old, new in names.items():
            x, y = r[old], got[r["channel"]][new]
            assert (x is None and y is None) or abs(x - y) < 1e-9 * max(1, abs(x)), (old, x, y)
    for r in got.values():
        assert abs(r["wide_power"] - r["total_power"]) < 1e-9 and abs(r["aw"] - r["alpha_power"] / r["wide_power"]) < 1e-12 and r["aperiodic_background_used"] == r["aperiodic_best_model_bic"]
        assert abs(sum(r[f"aperiodic_aic_weight_{m}"] for m in b.MODELS) - 1) < 1e-9 and r["alpha_periodic_frac"] <= 1
    assert len(b.columns(o)) == len(set(b.columns(o))) > 80


def test_table_of_odd_spectra(spark):
    channels = [("r", "none", [5.0], [1.0]), ("r", "zero", F40, np.zeros(40)), ("r", "bad", F40, [math.nan] * 40), ("q", "few", F40[:4], F40[:4]), ("q", "fine", F40, 1 / F40)]
    got = {r["channel"]: r for r in b.table(psd_of(spark, channels), by=("recording",)).collect()}
    assert got["none"]["total_power"] is None and got["bad"]["aperiodic_slope"] is None and got["zero"]["total_power"] == 0 and got["zero"]["peak_value_db"] is None
    assert got["few"]["aperiodic_knee_hz"] is None and got["few"]["aperiodic_background_used"] == "loglog" and got["bad"]["aperiodic_best_model_aic"] == "na"
    assert abs(got["fine"]["aperiodic_exponent"] - 1) < 1e-9
    assert b.table(psd_of(spark, channels).where(F.lit(False))).count() == 0
