"""Kernels against closed forms."""

import numpy as np
import pytest

from vitalframe.kernels import detector, features, filters, peaks, pulses, quality, registry, spectrum

FS = 60.0
T = np.arange(0, 30, 1 / FS)
WAVE = np.sin(2 * np.pi * 1.2 * T) + 0.3 * np.sin(2 * np.pi * 2.4 * T + 0.7)


def response(sos, f, fs):
    z = np.exp(-2j * np.pi * np.atleast_1d(f) / fs)
    return np.abs(np.prod([np.polyval(s[:3][::-1], z) / np.polyval(s[3:][::-1], z) for s in sos], axis=0))


def test_butterworth_edges():
    band = filters.butter_sections(4, (0.5, 4.0), 500.0, "band")
    assert np.allclose(response(band, [0.5, 4.0], 500), np.sqrt(0.5)) and response(band, 20, 500)[0] < 1e-2
    low, high = filters.butter_sections(6, (20.0,), 500.0, "low"), filters.butter_sections(5, (0.5,), 500.0, "high")
    assert np.allclose(response(low, [0, 20], 500), [1, np.sqrt(0.5)]) and np.allclose(response(high, [0.5, 100], 500), [np.sqrt(0.5), 1], atol=1e-6)


def test_zero_phase_keeps_band_and_length():
    out = filters.bandpass(WAVE, FS)
    assert len(out) == len(WAVE) and np.abs(out[300:-300] - WAVE[300:-300]).max() < 0.05
    assert np.allclose(filters.lowpass(np.full(200, 3.0), FS, 5.0), 3.0)


def test_savgol_reproduces_cubics():
    x = np.arange(40.0) ** 3
    assert np.allclose(filters.savgol(x), x) and filters.savgol(np.arange(3.0)).tolist() == [0, 1, 2]


def test_zero_padded_median():
    x = np.random.default_rng(0).normal(size=50)
    p = np.concatenate([np.zeros(3), x, np.zeros(3)])
    assert np.allclose(filters.zero_padded_median(x, 7), [np.median(p[i : i + 7]) for i in range(50)])


def test_outlier_is_masked_and_interpolated():
    z = WAVE.copy()
    z[500] += 50
    fixed, mask = filters.remove_outliers(z, FS)
    assert mask[500] and abs(fixed[500] - WAVE[500]) < 0.05 and np.allclose(fixed[~mask], z[~mask])


def test_resampling():
    t = lambda fs: np.arange(int(fs)) / fs
    assert np.allclose(filters.resample_fourier(np.sin(2 * np.pi * 3 * t(60)), 60, 500), np.sin(2 * np.pi * 3 * t(500)))
    x = np.sort(np.random.default_rng(1).uniform(0, 10, 20))
    at = np.linspace(x[0], x[-1], 99)
    assert np.allclose(filters.cubic_spline(x, x**3 - x, at), at**3 - at)


def test_peaks():
    assert peaks.local_maxima(np.array([0, 1, 1, 1, 0, 2, 0.0])).tolist() == [2, 5]
    assert peaks.find_peaks(np.array([0, 3, 1, 5, 0, 1, 0.0]), distance=3).tolist() == [3]
    assert peaks.prominence(np.array([0, 3, 1, 5, 0.0]), np.array([1, 3])).tolist() == [2, 5]
    assert len(peaks.systolic_peaks(WAVE, FS)) == 36 and len(peaks.robust_peaks(WAVE, FS)) == 36
    assert all(a < p < b for a, p, b in peaks.beats(WAVE, FS))


def test_spectrum():
    f, p = spectrum.welch(WAVE, FS, 1200)
    assert abs(np.trapezoid(p, f) - WAVE.var()) < 0.02
    found = spectrum.spectral_features(WAVE, FS)
    assert abs(found["F_MAX_1st"] - 1.2) < 0.03 and abs(found["F_MAX_2nd"] - 2.4) < 0.05 and abs(found["harmonic_ratio"] - 0.09) < 0.01
    with pytest.raises(ValueError):
        spectrum.spectral_features(np.array([1.0, np.nan, 2.0]), FS)
    assert np.allclose(np.abs(spectrum.analytic(np.cos(2 * np.pi * 5 * np.arange(100) / 100))), 1)


def test_quality():
    noise = np.random.default_rng(0).normal(size=len(WAVE))
    assert quality.custom_quality(WAVE, FS)[900] > 0.9 > quality.custom_quality(noise, FS)[900]
    assert quality.template_quality(WAVE, FS)[900] > 0.99
    assert quality.pulses_to_samples(np.array([0, 3, 5]), np.array([1.0, 0.5]), 8, -0.15).tolist() == [1, 1, 1, 0.75, 0.5, 0.5, -0.15, -0.15]
    assert quality.peak_score(2, 8) == 0 and quality.peak_score(3, 60) == 0.2 and quality.sweep_quality(np.linspace(1, 2, 50)) == 1.0


def test_features():
    found = features.ppg_features(WAVE, FS)
    assert list(found) == features.ppg_names() and abs(found["ppg_p1_hr_mean"] - 72) < 0.5 and abs(found["ppg_h4_PRV_MeanNN"] - 833.3) < 2
    short = features.ppg_features(WAVE[:20], FS)
    assert list(short) == features.ppg_names() and np.isnan(short["ppg_i6_IMF_1_skewness"]) or len(short) == len(found)
    assert features.beat_metrics(np.array([0, 1, 2, 1, 0.0]), [(0, 2, 5)], 1.0)[0].tolist() == [2, 5, 2, 0.4, 4, 2, 1]
    assert all(r["on"] <= r["u"] <= r["sp"] < r["off"] for r in features.fiducial_points(WAVE, FS))
    tone = np.sin(2 * np.pi * 5 * np.arange(600) / FS)
    assert abs(features.mode_features(tone, FS)["dom_freq"] - 5) < 0.3 and abs(features.mode_features(tone, FS)["if_mean"] - 5) < 0.3


def test_registry(spark):
    waves = spark.createDataFrame([("a", WAVE.tolist()), ("b", [1.0, 2.0]), ("c", [])], "file_id string, samples array<double>")
    out = {r["file_id"]: r for r in registry.process(waves, "signal", "bandpass", FS).collect()}
    assert out["a"]["status"] == "ok" and np.allclose(out["a"]["samples"], filters.bandpass(WAVE, FS)) and set(out) == {"a", "b", "c"}
    table = {r["file_id"]: r for r in registry.ppg_table(waves, FS, key="file_id").collect()}
    assert table["a"]["ppg_s3_F_MAX_1st"] and table["b"]["ppg_s3_F_MAX_1st"] is None


def pulse_wave(seconds=12, fs=120.0, rate=1.2, noise=0.01, seed=0):
    """Pulses with a dicrotic second hump and a slow drift."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * fs)) / fs
    phase = (t * rate) % 1
    shape = np.exp(-(((phase - 0.25) / 0.09) ** 2)) + 0.4 * np.exp(-(((phase - 0.6) / 0.11) ** 2))
    return shape + 0.1 * np.sin(2 * np.pi * 0.1 * t) + noise * rng.normal(size=len(t))


def test_detector_finds_every_beat():
    x, fs = pulse_wave(30), 120.0
    peaks, onsets = detector.peaks_and_onsets(x, fs)
    want = (np.arange(36) + 0.25) / 1.2 * fs
    hit = [np.abs(peaks - w).min() < 0.08 * fs for w in want if 2 * fs < w < len(x) - 2 * fs]
    assert np.mean(hit) > 0.95 and len(peaks) <= 37 and (onsets < peaks).all() and (np.diff(onsets) > 0).all()
    assert abs(detector.heart_rate(x, fs) - 72) <= 4
    assert [len(v) for v in detector.peaks_and_onsets(x[:100], fs)] == [0, 0] and [len(v) for v in detector.peaks_and_onsets(np.zeros(2000), fs)][0] == 0


def test_interval_repairs():
    tops = np.array([10, 85, 160, 170, 235, 460])
    moved, missing = detector.corrected(np.array([11, 84, 161, 172, 234, 461]), tops, 60.0, 75.0)
    assert moved.tolist() == [10, 85, 160, 235, 460] and missing.tolist() == [False, False, False, True]


def test_fiducials_in_order():
    rows = features.fiducial_points(pulse_wave(20, 120.0), 120.0)
    assert len(rows) > 15
    full = [r for r in rows if all(r[k] is not None for k in ("dn", "dp", "a", "b", "e", "p1", "p2"))]
    assert len(full) > 0.6 * len(rows)
    for r in full:
        assert r["on"] <= r["a"] <= r["b"] <= r["e"] and r["on"] < r["sp"] < r["dn"] <= r["off"] and r["on"] < r["u"] <= r["sp"] <= r["v"] and r["b"] <= r["p1"]


def test_pulse_cleaning():
    x, fs = pulse_wave(12), 120.0
    y = pulses.prepared(x, fs)
    assert y.min() == 0 and y.max() == 1 and len(y) == len(x)
    level, line = pulses.without_baseline(y, fs)
    assert np.allclose(level + line, y) and abs(np.median([level[v] for v in pulses.lowest_between(level, pulses.high_peaks(level, fs))])) < 1e-6
    cut = pulses.cropped(level, fs)
    assert cut.min() == 0 and cut.max() == 1
    assert pulses.without_doubles(np.array([5, 9, 30])).tolist() == [5, 30] and pulses.without_doubles(np.zeros(0, int)).tolist() == []
    with pytest.raises(ValueError):
        pulses.cropped(np.zeros(500), fs)
    assert pulses.similarity(y[:50], y[:50]) > 1 and pulses.fitted(np.arange(3), 5).tolist() == [0, 1, 2, 2, 2]


def test_pulse_morphology_and_block():
    one = np.interp(np.linspace(0, 1, 200), np.linspace(0, 1, 100), pulse_wave(1, 100.0, 1.0, 0.0)[:100])
    m = pulses.morphology(one, 200.0)
    assert len(pulses.MORPHOLOGY) == 37 and set(m) == set(pulses.MORPHOLOGY)
    assert abs(m["peak_pos"] - 50) < 5 and m["DT"] > 0 and m["area_1"] > 0
    hump = pulses.morphology(np.exp(-(((np.arange(200) - 80) / 30.0) ** 2)), 200.0)
    assert hump["w75"] < hump["w50"] < hump["w25"] < hump["w10"] and abs(hump["w50"] - 2 * 30 * np.sqrt(np.log(2)) / 200) < 0.02
    found = features.pulse_features(pulse_wave(20, 100.0), 100.0)
    assert set(found) == set(features.GROUPS["u5"][1]) and sum(np.isfinite(v) for v in found.values()) > 60
    assert abs(found["m2_F_MAX_1st"] - 1.2) < 0.5
    for bad in (np.zeros(1200), np.ones(50), np.full(1200, np.nan)):
        with pytest.raises((ValueError, IndexError)):
            features.pulse_features(bad, 100.0)


def test_three_estimators_differ_and_rank_noise():
    rng = np.random.default_rng(3)
    clean, fs = pulse_wave(20, 60.0), 60.0
    noisy = clean + rng.normal(size=len(clean)) * 0.8
    good, bad = quality.all_estimates(clean, fs), quality.all_estimates(noisy, fs)
    assert all(v is not None for v in good.values())
    assert all(np.mean(good[k][200:-200]) > np.mean(bad[k][200:-200]) for k in good if bad[k] is not None)
    assert not np.allclose(good["template"], good["pulse"]) and not np.allclose(good["custom"], good["template"])
    assert np.allclose(quality.ensemble(clean, fs), (quality.custom_quality(clean, fs) + quality.template_quality(clean, fs) + quality.pulse_quality(clean, fs)) / 3)
    assert quality.whole_score(clean, fs) > quality.whole_score(rng.normal(size=1200), fs)


def test_lag_error():
    x = np.sin(np.arange(200) / 7)
    assert quality.lag_error(x, x) == 0 and quality.lag_error(x[10:], x[:-10]) < 1e-20 and np.isnan(quality.lag_error(x, np.zeros(0)))
    assert abs(quality.lag_error(x, x + 1) - 1) < 1e-12


def test_interval_shape_and_bands():
    rng = np.random.default_rng(0)
    nn = 800 + 40 * np.sin(2 * np.pi * 0.1 * np.cumsum(np.full(300, 0.8))) + rng.normal(size=300)
    s, p = features.shape_of_intervals(nn), features.rhythm_power(nn)
    assert s["SD2"] > s["SD1"] > 0 and p["LF"] > 20 * p["HF"] and abs(p["LFn"] + p["HFn"] + (p["VLF"] + p["VHF"]) / p["TP"] - 1) < 1e-9
    assert all(np.isnan(v) for v in features.shape_of_intervals(nn[:3]).values())


def test_sweeps(spark):
    f = np.logspace(2, 5, 60)
    rows = [("s", i, float(v), float(100 / (1 + v / 1e4) + (3.0 if i == 30 else 0.0)), -170.0 if i < 30 else 170.0) for i, v in enumerate(f)]
    df = spark.createDataFrame(rows, "file_id string, i int, f double, zmag double, zphi double")
    r = registry.smoothed_sweeps(registry.sweep_waves(df, "file_id"), "file_id").first()
    assert len(r["mag_filtered"]) == 60 and max(abs(np.diff(r["phase_filtered"]))) < 40 and 0 <= r["quality_indicator"] <= 1
    pair = spark.createDataFrame([("s", [1.0, 2.0, 1.0], [1.0, 2.0, 1.0])], "k string, a array<double>, b array<double>")
    assert registry.lag_errors(pair, "k", "a", "b").first()["error"] == 0.0
