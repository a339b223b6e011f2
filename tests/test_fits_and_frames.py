"""Frames by blocks, fits, forecasters and noise measures against numpy."""

import numpy as np
import pytest

from tidegauge.operators import core, detect, features, smoothing

SERIES = "point string, pos long, value double"


def table(spark, series, first=0):
    rows = [(p, first + i, None if v is None or np.isnan(v) else float(v)) for p, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, SERIES).repartition(4)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    a = rng.normal(5, 2, 700).cumsum() / 50 + 100
    b = rng.normal(0, 1, 333)
    a[rng.choice(700, 60, False)] = np.nan
    b[100:160] = np.nan
    return {"a": a, "b": b, "one": np.array([3.0]), "none": np.full(40, np.nan)}


@pytest.fixture(params=[17, 65_536])
def block(request, monkeypatch):
    monkeypatch.setattr(core, "BLOCK", request.param)
    return request.param


def mean(x):
    x = x[~np.isnan(x)]
    return x.mean() if len(x) else np.nan


def test_drifts_skip_nulls_in_any_block(spark, series, block):
    got = {(r.point, r.pos): (r.drift_0, r.drift_1) for r in features.drifts(table(spark, series), ((20, 3), (50, 10))).collect()}
    for p, y in series.items():
        for i in range(len(y)):
            for k, (left, right) in enumerate(((20, 3), (50, 10))):
                want = abs(mean(y[i : i + right]) - mean(y[i - left : i])) if i >= left and i + right <= len(y) else 0.0
                assert got[p, i][k] == pytest.approx(0.0 if np.isnan(want) else want, abs=1e-9)


def test_centred_rolling_in_any_block(spark, series, block):
    got = {(r.point, r.pos): (r.roll_mean, r.roll_std) for r in features.centred_rolling(table(spark, series), 30).collect()}
    for p, y in series.items():
        m, s = np.full(len(y), np.nan), np.full(len(y), np.nan)
        for i in range(15, len(y) - 14):
            x = y[i - 15 : i + 15]
            x = x[~np.isnan(x)]
            m[i] = x.mean() if len(x) else np.nan
            s[i] = x.std(ddof=1) if len(x) > 1 else np.nan
        for k, w in enumerate((m, s)):
            known = np.flatnonzero(~np.isnan(w))
            for i in range(len(y)):
                ahead = known[known >= i]
                at = ahead[0] if len(ahead) else known[-1] if len(known) else None
                assert got[p, i][k] == (None if at is None else pytest.approx(w[at], abs=1e-8))


def test_moving_average_of_known_values(spark):
    got = [r.smooth for r in features.moving_average(table(spark, {"a": [1.0, np.nan, 4.0, 5.0, np.nan, 9.0, 9.0]}), 5).orderBy("pos").collect()]
    assert got == [None, None, pytest.approx(10 / 3), pytest.approx(6.0), pytest.approx(27 / 4), None, None]


def local_fits(y, width, order):
    n = len(y)
    w = min(width, n if n % 2 else n - 1)
    m, t = w // 2, np.arange(w) - w // 2
    out = []
    for i in range(n):
        c = min(max(i, m), n - 1 - m)
        out.append(np.polyval(np.polyfit(t, y[c - m : c + m + 1], min(order, w - 1)), i - c))
    return np.array(out)


@pytest.mark.parametrize("width, order", [(601, 3), (61, 1), (61, 3), (5, 2), (1, 0)])
@pytest.mark.filterwarnings("ignore")
def test_smoothing_equals_local_fits_anywhere(spark, width, order):
    rng = np.random.default_rng(1)
    series = {"long": rng.normal(0, 1, 1500).cumsum() + 50, "even": rng.normal(0, 1, 600), "few": rng.normal(0, 1, 4), "two": np.array([3.0, 5.0]), "one": np.array([7.0])}
    for first in (0, 10**8):
        got = {(r.point, r.pos): r.smooth for r in smoothing.smooth(table(spark, series, first), width, order).collect()}
        for p, y in series.items():
            assert np.allclose([got[p, first + i] for i in range(len(y))], local_fits(y, width, order), atol=1e-7), p


def test_smoothing_leaves_unknown_frames_out(spark):
    y = np.arange(30.0)
    y[12] = np.nan
    got = [r.smooth for r in smoothing.smooth(table(spark, {"a": y}), 5, 3).orderBy("pos").collect()]
    assert [v is None for v in got] == [10 <= i <= 14 for i in range(30)]
    with pytest.raises(ValueError):
        smoothing.smooth(table(spark, {"a": y}), 4, 1)


@pytest.mark.filterwarnings("ignore")
def test_piecewise_fit_equals_numpy(spark):
    rng = np.random.default_rng(2)
    series = {"long": rng.normal(0, 1, 900).cumsum(), "short": rng.normal(0, 1, 9), "bad": np.where(np.arange(200) % 50 == 7, np.nan, rng.normal(0, 1, 200)), "one": np.array([4.0])}
    got = {(r.point, r.pos): (r.fitted, r.residual) for r in smoothing.piecewise_residual(table(spark, series)).collect()}
    for p, y in series.items():
        y = np.nan_to_num(y)
        n, t = len(y), max(1, int(0.1 * len(y)))
        x = 2 * np.arange(n) / max(n - 1, 1) - 1
        f = np.polynomial.chebyshev.chebval(x, np.polynomial.chebyshev.chebfit(x, y, min(12, n - 1)))
        for part in (slice(0, t), slice(n - t, n)):
            f[part] = y[part] if t < 3 else np.polyval(np.polyfit(np.arange(t), y[part], 2), np.arange(t))
        assert np.allclose([got[p, i][0] for i in range(n)], f, atol=1e-6), p
        assert np.allclose([got[p, i][1] for i in range(n)], y - f, atol=1e-6)


def test_registered_forecaster_in_any_block(spark, series, block):
    seen = []

    def half(x):
        seen.append(x.shape)
        return x[:, -1] / 2 + x.mean(1) / 2

    got = {(r.point, r.pos): r.forecast for r in detect.forecasts(table(spark, series), 12, half, batch=50).collect()}
    want = {}
    for p, y in series.items():
        for i in range(12, len(y)):
            x = y[i - 12 : i]
            if not np.isnan(x).any():
                want[p, i] = x[-1] / 2 + x.mean() / 2
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    with pytest.raises(KeyError):
        detect.rolling_residual(table(spark, series), 12, "nobody")


def test_noise_measures_of_long_and_short_points(spark):
    rng = np.random.default_rng(5)
    series = {"noise": rng.normal(0, 1, 1000), "wave": 100 + np.sin(np.arange(1000) / 40), "short": rng.normal(0, 1, 90)}
    got = {r.point: r.high_share for r in features.high_frequency_share(table(spark, series)).collect()}
    for p, y in series.items():
        size = min(256, len(y))
        parts = [y[a : a + size] for a in range(0, len(y) - size + 1, size // 2)] if len(y) >= 256 else [y]
        window = np.hanning(size + 1)[:-1]
        power = np.mean([np.abs(np.fft.rfft((x - x.mean()) * window)) ** 2 for x in parts], axis=0)
        assert got[p] == pytest.approx(power[np.arange(len(power)) >= 0.1 * size].sum() / power.sum())


def test_wavelet_energy_equals_a_plain_transform(spark):
    rng = np.random.default_rng(6)
    series = {"a": rng.normal(0, 1, 300), "b": 10 + np.sin(np.arange(257) / 9)}
    lo = np.array(features.DB4)
    hi = np.array([(-1) ** (i + 1) * x for i, x in enumerate(lo[::-1])])
    got = {r.point: r.detail_share for r in features.wavelet_energy(table(spark, series)).collect()}
    for p, y in series.items():
        x, detail = y, 0.0
        for _ in range(5):
            n, size = len(x), (len(x) + 7) // 2
            at = lambda i: x[-i - 1 if i < 0 else 2 * n - 1 - i if i >= n else i]  # noqa: E731, B023
            pairs = [(sum(at(2 * k + 1 - t) * lo[t] for t in range(8)), sum(at(2 * k + 1 - t) * hi[t] for t in range(8))) for k in range(size)]
            x, detail = np.array([a for a, _ in pairs]), detail + sum(b * b for _, b in pairs)
        assert got[p] == pytest.approx(detail / (detail + (x * x).sum()))


def added(values):
    total = 0.0
    for v in values:
        total += v
    return total


@pytest.mark.parametrize("block", [17, 65_536])
def test_trimmed_means_add_from_the_last_row(spark, monkeypatch, block):
    monkeypatch.setattr(features, "BLOCK", block)
    rng = np.random.default_rng(4)
    y = {p: np.round(rng.exponential(30, 400), 2) for p in "abcdef"}
    got = {r.point: (r.trimmed_mean, r.trimmed_median) for r in features.trimmed(table(spark, y), "point").collect()}
    for p, x in y.items():
        low, high = np.quantile(x, (0.05, 0.95))
        keep = np.flatnonzero((x > low) & (x < high))[::-1]
        parts = [added(x[[i for i in keep if (399 - i) // block == b]].tolist()) for b in range(399 // block + 1)]
        assert got[p] == (added(parts) / len(keep), pytest.approx(np.median(x[keep])))


def test_rounding_is_that_of_the_shifted_value(spark):
    from tidegauge.plans.q_features import rounded

    x = [1.005, 1.115, -1.005, -2.5, 0.0, 1e300, 1e308, float("inf"), None]
    got = [r.v for r in rounded(spark.createDataFrame([(v,) for v in x], "v double").coalesce(1), 2, "v").collect()]
    assert got == [1.0, 1.12, -1.0, -2.5, 0.0, pytest.approx(1e300), 1e308, float("inf"), None]
