import math

import numpy as np
import pytest

from somaframe.functions import kernels as K


def gain(b, a, hz, rate):
    z = np.exp(-2j * np.pi * hz / rate * np.arange(len(b)))
    return abs((b @ z) / (a @ z))


@pytest.mark.parametrize(("low", "high", "rate"), [(5, 20, 130), (0.1, 0.5, 50)])
def test_band_pass_edges(low, high, rate):
    b, a = K.band_pass(3, low, high, rate)
    assert len(b) == len(a) == 7
    assert gain(b, a, low, rate) == pytest.approx(math.sqrt(0.5), rel=1e-4)
    assert gain(b, a, high, rate) == pytest.approx(math.sqrt(0.5), rel=1e-4)
    assert gain(b, a, 0, rate) < 1e-5


def test_zero_phase_keeps_a_sine_in_the_band():
    t = np.arange(10000) / 50
    y = K.zero_phase(*K.band_pass(3, 0.1, 0.5, 50), np.sin(2 * np.pi * 0.22 * t))
    assert np.abs(y - np.sin(2 * np.pi * 0.22 * t))[2500:-2500].max() < 0.01
    with pytest.raises(ValueError, match="short"):
        K.zero_phase(*K.band_pass(3, 0.1, 0.5, 50), np.ones(21))


def test_steady_state():
    b, a = K.band_pass(3, 5, 20, 130)
    out = K.run_filter(b, a, np.full(50, 2.0), K.steady_state(b, a) * 2)
    assert np.allclose(out, out[0], atol=1e-9)


def test_peaks():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 5, 0], float)
    assert K.peaks(x).tolist() == [1, 4, 7, 9]
    assert K.peaks(x, distance=3).tolist() == [1, 4, 9]
    assert K.peaks(x, prominence=2.5).tolist() == [4, 9]
    assert K.peaks(np.zeros(2)).tolist() == []


def test_spectrum_of_a_sine():
    t = np.arange(2048) / 10
    hz, power = K.spectrum(np.sin(2 * np.pi * 0.25 * t), 10, 512)
    assert hz[power.argmax()] == pytest.approx(0.25, abs=10 / 512)
    assert np.sum(power) * (hz[1] - hz[0]) == pytest.approx(0.5, rel=0.05)


def test_monotone_cubic():
    x = np.array([0.0, 1, 2, 4, 5])
    assert np.allclose(K.monotone_cubic(x, 2 * x + 1, np.linspace(0, 5, 31)), 2 * np.linspace(0, 5, 31) + 1)
    y = np.array([0.0, 0, 1, 1, 5])
    assert (np.diff(K.monotone_cubic(x, y, np.linspace(0, 5, 200))) >= -1e-12).all()
    assert np.isnan(K.monotone_cubic(x, y, np.array([-1.0, 6])))[0]


def test_tails():
    assert K.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert K.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert K.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert K.chi2_tail(0, 3) == 1


def exact_filter(b, a, x):
    """The recursion in sixty decimal digits, from rest."""
    from decimal import Decimal, localcontext

    with localcontext() as context:
        context.prec = 60
        num, den, z, out = [Decimal(v) for v in b.tolist()], [Decimal(v) for v in a.tolist()], [Decimal(0)] * len(b), []
        for v in x.tolist():
            y = num[0] * Decimal(v) + z[0]
            for k in range(len(b) - 1):
                z[k] = z[k + 1] + num[k + 1] * Decimal(v) - den[k + 1] * y
            out.append(float(y))
    return np.array(out)


@pytest.mark.parametrize(("order", "low", "high", "rate", "loop"), [(3, 5, 20, 130, 1e-9), (3, 0.1, 0.5, 10, 1e-9), (3, 0.1, 0.5, 50, 1e-5), (3, 0.1, 0.5, 250, 1e-1), (3, 5, 20, 1000, 1e-6), (1, 5, 20, 130, 1e-9), (2, 0.5, 40, 200, 1e-9)])
def test_blocked_filter_is_the_exact_recursion(order, low, high, rate, loop):
    """To 1e-12 in all bands. The loop over samples is as near only in wide bands: at 0.1 to 0.5 Hz of 250 its own rounding is 1e-3."""
    b, a = K.band_pass(order, low, high, rate)
    x = np.cumsum(np.random.default_rng(3).normal(size=1100))
    modes = K._modes(tuple(b.tolist()), tuple(a.tolist()))
    want = exact_filter(b, a, x)
    got = modes.run(x, np.zeros(len(a) - 1, complex))
    assert np.abs(got - want).max() <= 1e-12 * np.abs(want).max()
    plain = K.run_filter(b, a, x, np.zeros(len(a) - 1))
    assert np.abs(got - plain).max() <= loop * np.abs(want).max()


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 512, 700])
def test_blocks_and_states(n):
    b, a = K.band_pass(3, 5, 20, 130)
    modes = K._modes(tuple(b.tolist()), tuple(a.tolist()))
    x = np.random.default_rng(n).normal(size=n) + 5
    assert modes.run(x, modes.steady(x[0])) == pytest.approx(K.run_filter(b, a, x, K.steady_state(b, a) * x[0]), abs=1e-10)
    assert modes.run(np.full(n, 3.0), modes.steady(3.0)) == pytest.approx(np.zeros(n), abs=1e-12)


def test_blocks_are_five_times_as_fast():
    import time

    b, a = K.band_pass(3, 0.1, 0.5, 50)
    x = np.random.default_rng(4).normal(size=60_000)
    K.zero_phase(b, a, x)

    def took(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    assert 5 * min(took(lambda: K.zero_phase(b, a, x)) for _ in range(7)) < 2 * min(took(lambda: K.run_filter(b, a, x, np.zeros(6))) for _ in range(2))


@pytest.mark.parametrize("line", [False, True])
def test_densities_by_hand(line):
    rng = np.random.default_rng(5)
    parts = rng.normal(size=(3, 20)) + np.arange(20) * 0.3
    parts[1, [3, 11]] = np.nan
    got = K.densities(parts, line)
    for row, power in zip(parts, got, strict=True):
        there = ~np.isnan(row)
        at = np.arange(20)
        base = np.polyval(np.polyfit(at[there], row[there], 1), at) if line else np.full(20, np.nanmean(row))
        w = 0.5 - 0.5 * np.cos(2 * np.pi * at / 20)
        for k in range(11):
            z = sum((row[i] - base[i]) * w[i] * np.exp(-2j * np.pi * k * i / 20) for i in at[there])
            assert power[k] == pytest.approx((1 if k in (0, 10) else 2) * abs(z) ** 2 / (w @ w), abs=1e-9)


def test_a_filter_is_designed_once():
    """Windows of one rate share it."""
    assert K.band_pass(3, 0.1, 0.5, 8.0) is K.band_pass(3, 0.1, 0.5, 8.0)
