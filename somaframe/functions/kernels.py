"""Small numeric kernels for grouped functions: filtering, peaks, spectra, and distribution functions.

Each works on one series that a Spark group holds; none keeps state or reads files.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=256)
def band_pass(order: int, low: float, high: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a Butterworth band-pass: analogue poles on a circle, moved to the band at
    pre-warped edges, mapped to the z-plane bilinearly, gain one at the band's centre."""
    w0, w1 = (2 * rate * math.tan(math.pi * f / rate) for f in (low, high))
    width, centre = w1 - w0, math.sqrt(w0 * w1)
    prototype = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = prototype * width / 2
    root = np.sqrt(half**2 - centre**2 + 0j)
    poles = np.concatenate([half + root, half - root])
    z = (2 * rate + poles) / (2 * rate - poles)
    b = np.poly(np.concatenate([np.ones(order), -np.ones(order)])).astype(float)
    a = np.real(np.poly(z))
    at = np.exp(-1j * 2 * math.atan(centre / (2 * rate)) * np.arange(2 * order + 1))
    return b * abs((a @ at) / (b @ at)), a


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state under a constant input of one."""
    n = len(a)
    companion = np.zeros((n - 1, n - 1))
    companion[0] = -a[1:] / a[0]
    companion[1:, :-1] += np.eye(n - 2)
    return np.linalg.solve(np.eye(n - 1) - companion.T, b[1:] - a[1:] * b[0])


def run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II, transposed, sample by sample: what Modes gives block by block."""
    b0, bs, as_, z = float(b[0]), b[1:].tolist(), a[1:].tolist(), [*state.tolist(), 0.0]
    out, n = [], len(bs)
    for v in x.tolist():
        y = b0 * v + z[0]
        for k in range(n):
            z[k] = z[k + 1] + bs[k] * v - as_[k] * y
        out.append(y)
    return np.array(out)


#: Samples of a block, decimal digits in which a filter is taken apart, and how near to each other its poles may be.
BLOCK, DIGITS, NEAREST = 256, 80, 1e-7


class Modes:
    """A filter as a sum of one-pole recursions, run a block of samples at a time.

    A block's output is a matrix product of its samples (the impulse response) and one of the states before it (powers of the
    poles); the states behind it are those before, times the poles to the power of the block, and a third product. The state
    transition is diagonal, so its powers keep all digits, at low bands too, where those of the direct form lose them. Poles and
    residues are found in DIGITS decimal digits, as low bands have poles so near to each other that doubles would blur them."""

    def __init__(self, b: np.ndarray, a: np.ndarray):
        poles, residues = _taken_apart(tuple(b.tolist()), tuple(a.tolist()))
        self.poles, self.residues = np.array(poles), np.array(residues)
        powers = self.poles[None] ** np.arange(BLOCK + 1)[:, None]  # row n: poles to the power n
        response = (powers[:-1] * self.residues).sum(axis=1).real
        response[0] = b[0]
        lag = np.arange(BLOCK)[None] - np.arange(BLOCK)[:, None]
        self._own = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)  # sample i to output j
        out, into = powers[1:] * self.residues, powers[-2::-1]
        self._from_states = np.vstack([out.real.T, -out.imag.T])
        self._into_states = np.hstack([into.real, into.imag])
        self._ahead = powers[-1]

    def steady(self, level: float) -> np.ndarray:
        """States under a constant input."""
        return level / (1 - self.poles)

    def run(self, x: np.ndarray, states: np.ndarray) -> np.ndarray:
        blocks = np.zeros((-(-len(x) // BLOCK), BLOCK))
        blocks.ravel()[: len(x)] = x
        gained = blocks @ self._into_states
        gained = gained[:, : len(self.poles)] + 1j * gained[:, len(self.poles) :]
        before = np.empty_like(gained)
        for i in range(len(blocks)):
            before[i] = states
            states = states * self._ahead + gained[i]
        out = blocks @ self._own + np.hstack([before.real, before.imag]) @ self._from_states
        return out.ravel()[: len(x)]


@lru_cache(maxsize=256)
def _taken_apart(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[list[complex], list[complex]]:
    """Poles p and residues r with b / a = b[0] + the sum of r * (p / z + (p / z)^2 + ...): Newton's steps from the roots
    found in doubles, on the polynomial with exactly these coefficients."""
    with localcontext() as context:
        context.prec = DIGITS
        times = lambda u, v: (u[0] * v[0] - u[1] * v[1], u[0] * v[1] + u[1] * v[0])
        over = lambda u, v: tuple(part / (v[0] * v[0] + v[1] * v[1]) for part in times(u, (v[0], -v[1])))
        minus = lambda u, v: (u[0] - v[0], u[1] - v[1])

        def at(coefficients: list[Decimal], z: tuple) -> tuple:
            value = (Decimal(0), Decimal(0))
            for c in coefficients:
                value = times(value, z)
                value = (value[0] + c, value[1])
            return value

        lead = [Decimal(v) for v in a]
        slope = [c * (len(lead) - 1 - i) for i, c in enumerate(lead[:-1])]
        poles = []
        for root in np.roots(a):
            z = (Decimal(float(root.real)), Decimal(float(root.imag)))
            for _ in range(60):
                step = over(at(lead, z), at(slope, z))
                z = minus(z, step)
                if abs(step[0]) + abs(step[1]) < Decimal(10) ** (10 - DIGITS):
                    break
            poles.append(z)
        numerator = [Decimal(v) for v in b]
        # b(z) / a'(z) at the pole is the residue of the function of z; that of p / z + ... is it over p
        residues = [over(over(at(numerator, z), at(slope, z)), z) for z in poles]
        number = lambda z: complex(float(z[0]), float(z[1]))
        return [number(z) for z in poles], [number(z) for z in residues]


@lru_cache(maxsize=64)
def _modes(b: tuple[float, ...], a: tuple[float, ...]) -> Modes | None:
    """None where poles are so near to each other that the sum of one-pole recursions would lose digits."""
    roots = np.roots(a)
    apart = np.abs(roots[:, None] - roots[None]) + 2.0 * np.eye(len(roots))
    return Modes(np.array(b), np.array(a)) if apart.min() > NEAREST and np.abs(roots).max() < 1 else None


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, the ends mirrored about their values."""
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        raise ValueError("series too short for the filter")
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    modes = _modes(tuple(b.tolist()), tuple(a.tolist()))
    start = None if modes else steady_state(b, a)
    for _ in range(2):
        long = (modes.run(long, modes.steady(long[0])) if modes else run_filter(b, a, long, start * long[0]))[::-1]
    return long[pad:-pad]


def peaks(x: np.ndarray, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Local maxima (middle of flat tops), the higher first where two are closer than `distance`, then by prominence."""
    n = len(x)
    if n < 3:
        return np.zeros(0, int)
    change = np.flatnonzero(np.append(True, x[1:] != x[:-1]))  # starts of flat stretches
    ends = np.append(change[1:] - 1, n - 1)
    level = x[change]
    top = np.zeros(len(change), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    found = (change[top] + ends[top]) // 2
    if distance > 1 and len(found):
        keep = np.ones(len(found), bool)
        for i in np.argsort(x[found], kind="stable")[::-1]:
            if keep[i]:
                j = i - 1
                while j >= 0 and found[i] - found[j] < distance:
                    keep[j] = False
                    j -= 1
                j = i + 1
                while j < len(found) and found[j] - found[i] < distance:
                    keep[j] = False
                    j += 1
        found = found[keep]
    if prominence is not None and len(found):
        found = found[prominences(x, found) >= prominence]
    return found


def _lowest_before_higher(x: np.ndarray, height: float) -> tuple[float, bool]:
    """The lowest value before the first above height, and whether there is one above; x is read in growing pieces."""
    low, at, size = height, 0, 64
    while at < len(x):
        part = x[at : at + size]
        higher = part > height
        if higher.any():
            first = int(higher.argmax())
            return (min(low, float(part[:first].min())) if first else low), True
        low = min(low, float(part.min()))
        at, size = at + size, 2 * size
    return low, False


def bases(x: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two columns, before and behind each peak: the lowest value on the way to a higher sample (or an end), and whether there is a higher one."""
    sides = [(_lowest_before_higher(x[p::-1], x[p]), _lowest_before_higher(x[p:], x[p])) for p in found]
    low, met = (np.array([[side[i] for side in both] for both in sides]).reshape(-1, 2) for i in (0, 1))
    return low.astype(float), met.astype(bool)


def prominences(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Height over the higher of the two lowest points on the way to a higher sample (or an end)."""
    return x[found] - bases(x, found)[0].max(axis=1)


def densities(parts: np.ndarray, line: bool = False) -> np.ndarray:
    """One-sided densities, at a rate of one, of the rows, freed of their mean or line and under a periodic Hann taper.
    Holes (NaN) count as points on the mean or line."""
    n, at = parts.shape[1], np.arange(parts.shape[1]) - (parts.shape[1] - 1) / 2
    there = ~np.isnan(parts)
    with np.errstate(invalid="ignore", divide="ignore"):
        count = there.sum(axis=1, keepdims=True)
        flat = np.where(there, parts - np.nansum(parts, axis=1, keepdims=True) / count, 0.0)
        if line and n > 1:
            place = np.where(there, at - (there * at).sum(axis=1, keepdims=True) / count, 0.0)
            flat = flat - (flat * place).sum(axis=1, keepdims=True) / (place * place).sum(axis=1, keepdims=True) * place
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft(flat * taper)) ** 2 / np.sum(taper**2)
    power[:, 1 : (power.shape[1] - 1 if n % 2 == 0 else None)] *= 2
    return power


def spectrum(x: np.ndarray, rate: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Welch's averaged density over half-overlapping segments without their mean."""
    n = min(len(x), segment)
    parts = np.lib.stride_tricks.sliding_window_view(x, n)[:: n - n // 2]
    return np.fft.rfftfreq(n, 1 / rate), densities(parts).mean(axis=0) / rate


def monotone_cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fritsch and Carlson's interpolation; outside of x, NaN."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        m[:] = d[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = d[:-1] * d[1:] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
        for k, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
            s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            m[k] = 0.0 if np.sign(s) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    s = (at - x[i]) / h[i]
    out = (2 * s**3 - 3 * s**2 + 1) * y[i] + (s**3 - 2 * s**2 + s) * h[i] * m[i] + (-2 * s**3 + 3 * s**2) * y[i + 1] + (s**3 - s**2) * h[i] * m[i + 1]
    return np.where((at < x[0]) | (at > x[-1]), np.nan, out)


def normal_tail(z: float) -> float:
    """Two-sided p of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of a chi-square: the regularised upper incomplete gamma, by series or continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h
