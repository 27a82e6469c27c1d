"""Filter design and application in numpy: cascaded second-order sections, notches and windowed-sinc FIR filters.

A cascade runs as one linear state space, a block of samples at a time: within a block the response is a
matrix product, and only the few state values go from block to block.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Samples a block of the state-space recursion.
BLOCK = 128


def check_band(low: float | None, high: float | None, sfreq: float) -> tuple[float | None, float | None]:
    """Edges that mean something: none at or below zero, none at or above half the rate for the upper one; a lower edge there is an error."""
    low = None if low is None or low <= 0 else float(low)
    high = None if high is None or high >= sfreq / 2 else float(high)
    if low is not None and low >= sfreq / 2:
        raise ValueError("the lower edge is at or above half the sampling rate")
    if low is None and high is None:
        raise ValueError("no edge inside the band")
    return low, high


def butterworth(low: float | None, high: float | None, sfreq: float, order: int = 4) -> np.ndarray:
    """Second-order sections [b0 b1 b2 1 a1 a2]: low-pass, high-pass, band-pass (low < high) or band-stop (low > high)."""
    low, high = check_band(low, high, sfreq)
    warp = lambda f: 2 * sfreq * math.tan(math.pi * f / sfreq)
    poles = np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if low is None or high is None:
        edge = warp(high if low is None else low)
        p = poles * edge if low is None else edge / poles
        zeros = -np.ones(order) if low is None else np.ones(order)
        at = 1.0 if low is None else -1.0
    else:
        w1, w2 = sorted((warp(low), warp(high)))
        centre, width = w1 * w2, w2 - w1
        half = poles * width / 2 if low < high else width / 2 / poles
        root = np.sqrt(half**2 - centre)
        p = np.concatenate([half + root, half - root])
        if low < high:
            zeros = np.concatenate([np.ones(order), -np.ones(order)])
            at = np.exp(2j * math.atan(math.sqrt(centre) / (2 * sfreq)))
        else:
            z = (2 * sfreq + 1j * math.sqrt(centre)) / (2 * sfreq - 1j * math.sqrt(centre))
            zeros = np.array([z, z.conjugate()] * order)
            at = 1.0
    digital = (2 * sfreq + p) / (2 * sfreq - p)
    return _sections(zeros, digital, at)


def _sections(zeros: np.ndarray, poles: np.ndarray, unit_at: complex) -> np.ndarray:
    """Sections with gain 1 at a point of the unit circle, poles of largest radius last."""
    upper = sorted((p for p in poles if p.imag > 1e-12), key=abs)
    real = sorted((p.real for p in poles if abs(p.imag) <= 1e-12), key=abs)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper]
    pairs = [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=False)] + pairs
    if len(real) % 2:
        pairs.insert(0, (-real[-1], 0.0))
    flat = sorted(zeros, key=lambda z: (round(z.real, 9), abs(z.imag))) if np.isrealobj(zeros) or not np.any(np.abs(np.imag(zeros)) > 1e-12) else list(zeros)
    out = []
    for a1, a2 in pairs:
        if a2 == 0.0 and len(flat) % 2:
            z = flat.pop(0)
            b = [1.0, -float(np.real(z)), 0.0]
        else:
            z1, z2 = (flat.pop(0), flat.pop(-1) if np.isrealobj(np.real_if_close(flat)) else flat.pop(0))
            b = [1.0, -float(np.real(z1 + z2)), float(np.real(z1 * z2))]
        out.append([*b, 1.0, a1, a2])
    sos = np.array(out)
    z = np.exp(-1j * np.angle(unit_at))
    powers = np.array([1.0, z, z * z])
    sos[:, :3] /= np.abs((sos[:, :3] @ powers) / (sos[:, 3:] @ powers))[:, None]
    return sos


def notch(frequency: float, sfreq: float, quality: float = 30.0) -> np.ndarray:
    """One section that takes out a frequency; its width at -3 dB is frequency / quality."""
    w = 2 * math.pi * frequency / sfreq
    beta = math.tan(w / (2 * quality))
    gain = 1 / (1 + beta)
    return np.array([[gain, -2 * gain * math.cos(w), gain, 1.0, -2 * gain * math.cos(w), 2 * gain - 1]])


def response(sos: np.ndarray, frequencies: np.ndarray, sfreq: float) -> np.ndarray:
    """The complex gain at frequencies."""
    z = np.exp(-2j * np.pi * np.asarray(frequencies, float) / sfreq)
    powers = np.stack([np.ones_like(z), z, z * z])
    return np.prod((sos[:, :3] @ powers) / (sos[:, 3:] @ powers), axis=0)


def _state_space(sos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """x' = A x + B u, y = C x + D u, for the whole cascade."""
    n = 2 * len(sos)
    a, b = np.zeros((n, n)), np.zeros(n)
    through_c, through_d = np.zeros(n), 1.0  # what reaches the next section
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        s = slice(2 * i, 2 * i + 2)
        own = np.array([b1 - a1 * b0, b2 - a2 * b0])
        a[s] += np.outer(own, through_c)
        a[s, s] += np.array([[-a1, 1.0], [-a2, 0.0]])
        b[s] = own * through_d
        through_c, through_d = b0 * through_c, b0 * through_d
        through_c[2 * i] += 1.0
    return a, b, through_c, through_d


@lru_cache(64)
def _block_maps(coefficients: bytes, size: int) -> tuple[np.ndarray, ...]:
    """What a filter does to blocks of up to ``size`` samples: state to output, input to output, input to state (the last sample
    first), and the powers of its state matrix. They depend on the design alone, so a worker makes them once."""
    a, b, c, d = _state_space(np.frombuffer(coefficients).reshape(-1, 6))
    powers = np.empty((size + 1, len(b), len(b)))
    powers[0] = np.eye(len(b))
    for i in range(size):
        powers[i + 1] = a @ powers[i]
    free, to_state = c @ powers[:size], powers[:size] @ b
    response_ = np.r_[d, to_state @ c]
    lag = np.subtract.outer(np.arange(size), np.arange(size))
    return free, np.where(lag >= 0, response_[np.clip(lag, 0, None)], 0.0), to_state, powers


def causal(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The filtered signal and the state after it; without a state, from rest."""
    free, forced, to_state, powers = _block_maps(np.ascontiguousarray(sos, float).tobytes(), BLOCK)
    x = np.asarray(x, float)
    state = np.zeros(powers.shape[1]) if state is None else np.asarray(state, float)
    whole = len(x) // BLOCK
    blocks = x[: whole * BLOCK].reshape(whole, BLOCK)
    out, push = blocks @ forced.T, blocks @ to_state[::-1]
    for i in range(whole):
        out[i] += free @ state
        state = powers[BLOCK] @ state + push[i]
    rest = x[whole * BLOCK :]
    r = len(rest)
    tail = free[:r] @ state + forced[:r, :r] @ rest
    state = powers[r] @ state + (rest @ to_state[:r][::-1] if r else 0.0)
    return np.concatenate([out.ravel(), tail]), state


@lru_cache(64)
def _steady(coefficients: bytes) -> np.ndarray:
    """The state to which a constant input of 1 leads."""
    a, b, _, _ = _state_space(np.frombuffer(coefficients).reshape(-1, 6))
    return np.linalg.solve(np.eye(len(b)) - a, b)


def zero_phase(sos: np.ndarray, x: np.ndarray, pad: int | None = None) -> np.ndarray:
    """Forward and backward, over an odd extension of ``pad`` samples at each end, each way from the steady state of its first value."""
    x = np.asarray(x, float)
    if len(x) < 2:
        return x.copy()
    pad = min(len(x) - 1, 30 * (2 * len(sos) + 1) if pad is None else pad)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    steady = _steady(np.ascontiguousarray(sos, float).tobytes())
    for _ in range(2):
        wide = causal(sos, wide, steady * wide[0])[0][::-1]
    return wide[pad : pad + len(x)]


def windowed_sinc(low: float | None, high: float | None, sfreq: float, width: float | None = None) -> np.ndarray:
    """Taps of a linear-phase FIR filter (Hamming window, odd length); low > high stops the band between.

    An edge's transition, a quarter of its frequency but 2 Hz at least, lies outside the band that is kept, as far as there is
    room; the narrowest says how many taps there are.
    """
    low, high = check_band(low, high, sfreq)
    nyquist, stops = sfreq / 2, None not in (low, high) and low > high
    cuts, widths = [], []
    for edge, below in ((low, True), (high, False)):
        if edge is None:
            continue
        down = below is not stops  # the side of the edge on which the transition lies
        own = width or min(max(0.25 * edge, 2.0), edge if down else nyquist - edge)
        widths.append(own)
        cuts.append((float(np.clip(edge + (-own if down else own) / 2, 1e-6, nyquist - 1e-6)), below))
    n = math.ceil(3.3 * sfreq / min(widths)) | 1
    at = np.arange(n) - n // 2
    window = 0.54 + 0.46 * np.cos(2 * np.pi * at / (n - 1))

    def passing(cut: float, below: bool) -> np.ndarray:
        """A low-pass filter, or for a lower edge what it leaves."""
        taps = np.sinc(2 * cut / sfreq * at) * window
        return (at == 0) - taps / taps.sum() if below else taps / taps.sum()

    parts = [passing(*c) for c in cuts]
    if len(parts) == 1:
        return parts[0]
    # Both edges: what passes both, or in a stop what passes either.
    return parts[0] + parts[1] - (at == 0) if not stops else parts[0] + parts[1]


def convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The full convolution, by transforms."""
    n = len(x) + len(taps) - 1
    size = 1 << n.bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[:n]


def fir_zero_phase(taps: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Convolution with the taps centred, over reflected ends."""
    half = len(taps) // 2
    wide = np.pad(np.asarray(x, float), half, "reflect") if len(x) > 1 else np.pad(x, half, "edge")
    return convolved(wide, taps)[2 * half : 2 * half + len(x)]


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal along the last axis."""
    n = x.shape[-1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * weight, axis=-1)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Rational resampling: zeros put in, a low-pass at the lower of both rates, and every ``down``-th sample; a line through the ends is taken out first and put back."""
    x = np.asarray(x, float)
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down or len(x) < 2:
        return x.copy()
    n = -(-len(x) * up // down)
    line = lambda t: x[0] + (x[-1] - x[0]) * t / (len(x) - 1)
    most = max(up, down)
    half = 10 * most
    at = np.arange(-half, half + 1)
    taps = np.sinc(at / most) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    wide = np.zeros(len(x) * up)
    wide[::up] = x - line(np.arange(len(x)))
    size = 1 << (len(wide) + 2 * half).bit_length()
    full = np.fft.irfft(np.fft.rfft(wide, size) * np.fft.rfft(taps, size), size)
    return full[half : half + len(wide)][::down][:n] + line(np.arange(n) * down / up)


def tapers(n: int, nw: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` Slepian sequences of unit energy and their concentrations, from the commuting tridiagonal matrix."""
    i = np.arange(n)
    w = nw / n
    diagonal = ((n - 1 - 2 * i) / 2.0) ** 2 * math.cos(2 * math.pi * w)
    off = i[1:] * (n - i[1:]) / 2.0
    _, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    found = vectors[:, ::-1][:, :k].T.copy()
    for j, v in enumerate(found):
        if (j % 2 == 0 and v.sum() < 0) or (j % 2 and v[np.abs(v) > 1e-8][0] < 0):
            v *= -1
    lag = np.subtract.outer(i, i)
    kernel = 2 * w * np.sinc(2 * w * lag)
    return found, np.einsum("ki,ij,kj->k", found, kernel, found)


def morlet(x: np.ndarray, sfreq: float, frequencies: list[float], cycles: float = 7.0) -> np.ndarray:
    """Complex wavelet coefficients (frequency, time); a sinusoid of amplitude A has power A squared."""
    out = np.empty((len(frequencies), len(x)), complex)
    for row, f in zip(out, frequencies, strict=True):
        sigma = cycles / (2 * math.pi * f)
        half = max(1, int(round(3.5 * sigma * sfreq)))
        t = np.arange(-half, half + 1) / sfreq
        bell = np.exp(-(t**2) / (2 * sigma**2))
        wavelet = bell * np.exp(2j * math.pi * f * t) / (bell.sum() / 2)
        row[:] = np.convolve(x, wavelet, "full")[half : half + len(x)]
    return out
