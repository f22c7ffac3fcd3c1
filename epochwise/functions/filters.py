"""Band-pass design and zero-phase filtering of a piece of a track (numpy, used inside Arrow UDFs)."""

from __future__ import annotations

import math

import numpy as np


def design_butterworth(fs: float, low: float, high: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth band-pass of the given order."""
    if not 0 < low < high < fs / 2:
        raise ValueError("band limits must satisfy 0 < low < high < fs/2")
    # Band edges on the analog axis, then low-pass prototype -> band-pass -> bilinear transform.
    w1, w2 = (2 * fs * math.tan(math.pi * f / fs) for f in (low, high))
    width, centre2 = w2 - w1, w1 * w2
    k = np.arange(order)
    proto = np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half**2 - centre2)
    poles = np.concatenate((half + root, half - root))
    two_fs = 2 * fs
    digital = (two_fs + poles) / (two_fs - poles)
    zeros = np.concatenate((np.ones(order), -np.ones(order)))
    gain = (width**order * two_fs**order / np.prod(two_fs - poles)).real
    return gain * np.poly(zeros).real, np.poly(digital).real


def settle_samples(a: np.ndarray, tolerance: float = 1e-10) -> int:
    """Samples after which the response of the slowest pole has fallen to ``tolerance``."""
    radius = np.abs(np.roots(a)).max()
    return int(math.ceil(math.log(tolerance) / math.log(radius)))


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Delay line of the transposed direct form after an endless input of ones."""
    n = len(a) - 1
    # State equation s = S s + (b[1:] - a[1:] b[0]) with S the shift matrix corrected by a.
    shift = np.eye(n, k=1)
    shift[:, 0] -= a[1:]
    return np.linalg.solve(np.eye(n) - shift, b[1:] - a[1:] * b[0])


def recursion(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Run the filter along axis 0 for all columns of ``x`` at once."""
    s = np.vstack((state, np.zeros((1, x.shape[1]))))
    y = np.empty_like(x)
    b1, a1 = b[1:, None], a[1:, None]
    for i in range(len(x)):
        y[i] = b[0] * x[i] + s[0]
        s[:-1] = s[1:] + b1 * x[i] - a1 * y[i]
    return y


def zero_phase_exact(b: np.ndarray, a: np.ndarray, x: np.ndarray, true_start: bool, true_end: bool) -> np.ndarray:
    """Forward-backward recursion; true track ends are continued by odd reflection."""
    pad = min(3 * len(a), len(x) - 1)
    head = 2 * x[0] - x[pad:0:-1] if true_start else x[:0]
    tail = 2 * x[-1] - x[-2:-pad - 2:-1] if true_end else x[:0]
    ext = np.concatenate((head, x, tail))
    zi = steady_state(b, a)[:, None]
    forward = recursion(b, a, ext, zi * ext[0])[::-1]
    both = recursion(b, a, forward, zi * forward[0])[::-1]
    return both[len(head):len(head) + len(x)]


def zero_phase_spectral(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Multiply by the squared magnitude response; equals the recursion away from both ends."""
    size = 1 << (2 * len(x) - 1).bit_length()
    z = np.exp(-1j * np.pi * np.arange(size // 2 + 1) / (size // 2))
    power = np.abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) ** 2
    return np.fft.irfft(np.fft.rfft(x, size, axis=0) * power[:, None], size, axis=0)[:len(x)]
