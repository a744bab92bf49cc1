"""Zero-phase filters for signals, from their textbook definitions."""

from __future__ import annotations

import numpy as np

from .signals import FORM, Form


def notch(hz: float, q: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order notch of quality ``q``: numerator and denominator."""
    w = 2 * np.pi * hz / rate
    gain = 1 / (1 + np.tan(w / q / 2))
    return gain * np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * gain * np.cos(w), 2 * gain - 1])


def bandpass(order: int, low: float, high: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Butterworth bandpass by the bilinear transform: numerator and denominator."""
    lo, hi = (4 * np.tan(np.pi * f / rate) for f in (low, high))
    width, centre = hi - lo, np.sqrt(lo * hi)
    k = np.arange(1, order + 1)
    half = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(half**2 - centre**2)
    poles = np.concatenate([half + root, half - root])
    # order zeros at 0 and order at infinity; the latter go to -1
    b = np.poly(np.concatenate([np.ones(order), -np.ones(order)]))
    scale = width**order * 4.0**order / np.prod(4 - poles)
    return np.real(b * scale), np.real(np.poly((4 + poles) / (4 - poles)))


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Rows of ``x`` through the filter, all rows at once, sample by sample."""
    y, z = np.empty_like(x), state.copy()
    for i in range(x.shape[1]):
        v = x[:, i]
        out = b[0] * v + z[0]
        z[:-1] = z[1:] + np.outer(b[1:-1], v) - np.outer(a[1:-1], out)
        z[-1] = b[-1] * v - a[-1] * out
        y[:, i] = out
    return y


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` filtered forth and back, so that nothing is delayed.

    Ends are continued by their point reflection, and the filter starts in the
    state it would have after a constant.
    """
    n = len(a)
    pad = 3 * n
    if x.shape[1] <= pad:
        raise ValueError("a signal must be longer than its padding")
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    y = np.concatenate([left, x, right], axis=1)
    companion = np.zeros((n - 1, n - 1))
    companion[:, 0] = -a[1:]
    companion[: n - 2, 1:] = np.eye(n - 2)
    steady = np.linalg.solve(np.eye(n - 1) - companion, b[1:] - a[1:] * b[0])
    for _ in range(2):
        y = _run(b, a, y, np.outer(steady, y[:, 0]))[:, ::-1]
    return y[:, pad:-pad]


def running_median(x: np.ndarray, size: int) -> np.ndarray:
    """Median of each odd window, zeros beyond the ends."""
    h = size // 2
    padded = np.pad(x, ((0, 0), (h, h)))
    return np.stack([np.median(np.lib.stride_tricks.sliding_window_view(row, size), axis=1) for row in padded])


def cleaned(signal: np.ndarray, form: Form = FORM) -> np.ndarray:
    """A signal in the common form without mains hum, drift and noise, standardised over all leads.

    Notch at 50 Hz (quality 30), bandpass 0.67 to 40 Hz (order 4), less a
    running median of 0.4 s.  Signals of another shape, not finite, or flat
    after filtering raise.
    """
    x = np.asarray(signal, dtype=np.float64)
    if x.shape != (len(form.leads), form.samples) or not np.isfinite(x).all():
        raise ValueError("a finite signal in the common form is needed")
    x = both_ways(*notch(50, 30, form.rate), x)
    x = both_ways(*bandpass(4, 0.67, 40, form.rate), x)
    x = x - running_median(x, int(0.4 * form.rate) // 2 * 2 + 1)
    sd = float(x.std())
    if sd <= 1e-8:
        raise ValueError("the signal is flat")
    return np.ascontiguousarray((x - x.mean()) / (sd + 1e-8), dtype=np.float32)
