"""Spectrum of a trailing window that moves by one sample: the new one is added, the old one taken out."""

from __future__ import annotations

import numpy as np


class SlidingSpectrum:
    """DFT of the last ``n`` samples at the frequencies of a band; samples before the first are 0.

    A step turns every bin once, so a tick costs its samples times the band's bins and
    not the window. Rounding can't grow: after every n steps the bins are taken from the
    ring by a plain transform.
    """

    def __init__(self, n: int, fs: float, band: tuple[float, float]):
        self.n, self.fs, self.seen = n, fs, 0
        hz = np.fft.rfftfreq(n, 1 / fs)
        self.k = np.flatnonzero((hz >= band[0]) & (hz <= band[1]))
        self.turn = np.exp(2j * np.pi * self.k / n)
        self.ring = np.zeros(n)
        self.bins = np.zeros(len(self.k), complex)

    def push(self, x: float) -> None:
        at = self.seen % self.n
        self.bins = (self.bins + (x - self.ring[at])) * self.turn
        self.ring[at] = x
        self.seen += 1
        if at == self.n - 1:
            self.bins = np.fft.rfft(self.ring)[self.k]

    def peak(self) -> tuple[float, float]:
        """(Hz, amplitude) of the strongest frequency, the lower one on ties; zeros without any."""
        if not len(self.k) or not self.seen:
            return 0.0, 0.0
        size = np.abs(self.bins)
        i = int(size.argmax())
        return (float(self.k[i] * self.fs / self.n), float(2 * size[i] / self.n)) if size[i] > 0 else (0.0, 0.0)
