"""Scenes of reflectors that recordings are made of, and result comparison."""

from dataclasses import dataclass, field
from math import pi, sin

import numpy as np
import pandas as pd

from breathline.schemas import A121_COLUMNS

#: 56 bins of 2 cm.
RANGE = 0.30 + 0.02 * np.arange(56)


@dataclass
class Reflector:
    """Something at a distance that turns the phase of what it reflects over time."""

    at: float
    strength: float
    turn: callable = lambda t: 0.0
    width: float = 0.03

    def seen(self, distances, t):
        return self.strength * np.exp(-(((distances - self.at) / self.width) ** 2)) * np.exp(1j * self.turn(t))


@dataclass
class Scene:
    """Reflectors, a constant background and noise; ``frames`` are rows of a recording."""

    reflectors: list
    background: complex = 0
    noise: float = 0.0
    seed: int = 0
    distances: np.ndarray = field(default_factory=lambda: RANGE)

    def profiles(self, seconds, fs):
        rng, d = np.random.default_rng(self.seed), self.distances
        for k in range(round(seconds * fs)):
            z = self.background + sum(r.seen(d, k / fs) for r in self.reflectors)
            yield k, z + self.noise * (rng.normal(size=len(d)) + 1j * rng.normal(size=len(d)))

    def recording(self, seconds, fs=25.0):
        rows = []
        for k, z in self.profiles(seconds, fs):
            size, peak = np.abs(z), int(np.abs(z).argmax())
            arrays = [np.round(a, 8) for a in (self.distances, size, np.angle(z), z.real, z.imag)]
            rows.append((1000 * k / fs, k, self.distances[peak], size[peak], np.angle(z[peak]), size.mean(), *arrays))
        return pd.DataFrame(rows, columns=A121_COLUMNS)

    def live(self, seconds, fs=25.0, first=0):
        return [{"timestamp_ms": 1000 * (k + first) / fs, "frame": k + first, "distances": self.distances, "real": z.real, "imag": z.imag} for k, z in self.profiles(seconds, fs)]


def wave(size, hz):
    return lambda t: size * sin(2 * pi * hz * t)


def chest(breath_hz=0.3, heart_hz=1.1, breath=0.45, heart=0.07):
    return lambda t: wave(breath, breath_hz)(t) + wave(heart, heart_hz)(t)


def same_rows(spark_rows, columns, duck_rows):
    """Equal as multisets, columns by name."""
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    a = sorted(repr(tuple(r[n] for n in names)) for r in spark_rows)
    b = sorted(repr(tuple(r[i] for i in order)) for r in duck_rows)
    return a == b
