"""Causal filter chain of a live range-profile recording, one frame at a time."""

from __future__ import annotations

import math

import numpy as np

from ..constants import FRAME_RESP_BAND, GATE_HALF_WIDTH, HEART_BAND, RATE_WINDOW_S
from . import dsp, frames

FIELDS = ("time_s", "raw_phase", "raw_i", "raw_q", "resp_signal", "heart_signal")


class _Causal:
    """An IIR filter over all bins with its memory; without coefficients it passes values on."""

    def __init__(self, design: tuple[np.ndarray, np.ndarray] | None, m: int):
        self.design = design
        self.z = None if design is None else np.zeros((max(map(len, design)), m))

    def run(self, x: np.ndarray) -> np.ndarray:
        return x if self.design is None else dsp.filter_causal(*self.design, x, self.z)


class _Average(_Causal):
    """Exponential average, from the first value on."""

    def __init__(self, keep: float, m: int):
        super().__init__((np.array([1 - keep]), np.array([1.0, -keep])), m)
        self.keep, self.begun = keep, False

    def run(self, x: np.ndarray) -> np.ndarray:
        if not self.begun:
            self.z[0], self.begun = self.keep * x[0], True
        return super().run(x)


class _Turns:
    """Running sum of an angle's steps, each taken the short way round; 0 at first."""

    def __init__(self, m: int):
        self.angle, self.total = None, np.zeros(m)

    def run(self, angle: np.ndarray) -> np.ndarray:
        steps = np.diff(angle, axis=0, prepend=angle[:1] if self.angle is None else self.angle[None, :])
        steps -= 2 * np.pi * ((steps > np.pi).astype(float) - (steps < -np.pi))
        out = np.cumsum(np.vstack([self.total, steps]), axis=0)[1:]
        self.angle, self.total = angle[-1], out[-1]
        return out


class _Clock:
    """Which frames are new, and their seconds: always rising, by a frame's length where their times don't."""

    def __init__(self, fs: float):
        self.frame_s = 1 / max(fs, 1e-9)
        self.frame = self.ms = self.first_ms = self.seconds = None

    def passes(self, frame: int | None, ms: float) -> bool:
        last, own = (self.ms, ms) if frame is None else (self.frame, frame)
        return last is None or own > last

    def tick(self, frame: int | None, ms: float) -> float:
        self.first_ms = ms if self.first_ms is None else self.first_ms
        seconds = (ms - self.first_ms) / 1000
        self.seconds = seconds if self.seconds is None or seconds > self.seconds else self.seconds + self.frame_s
        self.ms, self.frame = ms, self.frame if frame is None else frame
        return self.seconds


def _mixed(smooth: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Weights of the bins of each frame: shares of their amplitudes, most of it for the one that leads, so a neighbour can't cancel it."""
    share = lambda w: w / (w.sum(axis=1, keepdims=True) + 1e-12)
    weights = share(np.maximum(smooth, 0))
    return share(0.35 * weights + 0.65 * leads) if len(leads) > 1 and leads.any() else weights


class LiveTrace:
    """Append-only traces: a frame's output never changes once it is given.

    A frame is dropped if its number (or, without one, its time) isn't past the last
    one's. New bin counts, or a rate that moved by more than 20 %, start anew but keep
    the selected bin where it still exists.
    """

    def __init__(self, target_m: float | None = None, use_gating: bool = False, half_width: float = GATE_HALF_WIDTH):
        self.target_m, self.use_gating, self.half_width = target_m, use_gating, half_width
        self.fs, self.distances, self.selected, self.clock = 0.0, np.empty(0), None, _Clock(0.0)

    @property
    def last_frame(self) -> int | None:
        return self.clock.frame

    def _start(self, fs: float, distances: np.ndarray) -> None:
        m = len(distances)
        self.selected = self.selected if self.selected is not None and self.selected < m else None
        self.fs, self.distances = float(fs), np.asarray(distances, float)
        band = lambda b, n: (r := dsp.band_for_rate(b, fs)) and dsp.coefficients(n, r, fs, "band")
        edge = min(0.04, 0.45 * fs)
        self.level = _Causal(dsp.coefficients(1, edge, fs, "high") if 0 < edge < fs / 2 else None, m)
        resp, heart = band(FRAME_RESP_BAND, 2), band(HEART_BAND, 3)
        self.resp, self.heart = _Causal(resp, m), _Causal(heart, m) if heart else None
        self.turns, self.clock = _Turns(m), _Clock(fs)
        self.average = _Average(math.exp(-1 / max(fs * RATE_WINDOW_S, 1e-9)), m)

    def feed(self, rows: list[dict]) -> list[dict]:
        """Outputs of new frames, in order: rows have timestamp_ms, frame, distances, real, imag."""
        if not rows or not len(rows[-1]["distances"]):
            return []
        fs = frames.sample_rate([r["timestamp_ms"] for r in rows], self.fs or 20.0)
        distances = rows[-1]["distances"]
        if len(distances) != len(self.distances) or self.fs <= 0 or abs(fs - self.fs) / self.fs > 0.20:
            self._start(fs, distances)
        m, taken, seconds = len(self.distances), [], []
        for r in rows:
            frame, ms = r.get("frame"), float(r["timestamp_ms"])
            if self.clock.passes(frame, ms) and min(len(r["real"]), len(r["imag"])) >= m:
                taken.append(r)
                seconds.append(self.clock.tick(frame, ms))
        return self._block(taken, seconds) if taken else []

    def _block(self, rows: list[dict], seconds: list[float]) -> list[dict]:
        """Outputs of frames that are new, through all filters together; how frames are cut into blocks makes no difference."""
        m = len(self.distances)
        z = np.array([np.asarray(r["real"], float)[:m] + 1j * np.asarray(r["imag"], float)[:m] for r in rows])
        smooth, phase = self.average.run(np.abs(z)), self.turns.run(np.angle(z))
        at = self._select(smooth[0])
        bins = frames.gate(self.distances, at, self.half_width, self.use_gating)
        weights = _mixed(smooth[:, bins], bins == at)
        moved = self.level.run(phase)
        resp, heart = self.resp.run(moved), self.heart.run(moved) if self.heart else np.zeros_like(moved)
        mean = lambda x: (x[:, bins] * weights).sum(axis=1)
        values = np.column_stack([seconds, phase[:, at], z[:, at].real, z[:, at].imag, mean(resp), mean(heart)])
        target = float(self.distances[at])
        return [{"frame": r.get("frame"), "selected_index": at, "target_distance_m": target} | dict(zip(FIELDS, v)) for r, v in zip(rows, values.tolist())]

    def _select(self, smooth: np.ndarray) -> int:
        """A given target's nearest bin; else the first frame's best one, kept from then on."""
        if self.target_m is not None and np.isfinite(self.target_m) and self.target_m > 0:
            self.selected = int(np.abs(self.distances - self.target_m).argmin())
        elif self.selected is None:
            self.selected = int(np.where(frames.beyond_leakage(self.distances), smooth, -np.inf).argmax())
        self.selected = min(max(self.selected, 0), len(self.distances) - 1)
        return self.selected
