"""Rate trackers as steps over explicit states: ``step(state, *measurement) -> (state, value)``.

A state is a plain tuple, so that a fold over a recording and a keyed stream share
the step and a stream can store it.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from ..constants import FRAME_RESP_BAND, HEART_BAND, HEART_CONFIDENCE_MIN, RESP_CONFIDENCE_MIN
from . import dsp

#: Fixed values. Least quality of a measurement that counts.
QUALITY_MIN = 0.25
#: Heart rate: deviations of rate, drift and bend when locked; noise of the bend; seconds
#: between measurements; gate in squared deviations, misses that open it, misses that unlock.
LOCKED_DEVIATIONS, BEND_NOISE, STEP_S = (0.10, 0.06, 0.03), 0.065, (0.05, 2.0)
GATE, OPEN_AFTER, UNLOCK_AFTER = 9.0, 4, 12
#: Deviation of a measurement: this over the root of its confidence, within limits.
SPREAD, SPREAD_LIMITS, UNLOCKED_DEVIATION = 0.22, (0.035, 0.22), 0.35
#: Displayed respiration rate: distance that smooths, distance that agrees, misses kept,
#: shares of the average, the confidence that is high.
NEAR_HZ, AGREE_HZ, MISSES_KEPT, SHARE, SURE_SHARE, SURE = 0.10, 0.06, 40, 0.10, 0.20, 8.0


def within(x: float, limits: tuple[float, float]) -> float:
    return min(max(x, limits[0]), limits[1])


# -- heart rate ------------------------------------------------------------------


class Lock(NamedTuple):
    """Mean and covariance (upper triangle, by rows) of rate, drift and bend; misses in a row."""

    mean: tuple[float, float, float]
    cov: tuple[float, float, float, float, float, float]
    missed: int


def predicted(lock: Lock, dt: float) -> Lock:
    """The lock after ``dt`` seconds of constant bend, with noise on the bend."""
    r, v, b = lock.mean
    rr, rv, rb, vv, vb, bb = lock.cov
    h, q = dt * dt / 2, BEND_NOISE**2
    mean = within(r + dt * v + h * b, HEART_BAND), v + dt * b, b
    cov = (
        rr + 2 * dt * rv + 2 * h * rb + dt * dt * vv + 2 * dt * h * vb + h * h * bb + q * h * h,
        rv + dt * (rb + vv) + (dt * dt + h) * vb + h * dt * bb + q * h * dt,
        rb + dt * vb + h * bb + q * h,
        vv + 2 * dt * vb + dt * dt * bb + q * dt * dt,
        vb + dt * bb + q * dt,
        bb + q,
    )
    return Lock(mean, cov, lock.missed + 1)


def corrected(lock: Lock, hz: float, confidence: float) -> Lock:
    """The lock moved to a measurement, or as it is where that lies beyond the gate."""
    rr, rv, rb, vv, vb, bb = lock.cov
    noise = within(SPREAD / math.sqrt(max(confidence, 1.0)), SPREAD_LIMITS)
    spread, off = max(rr + noise * noise, 1e-9), hz - lock.mean[0]
    if off * off > GATE * spread and lock.missed <= OPEN_AFTER:
        return lock
    a, b, c = rr / spread, rv / spread, rb / spread
    mean = within(lock.mean[0] + a * off, HEART_BAND), lock.mean[1] + b * off, lock.mean[2] + c * off
    return Lock(mean, (rr - a * rr, rv - a * rv, rb - a * rb, vv - b * rv, vb - b * rb, bb - c * rb), 0)


def heart_step(lock: Lock | None, hz: float, dt: float, confidence: float, quality: float) -> tuple[Lock | None, float]:
    """The tracked rate after a measurement, 0 while there is no lock (state None).

    A sure measurement locks; UNLOCK_AFTER ones in a row that don't correct unlock.
    """
    sure = HEART_BAND[0] <= hz <= HEART_BAND[1] and confidence >= HEART_CONFIDENCE_MIN and quality >= QUALITY_MIN
    if lock is None:
        if not sure:
            return None, 0.0
        r, v, b = (d * d for d in LOCKED_DEVIATIONS)
        return Lock((float(hz), 0.0, 0.0), (r, 0.0, 0.0, v, 0.0, b), 0), float(hz)
    lock = predicted(lock, within(dt, STEP_S))
    if sure:
        lock = corrected(lock, hz, confidence)
    return (None, 0.0) if lock.missed >= UNLOCK_AFTER else (lock, lock.mean[0])


def search_band(lock: Lock | None) -> tuple[float, float]:
    """Where the next heart rate is looked for."""
    return HEART_BAND if lock is None else dsp.heart_band(lock.mean[0], math.sqrt(max(lock.cov[0], 1e-6)))


# -- displayed respiration rate -----------------------------------------------------


class Display(NamedTuple):
    shown: float = 0.0
    candidate: float = 0.0
    votes: int = 0
    missed: int = 0


def _event(s: Display, hz: float, confidence: float, quality: float, present: bool) -> str:
    if not present:
        return "absent"
    low, high = 0.9 * FRAME_RESP_BAND[0], 1.05 * FRAME_RESP_BAND[1]
    if not low <= hz <= high or confidence < RESP_CONFIDENCE_MIN or quality < QUALITY_MIN:
        return "missed" if s.missed < MISSES_KEPT else "lost"
    return "near" if s.shown > 0 and abs(hz - s.shown) <= NEAR_HZ else "vote"


def _smoothed(s: Display, hz: float, confidence: float) -> Display:
    share = SURE_SHARE if confidence >= SURE else SHARE
    return Display((1 - share) * s.shown + share * hz, s.candidate, 0)


def _voted(s: Display, hz: float, confidence: float) -> Display:
    """A candidate takes 4 votes to replace a rate, and to be the first one 2, or 1 that is sure."""
    agrees = abs(hz - s.candidate) <= AGREE_HZ
    candidate, votes = (s.candidate, s.votes + 1) if agrees else (hz, 1)
    needed = 4 if s.shown > 0 else 1 if confidence >= SURE else 2
    return Display(hz, candidate, 0) if votes >= needed else Display(s.shown, candidate, votes)


#: What becomes of the display at each event.
TRANSITIONS = {
    "absent": lambda s, hz, confidence: Display(),
    "missed": lambda s, hz, confidence: s._replace(missed=s.missed + 1),
    "lost": lambda s, hz, confidence: Display(0.0, s.candidate, 0, s.missed + 1),
    "near": _smoothed,
    "vote": _voted,
}


def display_step(state: Display | None, hz: float, confidence: float, quality: float, present: bool) -> tuple[Display, float]:
    """The displayed rate after a measurement: slow to acquire, smoothed when near, slow to jump."""
    s = state or Display()
    s = TRANSITIONS[_event(s, hz, confidence, quality, bool(present))](s, float(hz), confidence)
    return s, s.shown
