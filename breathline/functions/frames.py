"""Range-profile analysis of one recording: phase, target bin, weights, presence."""

from __future__ import annotations

import numpy as np

from ..constants import FRAME_RESP_BAND, HEART_BAND, MIN_TARGET_DISTANCE
from . import dsp


def sample_rate(times_ms, default: float = 20.0) -> float:
    """Robust rate; total count over elapsed time where the gaps come in bursts."""
    t = np.asarray(times_ms, float)
    t = t[np.isfinite(t)]
    if t.size < 2:
        return default
    elapsed = (t[-1] - t[0]) / 1000
    total = (t.size - 1) / elapsed if elapsed > 0 else 0.0
    gaps = np.diff(t) / 1000
    ahead = gaps[gaps > 0]
    if not ahead.size:
        return total or default
    middle = np.median(ahead)
    bursts = ((gaps <= 0).sum() + (ahead < max(0.002, 0.2 * middle)).sum()) / gaps.size
    if total > 0 and (bursts > 0.05 or abs(1 / middle - total) / total > 0.25):
        return float(total)
    usual = ahead[(ahead > 0.25 * middle) & (ahead < 4 * middle)]
    return float(1 / (usual if usual.size else ahead).mean())


def time_axis(times_ms, fs: float) -> np.ndarray:
    """Seconds from the first sample, evenly spread over the same span where gaps come in bursts."""
    t = np.asarray(times_ms, float)
    wall = (t - t[0]) / 1000 if t.size else t
    if t.size < 3 or fs <= 0:
        return wall
    gaps = np.diff(t) / 1000
    gaps = gaps[np.isfinite(gaps)]
    even = np.arange(t.size) / fs
    if not gaps.size:
        return even
    ahead = gaps[gaps > 0]
    bursty = (gaps <= 0).mean() > 0.05 or (ahead.size and (ahead < max(0.002, 0.2 * np.median(ahead))).sum() / gaps.size > 0.05)
    return even * (wall[-1] / max(even[-1], 1e-9)) if bursty and wall[-1] > 0 else wall


def centred(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Profile less the centre of the circle that each bin's samples lie on, and the fit's quality.

    Kasa's closed form from sums; bins without a plausible circle stay as they are.
    """
    n, m = z.shape
    if n < 8:
        return z, np.full(m, 0.25)
    mean = z.mean(axis=0)
    u, v = (z - mean).real, (z - mean).imag
    r2 = u * u + v * v
    suu, svv, suv = (u * u).sum(0), (v * v).sum(0), (u * v).sum(0)
    su, sv = (u * r2).sum(0), (v * r2).sum(0)
    det = suu * svv - suv * suv
    ok = det > 1e-12
    safe = np.where(ok, det, 1.0)
    cu = np.where(ok, (svv * su - suv * sv) / safe / 2, 0.0)
    cv = np.where(ok, (suu * sv - suv * su) / safe / 2, 0.0)
    radius = np.sqrt(np.maximum(cu**2 + cv**2 + np.where(ok, r2.mean(0), 0.0), 0.0))
    centre = mean + cu + 1j * cv
    rms = np.sqrt(((np.abs(z - centre) - radius) ** 2).mean(0)) / (radius + 1e-12)
    typical = np.median(np.abs(z), axis=0)
    ok &= (radius > 0.05 * typical) & (radius < 20 * typical) & (rms < 0.45)
    return np.where(ok, z - centre, z), np.where(ok, np.clip(1 - rms / 0.45, 0, 1), 0.25)


def differential_phase(z: np.ndarray) -> np.ndarray:
    """Running sum of phase steps between unit phasors, less its line over time."""
    unit = z / (np.abs(z) + 1e-12)
    steps = np.angle(unit[1:] * unit[:-1].conj())
    return dsp.remove_line(np.concatenate([np.zeros((1, z.shape[1])), steps.cumsum(axis=0)]))


def wrapped_phase_sum(z: np.ndarray) -> np.ndarray:
    """Running sum of angle steps wrapped to [-pi, pi), from 0."""
    steps = np.mod(np.diff(np.angle(z), axis=0) + np.pi, 2 * np.pi) - np.pi
    return np.concatenate([np.zeros((1, z.shape[1])), steps.cumsum(axis=0)])


def energy_ratio(phase: np.ndarray, fs: float) -> np.ndarray:
    """Mean spectral energy in the vital band over that beside it, per bin."""
    n, m = phase.shape
    if n < 16 or fs <= 0:
        return np.ones(m)
    energy = np.abs(np.fft.rfft(phase * np.hanning(n)[:, None], axis=0)) ** 2
    f = np.fft.rfftfreq(n, 1 / fs)
    vital = (f >= FRAME_RESP_BAND[0]) & (f <= min(HEART_BAND[1], 0.46 * fs))
    beside = (f >= 0.03) & (f <= min(0.46 * fs, 5.0)) & ~vital
    if not vital.any() or not beside.any():
        return np.ones(m)
    return energy[vital].mean(0) / (energy[beside].mean(0) + 1e-18)


def beyond_leakage(distances: np.ndarray) -> np.ndarray:
    """Bins past the nearest usable distance; all where none are."""
    mask = distances >= MIN_TARGET_DISTANCE
    return mask if mask.any() else np.ones(len(distances), bool)


def target_bin(distances, amplitude, ratio, target_m, use_gating: bool, latest_peak_m: float) -> int:
    """The bin nearest a given target, else the best by amplitude, phase energy and latest peak."""
    if not len(distances):
        return 0
    if use_gating and target_m is not None and np.isfinite(target_m):
        return int(np.abs(distances - target_m).argmin())
    mask = beyond_leakage(distances)
    score = np.where(mask, amplitude / (np.median(amplitude[mask]) + 1e-12), 0.0) + 0.15 * np.clip(ratio, 0, 5)
    if np.isfinite(latest_peak_m) and latest_peak_m > 0:
        near = int(np.abs(distances - latest_peak_m).argmin())
        if mask[near]:
            score[near] += 0.5 * score.max()
    return int(score.argmax())


def nearest_bins(candidates: np.ndarray, selected: int, most: int) -> np.ndarray:
    """At most ``most`` candidates nearest the selected bin, the lower one first on ties, in order."""
    by = np.lexsort((candidates, np.abs(candidates - selected)))[:most]
    return np.sort(candidates[by])


def gate(distances: np.ndarray, selected: int, half_width: float, use_gating: bool, most: int = 3) -> np.ndarray:
    if use_gating:
        own = np.flatnonzero(np.abs(distances - distances[selected]) <= max(0.0, half_width))
    else:
        own = np.arange(max(0, selected - 1), min(len(distances), selected + 2))
    return nearest_bins(own if own.size else np.array([selected]), selected, most)


def shares(amplitude: np.ndarray) -> np.ndarray:
    w = np.maximum(np.asarray(amplitude, float), 0)
    w = w if w.sum() > 0 else np.ones(len(w))
    return w / (w.sum() + 1e-12)


def aligned_mean(x: np.ndarray, weights: np.ndarray, reference: int = 0) -> np.ndarray:
    """Weighted mean of cleaned columns, each turned to the sign of the reference column."""
    cleaned = dsp.clean_columns(x)
    if not x.shape[1]:
        return np.empty(0)
    w = np.asarray(weights, float)
    w = w / (w.sum() + 1e-12) if len(w) == x.shape[1] and w.sum() > 0 else np.full(x.shape[1], 1 / x.shape[1])
    ref = cleaned[:, min(max(reference, 0), x.shape[1] - 1)]
    return (cleaned * np.where(ref @ cleaned < 0, -1.0, 1.0)) @ w


def breathing(z: np.ndarray, fs: float, bins: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(Hz, confidence, signal) of a range segment: unwrapped phase, causal band-pass, weighted spectrum."""
    if not len(z) or not len(bins) or fs <= 0:
        return 0.0, 0.0, np.empty(0)
    moved = dsp.bandpass_columns(wrapped_phase_sum(z[:, bins]), fs, FRAME_RESP_BAND)
    even = np.full(moved.shape[1], 1 / moved.shape[1])
    return (*dsp.weighted_peak(moved, even, fs, FRAME_RESP_BAND), aligned_mean(moved, even))


def presence(amplitude_ratio: float, n_bins: int, phase_ratio: float) -> tuple[float, bool]:
    score = float(np.clip((amplitude_ratio - 1) * 35 + min(n_bins, 5) * 6 + np.clip(phase_ratio, 0, 5) * 10, 0, 100))
    return score, bool(score >= 20 and (amplitude_ratio >= 1.08 or phase_ratio >= 1.30))


def quality(amplitude_ratio: float, resp_conf: float, heart_conf: float, phase_ratio: float, present: bool) -> float:
    parts = 0.18 * np.log1p(max(amplitude_ratio - 1, 0)) + 0.22 * min(resp_conf / 5, 1) + 0.22 * min(heart_conf / 5, 1) + 0.20 * min(max(phase_ratio, 0) / 4, 1)
    return float(np.clip(parts + 0.18 * present, 0, 1))


# -- live and recorded variants that the analyser doesn't use ----------------------


def weighted_bins(score, inside, ratio, selected: int, most: int = 9) -> tuple[np.ndarray, int, int]:
    """(weights, best bin, how many) of gated bins by score and vital-band energy."""
    score = np.asarray(score, float)
    if not len(score):
        return score, selected, 0
    inside = np.asarray(inside, bool).copy()
    if not inside.any():
        inside[min(max(selected, 0), len(score) - 1)] = True
    own = np.where(inside, np.maximum(score, 0), 0.0)
    if own.sum() <= 0:
        own[inside] = 1.0
    local = own[inside]
    pick = np.flatnonzero(inside & (own >= local.mean() + 0.2 * local.max()) & (np.asarray(ratio) >= 1.8))
    if not pick.size:
        pick = np.flatnonzero(inside & (own >= np.percentile(local, 65)))
    if pick.size > most:
        pick = pick[np.argsort(own[pick])[-most:]]
    weights = np.zeros(len(score))
    weights[pick] = own[pick] if own[pick].sum() > 0 else 1.0
    return weights / (weights.sum() + 1e-12), int(pick[own[pick].argmax()]), int(pick.size)


def coherent_phase(z: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phase, I, Q) of weighted bins: phase steps of the mean cross product; bins turned to the heaviest one."""
    own = np.flatnonzero(np.asarray(weights) > 0)
    if not own.size or not len(z):
        return np.empty(0), np.empty(0), np.empty(0)
    w = np.asarray(weights, float)[own]
    unit = z[:, own] / (np.abs(z[:, own]) + 1e-12)
    steps = np.angle((unit[1:] * unit[:-1].conj()) @ (w / (w.sum() + 1e-12)))
    turn = np.angle((z[:, own] * z[:, own[w.argmax()]].conj()[:, None]).mean(axis=0))
    summed = (z[:, own] * np.exp(-1j * turn)) @ w
    return dsp.clean(np.concatenate([[0.0], steps.cumsum()])), summed.real, summed.imag
