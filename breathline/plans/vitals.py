"""Analysers of whole recordings, one row for each session.

Every analyser takes a DataFrame of samples of any number of sessions and groups
it once by session; within a group rows are ordered by ``seq`` (the order in which
they were stored). A session that can't be analysed gives a row with ``error``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..constants import (
    DOPPLER_HZ_PER_MPS,
    FRAME_RESP_BAND,
    GATE_HALF_WIDTH,
    HEART_BAND,
    HEART_CONFIDENCE_MIN,
    IMU_HEART_BAND,
    IMU_RESP_BAND,
    RATE_WINDOW_S,
    RESP_CONFIDENCE_MIN,
)
from ..functions import dsp, frames
from ..operators.grouped import per_session, per_sessions

RADAR_RESULT = ["sample_rate_hz", "peak_frequency_hz", "peak_speed_mps"]
IMU_RESULT = ["sample_rate_hz", "respiratory_bpm", "displacement_bpm", "heart_bpm"]
RADAR_STATS = ["sample_rate_hz", "peak_hz", "resp_bpm", "speed_mps"]
IMU_STATS = ["sample_rate_hz", "accel_rms_g", "gyro_rms_dps", "resp_bpm", "heart_bpm"]
FRAME_NUMBERS = [
    "sample_rate_hz", "target_distance_m", "gate_min_m", "gate_max_m", "peak_distance_m", "peak_amplitude", "mean_amplitude", "presence_score",
    "resp_bpm", "heart_bpm", "resp_hz", "heart_hz", "resp_confidence", "heart_confidence", "signal_quality",
]
FRAME_TRACES = ["times_s", "raw_phase", "resp_signal", "heart_signal", "raw_i", "raw_q", "distances_m", "latest_amplitude"]
FRAME_STATS = ["sample_rate_hz", "peak_distance_m", "peak_amplitude", "mean_amplitude", "target_distance_m", "gate_min_m", "gate_max_m", "presence_score", "present", "resp_bpm", "heart_bpm"]


def _numbers(names: list[str]) -> str:
    return ", ".join(f"{n} double" for n in names)


def _attempt(analyse: Callable[..., dict], *parts) -> dict:
    """What ``analyse`` gives, or its failure, of whatever kind, as ``error``: a bad recording must not stop the others."""
    try:
        return analyse(*parts)
    except Exception as e:
        return {"error": str(e) if isinstance(e, ValueError) else f"{type(e).__name__}: {e}"}


def _by_session(samples: DataFrame, key: str, columns: list[str], analyse: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """``analyse`` over each session's rows in order; its failure, of whatever kind, becomes the row's ``error``."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(rows: pd.DataFrame) -> dict:
        row = _attempt(analyse, rows)
        return {n: [row.get(n)] for n in [*names, "error"]}

    return per_session(samples, columns, run, f"{schema}, error string", key)


def _enough(group: pd.DataFrame, least: int = 10) -> None:
    if len(group) < least:
        raise ValueError(f"{len(group)} samples are fewer than {least}")


# -- scalar radar --------------------------------------------------------------


def radar_numbers(group: pd.DataFrame) -> dict[str, float]:
    """Rate over all gaps, strongest Welch frequency above 0, Doppler speed."""
    _enough(group)
    group = group.sort_values("Timestamp_ms", kind="stable")
    t = group["Timestamp_ms"].to_numpy(float) / 1000
    mean_gap = (t[-1] - t[0]) / (len(t) - 1)
    fs = 1 / mean_gap if mean_gap > 0 else 500.0
    volts = group["Voltage_mV"].to_numpy(float)
    f, p = dsp.welch(volts - volts.mean(), fs, 4096)
    peak = float(f[1:][p[1:].argmax()]) if len(p) > 1 else 0.0
    return {"sample_rate_hz": fs, "peak_frequency_hz": peak, "peak_speed_mps": peak / DOPPLER_HZ_PER_MPS}


def radar_vitals(samples: DataFrame, key: str = "session_id") -> DataFrame:
    return _by_session(samples, key, ["Timestamp_ms", "Voltage_mV"], radar_numbers, _numbers(RADAR_RESULT))


def positive_gap_rate(times_ms: np.ndarray, default: float) -> float:
    gaps = np.diff(times_ms)
    gaps = gaps[gaps > 0]  # summed in milliseconds: a rate that is off by a rounding moves frequencies over a band's edge
    return float(1 / (gaps.sum() / 1000 / gaps.size)) if gaps.size else default


def _top_in(f: np.ndarray, p: np.ndarray, low: float, high: float) -> float:
    inside = (f >= low) & (f <= high)
    return float(f[inside][p[inside].argmax()]) if inside.any() else 0.0


def _hann_spectrum(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    return np.fft.rfftfreq(len(x), 1 / max(fs, 1e-9)), np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x))))


def radar_stat_numbers(group: pd.DataFrame) -> dict[str, float]:
    """Statistics of a stored session, over its last 4,096 samples."""
    fs = positive_gap_rate(group["Timestamp_ms"].to_numpy(float), 500.0)
    volts, peak, resp = group["Voltage_mV"].to_numpy(float), 0.0, 0.0
    if len(volts) > 32:
        f, p = _hann_spectrum(volts[-4096:], fs)
        peak, resp = _top_in(f, p, 0.05, np.inf), 60 * _top_in(f, p, *IMU_RESP_BAND)
    return {"sample_rate_hz": fs, "peak_hz": peak, "resp_bpm": resp, "speed_mps": peak / DOPPLER_HZ_PER_MPS}


def radar_stats(samples: DataFrame, key: str = "session_id") -> DataFrame:
    return _by_session(samples, key, ["Timestamp_ms", "Voltage_mV"], radar_stat_numbers, _numbers(RADAR_STATS))


# -- accelerometer and gyroscope -----------------------------------------------------

_AXES, _TURNS = ["ax", "ay", "az"], ["gx", "gy", "gz"]


@lru_cache(maxsize=64)
def _imu_filters(fs: float) -> tuple[np.ndarray, np.ndarray]:
    return dsp.sections(4, IMU_RESP_BAND, fs), dsp.sections(4, IMU_HEART_BAND, fs)


def _columns(group: pd.DataFrame, names: list[str]) -> np.ndarray:
    return np.stack([group[c].to_numpy(float) for c in names], axis=1)


def _imu_series(group: pd.DataFrame) -> dict:
    """What the analyser reads of a recording, and its filters; rows aren't sorted by time."""
    _enough(group)
    t = group["Time_ms"].to_numpy(float)
    t = (t - t[0]) / 1000
    gaps = np.diff(t)
    fs = float(1 / gaps.mean()) if gaps.mean() > 0 else 100.0
    slow, fast = _imu_filters(fs)
    if len(t) <= (pad := dsp.extension(slow)):
        raise ValueError(f"{len(t)} samples are too few for an extension of {pad}")
    return {"t": t, "fs": fs, "slow": slow, "fast": fast, "gaps": np.concatenate([[gaps.mean()], gaps]), "accel": _columns(group, _AXES), "gyro": _columns(group, _TURNS)}


def _imu_rates(own: dict, down: np.ndarray, beat: np.ndarray) -> dict[str, float]:
    """Breath counts from tilt and displacement, heart rate from the spectrum. ``down``: filtered axes, then gravity's."""
    t, fs = own["t"], own["fs"]
    motion, tilt = dsp.first_component(down[:, :3])[0], np.degrees(dsp.first_component(down[:, 3:])[0])
    beat = dsp.first_component(beat)[0]
    f, p = np.fft.rfftfreq(len(beat), 1 / fs), np.abs(np.fft.rfft(beat - beat.mean()))
    path = dsp.remove_line(dsp.running_integral(dsp.running_integral(motion, t), t))
    distance, minutes = max(1, int(1.5 * fs)), max(t[-1] / 60, 1e-9)
    return {
        "sample_rate_hz": fs,
        "respiratory_bpm": dsp.count_peaks(tilt, distance, 0.0005) / minutes,
        "displacement_bpm": dsp.count_peaks(path, distance) / minutes,
        "heart_bpm": 60 * _top_in(f, p, *IMU_HEART_BAND),
    }


def imu_recordings(groups: list[pd.DataFrame]) -> list[dict]:
    """Numbers or the error of each recording; what runs along rows does so for all of them at once."""
    found = [_attempt(_imu_series, g) for g in groups]
    own = [f for f in found if "error" not in f]
    down = dsp.gravities(*([f[n] for f in own] for n in ("accel", "gyro", "gaps")))
    slow = dsp.filter_abreast([f["slow"] for f in own], [np.hstack([f["accel"], d]) for f, d in zip(own, down)])
    fast = dsp.filter_abreast([f["fast"] for f in own], [f["accel"] for f in own])
    rates = iter([_attempt(_imu_rates, *parts) for parts in zip(own, slow, fast)])
    return [f if "error" in f else next(rates) for f in found]


def imu_numbers(group: pd.DataFrame) -> dict[str, float]:
    """Those of one recording; ValueError where it can't be analysed."""
    found = imu_recordings([group])[0]
    if "error" in found:
        raise ValueError(found["error"])
    return found


def imu_vitals(samples: DataFrame, key: str = "session_id") -> DataFrame:
    whole = lambda groups: [{n: [row.get(n)] for n in [*IMU_RESULT, "error"]} for row in imu_recordings(groups)]
    return per_sessions(samples, ["Time_ms", *_AXES, *_TURNS], whole, f"{_numbers(IMU_RESULT)}, error string", key)


def imu_stat_numbers(group: pd.DataFrame) -> dict[str, float]:
    fs = positive_gap_rate(group["Time_ms"].to_numpy(float), 100.0)
    size, turn = (np.linalg.norm(group[c].to_numpy(float), axis=1) for c in (_AXES, _TURNS))
    resp = heart = 0.0
    if len(size) > 32:
        f, p = _hann_spectrum(size, fs)
        resp, heart = 60 * _top_in(f, p, *IMU_RESP_BAND), 60 * _top_in(f, p, *IMU_HEART_BAND)
    rms = lambda x: float(np.sqrt((x * x).mean()))
    return {"sample_rate_hz": fs, "accel_rms_g": rms(size), "gyro_rms_dps": rms(turn), "resp_bpm": resp, "heart_bpm": heart}


def imu_stats(samples: DataFrame, key: str = "session_id") -> DataFrame:
    return _by_session(samples, key, ["Time_ms", *_AXES, *_TURNS], imu_stat_numbers, _numbers(IMU_STATS))


# -- range profiles -------------------------------------------------------------------


def _last(group: pd.DataFrame, name: str) -> float:
    return float(group[name].iloc[-1]) if name in group else 0.0


def _array(value) -> np.ndarray:
    return np.asarray(value, float) if value is not None else np.empty(0)


def _matrix(group: pd.DataFrame, name: str) -> np.ndarray:
    """Rows of equal length; ValueError where they differ."""
    rows = [_array(v) for v in group[name]]
    if len({len(r) for r in rows}) > 1:
        raise ValueError(f"{name} has arrays of different lengths")
    return np.stack(rows)


def nothing_found(group: pd.DataFrame | None) -> dict:
    """The result without an analysis: latest scalars, no rates."""
    at = _last(group, "PeakDistance_m") if group is not None and len(group) else 0.0
    known = {n: _last(group, c) if group is not None and len(group) else 0.0 for n, c in (("peak_amplitude", "PeakAmplitude"), ("mean_amplitude", "MeanAmplitude"))}
    return {n: 0.0 for n in FRAME_NUMBERS} | {n: [] for n in FRAME_TRACES} | known | {
        "target_distance_m": at, "peak_distance_m": at, "gate_min_m": max(0.0, at - GATE_HALF_WIDTH), "gate_max_m": at + GATE_HALF_WIDTH,
        "present": False, "selected_index": 0, "candidate_bins": 0,
    }


def frame_numbers(
    group: pd.DataFrame,
    gate_half_width_m: float = GATE_HALF_WIDTH,
    max_frames: int | None = 900,
    target_distance_m: float | None = None,
    heart_prior_hz: float | None = None,
    heart_prior_std_hz: float | None = None,
    use_gating: bool = True,
    auto_gate: bool = True,
) -> dict:
    """Presence, target, respiration and heart rate of one recording; ``auto_gate`` has no effect.

    Of its last ``max_frames`` frames, or of all with None.
    """
    if not len(group) or "Timestamp_ms" not in group:
        return nothing_found(group)
    rows = group.sort_values("Frame" if "Frame" in group else "Timestamp_ms", kind="stable")
    rows = rows if max_frames is None else rows.tail(max_frames)
    times = rows["Timestamp_ms"].to_numpy(float)
    fs = frames.sample_rate(times)
    seconds = frames.time_axis(times, fs)
    result = nothing_found(rows) | {"sample_rate_hz": fs}
    if {"Real", "Imag"} <= set(rows):
        re, im = _matrix(rows, "Real"), _matrix(rows, "Imag")
        distances = _array(rows["Distances_m"].iloc[-1]) if "Distances_m" in rows else np.empty(0)
        m = min(re.shape[1], im.shape[1], len(distances) or re.shape[1])
        if m:
            z = re[:, :m] + 1j * im[:, :m]
            distances = distances[:m] if len(distances) else np.arange(m, dtype=float)
            return result | _from_profiles(z, distances, seconds, fs, _last(rows, "PeakDistance_m"), max(0.01, float(gate_half_width_m)), target_distance_m, (heart_prior_hz, heart_prior_std_hz), use_gating)
    if "PeakPhase_rad" not in rows:
        return nothing_found(rows)
    return result | _from_phase(rows, seconds, fs, gate_half_width_m, target_distance_m, (heart_prior_hz, heart_prior_std_hz))


def _gated(resp: tuple[float, float], heart: tuple[float, float], length_s: float, present: bool) -> dict[str, float]:
    """Rates that are long and sure enough; without presence there are none."""
    (resp_hz, resp_conf), (heart_hz, heart_conf) = resp, heart
    if not present:
        resp_conf = heart_conf = 0.0
    resp_hz = resp_hz if length_s >= RATE_WINDOW_S and resp_conf >= RESP_CONFIDENCE_MIN else 0.0
    heart_hz = heart_hz if heart_conf >= HEART_CONFIDENCE_MIN else 0.0
    return {"resp_hz": resp_hz, "heart_hz": heart_hz, "resp_bpm": 60 * resp_hz, "heart_bpm": 60 * heart_hz, "resp_confidence": resp_conf, "heart_confidence": heart_conf}


def _heart(source, fs: float, prior, reject, zero_phase: bool) -> tuple[np.ndarray, tuple[float, float]]:
    """The heart's part of a phase and its (Hz, confidence)."""
    signal = dsp.bandpass_columns(source, fs, HEART_BAND, 3, zero_phase)[:, 0]
    return signal, dsp.fused_peak(signal, fs, dsp.heart_band(*prior), reject)


def _around(at: float, half_width: float) -> dict[str, float]:
    return {"target_distance_m": at, "gate_min_m": at - half_width, "gate_max_m": at + half_width}


def _steadiness(amplitude: np.ndarray) -> float:
    """Presence by amplitudes alone, 0 to 100: their middle against their middle and spread."""
    middle = np.median(amplitude)
    spread = 1.4826 * np.median(np.abs(amplitude - middle))
    return float(np.clip(40 * middle / (spread + middle + 1e-9), 0, 100))


def _from_profiles(z, distances, seconds, fs, latest_peak, half_width, target_m, prior, use_gating) -> dict:
    band = dsp.band_for_rate(FRAME_RESP_BAND, fs)
    moving = z - dsp.static_clutter(z, fs, (band or FRAME_RESP_BAND)[0])
    amplitude = np.abs(moving)
    smooth = dsp.moving_amplitude(amplitude, fs)[-1]
    typical = np.median(amplitude, axis=0)
    phase = frames.differential_phase(frames.centred(z)[0])
    ratio = frames.energy_ratio(phase, fs)
    at = frames.target_bin(distances, typical, ratio, target_m, bool(use_gating), latest_peak)
    bins = frames.gate(distances, at, half_width, bool(use_gating))
    weights = frames.shares(smooth[bins])
    reference = int(np.flatnonzero(bins == at)[0]) if at in bins else int(weights.argmax())
    length = len(z) / max(fs, 1e-9)
    resp_hz, resp_conf, resp_signal = frames.breathing(z, fs, bins)
    sure = length >= RATE_WINDOW_S and resp_conf >= RESP_CONFIDENCE_MIN and 0.9 * FRAME_RESP_BAND[0] <= resp_hz <= min(1.05 * FRAME_RESP_BAND[1], 0.46 * fs)
    heart_signal, heart = _heart(frames.aligned_mean(phase[:, bins], weights, reference), fs, prior, dsp.harmonics(resp_hz) if sure else (), True)
    floor = np.median(typical[frames.beyond_leakage(distances)]) + 1e-12
    amp_ratio, phase_ratio = float(typical[at] / floor), float(ratio[at])
    score, present = frames.presence(amp_ratio, len(bins), phase_ratio)
    rates = _gated((resp_hz, resp_conf), heart if length >= 10 else (0.0, 0.0), length, present)
    n = min(len(seconds), len(resp_signal), len(heart_signal))
    tail = lambda x: x[len(x) - n :]
    return rates | {
        **_around(float(distances[at]), half_width), "presence_score": score, "present": present, "selected_index": at, "candidate_bins": len(bins),
        "signal_quality": frames.quality(amp_ratio, rates["resp_confidence"], rates["heart_confidence"], phase_ratio, present),
        "times_s": tail(seconds), "resp_signal": tail(resp_signal), "heart_signal": tail(heart_signal),
        "raw_phase": phase[:, at], "raw_i": moving[:, at].real, "raw_q": moving[:, at].imag, "distances_m": distances, "latest_amplitude": smooth,
    }


def _from_phase(rows, seconds, fs, half_width, target_m, prior) -> dict:
    """Rates from the peak's phase alone, where a recording has no profiles: one bin, whose amplitudes tell presence."""
    values = {n: rows[c].to_numpy(float) for n, c in (("phase", "PeakPhase_rad"), ("amplitude", "PeakAmplitude"), ("distance", "PeakDistance_m")) if c in rows}
    phase, length = dsp.clean(np.unwrap(values["phase"])), len(rows) / max(fs, 1e-9)
    signal = dsp.bandpass_columns(phase, fs, FRAME_RESP_BAND)[:, 0]
    resp = dsp.weighted_peak(signal, [1.0], fs, FRAME_RESP_BAND)
    multiples = resp[0] * np.arange(2, 7)
    heart_signal, heart = _heart(dsp.without_harmonics(phase, fs, resp[0]), fs, prior, multiples, False)
    score = _steadiness(values.get("amplitude", np.zeros(1)))
    present = score >= 20
    rates = _gated(resp, (heart[0] * (length >= 10), heart[1]), length, present)
    sure = np.minimum([rates["resp_confidence"] / 5, rates["heart_confidence"] / 5, float(present)], 1)
    at = float(np.median(values.get("distance", np.zeros(1)))) if target_m is None else float(target_m)
    traces = {"times_s": seconds, "raw_phase": phase, "resp_signal": signal, "heart_signal": heart_signal}
    return rates | traces | _around(at, half_width) | {"presence_score": score, "present": present, "candidate_bins": 1, "signal_quality": float(sure.sum() / 4)}


def frame_vitals(samples: DataFrame, key: str = "session_id", traces: bool = False, **options) -> DataFrame:
    """Scalars of each session, and its traces if asked for; array columns hold arrays of doubles."""
    schema = _numbers(FRAME_NUMBERS) + ", present boolean, selected_index int, candidate_bins int" + "".join(f", {n} array<double>" for n in FRAME_TRACES) * traces
    columns = [c for c in samples.columns if c not in (key, "seq")]
    return _by_session(samples, key, columns, lambda g: frame_numbers(g, **options), schema)


def frame_stats(samples: DataFrame, key: str = "session_id", max_frames: int | None = 1200) -> DataFrame:
    """The eleven numbers that are stored with a session, of its last frames or of all."""
    columns = [c for c in samples.columns if c not in (key, "seq")]

    def analyse(group: pd.DataFrame) -> dict:
        found = frame_numbers(group, max_frames=max_frames)
        return found | {"present": float(found["present"])}

    return _by_session(samples, key, columns, analyse, _numbers(FRAME_STATS))
