"""Analysers on scenes with known rates."""

import numpy as np
import pandas as pd
import pytest
from helpers import RANGE, Reflector, Scene, chest, wave

from breathline.functions.live import LiveTrace
from breathline.plans import vitals as V


def person(at=0.74, strength=60.0):
    return Reflector(at, strength, chest(breath_hz=0.3, heart_hz=1.1))


def doppler(hz=7.0, fs=80.0, seconds=16):
    t = np.arange(round(fs * seconds)) / fs
    volts = 900 + 30 * np.cos(2 * np.pi * hz * t) + 5 * np.sin(2 * np.pi * 0.3 * t)
    return pd.DataFrame({"Timestamp_ms": 1000 * t + 5_000, "RawADC": np.round(volts), "Voltage_mV": volts})


def lying_sensor(fs=60.0, seconds=40, breath_hz=0.2, heart_hz=1.5):
    """A sensor on a chest: it tilts with every breath and shakes with every beat."""
    t = np.arange(round(fs * seconds)) / fs
    tilt = np.radians(3) * np.sin(2 * np.pi * breath_hz * t)
    turn = np.degrees(np.gradient(tilt, t))
    beat = 0.004 * np.sin(2 * np.pi * heart_hz * t)
    return pd.DataFrame({"Time_ms": 1000 * t, "ax": np.sin(tilt) + beat, "ay": 0.4 * beat, "az": np.cos(tilt), "gx": 0.0, "gy": turn, "gz": 0.0})


def test_doppler_peak_and_rate():
    found = V.radar_numbers(doppler())
    assert found["sample_rate_hz"] == pytest.approx(80) and found["peak_frequency_hz"] == pytest.approx(7, abs=0.07)
    assert found["peak_speed_mps"] == pytest.approx(found["peak_frequency_hz"] / 70.16)
    stats = V.radar_stat_numbers(doppler())
    assert stats["peak_hz"] == pytest.approx(7, abs=0.07) and stats["resp_bpm"] == pytest.approx(18, abs=4)


def test_breaths_and_beats_of_a_lying_sensor():
    found = V.imu_numbers(lying_sensor())
    assert found["sample_rate_hz"] == pytest.approx(60)
    assert found["respiratory_bpm"] == pytest.approx(12, abs=2) and found["heart_bpm"] == pytest.approx(90, abs=2)
    assert V.imu_stat_numbers(lying_sensor())["accel_rms_g"] == pytest.approx(1, abs=0.01)


def test_sessions_in_one_pass_and_errors(spark, monkeypatch):
    """A recording that is too short, and one whose analysis breaks in any other way, don't stop the others."""
    parts = [doppler().assign(session_id="fine"), doppler().head(7).assign(session_id="short"), doppler().head(40).assign(session_id="broken")]
    rows = pd.concat(parts).reset_index(drop=True)
    df = spark.createDataFrame(rows.assign(seq=np.arange(len(rows))))

    def analyse(group):
        if len(group) == 40:
            raise ZeroDivisionError("no rate")
        return V.radar_numbers(group)

    found = {r.session_id: r for r in V._by_session(df, "session_id", ["Timestamp_ms", "Voltage_mV"], analyse, V._numbers(V.RADAR_RESULT)).collect()}
    assert found["fine"].error is None and found["fine"].peak_frequency_hz == pytest.approx(7, abs=0.07)
    assert found["short"].error == "7 samples are fewer than 10"
    assert found["broken"].error == "ZeroDivisionError: no rate" and found["broken"].sample_rate_hz is None
    assert {r.session_id: r.error for r in V.radar_vitals(df).collect()}["broken"] is None


@pytest.mark.parametrize("background", [0, 40 - 70j])
def test_person_before_a_background(background):
    found = V.frame_numbers(Scene([person()], background, noise=0.4, seed=3).recording(48))
    assert found["present"] and found["target_distance_m"] == pytest.approx(0.74, abs=0.021)
    assert found["resp_bpm"] == pytest.approx(18, abs=0.5) and found["heart_bpm"] == pytest.approx(66, abs=1)
    assert len(found["resp_signal"]) == len(found["heart_signal"]) == len(found["times_s"])


def test_given_target_wins_over_a_stronger_one():
    scene = Scene([Reflector(0.5, 20, chest()), Reflector(1.1, 90, wave(0.3, 0.2))], noise=0.2)
    found = V.frame_numbers(scene.recording(12), target_distance_m=0.5, gate_half_width_m=0.06, auto_gate=False)
    assert found["peak_distance_m"] == pytest.approx(1.1, abs=0.021) and found["target_distance_m"] == pytest.approx(0.5)
    assert found["gate_min_m"] < 0.5 < found["gate_max_m"]


def test_fan_behind_a_person():
    scene = Scene([Reflector(0.58, 55, chest()), Reflector(1.2, 12, wave(1.5, 1.7))], noise=0.5, seed=9)
    assert V.frame_numbers(scene.recording(24), gate_half_width_m=0.06)["target_distance_m"] == pytest.approx(0.58, abs=0.021)


def test_target_that_moved_on_without_gating():
    scene = Scene([Reflector(0.9, 50, chest()), Reflector(0.44, 15)], noise=0.5, seed=2)
    assert V.frame_numbers(scene.recording(30), target_distance_m=0.44, use_gating=False)["target_distance_m"] == pytest.approx(0.9, abs=0.021)


def test_no_rates_without_time_or_motion():
    assert V.frame_numbers(Scene([person()], noise=0.3).recording(9))["resp_bpm"] == 0
    chair = V.frame_numbers(Scene([Reflector(0.66, 50)], noise=1.0, seed=5).recording(48), use_gating=False)
    assert chair["resp_bpm"] == 0 and chair["heart_bpm"] == 0


def test_recordings_without_profiles():
    full = Scene([person()], noise=0.1).recording(48)
    found = V.frame_numbers(full.drop(columns=["Real", "Imag"]))
    assert found["present"] and found["resp_bpm"] == pytest.approx(18, abs=0.6) and found["selected_index"] == 0
    assert V.frame_numbers(full.drop(columns=["Real", "Imag", "PeakPhase_rad"]))["sample_rate_hz"] == 0
    assert V.frame_numbers(full.head(0))["present"] is False


def test_ragged_arrays_become_an_error(spark):
    rows = Scene([person()]).recording(1)
    rows.at[11, "Imag"] = rows.at[11, "Imag"][:-3]
    df = spark.createDataFrame(rows.assign(session_id=1, seq=rows.Frame).map(lambda v: v.tolist() if isinstance(v, np.ndarray) else v))
    assert "different lengths" in V.frame_vitals(df).collect()[0].error


def test_numbers_that_only_helpers_give():
    """Bands, harmonics, entropy and components that the analysers use inside."""
    from breathline.functions import dsp

    fs = 25.0
    t = np.arange(1_500) / fs
    x = np.sin(2 * np.pi * 0.4 * t) + 0.6 * np.sin(2 * np.pi * 0.8 * t) + 0.2 * np.sin(2 * np.pi * 1.3 * t)
    hz, power = dsp.band_spectrum(x, fs, (0.1, 3.0))
    assert hz[power.argmax()] == pytest.approx(0.4, abs=0.03)
    rest = dsp.without_harmonics(x, fs, 0.4)
    hz, power = dsp.band_spectrum(rest, fs, (0.65, 3.0))
    assert hz[power.argmax()] == pytest.approx(1.3, abs=0.03)
    assert dsp.spectral_entropy(x, fs, (0.1, 3.0)) < 0.6 < dsp.spectral_entropy(np.random.default_rng(0).normal(size=1_500), fs, (0.1, 3.0))
    steady = dsp.static_clutter(np.full((400, 3), 2 - 1j), fs, 0.1)
    assert steady[-1] == pytest.approx(np.full(3, 2 - 1j), abs=0.05)
    assert dsp.remove_polynomial(5 + t - 0.3 * t**2 + 0.01 * t**3) == pytest.approx(np.zeros(1_500), abs=1e-6)
    wobble = np.stack([3 * x, -x, 0.1 * x], axis=1)
    along, share = dsp.first_component(wobble)
    assert share == pytest.approx(1) and along == pytest.approx(x * np.sqrt(10.01))


# -- live traces ------------------------------------------------------------------------


def test_live_gate_keeps_the_breath():
    scene = Scene([Reflector(0.6, 100, wave(0.35, 0.22), width=0.05)], noise=0.3)
    out = LiveTrace(target_m=0.6, use_gating=True, half_width=0.12).feed(scene.live(26))
    late = np.array([r["resp_signal"] for r in out if r["time_s"] > 18])
    assert late.std() > 0.04 and all(r["target_distance_m"] == pytest.approx(0.6) for r in out)


def test_live_is_append_only_and_drops_late_frames():
    rows = Scene([person(strength=45)], noise=0.2).live(10)
    whole, parts = LiveTrace().feed(rows), LiveTrace()
    first = parts.feed(rows[:140])
    both = first + parts.feed(rows[90:])
    assert both[:140] == first and len(both) == len(rows)
    assert [r["heart_signal"] for r in both] == pytest.approx([r["heart_signal"] for r in whole])


def test_live_restarts_on_other_bins():
    trace = LiveTrace()
    trace.feed(Scene([person()]).live(2))
    again = trace.feed(Scene([person()], distances=RANGE[:30]).live(1, first=50))
    assert again[0]["time_s"] == 0 and len(again) == 25
