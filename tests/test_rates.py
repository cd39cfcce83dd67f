"""Rates that decide which frequencies are in a band."""

import numpy as np
import pandas as pd
import pytest

from breathline.plans import views
from breathline.plans import vitals as V


def imu(n, hz):
    t = np.arange(1, n + 1) * 50.0
    a = 1 + 0.1 * np.cos(2 * np.pi * hz * t / 1000)
    return pd.DataFrame({"Time_ms": t, "ax": a, **dict.fromkeys(["ay", "az", "gx", "gy", "gz"], 0.0)})


def test_even_gaps_give_their_rate():
    assert all(V.positive_gap_rate(np.arange(n) * 50.0, 100.0) == pytest.approx(20, rel=1e-15) for n in range(2, 2000))


def test_a_heart_rate_at_the_edge_is_found():
    assert V.imu_stat_numbers(imu(555, 4.0))["heart_bpm"] == pytest.approx(240)


def test_the_view_shows_the_same_heart_rate(spark):
    rows = spark.createDataFrame(imu(555, 4.0).assign(session_id=1, seq=range(555)))
    shown = views.imu_view(rows, None).first()
    assert shown.heart_bpm == pytest.approx(240) and shown.hz[111] == pytest.approx(4)


@pytest.mark.parametrize("n", [1100, 1200, 1400, 1800, 2000, 4000])
def test_radar_view_rates_at_the_bands_edges(n):
    """A tone at an edge of the respiration band is in the band, as by the SQL's rate."""
    t = np.arange(1, n + 1) * 50.0
    fs = 1 / ((t[-1] - t[0]) / 1000 / (n - 1))
    for edge in (0.1, 0.6):
        k = round(edge * n / 20)
        hz = k * (1 / (n * (1 / fs)))
        own = pd.DataFrame({"Timestamp_ms": t, "Voltage_mV": np.sin(2 * np.pi * k * np.arange(n) / n)})
        inside = abs(hz - edge) < 1e-9 and 0.1 <= hz <= 0.6
        assert (abs(V.radar_stat_numbers(own)["resp_bpm"] - 60 * edge) < 1e-6) == inside
