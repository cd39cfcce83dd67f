"""Many recordings at once give what each gives alone, and a bad one doesn't stop the others."""

import numpy as np
import pandas as pd
import pytest

from breathline.functions import dsp
from breathline.plans import vitals as V

LENGTHS = [300, 5, 257, 640, 639, 511, 300, 90, 310, 320, 700, 5]


def recording(n, seed, gap_ms=40.0):
    rng = np.random.default_rng(seed)
    values = {c: rng.normal(size=n) for c in ("ax", "ay", "az", "gx", "gy", "gz")}
    return pd.DataFrame({"Time_ms": gap_ms * np.arange(n)} | values)


def test_gravities_equal_gravity():
    rows = [recording(n, i) for i, n in enumerate(LENGTHS)]
    accel, gyro = ([r[names].to_numpy() for r in rows] for names in (["ax", "ay", "az"], ["gx", "gy", "gz"]))
    accel[0][0] = accel[2][7] = accel[3][600] = 0.0
    accel[4][9] = np.nan
    dt = [np.full(len(r), 0.04) for r in rows]
    for one, own in zip(map(dsp.gravity, accel, gyro, dt), dsp.gravities(accel, gyro, dt), strict=True):
        assert np.array_equal(one, own, equal_nan=True)


def test_filters_abreast_equal_one_by_one():
    rng = np.random.default_rng(1)
    slow, fast = dsp.sections(4, (0.1, 0.6), 25.0), dsp.sections(4, (0.65, 4.0), 25.0)
    columns = [rng.normal(size=(n, m)).cumsum(0) for n, m in ((300, 6), (310, 3), (640, 6), (30, 3), (33, 1), (500, 3))]
    filters = [slow, slow, slow, fast, fast, fast]
    for sos, x, own in zip(filters, columns, dsp.filter_abreast(filters, columns), strict=True):
        assert own == pytest.approx(dsp.filter_zero_phase(sos, x), abs=1e-10)


def test_recordings_abreast():
    groups = [recording(n, i) for i, n in enumerate(LENGTHS)]
    groups[5].loc[3, "ax"] = np.nan
    groups[6]["Time_ms"] *= 25  # 1 Hz: the heart band can't be told
    found = V.imu_recordings(groups)
    for one, own in zip((V.imu_recordings([g])[0] for g in groups), found, strict=True):
        assert own == (pytest.approx(one) if "error" not in one else one)
    assert ["error" in f for f in found] == [i in (1, 5, 6, 11) for i in range(len(LENGTHS))]
    assert "5 samples" in found[1]["error"]


def test_peaks_within_a_distance():
    x = np.random.default_rng(2).normal(size=400)
    kept = dsp.find_peaks(x, 15)
    assert (np.diff(kept) >= 15).all() and len(dsp.find_peaks(x)) > len(kept) > 10
