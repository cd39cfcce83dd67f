"""Rate trackers: as steps, as folds over recordings, as streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathline.functions.trackers import Display, display_step, heart_step, predicted, search_band
from breathline.operators import folds
from breathline.streaming import live


def stepped(step, measurements, state=None):
    out = []
    for m in measurements:
        state, value = step(state, *m)
        out.append(value)
    return state, out


def test_prediction_is_that_of_matrices():
    lock, _ = stepped(heart_step, [(1.4, 1, 20, 1), (1.5, 0.7, 18, 0.9), (1.45, 1.1, 30, 0.5)])
    for dt in (0.05, 0.4, 2.0):
        move = np.array([[1, dt, dt * dt / 2], [0, 1, dt], [0, 0, 1]])
        push = np.array([dt * dt / 2, dt, 1])
        upper = np.triu_indices(3)
        full = np.zeros((3, 3))
        full[upper] = lock.cov
        full = full + np.triu(full, 1).T
        ahead = predicted(lock, dt)
        assert ahead.mean == pytest.approx(tuple(move @ lock.mean))
        assert ahead.cov == pytest.approx(tuple((move @ full @ move.T + 0.065**2 * np.outer(push, push))[upper]))


def test_heart_rate_locks_follows_and_lets_go():
    assert stepped(heart_step, [(1.3, 1, 13.9, 1), (1.3, 1, 50, 0.2), (0.4, 1, 50, 1)]) == (None, [0, 0, 0])
    lock, out = stepped(heart_step, [(1.3, 1, 14, 0.25)])
    assert out == [1.3]
    followed, out = stepped(heart_step, [(1.3 + 0.01 * k, 1, 25, 1) for k in range(20)], lock)
    assert abs(out[-1] - 1.49) < 0.03 and np.all(np.diff(out) > -0.01)
    jumped, out = stepped(heart_step, [(2.8, 0.1, 25, 1)], followed)
    assert abs(out[0] - 1.49) < 0.05 and jumped.missed == 1  # beyond the gate
    _, out = stepped(heart_step, [(2.8, 0.1, 25, 1)] * 5, followed)
    assert out[3] < 1.8 and out[4] > 2.0  # the gate opens
    gone, out = stepped(heart_step, [(0.0, 1, 0, 0)] * 12, followed)
    assert gone is None and out[-1] == 0 and all(out[:11])


def test_search_band_follows_the_lock():
    lock, _ = stepped(heart_step, [(1.6, 1, 20, 1)] * 6)
    low, high = search_band(lock)
    assert low < 1.6 < high and high - low == pytest.approx(0.8, abs=1e-6)
    assert search_band(None) == (0.65, 3.0)
    wide, _ = stepped(heart_step, [(0, 2, 0, 0)] * 9, lock)
    assert search_band(wide)[1] - search_band(wide)[0] > 2


@pytest.mark.parametrize(("given", "shown"), [
    ([(0.21, 4.0)], [0]),
    ([(0.21, 4.0), (0.25, 4.0)], [0, 0.25]),
    ([(0.21, 4.0), (0.31, 4.0), (0.30, 4.0)], [0, 0, 0.30]),
    ([(0.21, 8.0), (0.29, 4.0), (0.29, 8.0)], [0.21, 0.218, 0.2324]),
    ([(0.21, 8.0), *[(0.5, 9.0)] * 3, (0.22, 9.0), *[(0.5, 9.0)] * 4], [0.21, 0.21, 0.21, 0.21, 0.212, 0.212, 0.212, 0.212, 0.5]),
    ([(0.21, 8.0), *[(0.21, 3.9)] * 41, (0.21, 4.0), (0.21, 4.0)], [*[0.21] * 41, 0, 0, 0.21]),
    ([(0.05, 9.0), (1.2, 9.0)], [0, 0]),
])
def test_display(given, shown):
    assert stepped(display_step, [(hz, c, 0.25, True) for hz, c in given])[1] == pytest.approx(shown)


def test_display_clears_at_once_when_nobody_is_there():
    state, out = stepped(display_step, [(0.3, 9, 1, True), (0.3, 9, 1, False)])
    assert out == [0.3, 0.0] and state == Display()


# -- folds and streams -----------------------------------------------------------------


def measurements(spark):
    rows = []
    for s in ("a", "b"):
        for k in range(60):
            rate = 1.2 + 0.004 * k + (0.9 if k % 13 == 5 else 0)
            rows.append((s, k, rate, 1.0, 20.0 if k % 7 else 3.0, 0.8, k < 50 or s == "a"))
    return spark.createDataFrame(rows, "session_id string, seq long, hz double, dt_s double, confidence double, quality double, present boolean")


def test_folds_are_the_steps(spark):
    df = measurements(spark)
    rows = df.where("session_id = 'a'").orderBy("seq").collect()
    got = [r.tracked_hz for r in folds.kalman_track(df).where("session_id = 'a'").orderBy("seq").collect()]
    assert got == stepped(heart_step, [(r.hz, r.dt_s, r.confidence, r.quality) for r in rows])[1]


@pytest.mark.parametrize("name", ["heart", "respiration"])
def test_streams_equal_folds(spark, tmp_path, name):
    """Whatever the cut into batches; repeated and late measurements are dropped."""
    df = measurements(spark).withColumn("hz", F.col("hz") / (1 if name == "heart" else 4))
    fold, stream, out = (folds.kalman_track, live.live_heart_rates, "tracked_hz") if name == "heart" else (folds.stabilise_rate, live.live_respiration_rates, "shown_hz")
    source, seen = str(tmp_path / "in"), []
    for part in ("seq < 23", "seq between 15 and 40", "seq > 40", "seq between 3 and 9"):
        df.where(part).coalesce(1).write.mode("append").parquet(source)
        query = stream(spark.readStream.schema(df.schema).parquet(source), idle=None).writeStream.foreachBatch(lambda b, k: seen.extend(b.collect()))
        assert query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    want = {(r.session_id, r.seq): r[out] for r in fold(df).collect()}
    assert {(r.session_id, r.seq): r[out] for r in seen} == want and len(seen) == len(want)


def test_exponential_average_is_a_weighted_sum(spark):
    rng = np.random.default_rng(2)
    rows = [(s, k, float(v)) for s in range(3) for k, v in enumerate(rng.normal(size=(1, 2, 500)[s]))]
    got = {r.session_id: r.ema for r in folds.ema_last(spark.createDataFrame(rows, "session_id int, seq int, x double"), "x", 10.0, 3.0).collect()}
    keep = math.exp(-1 / 30)
    for s in range(3):
        own = [x for t, _, x in rows if t == s]
        e = own[0]
        for x in own[1:]:
            e = keep * e + (1 - keep) * x
        assert got[s] == pytest.approx(e, abs=1e-12)
