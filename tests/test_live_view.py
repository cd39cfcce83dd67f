"""The live view: target changes, late results, restarts, and its state's size."""

import pickle

import numpy as np
import pandas as pd
import pytest
from helpers import Reflector, Scene, chest

from breathline.functions import view as V
from breathline.functions.sliding import SlidingSpectrum
from breathline.streaming import live_view as L

FS = 20.0
FRAMES = "session_id string, " + L.COLUMNS[V.FRAME]
CONTROLS = "session_id string, at_ms double, " + L.COLUMNS[V.CONTROL]
RESULTS = "session_id string, at_ms double, " + L.COLUMNS[V.RESULT]


def frame_events(seconds, first=0, session="a"):
    scene = Scene([Reflector(0.74, 60, chest(0.3, 1.2)), Reflector(0.46, 40, chest(0.5, 1.6))], noise=0.2, seed=4)
    return [(session, r["timestamp_ms"], r["frame"], r["distances"].tolist(), r["real"].tolist(), r["imag"].tolist()) for r in scene.live(seconds, FS, first)]


def test_sliding_spectrum_equals_the_transform_of_the_window():
    rng = np.random.default_rng(1)
    x = rng.normal(size=2_000) * 50
    n, band = 300, (0.1, 3.0)
    s = SlidingSpectrum(n, FS, band)
    hz = np.fft.rfftfreq(n, 1 / FS)
    inside = (hz >= band[0]) & (hz <= band[1])
    for t, v in enumerate(x):
        s.push(v)
        if t % 37 == 0 or t in (0, n - 1, n, 1_999):
            window = np.concatenate([np.zeros(max(0, n - t - 1)), x[max(0, t - n + 1) : t + 1]])
            want = np.fft.rfft(window)[inside]
            assert np.abs(s.bins - want).max() < 1e-9 * max(1, np.abs(want).max())
            assert t < n or s.peak()[0] == pytest.approx(hz[inside][np.abs(want).argmax()])
    assert SlidingSpectrum(8, FS, (90, 99)).peak() == (0.0, 0.0)


def outputs(frames=(), controls=(), results=(), view=None, recent=None):
    """Events in dicts through the pure steps."""
    rows = [dict(zip([f.split()[0] for f in ddl.split(", ")], r), kind=kind) for ddl, kind, own in ((FRAMES, V.FRAME, frames), (CONTROLS, V.CONTROL, controls), (RESULTS, V.RESULT, results)) for r in own]
    for r in rows:
        r.setdefault("at_ms", r.get("timestamp_ms"))
    return V.viewed(view or V.View(), rows, V.Recent() if recent is None else recent)


def test_target_changes_reset_and_late_results_are_dropped():
    sure = (0.3, 9.0, 1.2, 30.0, 0.9, True)
    recent = V.Recent()
    view, first = outputs(frame_events(20), recent=recent)
    assert {r["trace"] for r in first} == {0} and len(first) == 400
    # Another state's target, a target without number: nothing changes.
    view, out = outputs(controls=[("a", 2e4, "DETERMINE_DISTANCE_ESTIMATE", 0.46, 0.1), ("a", 2e4, V.ESTIMATING, float("nan"), 0.1)], view=view, recent=recent)
    assert out == [] and view.request == 0
    view, out = outputs(results=[("a", 2e4, 0, *sure), ("a", 2.1e4, 7, *sure)], view=view, recent=recent)
    assert [r["tracked_heart_hz"] for r in out] == [1.2] and out[0]["shown_resp_hz"] == 0.3
    # The target counts: a new trace from the recent frames, at its bin; a result of the old request is late.
    view, out = outputs(controls=[("a", 2.2e4, V.ESTIMATING, 0.46, 0.1)], results=[("a", 2.3e4, 0, *sure)], view=view, recent=recent)
    assert out[0]["kind"] == "request" and out[0]["request_id"] == 1 and {r["kind"] for r in out[1:]} == {"trace"}
    assert len(out) == 401 and all(r["trace"] == 1 and r["target_distance_m"] == pytest.approx(0.46) for r in out)
    assert view.lock is None and view.display is None
    view, out = outputs(controls=[("a", 2.4e4, V.ESTIMATING, 0.46, 0.2)], view=view, recent=recent)
    assert out == [] and view.chain.half_width == 0.2
    view, out = outputs(results=[("a", 2.5e4, 1, *sure)], view=view, recent=recent)
    assert out[0]["tracked_heart_hz"] == 1.2
    view, out = outputs(results=[("a", 2.6e4, 1, *sure[:-1], False)], view=view, recent=recent)
    assert (out[0]["tracked_heart_hz"], out[0]["shown_resp_hz"]) == (0.0, 0.0)
    # Losing the target is a change too.
    view, out = outputs(controls=[("a", 2.7e4, "NO_PRESENCE", None, None)], view=view, recent=recent)
    assert out[0]["request_id"] == 2 and view.target is None


def test_recent_frames_are_the_horizon_and_only_changes_are_noted():
    recent = V.Recent()
    view, _ = outputs(frame_events(100), recent=recent)
    assert min(recent) == 99 - 30 and max(recent) == 99 and view.seconds == tuple(sorted(recent))
    size = len(pickle.dumps(view))
    recent.changed.clear(), recent.gone.clear()
    view, out = outputs(frame_events(1, 2_000), view=view, recent=recent)
    assert recent.changed == {100} and recent.gone == {69} and len(out) == 20
    assert abs(len(pickle.dumps(view)) - size) < 500
    _, again = outputs(frame_events(1, 2_000), view=view, recent=recent)
    assert again == []


def test_rates_of_the_trailing_window():
    _, out = outputs(frame_events(60), controls=[("a", 0.0, V.ESTIMATING, 0.74, 0.05)])
    last = out[-1]
    assert last["resp_peak_hz"] == pytest.approx(0.3, abs=0.04) and 0.65 <= last["heart_peak_hz"] <= 3.0


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    """Three runs of one query: frames, a target change, late and current results; then the same in one batch."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    sure = (0.3, 9.0, 1.2, 30.0, 0.9, True)
    frames = [frame_events(12, 0, s) for s in "ab"], [frame_events(8, 200, s) for s in "ab"], [frame_events(4, 340, s) for s in "ab"]
    controls = [], [("a", 12_500.0, V.ESTIMATING, 0.46, 0.1)], [("b", 21_000.0, "NO_PRESENCE", None, None)]
    results = [("a", 11_900.0, 0, *sure)], [("a", 15_000.0, 0, *sure), ("a", 16_000.0, 1, *sure)], [("a", 22_500.0, 1, *sure)]
    schemas = {"frames": FRAMES, "controls": CONTROLS, "results": RESULTS}
    try:
        seen = []
        for k in range(3):
            own = {"frames": [r for part in frames[k] for r in part], "controls": controls[k], "results": results[k]}
            for name, rows in own.items():
                spark.createDataFrame(rows, schemas[name]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            parts = {n: spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in schemas.items()}
            out = L.live_view(L.united(**parts), idle_ms=None).writeStream.foreachBatch(lambda b, i: seen.append(b.toPandas())).option("checkpointLocation", str(tmp_path / "cp"))
            assert out.trigger(availableNow=True).start().awaitTermination(100)
        got = pd.concat(seen)
        # With an idle time the query goes on triggering, and gives the same.
        kept = []
        query = L.live_view(L.united(**parts)).writeStream.foreachBatch(lambda b, i: kept.append(b.toPandas())).start()
        for _ in range(60):
            if sum(map(len, kept)) >= 1_090 + 4:
                break
            query.awaitTermination(1)
        query.stop()
    finally:
        spark.conf.unset(provider)
    sizes = {("a", 0): 250, ("a", 1): 420, ("b", 0): 420}
    assert pd.concat(kept).query("kind == 'trace'").groupby(["session_id", "trace"]).size().to_dict() == sizes
    rows = {n: spark.read.schema(s).parquet(str(tmp_path / n)) for n, s in schemas.items()}
    batch = L.recorded_view(L.united(**rows)).toPandas()
    order = ["session_id", "trace", "kind", "frame", "request_id"]
    rates = lambda df: df[df.kind != "trace"].sort_values(order)[[*order, "shown_resp_hz", "tracked_heart_hz"]].to_dict("records")
    assert repr(rates(got)) == repr(rates(batch)) and len(rates(got)) == 4
    trace = lambda df: df[df.kind == "trace"].sort_values(order).reset_index(drop=True)
    a, b = trace(got), trace(batch)
    assert a.groupby(["session_id", "trace"]).size().to_dict() == sizes
    b0 = b[(b.session_id == "b")]
    assert a[a.session_id == "b"].resp_signal.to_numpy() == pytest.approx(b0.resp_signal.to_numpy(), abs=1e-9)
    # The first frames' spectra are flat: their peaks are ties.
    assert a[a.session_id == "b"].resp_peak_hz.to_numpy()[150:] == pytest.approx(b0.resp_peak_hz.to_numpy()[150:], abs=1e-6)
