import numpy as np
import pytest
from pyspark.sql import functions as F

from breathline.operators.sweeps import frame_rows
from breathline.sources.frame_files import SCHEMA, Layout, SweepFiles, encoded


def plain(iq, distances, ticks, layout):
    """Rows of one session by loops over results."""
    rows, first = [], None
    for k, (tick, block) in enumerate(zip(ticks, iq)):
        z = block[0, ..., 0] + 1j * block[0, ..., 1]
        z = sum(z[1:], z[0]) / len(z)
        size = np.abs(z)
        if np.isfinite(tick):
            first = tick if first is None else first
            ms = layout.start_ms + (tick - first) * 1000
        else:
            ms = layout.start_ms + k * 1000 / max(layout.rate_hz, 1)
        p = int(size.argmax())
        rows.append((ms, k, distances[p], size[p], np.angle(z[p]), size.mean(), z))
    return rows


def session(tmp_path, name, layout, n, seed):
    rng = np.random.default_rng(seed)
    ticks = 7 + np.arange(n) / 20
    ticks[[1, n - 1]] = np.nan
    iq = rng.integers(-3000, 3000, (n, max(layout.subframes, 1), layout.sweeps, layout.points, 2))
    (tmp_path / name).write_bytes(layout.head() + encoded(layout, ticks, iq))
    return ticks, iq


def test_files_to_rows(spark, tmp_path):
    spark.dataSource.register(SweepFiles)
    layouts = {"a": Layout(2, 3, 5, 20.0, 1000.0, 0.2, 0.1), "b": Layout(0, 1, 4, 0.5, 50.0, 0.3, 0.02)}
    made = {s: session(tmp_path, f"{s}.sweeps", layout, 23, k) for k, (s, layout) in enumerate(layouts.items())}
    (tmp_path / "odd.sweeps").write_bytes(b"something else that is long enough to have a header, but has none")
    (tmp_path / "short.sweeps").write_bytes(b"SWEEPS")
    with open(tmp_path / "a.sweeps", "ab") as f:
        f.write(b"unfinished")
    results = spark.read.format("sweep_files").option("path", str(tmp_path)).option("rangeBytes", 500).load()
    assert results.rdd.getNumPartitions() > 4
    got = frame_rows(results, "rate_hz", "start_ms", "distances").orderBy("session_id", "seq").collect()
    assert len(got) == 46
    for s, layout in layouts.items():
        ticks, iq = made[s]
        want = plain(iq, layout.start_m + layout.step_m * np.arange(layout.points), ticks, layout)
        for r, w in zip([r for r in got if r.session_id == s], want, strict=True):
            assert (r.Timestamp_ms, r.Frame, r.PeakDistance_m) == pytest.approx(w[:3])
            assert (r.PeakAmplitude, r.PeakPhase_rad, r.MeanAmplitude) == pytest.approx(w[3:6])
            assert np.allclose(np.array(r.Real) + 1j * np.array(r.Imag), w[6])


def test_odd_results(spark):
    one = {"re": [[1.0, 2.0], [3.0, 0.0]], "im": [[0.0, 0.0], [0.0, 2.0]]}
    uneven = {"re": [[1.0], [3.0, 0.0]], "im": [[0.0], [0.0, 2.0]]}
    lacking = {"re": [[None, 1.0]], "im": [[0.0, 1.0]]}
    empty = {"re": [], "im": []}
    d3 = [0.1, 0.2, 0.3]
    rows = [
        ("s", 1, None, 10.0, 5.0, d3, empty, None), ("s", 2, float("inf"), 10.0, 5.0, d3, one, []), ("s", 3, 2.0, 10.0, 5.0, [0.1, 0.2], uneven, [one, uneven]),
        ("s", 4, 2.5, 10.0, 5.0, None, one, None), ("s", 5, 3.0, 10.0, 5.0, d3, uneven, None), ("s", 6, 3.0, 10.0, 5.0, d3, lacking, None), ("s", 7, 3.0, 10.0, 5.0, d3, None, None),
        (None, 1, None, 0.0, 0.0, d3, one, None),
    ]
    results = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in ("n", "re", "tick", "at", "peak_bin")})
    got = frame_rows(results, "rate_hz", "start_ms", "distances").orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.seq, r.Frame, r.Timestamp_ms, r.PeakDistance_m, r.Real) for r in got] == [
        (None, 1, 0, 0.0, 0.0, [2.0, 1.0]), ("s", 2, 0, 5.0, 0.0, [2.0, 1.0]), ("s", 3, 1, 5.0, 0.1, [2.0, 1.0]), ("s", 4, 2, 505.0, 0.0, [2.0, 1.0]),
    ]
    assert frame_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_of_files(spark, tmp_path):
    spark.dataSource.register(SweepFiles)
    layout, folder = Layout(1, 2, 3, 20.0, 0.0, 0.2, 0.1), tmp_path / "in"
    folder.mkdir()
    _, iq = session(folder, "a.sweeps", layout, 10, 3)

    def run():
        stream = spark.readStream.format("sweep_files").option("path", str(folder)).option("rangeBytes", 100).load()
        query = stream.select("session_id", "seq", F.element_at("subframes", 1).alias("f")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    with open(folder / "a.sweeps", "ab") as f:
        f.write(encoded(layout, np.arange(4.0), iq[:4]))
    session(folder, "b.sweeps", layout, 5, 4)
    run()  # goes on from what was read
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.seq) for r in got] == [*(("a", k) for k in range(14)), *(("b", k) for k in range(5))]
    assert got[13].f.re == iq[3, 0, ..., 0].tolist() and got[13].f.im == iq[3, 0, ..., 1].tolist()
