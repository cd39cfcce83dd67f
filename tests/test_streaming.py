"""Live traces in Structured Streaming equal the batch ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathline.streaming import live


def frame_rows(n, start=0):
    d = np.linspace(0.3, 0.7, 9)
    for s in ("a", "b"):
        for f in range(start, n):
            z = 50 * np.exp(0.3j * np.sin(np.pi / 2 * f / 20 + d + (s == "b")))
            yield (s, f * 50.0, f, d.tolist(), z.real.tolist(), z.imag.tolist())


SCHEMA = "session_id string, timestamp_ms double, frame long, distances array<double>, real array<double>, imag array<double>"


def test_stream_equals_batch(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(list(rows), SCHEMA).withColumns({c: F.to_json(c) for c in ("distances", "real", "imag")})
    source, seen = str(tmp_path / "in"), []

    def run():
        out = live.live_traces(live.frame_stream(spark, source), idle=None).writeStream.foreachBatch(lambda b, k: seen.extend(b.collect()))
        query = out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    df(frame_rows(120)).coalesce(1).write.parquet(source)
    run()
    first = len(seen)
    df(frame_rows(160, 100)).coalesce(1).write.mode("append").parquet(source)  # 20 frames come again
    run()
    assert first == 240 and len(seen) == 320
    batch = {(r.session_id, r.frame): r for r in live.recorded_traces(spark.createDataFrame(list(frame_rows(160)), SCHEMA)).collect()}
    for r in seen:
        assert r.resp_signal == pytest.approx(batch[r.session_id, r.frame].resp_signal, abs=1e-9)


def test_lines_are_persisted_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1,2,3\nbad\n2,3,4\n")
    run = lambda: live.persist(live.line_stream(spark, str(tmp_path / "in"), "radar", "s1"), str(tmp_path / "out"), str(tmp_path / "cp"), None).awaitTermination(120)
    run()
    (tmp_path / "in/b.txt").write_text("3,4,5\n")
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.Timestamp_ms for r in out.collect()) == [1, 2, 3]


def test_sliding_stats(spark):
    rows = [("a", float(i), 1.0 + i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "session_id string, t double, x double").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    full = live.sliding_stats(df, "ts", "x").where("n = 10").collect()
    assert full and all(r["mean"] == 1.5 for r in full)


def test_history_is_bounded(spark, tmp_path):
    """The last rows of each session's trace, whatever came before."""
    assert live.history_rows(20.0) == 4_320 and live.history_rows(0.1) == 216
    source, seen = str(tmp_path / "in"), {}
    schema = "session_id string, frame long, time_s double, raw_phase double, raw_i double, raw_q double, resp_signal double, heart_signal double"
    for part in (range(300), range(300, 520)):
        rows = [("a", k, k / 20, *[float(k)] * 5) for k in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = live.live_history(spark.readStream.schema(schema).parquet(source), 0.5, None).writeStream.outputMode("update")
        query = out.foreachBatch(lambda b, k: seen.update({r.session_id: r for r in b.collect()})).option("checkpointLocation", str(tmp_path / "cp"))
        assert query.trigger(availableNow=True).start().awaitTermination(120)
    most = live.history_rows(0.5)
    assert seen["a"].frame == list(range(520 - most, 520)) and seen["a"].raw_i == [float(k) for k in range(520 - most, 520)]


def test_idle_histories_are_dropped(spark, tmp_path):
    source, seen = str(tmp_path / "in"), {}
    schema = "session_id string, frame long, time_s double, raw_phase double, raw_i double, raw_q double, resp_signal double, heart_signal double"

    def send(frames):
        spark.createDataFrame([("a", k, k / 20, *[float(k)] * 5) for k in frames], schema).coalesce(1).write.mode("append").parquet(source)

    def until(frames):
        for _ in range(120):
            if seen.get("a") == frames:
                break
            query.awaitTermination(0.5)
        assert seen["a"] == frames

    send(range(3))
    out = live.live_history(spark.readStream.schema(schema).parquet(source), 0.5, "3 seconds").writeStream.outputMode("update")
    query = out.foreachBatch(lambda b, k: seen.update({r.session_id: r.frame for r in b.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        until([0, 1, 2])
        query.awaitTermination(10)
        send(range(5, 7))
        until([5, 6])
    finally:
        query.stop()


def test_snapshots_by_offset(spark):
    rows = spark.createDataFrame([(s, k) for s in ("a", "b", "c") for k in range(5)], "session_id string, seq long")
    offsets = spark.createDataFrame([("a", 2), ("b", 9)], "session_id string, offset long")
    assert sorted(map(tuple, live.since(rows, offsets).collect())) == [("a", 3), ("a", 4), *(("c", k) for k in range(5))]
    assert live.since(rows).count() == 15


def test_analysis_of_each_tick_covers_its_horizon(spark, tmp_path):
    from helpers import Reflector, Scene, chest

    scene = Scene([Reflector(0.74, 60, chest())], noise=0.3, seed=3)
    rows = scene.recording(50).assign(session_id="s1")
    rows["seq"] = rows.Frame
    df = spark.createDataFrame(rows.map(lambda v: v.tolist() if isinstance(v, np.ndarray) else v))
    source = str(tmp_path / "in")
    for part in ("Frame < 300", "Frame between 300 and 699", "Frame >= 700"):
        df.where(part).coalesce(1).write.mode("append").parquet(source)
        query = live.analyse(spark.readStream.schema(df.schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "cp"), window_s=10.0, trigger=None, max_frames=10_000)
        assert query.awaitTermination(240)
    found = {r.request_id: r for r in spark.read.parquet(str(tmp_path / "out/vitals")).collect()}
    assert live.horizon(10.0) == 30 and live.horizon(60.0) == 80
    assert set(found) == {0, 1, 2} and found[2].error is None
    assert found[2].resp_bpm == pytest.approx(18, abs=0.6) and found[2].target_distance_m == pytest.approx(0.74)
    left = {p.name: spark.read.parquet(str(p)) for p in (tmp_path / "out/recent").iterdir()}
    assert set(left) == {"1", "2"} and left["2"].agg({"Frame": "min"}).first()[0] == 1249 - 30 * 25


def test_lines_of_a_device(tmp_path):
    """A terminal gives its bytes once and can't be sought; a batch can be planned again."""
    import os
    import tty

    from breathline.sources.serial_lines import LineReader

    master, slave = os.openpty()
    tty.setraw(slave)
    reader = LineReader(os.ttyname(slave), 1 << 12)
    os.write(master, b"1,2,3\n4,5")
    lines, first = reader.read({"at": 0})
    assert [t for _, t in lines] == ["1,2,3"]
    os.write(master, b",6\r\n7,8,9\n")
    lines, second = reader.read(first)
    assert [t for _, t in lines] == ["4,5,6", "7,8,9"]
    assert [t for _, t in reader.readBetweenOffsets(first, second)] == ["4,5,6", "7,8,9"]
    assert list(reader.read(second)[0]) == []
    for _ in range(3):  # a line beyond the limit is dropped, its end too
        os.write(master, b"x" * 2_000)
        lines, second = reader.read(second)
        assert list(lines) == []
    os.write(master, b"x\nfine\n")
    assert [t for _, t in reader.read(second)[0]] == ["fine"]
    os.close(master)
    os.close(slave)


def test_long_line_of_a_file_does_not_stall(tmp_path):
    from breathline.sources.serial_lines import LineReader

    path = tmp_path / "log"
    path.write_bytes(b"a\n" + b"y" * 500 + b"\nb\n" + b"z" * 90)
    reader, at, seen = LineReader(str(path), 64), {"at": 0}, []
    for _ in range(12):
        lines, at = reader.read(at)
        seen += [t for _, t in lines]
    assert seen == ["a", "b"]
    with path.open("ab") as f:
        f.write(b"\nc\n")
    for _ in range(3):
        lines, at = reader.read(at)
        seen += [t for _, t in lines]
    assert seen == ["a", "b", "c"]
