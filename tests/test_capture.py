import pytest
from pyspark.errors import StreamingQueryException

from breathline.sources.files import scan_files
from breathline.sources.recordings import SessionStore, list_files
from breathline.streaming.capture import Capture

FIELDS = "session_id long, seq long, Timestamp_ms double, RawADC double, Voltage_mV double"


def send(spark, folder, rows):
    spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(str(folder))


def rows(sessions, first, n):
    return [(s, k, 10.0 * k, float(k), s + k / 8) for k in range(first, first + n) for s in sessions]


def run(spark, capture, sent, tmp_path):
    stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(str(sent))
    capture.start(stream, str(tmp_path / "cp"), None).awaitTermination()


def agree(spark, capture, want):
    stored = sorted((r.session_id, r.timestamp_ms, r.raw_adc, r.voltage_mv) for r in capture.samples().collect())
    done = capture.finish().orderBy("session_id").collect()
    found, problems = scan_files(spark, capture.folder, "radar")
    filed = sorted((int(r.session_id.removeprefix("radar_raw_").removesuffix(".csv")), r.Timestamp_ms, r.RawADC, r.Voltage_mV) for r in found.collect())
    assert problems.count() == 0 and stored == filed == sorted((s, t, a, v) for s, _, t, a, v in want)
    return done


@pytest.mark.parametrize("broken", ["_store_rows", "_store_lines", "after"])
def test_crash_between_the_sinks(spark, tmp_path, monkeypatch, broken):
    sent, store = tmp_path / "sent", SessionStore(spark, str(tmp_path / "store"))
    capture = Capture(store, str(tmp_path / "csv"), "radar")
    send(spark, sent, rows([1, 2], 0, 12))
    run(spark, capture, sent, tmp_path)
    assert capture.last() == 0
    agree(spark, capture, rows([1, 2], 0, 12))
    for entry in (tmp_path / "csv").glob("*.csv"):
        entry.unlink()

    send(spark, sent, rows([2, 3], 12, 11))
    crashed = Capture(store, str(tmp_path / "csv"), "radar")

    def fails(batch, number):
        if broken == "after":
            Capture._store_lines(crashed, batch, number)
        raise OSError("power is gone")

    monkeypatch.setattr(crashed, "_store_lines" if broken == "after" else broken, fails)
    with pytest.raises(StreamingQueryException, match="power is gone"):
        run(spark, crashed, sent, tmp_path)
    assert crashed.last() == 0
    agree(spark, crashed, rows([1, 2], 0, 12))  # the broken batch counts in neither
    for entry in (tmp_path / "csv").glob("*.csv"):
        entry.unlink()

    again = Capture(store, str(tmp_path / "csv"), "radar")
    run(spark, again, sent, tmp_path)
    done = agree(spark, again, rows([1, 2], 0, 12) + rows([2, 3], 12, 11))
    assert [(r.session_id, r.samples, r.error) for r in done] == [(1, 12, None), (2, 23, None), (3, 11, None)]
    assert sorted(r.label for r in list_files(spark, again.folder, "radar").collect()) == [f"radar_raw_{s}.csv" for s in (1, 2, 3)]


def test_finish(spark, tmp_path):
    sent, store = tmp_path / "sent", SessionStore(spark, str(tmp_path / "store"))
    capture = Capture(store, str(tmp_path / "csv"), "radar")
    assert capture.last() == -1 and capture.samples().count() == 0 == capture.finish().count()
    send(spark, sent, rows([4], 0, 10) + rows([5], 0, 9) + [(None, 1, 1.0, 1.0, 1.0)])
    run(spark, capture, sent, tmp_path)
    (tmp_path / "csv" / "radar_raw_6.csv").write_text("mine\n")
    send(spark, sent, rows([6], 0, 10))
    run(spark, capture, sent, tmp_path)
    for _ in (0, 1):  # again, with the same result
        done = {r.session_id: (r.samples, r.error) for r in capture.finish().collect()}
        assert done == {4: (10, None), 5: (9, "fewer than 10 samples"), 6: (10, "radar_raw_6.csv is there already")}
        assert (tmp_path / "csv" / "radar_raw_6.csv").read_text() == "mine\n"
        assert [(r.id, r.sample_count) for r in store.sessions().collect()] == [(4, 10)]
    assert [r.seq for r in capture.load(4).collect()] == list(range(10))
    with pytest.raises(ValueError, match="unknown sensor"):
        Capture(store, str(tmp_path), "sonar")


def test_pieces_dont_grow_with_sessions(spark, tmp_path):
    """A batch leaves a file a task, not one a session; finish gives each session its own."""
    sent, store = tmp_path / "sent", SessionStore(spark, str(tmp_path / "store"))
    capture = Capture(store, str(tmp_path / "csv"), "radar")
    send(spark, sent, rows(range(40), 0, 11))
    send(spark, sent, rows(range(40), 11, 1))
    run(spark, capture, sent, tmp_path)
    pieces = [p for p in (tmp_path / "csv" / ".pieces").rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]
    assert capture.last() == 1 and len(pieces) == 2
    assert len(agree(spark, capture, rows(range(40), 0, 12))) == 40
