"""Named recording files, folders with odd files, and the store clustered by session."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_vitals import doppler

from breathline.plans import vitals as V
from breathline.schemas import A121_COLUMNS, RADAR_COLUMNS, detect_sensor, detected
from breathline.sources import files as N
from breathline.sources import recordings as S
from breathline.sources.clustered import ClusteredStore


def sessions(spark, names, n=400):
    own = doppler().head(n).reset_index(drop=True)
    rows = pd.concat(own.assign(session_id=k, seq=np.arange(n)) for k in names)
    return spark.createDataFrame(rows.sample(frac=1, random_state=0)).repartition(4)


def test_recordings_come_back(spark, tmp_path):
    """One file a session whatever the partitions; the same sessions, rows and order."""
    path = str(tmp_path / "raw")
    df = sessions(spark, ["a", "b", "radar_raw_2024-01-02_03-04-05.csv"])
    N.save_recordings(df, path, "radar")
    assert sorted(os.listdir(path)) == ["radar_raw_2024-01-02_03-04-05.csv", "radar_raw_a.csv", "radar_raw_b.csv"]
    rows, problems = N.scan_files(spark, path, "radar")
    assert problems.count() == 0
    back = rows.withColumn("session_id", N.session_of("session_id", "radar")).toPandas().sort_values(["session_id", "seq"])
    assert back.groupby("session_id").size().to_dict() == {"a": 400, "b": 400, "2024-01-02_03-04-05": 400}
    assert back[back.session_id == "a"][RADAR_COLUMNS].to_numpy() == pytest.approx(doppler().head(400)[RADAR_COLUMNS].to_numpy(), abs=0)
    assert [r.label for r in S.list_files(spark, path, "radar").collect()] == ["radar_raw_b.csv", "radar_raw_a.csv", "radar_raw_2024-01-02_03-04-05.csv"]
    vitals = N.analyse_files(spark, path, "radar", V.radar_vitals).collect()
    assert len(vitals) == 3 and len({r.peak_frequency_hz for r in vitals}) == 1
    with pytest.raises(Exception, match="is there already"):
        N.save_recordings(df, path, "radar")
    assert len(os.listdir(path)) == 3
    N.save_recordings(df, path, "radar", overwrite=True)


@pytest.mark.parametrize("names,match", [(["ok", "a/b"], "no file can have"), (["5", "radar_raw_5.csv"], "more than one session"), (["ok", None], "without a session")])
def test_nothing_is_written_when_one_session_cant_be(spark, tmp_path, names, match):
    df = sessions(spark, ["x", "y"], 20).withColumn("session_id", F.when(F.col("session_id") == "x", F.lit(names[0])).otherwise(F.lit(names[1])))
    with pytest.raises(Exception, match=match):
        N.save_recordings(df, str(tmp_path / "raw"), "radar")
    assert not os.path.exists(tmp_path / "raw") or not os.listdir(tmp_path / "raw")


def test_short_sessions_and_unknown_places(spark, tmp_path):
    with pytest.raises(ValueError, match="fewer than 10"):
        N.save_recordings(sessions(spark, ["a"], 9), str(tmp_path), "radar")
    with pytest.raises(ValueError, match="mounted"):
        N.save_recordings(sessions(spark, ["a"], 20), "viewfs://store/raw", "radar")
    with pytest.raises(ValueError, match="unknown sensor"):
        N.save_recordings(sessions(spark, ["a"], 20), str(tmp_path), "sonar")


def test_odd_files_dont_stop_a_batch(spark, tmp_path):
    good = doppler()
    good.to_csv(tmp_path / "radar_raw_0.csv", index=False)
    good[["Voltage_mV", "RawADC", "Timestamp_ms"]].assign(more="x").to_csv(tmp_path / "radar_raw_1.csv", index=False)
    good.drop(columns="RawADC").to_csv(tmp_path / "radar_raw_2.csv", index=False)
    (tmp_path / "radar_raw_3.csv").write_text("")
    (tmp_path / "radar_raw_4.csv").write_text("Timestamp_ms,RawADC,Voltage_mV\n")
    (tmp_path / "radar_raw_5.csv").write_text("Timestamp_ms,RawADC,Voltage_mV\n" + "oops,1\n" * 3)
    (tmp_path / "radar_raw_6.csv").write_bytes(b"\xff\xfe\x00 binary")
    rows = {r.session_id: r for r in N.analyse_files(spark, str(tmp_path), "radar", V.radar_vitals).collect()}
    assert len(rows) == 7
    assert rows["radar_raw_0.csv"].error is None and rows["radar_raw_0.csv"].peak_frequency_hz == rows["radar_raw_1.csv"].peak_frequency_hz
    assert rows["radar_raw_2.csv"].error == "missing radar columns: RawADC"
    assert rows["radar_raw_3.csv"].error == "the file is empty" and rows["radar_raw_4.csv"].error == "the file has no samples"
    assert "fewer than 10" in rows["radar_raw_5.csv"].error and "missing radar columns" in rows["radar_raw_6.csv"].error
    only = tmp_path / "odd"
    only.mkdir()
    (only / "radar_raw_9.csv").write_text("a,b\n1,2\n")
    assert [r.error for r in N.analyse_files(spark, str(only), "radar", V.radar_vitals).collect()] == ["missing radar columns: Timestamp_ms, RawADC, Voltage_mV"]


def test_small_and_large_files_give_the_same_lines(spark, tmp_path, monkeypatch):
    """Files are read whole up to a size and by lines beyond it, and one isn't opened by the other's reader."""
    head = "Timestamp_ms,RawADC,Voltage_mV"
    (tmp_path / "radar_raw_1.csv").write_bytes(f"\ufeff{head}\r\n1,2,3\r\n\r\n4,5,6\r\n".encode())
    (tmp_path / "radar_raw_2.csv").write_text(f"\n{head}\n7,8,9\n" + "\n" * 3 + "10,11,\u00e9\n" * 40)
    (tmp_path / "radar_raw_3.csv").write_text("")
    found = []
    for limit in (1 << 20, 100, 0):
        monkeypatch.setattr(N, "SMALL", limit)
        rows, problems = N.scan_files(spark, str(tmp_path), "radar")
        own = rows.orderBy("session_id", "seq").select("session_id", *RADAR_COLUMNS).collect()
        found.append(([tuple(r) for r in own], [tuple(r) for r in problems.collect()]))
    assert found[0] == found[1] == found[2]
    assert len(found[0][0]) == 43 and found[0][0][:3] == [("radar_raw_1.csv", 1.0, 2.0, 3.0), ("radar_raw_1.csv", 4.0, 5.0, 6.0), ("radar_raw_2.csv", 7.0, 8.0, 9.0)]
    assert found[0][1] == [("radar_raw_3.csv", "the file is empty")]


def test_frames_with_malformed_arrays(spark, tmp_path):
    line = '0,{k},0.3,1.0,0.1,0.5,"[0.2,0.3]","[1,2]","[0,0]","[1,2]","{im}"\n'
    (tmp_path / "a121_sparse_iq_1.csv").write_text(",".join(A121_COLUMNS) + "\n" + "".join(line.format(k=k, im="[0,0]") for k in range(3)))
    (tmp_path / "a121_sparse_iq_2.csv").write_text(",".join(A121_COLUMNS) + "\n" + line.format(k=0, im="[0,0]") + line.format(k=1, im="[0,"))
    rows, problems = N.scan_files(spark, str(tmp_path), "a121")
    assert [(r.session_id, r.error) for r in problems.collect()] == [("a121_sparse_iq_2.csv", "malformed array")]
    back = rows.orderBy("Frame").collect()
    assert [r.Frame for r in back] == [0, 1, 2] and back[0].Real == [1.0, 2.0]


def test_detection_over_a_table(spark):
    own = [RADAR_COLUMNS, [*A121_COLUMNS, "x"], ["Time_ms", "ax", "ay", "az", "gx", "gy", "gz", "RawADC"], RADAR_COLUMNS[1:], []]
    got = [r[0] for r in spark.createDataFrame([(k, c) for k, c in enumerate(own)], "k int, c array<string>").orderBy("k").select(detected(F.col("c"))).collect()]
    assert got == ["radar", "a121", "imu", None, None]
    assert got[:3] == [detect_sensor(c) for c in own[:3]]


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "session_id" in line]


def test_work_by_session_needs_no_exchange(spark, tmp_path):
    store = ClusteredStore(spark, str(tmp_path / "store"), 4)
    df = sessions(spark, [1, 2, 3, 4, 5], 60)
    for k in range(3):
        store.append("radar", df.where(F.col("seq") % 3 == k))
    store.record(df.groupBy("session_id").agg(F.count("*").alias("sample_count")).withColumns({"sensor": F.lit("radar"), "seq": F.lit(0)}))
    samples = store.samples("radar")
    assert exchanges(df.groupBy("session_id").count())
    assert not exchanges(samples.groupBy("session_id").agg(F.avg("voltage_mv")))
    assert not exchanges(store.joined("radar").groupBy("session_id").agg(F.avg("voltage_mv")))
    named = samples.withColumnsRenamed({"timestamp_ms": "Timestamp_ms", "voltage_mv": "Voltage_mV"})
    vitals = V.radar_vitals(named)
    assert not exchanges(vitals) and exchanges(V.radar_vitals(df))
    plain = {r.session_id: r for r in V.radar_vitals(df).collect()}
    assert {r.session_id: r for r in vitals.collect()} == plain and len(plain) == 5
    assert "EqualTo(session_id,3)" in samples.where("session_id = 3")._jdf.queryExecution().executedPlan().toString()


def test_compaction_keeps_rows_and_breaks_off_safely(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store, df = ClusteredStore(spark, path, 3), sessions(spark, [1, 2, 3, 4], 50)
    assert store.samples("radar").count() == 0 and store.sessions().count() == 0 and store.files("radar_samples") == 0
    for k in range(5):
        store.append("radar", df.where(F.col("seq") % 5 == k))
    many = store.files("radar_samples")
    whole = [tuple(r) for r in store.load(2, "radar").collect()]
    assert many > 3 and [r[1] for r in whole] == list(range(50))

    class Broken(Exception):
        pass

    append = store._append

    def dies(rows, table):
        append(rows.limit(10), table)
        raise Broken

    monkeypatch.setattr(store, "_append", dies)
    with pytest.raises(Broken):
        store.compact("radar")
    monkeypatch.undo()
    assert store.files("radar_samples") == many and store.samples("radar").count() == 200
    store.compact("radar")
    assert store.files("radar_samples") <= 3 and [tuple(r) for r in store.load(2, "radar").collect()] == whole
    # Another store object over the same path sees the same rows, and goes on.
    again = ClusteredStore(spark, path, 3)
    again.append("radar", df.where("session_id = 1").withColumn("session_id", F.lit(9)))
    assert again.samples("radar").count() == 250 == store.samples("radar").count()
    again.record(spark.createDataFrame([(1, "radar", 0, 5), (1, "radar", 1, 7)], "session_id long, sensor string, seq long, sample_count long"))
    assert [(r.session_id, r.sample_count) for r in again.sessions().collect()] == [(1, 7)]
    with pytest.raises(ValueError, match="unknown sensor"):
        store.append("sonar", df)


def test_small_files_are_read_as_lines_are(spark, tmp_path, monkeypatch):
    """Marks, blank lines, quotes and another order of columns, in files read whole and by lines."""
    head = "Voltage_mV,RawADC,Timestamp_ms,more\r\n"
    (tmp_path / "radar_raw_1.csv").write_bytes(b"\xef\xbb\xbf\r\n  \r\n" + head.encode() + b"3.5,2,10,a\r\n\r\n4.5,x\r\n")
    (tmp_path / "radar_raw_2.csv").write_text('RawADC,"Timestamp_ms",Voltage_mV\n"1",2,"3"\n4,5,6,7\n')
    read = lambda: [tuple(r)[:1] + tuple(r)[2:] for r in N.scan_files(spark, str(tmp_path), "radar")[0].orderBy("session_id", "seq").collect()]
    whole = read()
    assert [r[1:] for r in whole if "2.csv" in r[0]] == [(2.0, 1.0, 3.0), (5.0, 4.0, 6.0)]
    assert len(whole) == 4
    monkeypatch.setattr(N, "SMALL", 0)
    key = lambda rows: sorted(map(repr, rows))
    assert key(read()) == key(whole)
