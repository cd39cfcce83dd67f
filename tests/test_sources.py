import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_vitals import doppler

from breathline.operators import bins as B
from breathline.operators import cleaning as C
from breathline.operators import timing as T
from breathline.plans import vitals as V
from breathline.schemas import A121_COLUMNS, IMU_COLUMNS, RADAR_COLUMNS, detect_sensor, require_columns
from breathline.sources import recordings as S


def test_detection_and_missing_columns():
    assert detect_sensor([*RADAR_COLUMNS, "x"]) == "radar" and detect_sensor(A121_COLUMNS) == "a121" and detect_sensor(IMU_COLUMNS) == "imu"
    with pytest.raises(ValueError):
        detect_sensor(["a"])
    with pytest.raises(ValueError, match="RawADC"):
        require_columns(["Timestamp_ms", "Voltage_mV"], "radar")


def test_arrays(spark):
    df = spark.createDataFrame([("[1.5,2]",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(S.decode_array("a")).collect()] == [[1.5, 2.0], [], []]
    with pytest.raises(Exception, match="malformed"):
        spark.createDataFrame([("[1,2",)], "a string").select(S.decode_array("a")).collect()
    one = spark.createDataFrame([([1 / 3, 2.0],)], "a array<double>")
    assert one.select(S.encode_array("a")).first()[0] == "[0.33333333,2.0]"


def test_csv_scan_analyse_and_save(spark, tmp_path):
    for k in range(2):
        doppler().to_csv(tmp_path / f"radar_raw_{k}.csv", index=False)
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    df = S.scan_csv(spark, str(tmp_path), "radar")
    rows = V.radar_vitals(df).collect()
    assert len(rows) == 2 and all(6.9 <= r.peak_frequency_hz <= 7.1 for r in rows)
    assert S.open_csv(spark, str(tmp_path / "radar_raw_0.csv"))[0] == "radar"
    assert [r.label for r in S.list_files(spark, str(tmp_path), "radar").collect()] == ["radar_raw_1.csv", "radar_raw_0.csv"]
    out = S.save_csv(df.where("session_id = 'radar_raw_0.csv'"), str(tmp_path / "out"), "radar")
    assert spark.read.option("header", True).csv(out).count() == 1280
    with pytest.raises(ValueError):
        S.save_csv(df.limit(3), str(tmp_path / "out"), "radar")


def test_lines(spark):
    lines = spark.createDataFrame([("1,2,3",), ("1,2",), ("1,x,3",), ("1,2,3,4",), (" 4, 5 ,6 ",), ("",)], "line string")
    assert [tuple(r) for r in S.parse_lines(lines, "radar").collect()] == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    six = spark.createDataFrame([("1,2,3,4,5,6",)], "line string")
    assert S.parse_lines(six, "imu", time_ms=F.lit(9.0)).first().Time_ms == 9.0


def test_store_round_trip(spark, tmp_path):
    store = S.SessionStore(spark, str(tmp_path / "store"))
    assert store.sessions().count() == 0
    one, two = store.create("radar"), store.create("imu", "x.csv")
    assert (one, two) == (1, 2)
    df = spark.createDataFrame(doppler().head(50).assign(seq=np.arange(50)))
    store.append(one, "radar", df)
    store.finish(one, 50, {"resp_bpm": 15.0})
    back = store.load(one, "radar").toPandas()
    assert back.Voltage_mV.tolist() == doppler().head(50).Voltage_mV.tolist()
    done = {r.id: r for r in store.sessions().collect()}
    assert done[1].sample_count == 50 and done[1].stopped_at and done[2].stopped_at is None
    with pytest.raises(ValueError):
        store.append(one, "sonar", df)
    assert [r.id for r in S.newest_sessions(store.sessions()).collect()] == [2, 1]


def test_ports(spark):
    assert S.ordered_ports(["a", "b", "c"], "b") == ["b", "c", "a"]
    assert S.ordered_ports(["a", "b"], "z") == ["b", "a"]
    ports = spark.createDataFrame([("COM1", "WCH interface A"), ("COM2", "WCH interface B"), ("COM3", "modem"), ("COM4", "WCH")], "device string, description string")
    assert [(r.device, r.score) for r in S.rank_ports(ports).collect()] == [("COM1", 30), ("COM4", 20), ("COM2", 10)]


def test_session_plan(spark):
    asked = [(0.2, 1.0, 16, 20.0, 921600, 1), (0.2, 1.5, 16, 20.0, 921600, 1), (0.2, 1.5, 12, 50.0, 921600, 1)]
    rows = B.session_plan(spark.createDataFrame(asked, "start_m double, end_m double, sweeps int, rate_hz double, baud int, step int")).collect()
    assert [(r.cap, r.step_length, r.num_points, r.sweeps_per_frame) for r in rows] == [(960, 6, 55, 16), (960, 12, 45, 16), (384, 24, 23, 12)]
    assert rows[0].planned_end_m == pytest.approx(1.010)


def test_robust_rate_branches(spark):
    def rate(times):
        df = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate(times)], "session_id int, seq int, t_ms double")
        return T.robust_rate(df).first().fs

    from breathline.functions.frames import sample_rate

    bursts = np.concatenate([[0.0], np.cumsum(np.tile([0, 0.5, 50], 100))])
    jitter = np.cumsum(50 + np.random.default_rng(0).normal(size=300))
    hole = np.concatenate([np.arange(100) * 50.0, 5_300 + np.arange(100) * 50.0])
    for times in (bursts, jitter, hole, [7.0], [5.0, 5.0], np.arange(40) * 50.0):
        assert rate(times) == pytest.approx(sample_rate(times)), len(times)


def test_cleaning_edges(spark):
    nan = float("nan")
    rows = [("a", i, v) for i, v in enumerate([nan, 1.0, None, 3.0, nan])] + [("b", 0, nan), ("b", 1, None)]
    got = C.interp_gaps(spark.createDataFrame(rows, "session_id string, seq int, x double")).orderBy("session_id", "seq").collect()
    assert [r.x for r in got] == [1, 1, 2, 3, 3, 0, 0]
    big = pd.DataFrame({"session_id": 1, "seq": range(20), "x": [0.0, 1.0] * 9 + [500.0, 1.0]})
    from breathline.functions.dsp import clean

    mine = C.clean_signal(spark.createDataFrame(big)).orderBy("seq").toPandas().x
    assert mine.to_numpy() == pytest.approx(clean(big.x))


def test_medians_of_long_recordings(spark):
    """Few values or many, ties, nulls: ranks within a bracket give the same median."""
    rng = np.random.default_rng(4)
    series = [[1.0], [1.0, 2.0], [3.0] * 40, [None, 2.0, 7.0, None], [None], rng.normal(size=5_001).tolist(), rng.integers(0, 9, 4_000).astype(float).tolist(), [0.0] * 900 + [1.0] * 900]
    df = spark.createDataFrame([(k, i, float(50 * i + v if v else 50 * i), v) for k, own in enumerate(series) for i, v in enumerate(own)], "session_id int, seq int, t_ms double, x double")
    plain, ranked = ({r.session_id: r.m for r in T.medians(df, "x", "m", long=long).collect()} for long in (False, True))
    assert {k: v for k, v in plain.items() if v is not None} == ranked
    some = df.where("session_id > 4")
    for f in (lambda long: T.robust_rate(some, long=long), lambda long: C.despike(some.select("session_id", "seq", "x"), limit=1.0, long=long)):
        assert sorted(map(tuple, f(True).collect())) == sorted(map(tuple, f(False).collect()))


def test_two_writers_get_different_sessions(spark, tmp_path, monkeypatch):
    """Both read the store before either has written."""
    a, b = (S.SessionStore(spark, str(tmp_path / "store")) for _ in range(2))
    before = a._log()
    for store in (a, b):
        monkeypatch.setattr(store, "_log", lambda: before)
    assert (a.create("radar"), b.create("imu"), a.create("imu")) == (1, 2, 3)
    found = S.SessionStore(spark, str(tmp_path / "store")).sessions()
    assert sorted((r.id, r.sensor) for r in found.collect()) == [(1, "radar"), (2, "imu"), (3, "imu")]
