import numpy as np
import pandas as pd
import pytest
from test_vitals import doppler

from breathline.cli import main
from breathline.sources.frame_files import Layout, encoded
from breathline.sources.serial_lines import LineReader, SerialLines


def test_commands(spark, tmp_path, capsys):
    doppler().to_csv(tmp_path / "radar_raw_1.csv", index=False)
    doppler().head(4).to_csv(tmp_path / "radar_raw_2.csv", index=False)
    assert main(["batch-radar", str(tmp_path)]) == 0
    out = capsys.readouterr()
    assert "radar_raw_1.csv: sample_rate_hz=80" in out.out and "radar_raw_2.csv" in out.err
    assert main(["plot-radar", str(tmp_path / "radar_raw_2.csv")]) == 1
    assert main(["detect", str(tmp_path / "radar_raw_1.csv")]) == 0
    assert main(["plan-frames"]) == 0
    assert main(["ports"]) == 0
    assert "step 24, points 23, sweeps 12" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_capture_commands(spark, tmp_path, capsys):
    line, out = tmp_path / "tty", tmp_path / "raw"
    line.write_text("".join(f"{r.Timestamp_ms},{r.RawADC},{r.Voltage_mV}\nnoise\n" for r in doppler().itertuples()))
    assert main(["capture-radar", "-p", str(line), "-o", str(out), "--seconds", "1"]) == 0
    said = capsys.readouterr().out
    (saved,) = out.glob("radar_raw_*.csv")
    assert f"saved {saved}" in said and "sample_rate_hz=80" in said
    assert np.allclose(pd.read_csv(saved).to_numpy(), doppler()[["Timestamp_ms", "RawADC", "Voltage_mV"]].to_numpy())
    line.write_text("1,2,3,4,5,6\n" * 3)
    assert main(["capture-imu", "-p", str(line), "-o", str(out), "--seconds", "1", "--no-plot"]) == 1
    assert "fewer than 10 samples" in capsys.readouterr().err
    line.write_text("")
    assert main(["capture-imu", "-p", str(line), "-o", str(out), "--seconds", "0"]) == 1
    assert "no samples" in capsys.readouterr().err


def test_frames_of_a_folder(spark, tmp_path, capsys):
    layout = Layout(0, 1, 2, 20.0, 0.0, 0.25, 0.25)
    iq = np.zeros((5, 1, 1, 2, 2), int)
    iq[:, 0, 0, 1, 0] = range(1, 6)
    (tmp_path / "s.sweeps").write_bytes(layout.head() + encoded(layout, np.full(5, np.nan), iq))
    assert main(["test-frames", str(tmp_path), "--frames", "2"]) == 0
    assert capsys.readouterr().out.splitlines() == [f"s frame 00{k}: peak=0.500 m, amplitude={k + 1}.0, phase=0.00 rad" for k in (0, 1)]


def test_lines_wait_for_their_end(tmp_path):
    path = tmp_path / "tty"
    path.write_bytes(b"1,2,3\r\n4,5")
    reader = LineReader(str(path), 1 << 20)
    rows, at = reader.read(reader.initialOffset())
    assert list(rows) == [(0, "1,2,3")] and at == {"at": 7}
    path.write_bytes(b"1,2,3\r\n4,5,6\n")
    rows, end = reader.read(at)
    assert list(rows) == [(7, "4,5,6")] == list(reader.readBetweenOffsets(at, end))
    assert list(LineReader("/nowhere", 1).read({"at": 3})[0]) == []


def test_serial_stream(spark, tmp_path):
    path = tmp_path / "tty"
    path.write_text("1,2,3\nx\n4,5,6\n")
    spark.dataSource.register(SerialLines)
    seen = []
    query = spark.readStream.format("serial_lines").option("path", str(path)).load().writeStream.foreachBatch(lambda b, k: seen.extend(r.line for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(60):
        if len(seen) >= 3:
            break
        query.awaitTermination(1)
    query.stop()
    assert seen == ["1,2,3", "x", "4,5,6"]
