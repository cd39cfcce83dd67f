"""Commands: ``python -m breathline.cli COMMAND``.

ports, plot-radar, plot-imu, batch-radar, batch-imu, capture-radar, capture-imu,
test-frames, plan-frames, detect. The plot commands print the numbers; charts are left to
what reads the tables.
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.bins import session_plan
from .operators.sweeps import frame_rows
from .plans import vitals as V
from .sources import recordings as S
from .sources.files import analyse_files
from .sources.frame_files import SweepFiles
from .sources.serial_lines import SerialLines
from .streaming.capture import Capture

ANALYSERS = {"radar": (V.radar_vitals, V.RADAR_RESULT), "imu": (V.imu_vitals, V.IMU_RESULT)}


def _print(rows, names: list[str]) -> int:
    """One line a recording, a partition of them at a time; errors go to stderr and don't stop the others."""
    failed = 0
    for r in rows.orderBy("session_id").toLocalIterator():
        if r.error:
            failed += 1
            print(f"{r.session_id}: {r.error}", file=sys.stderr)
        else:
            print(f"{r.session_id}: " + ", ".join(f"{n}={r[n]:.3f}" for n in names))
    return failed


def _ports(preferred: str | None = None) -> list[str]:
    found = sorted(glob.glob("/dev/ttyUSB*") + glob.glob("/dev/ttyACM*"))
    if preferred and os.path.exists(preferred):
        found = [p for p in found if p != preferred] + [preferred]
    return S.ordered_ports(found, preferred)


def capture(spark: SparkSession, sensor: str, port: str, folder: str, seconds: float | None = None) -> tuple[str | None, str | None]:
    """Samples of a serial line as one session, to a named file and a store in ``folder``, until Ctrl+C or for some seconds: (path, error)."""
    number = int(f"{datetime.now():%Y%m%d%H%M%S}")
    spark.dataSource.register(SerialLines)
    lines = spark.readStream.format("serial_lines").option("path", port).load()
    samples = S.parse_lines(lines.select(F.lit(number).cast("long").alias("session_id"), F.col("offset").alias("seq"), "line"), sensor)
    store = os.path.join(folder, ".store")
    sinks = Capture(S.SessionStore(spark, store), folder, sensor, f"capture-{number}")
    query, begin = sinks.start(samples, os.path.join(store, f"checkpoint-{number}")), time.monotonic()
    try:
        while query.isActive and (seconds is None or time.monotonic() - begin < seconds):
            query.awaitTermination(0.25)
        if query.isActive:
            query.processAllAvailable()
    except KeyboardInterrupt:
        pass
    finally:
        query.stop()
    done = sinks.finish().first()
    return (done.path, done.error) if done else (None, "no samples")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="breathline")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("ports", help="serial devices")
    for sensor in ANALYSERS:
        commands.add_parser(f"plot-{sensor}", help=f"numbers of one {sensor} recording").add_argument("path")
        commands.add_parser(f"batch-{sensor}", help=f"numbers of all {sensor} recordings of a folder").add_argument("path")
        own = commands.add_parser(f"capture-{sensor}", help=f"store samples of a {sensor} line until Ctrl+C")
        own.add_argument("-p", "--port")
        own.add_argument("-o", "--output-dir", default=f"raw_{sensor}")
        own.add_argument("--seconds", type=float)
        own.add_argument("--no-plot", action="store_true")
    frames = commands.add_parser("test-frames", help="first frames of a folder of sweep files")
    frames.add_argument("path")
    frames.add_argument("--frames", type=int, default=20)
    commands.add_parser("detect", help="sensor of a recording").add_argument("path")
    plan = commands.add_parser("plan-frames", help="settings of a range-profile session")
    for name, kind, default in (("start-m", float, 0.2), ("end-m", float, 1.5), ("sweeps", int, 12), ("rate-hz", float, 50.0), ("baud", int, 921600), ("step", int, 1)):
        plan.add_argument(f"--{name}", type=kind, default=default)
    a = parser.parse_args(argv)
    if a.command == "ports":
        print("\n".join(_ports()) or "no serial ports")
        return 0
    spark = SparkSession.builder.appName("breathline").getOrCreate()
    if a.command == "detect":
        print(S.open_csv(spark, a.path)[0])
        return 0
    if a.command == "plan-frames":
        row = (a.start_m, a.end_m, a.sweeps, a.rate_hz, a.baud, a.step)
        r = session_plan(spark.createDataFrame([row], "start_m double, end_m double, sweeps int, rate_hz double, baud int, step int")).first()
        print(f"start point {r.start_point}, step {r.step_length}, points {r.num_points}, sweeps {r.sweeps_per_frame}, end {r.planned_end_m:.3f} m")
        return 0
    if a.command == "test-frames":
        spark.dataSource.register(SweepFiles)
        rows = frame_rows(spark.read.format("sweep_files").load(a.path), "rate_hz", "start_ms", "distances")
        for r in rows.where(F.col("Frame") < a.frames).orderBy("session_id", "Frame").toLocalIterator():
            print(f"{r.session_id} frame {r.Frame:03d}: peak={r.PeakDistance_m:.3f} m, amplitude={r.PeakAmplitude:.1f}, phase={r.PeakPhase_rad:.2f} rad")
        return 0
    kind, sensor = a.command.split("-")
    analyse, names = ANALYSERS[sensor]
    if kind == "capture":
        ports = _ports(a.port)
        if not ports:
            print("no serial port", file=sys.stderr)
            return 1
        path, error = capture(spark, sensor, ports[0], os.path.abspath(a.output_dir), a.seconds)
        if error:
            print(error, file=sys.stderr)
            return 1
        print(f"saved {path}")
        return 0 if a.no_plot else int(_print(analyse_files(spark, path, sensor, analyse, "*.csv"), names) > 0)
    failed = _print(analyse_files(spark, a.path, sensor, analyse, None if kind == "batch" else "*.csv"), names)
    return int(failed > 0 and kind == "plot")


if __name__ == "__main__":
    sys.exit(main())
