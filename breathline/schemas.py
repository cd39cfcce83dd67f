"""Schemas of recordings, sensor detection and checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D = T.DoubleType()

RADAR_COLUMNS = ["Timestamp_ms", "RawADC", "Voltage_mV"]
IMU_COLUMNS = ["Time_ms", "ax", "ay", "az", "gx", "gy", "gz"]
FRAME_SCALARS = ["Timestamp_ms", "Frame", "PeakDistance_m", "PeakAmplitude", "PeakPhase_rad", "MeanAmplitude"]
FRAME_ARRAYS = ["Distances_m", "Amplitude", "Phase", "Real", "Imag"]
A121_COLUMNS = FRAME_SCALARS + FRAME_ARRAYS
TIME_COLUMN = {"radar": "Timestamp_ms", "a121": "Timestamp_ms", "imu": "Time_ms"}
COLUMNS = {"radar": RADAR_COLUMNS, "a121": A121_COLUMNS, "imu": IMU_COLUMNS}

CSV_SCHEMA = {
    "radar": T.StructType([T.StructField(c, _D) for c in RADAR_COLUMNS]),
    "imu": T.StructType([T.StructField(c, _D) for c in IMU_COLUMNS]),
    "a121": T.StructType([T.StructField(c, T.LongType() if c == "Frame" else _D) for c in FRAME_SCALARS] + [T.StructField(c, T.StringType()) for c in FRAME_ARRAYS]),
}
SESSIONS = "id long, sensor string, started_at string, stopped_at string, csv_path string, sample_count long, stats_json string"
#: Column names of the sample tables.
STORED = {c: c.lower().replace("rawadc", "raw_adc").replace("peakd", "peak_d").replace("peaka", "peak_a").replace("peakp", "peak_p").replace("meana", "mean_a") for cs in COLUMNS.values() for c in cs}


def detect_sensor(columns: Iterable[str]) -> str:
    """The first sensor, in the order radar, a121, imu, all of whose columns are there."""
    have = set(columns)
    for sensor in ("radar", "a121", "imu"):
        if have.issuperset(COLUMNS[sensor]):
            return sensor
    raise ValueError("no known sensor has these columns: " + ", ".join(sorted(have)))


def detected(columns: Column) -> Column:
    """``detect_sensor`` of an array of column names; null where no sensor has these."""
    found = F.lit(None).cast("string")
    for sensor in ("imu", "a121", "radar"):
        found = F.when(F.size(F.array_except(F.array(*(F.lit(c) for c in COLUMNS[sensor])), columns)) == 0, sensor).otherwise(found)
    return found


def require_columns(columns: Iterable[str], sensor: str) -> None:
    missing = [c for c in COLUMNS[sensor] if c not in set(columns)]
    if missing:
        raise ValueError(f"missing {sensor} columns: {', '.join(missing)}")
