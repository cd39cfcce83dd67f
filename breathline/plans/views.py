"""What the live and history views show, as tables: one row a session with arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import HEART_BAND, RESP_BAND
from ..functions import dsp
from ..operators import bins as B
from ..operators import phase as P
from ..operators import timing as T
from . import vitals as V

#: Rows of a live view, and of its spectrum.
LIVE_ROWS, SPECTRUM_ROWS = 20_000, 4_096
_ARRAYS = ["t", "x", "hz", "amplitude", "resp", "heart"]


def _view(samples: DataFrame, key: str, columns: list[str], stats, names: list[str], time: str, value, seconds: float | None, bands: bool) -> DataFrame:
    def run(group: pd.DataFrame) -> dict:
        rows = group.tail(LIVE_ROWS) if seconds is not None else group
        numbers = stats(rows)
        ms = rows[time].to_numpy(float)
        view = rows[ms >= ms[-1] - 1000 * seconds] if seconds is not None else rows
        t, x = (view[time].to_numpy(float) - float(view[time].iloc[0])) / 1000, value(view)
        out = {"t": t, "x": x, "hz": [], "amplitude": [], "resp": [], "heart": []}
        fs = numbers["sample_rate_hz"]
        if len(x) > 32:
            own = x[-SPECTRUM_ROWS:] if seconds is not None else x
            out["hz"] = np.fft.rfftfreq(len(own), 1 / max(fs, 1e-9))
            out["amplitude"] = np.abs(np.fft.rfft((own - own.mean()) * np.hanning(len(own)))) / len(own)
        if bands and len(x) > 48:
            out |= {"resp": dsp.bandpass(x, fs, RESP_BAND), "heart": dsp.bandpass(x, fs, HEART_BAND)}
        return numbers | out

    schema = ", ".join([f"{n} double" for n in names] + [f"{n} array<double>" for n in _ARRAYS])
    return V._by_session(samples, key, columns, run, schema)


def radar_view(samples: DataFrame, seconds: float | None = 10.0, key: str = "session_id") -> DataFrame:
    """Voltage, spectrum and band signals of the trailing window; with ``seconds`` None of the whole recording.

    Statistics cover the last 20,000 rows live and the whole recording otherwise.
    """
    return _view(samples, key, ["Timestamp_ms", "Voltage_mV"], V.radar_stat_numbers, V.RADAR_STATS, "Timestamp_ms", lambda v: v["Voltage_mV"].to_numpy(float), seconds, seconds is not None)


def imu_view(samples: DataFrame, seconds: float | None = 10.0, key: str = "session_id") -> DataFrame:
    """The same of the acceleration's size."""
    size = lambda v: np.linalg.norm(v[["ax", "ay", "az"]].to_numpy(float), axis=1)
    return _view(samples, key, ["Time_ms", "ax", "ay", "az", "gx", "gy", "gz"], V.imu_stat_numbers, V.IMU_STATS, "Time_ms", size, seconds, seconds is not None)


def latest_profile(long: DataFrame, target_m: float | None = None, keys=("session_id",)) -> DataFrame:
    """The bin shown of each session's last frame: nearest a target, else the strongest usable one.

    ``long`` has bin, distance_m, re, im by session and seq.
    """
    keys = list(keys)
    last = long.groupBy(*keys).agg(F.max("seq").alias("seq"))
    b = B.beyond_leakage(long.join(last, [*keys, "seq"]), keys).withColumn("amplitude", B.magnitude("re", "im"))
    row = F.struct("bin", "distance_m", "amplitude")
    if target_m:
        best = F.min_by(row, F.struct(F.abs(F.col("distance_m") - target_m), "bin"))
    else:
        best = F.max_by(row, F.struct(F.when(F.col("searched"), F.col("amplitude")).otherwise(-1e18), -F.col("bin")))
    return b.groupBy(*keys).agg(best.alias("s"), F.max("amplitude").alias("top_amplitude")).select(*keys, "s.*", "top_amplitude")


def raw_iq_trace(samples: DataFrame, seconds: float = 10.0, keys=("session_id",)) -> DataFrame:
    """I, Q and unwrapped phase less its median over the trailing window, with its time axis.

    ``samples`` has t_ms, re, im of one bin by session and seq. Times are evenly spread
    where more than a twentieth of the gaps are not positive.
    """
    keys = list(keys)
    recent = T.trailing_window(samples, seconds, keys=keys)
    g = T.gaps(recent, keys=keys)
    own = g.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("gap") <= 0).cast("long")).alias("back"), ((F.max_by("t_ms", "seq") - F.min_by("t_ms", "seq")) / 1000).alias("span"), F.min_by("t_ms", "seq").alias("first_ms"))
    u = P.unwrap(g.withColumn("angle", F.atan2("im", "re")), keys=keys)
    middle = u.groupBy(*keys).agg(F.median("phase").alias("middle"))
    u = u.withColumn("i", F.row_number().over(T.ordered(keys)) - 1).join(own, keys).join(middle, keys)
    fs = F.greatest((F.col("n") - 1) / F.greatest("span", F.lit(1e-9)), F.lit(1.0))
    time_s = F.when(F.col("back") > 0.05 * (F.col("n") - 1), F.col("i") / fs).otherwise((F.col("t_ms") - F.col("first_ms")) / 1000)
    return u.where("n >= 2").select(*keys, "seq", time_s.alias("time_s"), F.col("re").alias("raw_i"), F.col("im").alias("raw_q"), (F.col("phase") - F.col("middle")).alias("raw_phase"))
