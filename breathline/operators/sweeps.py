"""Results of a range-profile sensor, with all sweeps, as rows of recordings.

A result has ``frame`` (re and im, each an array of sweeps) and ``subframes`` (an array of
such frames, or null). The first subframe counts where there is one. Its sweeps are
averaged before anything is shuffled, so what moves is one profile a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import A121_COLUMNS
from .bins import project_frame
from .timing import finite


def first_subframe(frame: str | Column = "frame", subframes: str | Column = "subframes") -> Column:
    frame, subframes = (F.col(c) if isinstance(c, str) else c for c in (frame, subframes))
    return F.when(F.size(subframes) > 0, F.get(subframes, F.lit(0))).otherwise(frame)


def mean_sweep(sweeps: Column) -> Column:
    """Mean of sweeps point by point; null without sweeps, and where they differ in length or lack values."""
    first = F.get(sweeps, F.lit(0))
    even = (F.size(sweeps) > 0) & F.forall(sweeps, lambda s: F.coalesce(F.size(s) == F.size(first), F.lit(False)))
    total = F.aggregate(F.slice(sweeps, F.lit(2), F.size(sweeps)), first, lambda t, s: F.zip_with(t, s, lambda a, b: a + b))
    mean = F.transform(total, lambda x: x / F.size(sweeps))
    return F.when(even & F.forall(mean, lambda x: x.isNotNull()), mean)


def frame_rows(results: DataFrame, rate_hz: str | float = 50.0, start_ms: str | float = 0.0, distances: str | None = None, keys: Sequence[str] = ("session_id",), order: str = "seq") -> DataFrame:
    """Rows with a recording's columns, its keys and order, from results (frame, subframes, tick_s).

    Frames count from 0 in a session. A result whose sweeps are none, empty or uneven gives
    no row and doesn't count. Its time is that of its tick, from the session's first tick
    on; without a finite tick it is its number over the rate (1 Hz at least). Distances of
    another length than the profile are replaced by 0, 1, 2, ...
    """
    value = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
    at = F.col(distances) if distances else F.lit(None).cast("array<double>")
    own = results.select(*keys, order, first_subframe().alias("f"), F.col("tick_s").cast("double").alias("tick"), value(rate_hz).alias("rate"), value(start_ms).alias("start"), at.alias("at"))
    own = own.withColumns({"re": mean_sweep(F.col("f.re")), "im": mean_sweep(F.col("f.im"))}).drop("f").where((F.size("re") > 0) & (F.size("re") == F.size("im")))
    own = own.withColumn("at", F.when(F.size("at") == F.size("re"), F.col("at")).otherwise(F.sequence(F.lit(0), F.size("re") - 1).cast("array<double>")))
    w = W.partitionBy(*keys).orderBy(order)
    tick = F.when(finite("tick"), F.col("tick"))
    own = own.withColumns({"n": (F.row_number().over(w) - 1).cast("long"), "tick": tick, "first": F.first(tick, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))})
    ms = F.col("start") + F.when(F.col("tick").isNotNull(), (F.col("tick") - F.col("first")) * 1000.0).otherwise(F.col("n") * 1000.0 / F.greatest("rate", F.lit(1.0)))
    own = project_frame(own.withColumn("ms", ms), distances="at")
    names = ["ms", "n", "peak_distance_m", "peak_amplitude", "peak_phase_rad", "mean_amplitude", "at", "amplitude", "phase", "re", "im"]
    return own.select(*keys, order, *(F.col(n).alias(c) for n, c in zip(names, A121_COLUMNS, strict=True)))
