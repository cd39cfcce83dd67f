"""Cleaning of ordered values, as window expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timing import KEYS, ORDER, finite, medians, ordered, so_far


def interp_gaps(df: DataFrame, x: str = "x", keys=KEYS, order=ORDER) -> DataFrame:
    """Non-finite values by linear interpolation over the row number; ends are held; 0 where none is finite."""
    w = ordered(keys, order)
    good = F.when(finite(x), F.col(x))
    i = F.row_number().over(w)
    df = df.withColumns({"_v": good}).withColumns({"_i": i, "_at": F.when(F.col("_v").isNotNull(), i)})
    # What follows is what precedes from the other end: Spark goes through a frame up to the last row anew for each row.
    before, after = so_far(keys, order), so_far(keys, [F.desc("_i")])
    df = df.withColumns({f"_{n}0": F.last(c, ignorenulls=True).over(before) for n, c in (("v", "_v"), ("i", "_at"))})
    df = df.withColumns({f"_{n}1": F.last(c, ignorenulls=True).over(after) for n, c in (("v", "_v"), ("i", "_at"))})
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_i") - F.col("_i0")) / (F.col("_i1") - F.col("_i0"))
    filled = F.coalesce("_v", between, "_v0", "_v1", F.lit(0.0))
    return df.withColumn(x, filled).drop("_v", "_i", "_at", "_v0", "_i0", "_v1", "_i1")


def despike(df: DataFrame, x: str = "x", limit: float = 7.0, keys=KEYS, long: bool = False) -> DataFrame:
    """Values clipped at ``limit`` robust deviations; recordings under 8 rows only lose their mean.

    Two exact medians, each one aggregate by key joined back to the rows; ``long`` as in ``timing.medians``.
    """
    first = df.groupBy(*keys).agg(*([] if long else [F.median(x).alias("_m")]), F.count("*").alias("_n"), F.avg(x).alias("_avg"))
    if long:
        first = first.join(medians(df, x, "_m", keys, long), keys, "left")
    with_median = df.join(first, keys)
    spread = medians(with_median, F.abs(F.col(x) - F.col("_m")), "_s", keys, long).withColumn("_s", F.col("_s") * 1.4826)
    low, high = F.col("_m") - limit * F.col("_s"), F.col("_m") + limit * F.col("_s")
    clipped = F.when(F.col("_s") > 1e-12, F.least(F.greatest(F.col(x), low), high)).otherwise(F.col(x))
    value = F.when(F.col("_n") < 8, F.col(x) - F.col("_avg")).otherwise(clipped)
    return with_median.join(spread, keys).withColumn(x, value).select(*df.columns)


def detrend(df: DataFrame, x: str = "x", keys=KEYS, order=ORDER) -> DataFrame:
    """Less the least-squares line over the row number; recordings under 3 rows stay."""
    all_rows = W.partitionBy(*keys)
    df = df.withColumn("_i", (F.row_number().over(ordered(keys, order)) - 1).cast("double"))
    line = F.regr_intercept(F.col(x), F.col("_i")).over(all_rows) + F.regr_slope(F.col(x), F.col("_i")).over(all_rows) * F.col("_i")
    return df.withColumns({"_line": line, "_n": F.count("*").over(all_rows)}).withColumn(x, F.when(F.col("_n") < 3, F.col(x)).otherwise(F.col(x) - F.col("_line"))).drop("_i", "_line", "_n")


def clean_signal(df: DataFrame, x: str = "x", keys=KEYS, order=ORDER) -> DataFrame:
    return detrend(despike(interp_gaps(df, x, keys, order), x, keys=keys), x, keys, order)


def oversample_average(df: DataFrame, raw: str = "raw", block: int = 64, keys=KEYS, order=ORDER, gain: str | None = None, offset: str | None = None) -> DataFrame:
    """Integer means of full blocks of raw counts, with their voltage.

    ``gain`` (in 65536ths of a millivolt a count) and ``offset`` (millivolts) name columns with
    the fitted line of a session's converter; without them, and where either is null, counts
    are taken to be even over the converter's range. The fit's table for the range's top end isn't used.
    """
    b = F.floor((F.row_number().over(ordered(keys, order)) - 1) / block).alias("block")
    line = [F.max(c).cast("long").alias(n) if c else F.lit(None).cast("long").alias(n) for c, n in ((gain, "_gain"), (offset, "_offset"))]
    summed = df.select(*keys, b, raw, *(c for c in (gain, offset) if c)).groupBy(*keys, "block").agg(F.sum(raw).alias("s"), F.count("*").alias("n"), *line).where(F.col("n") == block)
    mean = F.floor(F.col("s") / block)
    fitted = F.floor((F.col("_gain") * mean + 32768) / 65536) + F.col("_offset")
    return summed.select(*keys, "block", mean.cast("long").alias("raw_adc"), F.coalesce(fitted, F.floor(mean * 3100 / 4095)).cast("long").alias("voltage_mv"))


def tilt_and_displacement(df: DataFrame, baseline_rows: int = 200, block: int = 10, keys=KEYS, order=ORDER) -> DataFrame:
    """Means of blocks after a baseline: displacement of az from it, and tilt in degrees."""
    i = F.row_number().over(ordered(keys, order)) - 1
    marked = df.withColumn("i", i).withColumn("block", F.when(F.col("i") >= baseline_rows, F.floor((F.col("i") - baseline_rows) / block)))
    base = marked.where(F.col("block").isNull()).groupBy(*keys).agg(F.avg("az").alias("base"))
    means = marked.where(F.col("block").isNotNull()).groupBy(*keys, "block").agg(F.avg("ay").alias("ay"), F.avg("az").alias("az"), F.count("*").alias("n")).where(F.col("n") == block)
    return means.join(base, keys).select(*keys, "block", (F.col("az") - F.col("base")).alias("displacement"), F.degrees(F.atan2("ay", "az")).alias("tilt_deg"))
