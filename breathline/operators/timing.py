"""Order-based operators over many recordings: rates, time axes, windows, tails.

``keys`` name a recording; ``order`` is a total order within it. Everything that
needs the order uses the same window, so Spark sorts a recording once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS, ORDER = ["session_id"], ["seq"]


def ordered(keys=KEYS, order=ORDER):
    return W.partitionBy(*keys).orderBy(*order)


def whole(keys=KEYS, order=ORDER):
    return ordered(keys, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def so_far(keys=KEYS, order=ORDER):
    return ordered(keys, order).rowsBetween(W.unboundedPreceding, 0)


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def gaps(df: DataFrame, t: str = "t_ms", keys=KEYS, order=ORDER) -> DataFrame:
    """Finite times with ``gap``, the seconds since the row before (null in the first)."""
    return df.where(finite(t)).withColumn("gap", (F.col(t) - F.lag(t).over(ordered(keys, order))) / 1000)


def medians(df: DataFrame, x: str | Column, out: str, keys=KEYS, long: bool = False) -> DataFrame:
    """Exact median of the non-null values of each key.

    An aggregate holds a key's distinct values in one task, which is fine for recordings of
    some hours. With ``long`` it holds a sketch of bounded size instead; only the values
    between its 49th and 51st percentile are counted and ranked, by Spark's sort.
    """
    if not long:
        return df.groupBy(*keys).agg(F.median(x).alias(out))
    own = df.select(*keys, (F.col(x) if isinstance(x, str) else x).cast("double").alias("_x")).where("_x is not null")
    # Ranks are off by a thousandth at most, so both middle values lie between.
    marks = own.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", [0.49, 0.51], 1_000).alias("_q"))
    placed = own.join(marks, keys).groupBy(*keys, F.when(F.col("_x") < F.col("_q")[0], F.lit(None)).otherwise(F.col("_x")).alias("_x")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"), F.first("_q").alias("_q"))
    # Smaller values are one row, the null, which sorts first.
    ranked = placed.where(F.col("_x").isNull() | (F.col("_x") <= F.col("_q")[1])).withColumn("_c", F.sum("_c").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("_x")).rowsBetween(W.unboundedPreceding, 0)))
    at = lambda rank: F.min(F.when(F.col("_c") > rank, F.col("_x")))
    middle = (at(F.floor((F.col("_n") - 1) / 2)) + at(F.ceil((F.col("_n") - 1) / 2))) / 2
    return ranked.groupBy(*keys).agg(middle.alias(out))


def rate_of_all_gaps(df: DataFrame, default: float, t: str = "t_ms", keys=KEYS) -> DataFrame:
    """Rate of time-sorted samples; the mean of all gaps telescopes to span / (n - 1)."""
    span = (F.max(t) - F.min(t)) / 1000
    fs = F.when(span > 0, (F.count(t) - 1) / span).otherwise(default)
    return df.groupBy(*keys).agg(fs.alias("fs"))


def rate_in_stored_order(df: DataFrame, default: float, t: str = "t_ms", keys=KEYS, order=ORDER) -> DataFrame:
    """Rate of samples as stored: (last - first) / (n - 1), by order and not by time."""
    by = F.struct(*order)
    span = (F.max_by(t, by) - F.min_by(t, by)) / 1000
    return df.groupBy(*keys).agg(F.when(span > 0, (F.count(t) - 1) / span).otherwise(default).alias("fs"))


def rate_of_positive_gaps(df: DataFrame, default: float, t: str = "t_ms", keys=KEYS, order=ORDER) -> DataFrame:
    ahead = F.when(F.col("gap") > 0, F.col("gap"))
    return gaps(df, t, keys, order).groupBy(*keys).agg(F.coalesce(1 / F.avg(ahead), F.lit(float(default))).alias("fs"))


def robust_rate(df: DataFrame, default: float = 20.0, t: str = "t_ms", keys=KEYS, order=ORDER, long: bool = False) -> DataFrame:
    """Rate from usual gaps, or count over elapsed time where gaps come in bursts.

    Both passes group by the same keys, so the gaps are exchanged once. ``long`` as in :func:`medians`.
    """
    g = gaps(df, t, keys, order)
    by, gap = F.struct(*order), F.col("gap")
    first = g.groupBy(*keys).agg(
        F.count("*").alias("n"), ((F.max_by(t, by) - F.min_by(t, by)) / 1000).alias("elapsed"), *([] if long else [F.median(F.when(gap > 0, gap)).alias("middle")]), F.sum((gap <= 0).cast("long")).alias("back")
    )
    if long:
        first = first.join(medians(g, F.when(gap > 0, gap), "middle", keys, long), keys, "left")
    usual = F.when((gap > 0.25 * F.col("middle")) & (gap < 4 * F.col("middle")), gap)
    short = (gap > 0) & (gap < F.greatest(F.lit(0.002), 0.2 * F.col("middle")))
    second = g.join(first, keys).groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("elapsed").alias("elapsed"), F.first("middle").alias("middle"), F.first("back").alias("back"),
        F.sum(short.cast("long")).alias("short"), F.avg(usual).alias("usual"), F.avg(F.when(gap > 0, gap)).alias("ahead"),
    )
    total = F.when(F.col("elapsed") > 0, (F.col("n") - 1) / F.col("elapsed")).otherwise(0.0)
    bursty = (F.col("back") + F.col("short")) / (F.col("n") - 1)
    or_default = F.when(total > 0, total).otherwise(float(default))
    fs = (
        F.when(F.col("n") < 2, float(default))
        .when(F.col("middle").isNull(), or_default)
        .when((total > 0) & ((bursty > 0.05) | (F.abs(1 / F.col("middle") - total) / total > 0.25)), total)
        .otherwise(1 / F.coalesce("usual", "ahead"))
    )
    return second.select(*keys, fs.alias("fs"), F.coalesce(bursty, F.lit(0.0)).alias("bursty"))


def time_axis(df: DataFrame, rates: DataFrame, t: str = "t_ms", keys=KEYS, order=ORDER) -> DataFrame:
    """Adds ``time_s``: wall seconds, or even ones over the same span where gaps come in bursts.

    ``rates`` has ``fs`` by key.
    """
    w, all_rows, gap = ordered(keys, order), whole(keys, order), F.col("gap")
    g = gaps(df, t, keys, order).withColumn("n", F.count("*").over(all_rows)).withColumn("i", F.row_number().over(w) - 1)
    middle = g.groupBy(*keys).agg(F.median(F.when(gap > 0, gap)).alias("middle"))
    short = (gap > 0) & (gap < F.greatest(F.lit(0.002), 0.2 * F.col("middle")))
    g = g.join(middle, keys).join(rates.select(*keys, "fs"), keys)
    g = g.withColumn("back", F.avg((gap <= 0).cast("double")).over(all_rows)).withColumn("short", F.sum(F.coalesce(short, F.lit(False)).cast("long")).over(all_rows) / (F.col("n") - 1))
    wall = (F.col(t) - F.first(t).over(all_rows)) / 1000
    span = (F.last(t).over(all_rows) - F.first(t).over(all_rows)) / 1000
    even = F.col("i") / F.col("fs") * (span / F.greatest((F.col("n") - 1) / F.col("fs"), F.lit(1e-9)))
    use_even = (F.col("n") >= 3) & (F.col("fs") > 0) & ((F.col("back") > 0.05) | (F.col("short") > 0.05)) & (span > 0)
    return g.withColumn("time_s", F.when(use_even, even).otherwise(wall)).select(*df.columns, "time_s")


def rebased(df: DataFrame, t: str = "t_ms", keys=KEYS, order=ORDER) -> DataFrame:
    """Adds seconds since the earliest and since the first row."""
    w = whole(keys, order)
    return df.withColumns({"since_min": (F.col(t) - F.min(t).over(w)) / 1000, "since_first": (F.col(t) - F.first(t).over(w)) / 1000})


def trailing_window(df: DataFrame, seconds: float, t: str = "t_ms", keys=KEYS, order=ORDER) -> DataFrame:
    """Rows within ``seconds`` of the last row (not of the latest time)."""
    return df.withColumn("last_t", F.last(t).over(whole(keys, order))).where(F.col(t) >= F.col("last_t") - seconds * 1000).drop("last_t")


def since_cutoff(df: DataFrame, cutoff_ms: float, t: str = "t_ms", keys=KEYS, order=ORDER) -> DataFrame:
    """Rows from a cutoff on; the last row alone where a recording has none."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    late = F.max((F.col(t) >= cutoff_ms).cast("int")).over(W.partitionBy(*keys))
    marked = df.withColumns({"late": late, "back": F.row_number().over(w)})
    return marked.where((F.col(t) >= cutoff_ms) | ((F.col("late") == 0) & (F.col("back") == 1))).drop("late", "back")


def tail(df: DataFrame, n: int, keys=KEYS, order=ORDER) -> DataFrame:
    """The last n rows of each recording; the rank limit is applied before the exchange."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).drop("back")


def bounded_history(df: DataFrame, rates: DataFrame, seconds: float = 180.0, keys=KEYS, order=ORDER) -> DataFrame:
    """The last rows of each recording that a live history of ``seconds`` keeps at its rate: a fifth more, 32 at least."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    most = F.greatest(F.lit(32), F.rint(seconds * F.greatest("fs", F.lit(1.0)) * 1.2))
    ranked = df.withColumn("back", F.row_number().over(w)).join(rates.select(*keys, "fs"), keys)
    return ranked.where(F.col("back") <= most).select(*df.columns)


def view_horizon(df: DataFrame, seconds: float, t: str = "t_ms", keys=KEYS, order=ORDER) -> DataFrame:
    """Rows of a live trace that its view draws (``shown``), among those of its spectrum: 30 s, 20 s or the view."""
    last = F.last(t).over(whole(keys, order))
    recent = df.withColumn("_last", last).where(F.col(t) >= F.col("_last") - 1000 * max(30.0, 20.0, seconds))
    return recent.withColumn("shown", F.col(t) >= F.col("_last") - 1000 * seconds).drop("_last")


def plot_range(df: DataFrame, x: str, least_span: float = 1e-3, keys=KEYS, order=ORDER) -> DataFrame:
    """Axis limits from finite values, less 5 % (1 to 50 rows) at either end of more than 20."""
    w = ordered(keys, order)
    good = df.where(finite(x)).withColumns({"i": F.row_number().over(w), "n": F.count("*").over(W.partitionBy(*keys))})
    trim = F.when(F.col("n") > 20, F.least(F.greatest(F.floor(F.col("n") / 20), F.lit(1)), F.lit(50))).otherwise(0)
    inner = good.where((F.col("i") > trim) & (F.col("i") <= F.col("n") - trim))
    low, high = F.min(x), F.max(x)
    half = 0.65 * F.greatest(high - low, F.lit(float(least_span)))
    return inner.groupBy(*keys).agg(((low + high) / 2 - half).alias("y_min"), ((low + high) / 2 + half).alias("y_max"))


def running_integral(df: DataFrame, x: str, t: str, out: str, keys=KEYS, order=ORDER) -> DataFrame:
    """Cumulative trapezoid from 0; ``t`` in seconds."""
    w = ordered(keys, order)
    step = (F.col(x) + F.lag(x).over(w)) / 2 * (F.col(t) - F.lag(t).over(w))
    return df.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn(out, F.sum("step").over(so_far(keys, order))).drop("step")
