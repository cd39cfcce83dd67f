"""Phase unwrapping over (key, bin) series in native expressions, and their spectra."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import FRAME_RESP_BAND, HEART_BAND
from .cleaning import clean_signal
from .grouped import per_series
from .timing import KEYS, ORDER, ordered, so_far, whole

_PI = math.pi


def _running(df: DataFrame, step: Column, out: str, keys, order) -> DataFrame:
    return df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn(out, F.sum("_step").over(so_far(keys, order))).drop("_step")


def unwrap_live(df: DataFrame, angle: str = "angle", out: str = "phase", keys=KEYS, order=ORDER) -> DataFrame:
    """Running sum of angle steps from 0; steps beyond +-pi are turned back, +-pi itself stays."""
    d = F.col(angle) - F.lag(angle).over(ordered(keys, order))
    return _running(df, F.when(d > _PI, d - 2 * _PI).when(d < -_PI, d + 2 * _PI).otherwise(d), out, keys, order)


def unwrap_mod(df: DataFrame, angle: str = "angle", out: str = "phase", keys=KEYS, order=ORDER) -> DataFrame:
    """Running sum of angle steps wrapped to [-pi, pi), from 0."""
    d = F.col(angle) - F.lag(angle).over(ordered(keys, order)) + _PI
    return _running(df, d - F.floor(d / (2 * _PI)) * (2 * _PI) - _PI, out, keys, order)


def unwrap(df: DataFrame, angle: str = "angle", out: str = "phase", keys=KEYS, order=ORDER) -> DataFrame:
    """From the first angle on; a step of exactly +pi stays +pi."""
    d = F.col(angle) - F.lag(angle).over(ordered(keys, order))
    m = d + _PI - F.floor((d + _PI) / (2 * _PI)) * (2 * _PI) - _PI
    m = F.when((m == -_PI) & (d > 0), _PI).otherwise(m)
    turned = _running(df, F.when(F.abs(d) < _PI, d).otherwise(m), "_sum", keys, order)
    return turned.withColumn(out, F.col("_sum") + F.first(angle).over(whole(keys, order))).drop("_sum")


def differential_phase(long: DataFrame, keys=("session_id", "bin"), order=ORDER) -> DataFrame:
    """Running sum of phase steps between unit phasors, less its line over the row number."""
    w, all_rows = ordered(keys, order), W.partitionBy(*keys)
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) + 1e-12
    d = long.withColumns({"ur": F.col("re") / size, "ui": F.col("im") / size})
    pr, pi = F.lag("ur").over(w), F.lag("ui").over(w)
    step = F.atan2(F.col("ui") * pr - F.col("ur") * pi, F.col("ur") * pr + F.col("ui") * pi)
    d = _running(d, step, "_sum", keys, order).withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
    line = F.regr_intercept(F.col("_sum"), F.col("_i")).over(all_rows) + F.regr_slope(F.col("_sum"), F.col("_i")).over(all_rows) * F.col("_i")
    return d.withColumn("phase", F.col("_sum") - F.coalesce(line, F.lit(0.0))).drop("ur", "ui", "_sum", "_i")


def dft_power(df: DataFrame, x: str, keys=KEYS, order=ORDER, window: str = "hann") -> DataFrame:
    """Power by frequency number k of whole series, mean-free and windowed.

    One exchange by series and one FFT each, many series an Arrow batch; a worker holds
    one series. What isn't a number counts as the mean.
    """

    def power(v: np.ndarray) -> dict:
        n = len(v)
        good = np.isfinite(v)
        y = np.where(good, v - (v[good].mean() if good.any() else 0.0), 0.0)
        if window == "hann":
            y = y * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1)))
        return {"k": np.arange(n // 2 + 1, dtype=np.int32), "n": np.full(n // 2 + 1, n), "power": np.abs(np.fft.rfft(y)) ** 2}

    return per_series(df.withColumn(x, F.col(x).cast("double")), x, power, "k int, n long, power double", list(keys), list(order))


def band_top(power: DataFrame, rates: DataFrame, band: tuple[float, float], keys=KEYS) -> DataFrame:
    """The strongest frequency in a band; the lower one on ties. ``rates`` has fs by key."""
    p = power.join(rates.select(*keys, "fs"), keys).withColumn("hz", F.col("k") * F.col("fs") / F.col("n"))
    inside = p.where((F.col("hz") >= band[0]) & (F.col("hz") <= band[1]))
    return inside.groupBy(*keys).agg(F.max_by("hz", F.struct("power", -F.col("k"))).alias("peak_hz"), F.max("power").alias("power"))


def energy_ratio(power: DataFrame, fs: Column, keys=KEYS) -> DataFrame:
    """Mean energy in the vital band over that beside it; 1 where a series is short or a side empty."""
    hz, top = F.col("k") * fs / F.col("n"), fs * 0.46
    vital = (hz >= FRAME_RESP_BAND[0]) & (hz <= F.least(F.lit(HEART_BAND[1]), top))
    beside = (hz >= 0.03) & (hz <= F.least(top, F.lit(5.0))) & ~vital
    a, b = F.avg(F.when(vital, F.col("power"))), F.avg(F.when(beside, F.col("power")))
    ratio = F.when((F.max("n") < 16) | a.isNull() | b.isNull(), 1.0).otherwise(a / (b + 1e-18))
    return power.groupBy(*keys).agg(ratio.alias("energy_ratio"))


def autocorrelation(df: DataFrame, x: str, first: int, last: int, keys=KEYS, order=ORDER) -> DataFrame:
    """Normalised autocorrelation at lags first .. last by an equi-join of the series with itself."""
    d = df.withColumn("i", F.row_number().over(ordered(keys, order))).select(*keys, "i", F.col(x).alias("y"))
    shifted = d.select(*keys, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("lag"), (F.col("i") + F.col("lag")).alias("i"), F.col("y").alias("z"))
    zero = d.groupBy(*keys).agg((F.sum(F.col("y") * F.col("y")) + 1e-12).alias("energy"))
    s = d.join(shifted, [*keys, "i"]).groupBy(*keys, "lag").agg(F.sum(F.col("y") * F.col("z")).alias("s"))
    return s.join(zero, keys).select(*keys, "lag", (F.col("s") / F.col("energy")).alias("acf"))


def lag_peak(acf: DataFrame, first: int, last: int, keys=KEYS) -> DataFrame:
    """Best local maximum of lags first .. last, else the largest one, refined by a parabola."""
    w = W.partitionBy(*keys).orderBy("lag")
    a = acf.withColumns({"y0": F.lag("acf").over(w), "y2": F.lead("acf").over(w)})
    a = a.where((F.col("lag") >= first) & (F.col("lag") <= last))
    top = (F.col("acf") > F.col("y0")) & (F.col("acf") > F.col("y2"))
    best = a.groupBy(*keys).agg(F.max_by(F.struct("lag", "acf", "y0", "y2"), F.struct(F.coalesce(top, F.lit(False)).cast("int"), "acf", -F.col("lag"))).alias("b")).select(*keys, "b.*")
    bend = F.col("y0") - 2 * F.col("acf") + F.col("y2")
    offset = F.when(F.abs(bend) > 1e-12, 0.5 * (F.col("y0") - F.col("y2")) / bend).otherwise(0.0)
    return best.select(*keys, "lag", "acf", (F.col("lag") + F.coalesce(offset, F.lit(0.0))).alias("refined_lag"))


def notch(power: str | Column, hz: str | Column, rejected: list[float], depth: float = 0.50, least: float = 0.020, share: float = 0.015) -> Column:
    power, hz = (F.col(c) if isinstance(c, str) else c for c in (power, hz))
    for r in rejected:
        if r > 0:
            power = power * (1 - depth * F.exp(-0.5 * F.pow((hz - r) / max(least, share * r), 2)))
    return power


def smoothed(df: DataFrame, x: str, keys=KEYS, order=ORDER) -> DataFrame:
    """Five-tap kernel with zeros outside."""
    w = ordered(keys, order)
    taps = {-2: 0.12, -1: 0.20, 0: 0.36, 1: 0.20, 2: 0.12}
    total = sum((c * (F.col(x) if k == 0 else F.coalesce(F.lag(x, -k).over(w), F.lit(0.0))) for k, c in taps.items()), F.lit(0.0))
    return df.withColumn("smooth", total)


def local_maxima(df: DataFrame, x: str, keys=KEYS, order=ORDER) -> DataFrame:
    w = ordered(keys, order)
    return df.withColumns({"_a": F.lag(x).over(w), "_b": F.lead(x).over(w)}).where((F.col(x) > F.col("_a")) & (F.col(x) > F.col("_b"))).drop("_a", "_b")


def covariance(df: DataFrame, names: list[str], keys=KEYS) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return df.groupBy(*keys).agg(*(F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs))


def first_component(df: DataFrame, names: list[str], keys=KEYS) -> DataFrame:
    """First principal axis of three columns by key, and its share of the variance.

    In closed form from the covariance: the largest root of a symmetric 3 x 3 matrix by
    the cosine formula, its axis as the largest cross product of the rows less that root.
    The axis' largest entry is positive. Without variance the axis is null, the share 0.
    """
    x, y, z = names
    c = covariance(df, names, keys)
    xx, xy, xz, yy, yz, zz = (F.col(f"cov_{a}_{b}") for a, b in ((x, x), (x, y), (x, z), (y, y), (y, z), (z, z)))
    mean = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    c = c.withColumns({"_q": mean, "_p": F.sqrt(((xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean) + 2 * off) / 6)})
    q, p = F.col("_q"), F.col("_p")
    a, b, d = xx - q, yy - q, zz - q
    det = a * (b * d - yz * yz) - xy * (xy * d - yz * xz) + xz * (xy * yz - b * xz)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))) / 3
    c = c.withColumn("_top", F.when(p > 0, q + 2 * p * F.cos(turn)).otherwise(q))
    rows = [(xx - F.col("_top"), xy, xz), (xy, yy - F.col("_top"), yz), (xz, yz, zz - F.col("_top"))]
    cross = lambda r, s: (r[1] * s[2] - r[2] * s[1], r[2] * s[0] - r[0] * s[2], r[0] * s[1] - r[1] * s[0])
    size = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    found = [F.struct(size(v).alias("size"), *(e.alias(n) for e, n in zip(v, "abc"))) for v in (cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2]))]
    c = c.withColumn("_v", F.greatest(*found))
    entries = [F.col(f"_v.{n}") / F.col("_v.size") for n in "abc"]
    largest = F.greatest(*(F.struct(F.abs(e).alias("s"), e.alias("e")) for e in entries))["e"]
    axis = [F.when(F.col("_v.size") > 0, e * F.signum(largest)) for e in entries]
    share = F.when(q > 0, F.col("_top") / (3 * q)).otherwise(0.0)
    return c.select(*keys, *(e.alias(f"axis_{n}") for e, n in zip(axis, names)), share.alias("share"))


def projected(df: DataFrame, names: list[str], keys=KEYS, out: str = "component") -> DataFrame:
    """Adds the projection of the uncentred rows on their recording's first principal axis."""
    axes = first_component(df, names, keys).select(*keys, *(F.col(f"axis_{n}").alias(f"_axis_{n}") for n in names))
    dot = sum((F.col(n) * F.col(f"_axis_{n}") for n in names), F.lit(0.0))
    return df.join(axes, keys).withColumn(out, dot).select(*df.columns, out)


def phase_matrix(angles: DataFrame, keys=("session_id", "bin"), order=ORDER) -> DataFrame:
    """``phase`` of each series of angles: unwrapped, less its median, cleaned."""
    keys = list(keys)
    u = unwrap(angles, keys=keys, order=order)
    middle = u.groupBy(*keys).agg(F.median("phase").alias("_middle"))
    return clean_signal(u.join(middle, keys).withColumn("phase", F.col("phase") - F.col("_middle")).drop("_middle"), "phase", keys, order)


def aligned_mean(long: DataFrame, x: str, weights: DataFrame, reference: str = "reference_bin", keys=KEYS, order=ORDER) -> DataFrame:
    """Weighted mean over bins of cleaned series, each turned to the sign of its product with the reference bin's.

    ``weights`` has bin, weight and the reference bin by key; its bins are the ones that count.
    """
    keys, order = list(keys), list(order)
    own = long.select(*keys, *order, "bin", F.col(x).alias("_x")).join(weights.select(*keys, "bin", "weight", F.col(reference).alias("_reference")), [*keys, "bin"])
    cleaned = clean_signal(own, "_x", [*keys, "bin"], order)
    ref = cleaned.where(F.col("bin") == F.col("_reference")).select(*keys, *order, F.col("_x").alias("_r"))
    both = cleaned.join(ref, [*keys, *order])
    turn = F.when(F.sum(F.col("_x") * F.col("_r")).over(W.partitionBy(*keys, "bin")) < 0, -1.0).otherwise(1.0)
    turned = both.withColumn("_turned", turn * F.col("weight") * F.col("_x"))
    return turned.groupBy(*keys, *order).agg((F.sum("_turned") / (F.sum("weight") + 1e-12)).alias("mean"))


def coherent_phase(long: DataFrame, weights: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """``phase``, ``raw_i`` and ``raw_q`` of weighted bins by row.

    Phase: running sum of the angles of the mean cross product of successive unit
    phasors, cleaned. I and Q: weighted sum of the bins, each turned to the heaviest one
    by the angle of their mean product. ``weights`` has bin and weight > 0 by key.
    """
    keys, order = list(keys), list(order)
    total = F.sum("weight").over(W.partitionBy(*keys)) + 1e-12
    heaviest = F.max_by("bin", F.struct("weight", -F.col("bin"))).over(W.partitionBy(*keys))
    w = weights.where("weight > 0").select(*keys, "bin", "weight").withColumns({"_share": F.col("weight") / total, "_heaviest": heaviest})
    own = long.select(*keys, *order, "bin", "re", "im").join(w, [*keys, "bin"])
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) + 1e-12
    u = own.withColumns({"_a": F.col("re") / size, "_b": F.col("im") / size})
    before = ordered([*keys, "bin"], order)
    u = u.withColumns({"_pa": F.lag("_a").over(before), "_pb": F.lag("_b").over(before)})
    cross = u.groupBy(*keys, *order).agg(F.sum(F.col("_share") * (F.col("_a") * F.col("_pa") + F.col("_b") * F.col("_pb"))).alias("_c"), F.sum(F.col("_share") * (F.col("_b") * F.col("_pa") - F.col("_a") * F.col("_pb"))).alias("_s"))
    phase = clean_signal(_running(cross, F.atan2("_s", "_c"), "phase", keys, order).select(*keys, *order, "phase"), "phase", keys, order)
    ref = own.where(F.col("bin") == F.col("_heaviest")).select(*keys, *order, F.col("re").alias("_re"), F.col("im").alias("_im"))
    both = own.join(ref, [*keys, *order])
    series = W.partitionBy(*keys, "bin")
    c, d = (F.avg(e).over(series) for e in (F.col("re") * F.col("_re") + F.col("im") * F.col("_im"), F.col("im") * F.col("_re") - F.col("re") * F.col("_im")))
    both = both.withColumns({"_c": c, "_d": d}).withColumn("_turn", F.when(F.hypot("_c", "_d") > 1e-12, F.atan2("_d", "_c")).otherwise(0.0))
    i = F.col("weight") * (F.col("re") * F.cos("_turn") + F.col("im") * F.sin("_turn"))
    q = F.col("weight") * (F.col("im") * F.cos("_turn") - F.col("re") * F.sin("_turn"))
    return phase.join(both.groupBy(*keys, *order).agg(F.sum(i).alias("raw_i"), F.sum(q).alias("raw_q")), [*keys, *order])
