"""Range-bin operators: arrays of one frame, or long rows (session, frame, bin)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import BASE_STEP, FRAME_RESP_BAND, HEART_BAND, MIN_TARGET_DISTANCE, RANGE_STEPS
from .timing import KEYS, medians


def magnitude(*parts: str | Column) -> Column:
    parts = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def frame_amplitude(re: str = "re", im: str = "im") -> Column:
    return F.zip_with(re, im, lambda a, b: F.sqrt(a * a + b * b))


def frame_phase(re: str = "re", im: str = "im") -> Column:
    return F.zip_with(re, im, lambda a, b: F.atan2(b, a))


def array_mean(a: str | Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def first_max(a: str | Column) -> Column:
    """0-based position of the largest element, the first one on ties."""
    a = F.col(a) if isinstance(a, str) else a
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def project_frame(df: DataFrame, start_m: float = 0.2, step_m: float = 0.02, distances: str | None = None) -> DataFrame:
    """Peak distance, amplitude and phase and mean amplitude of frames (re, im arrays).

    Where ``distances`` differs in length from the profile, bins count as 0, 1, 2, ...
    """
    df = df.withColumns({"amplitude": frame_amplitude(), "phase": frame_phase()}).withColumn("peak_bin", first_max("amplitude"))
    if distances is None:
        at = F.lit(start_m) + F.col("peak_bin") * F.lit(step_m)
    else:
        at = F.when(F.size(distances) == F.size("re"), F.expr(f"{distances}[peak_bin]")).otherwise(F.col("peak_bin").cast("double"))
    return df.withColumns({"peak_distance_m": at, "peak_amplitude": F.array_max("amplitude"), "peak_phase_rad": F.expr("phase[peak_bin]"), "mean_amplitude": array_mean("amplitude")})


def explode_bins(df: DataFrame, start_m: float = 0.2, step_m: float = 0.02, keys=("session_id", "seq")) -> DataFrame:
    """Long rows: bin, distance, re, im."""
    pairs = F.arrays_zip("re", "im")
    long = df.select(*keys, F.posexplode(pairs).alias("bin", "z"))
    return long.select(*keys, "bin", (F.lit(start_m) + F.col("bin") * F.lit(step_m)).alias("distance_m"), F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def nearest_bin(bins: DataFrame, target: str | Column, keys=KEYS) -> DataFrame:
    """The bin nearest a target distance, the lower one on ties."""
    target = F.col(target) if isinstance(target, str) else target
    return bins.groupBy(*keys).agg(F.min_by("bin", F.struct(F.abs(F.col("distance_m") - target), "bin")).alias("bin"))


def beyond_leakage(bins: DataFrame, keys=KEYS) -> DataFrame:
    """Adds ``searched``: bins past the nearest usable distance, or all where none are."""
    far = F.col("distance_m") >= MIN_TARGET_DISTANCE
    any_far = F.max(far.cast("int")).over(W.partitionBy(*keys)) == 1
    return bins.withColumn("searched", F.when(any_far, far).otherwise(True))


def gated(bins: DataFrame, selected: DataFrame, half_width: float, keys=KEYS) -> DataFrame:
    """Bins within half a gate of the selected one; ``selected`` has one distance a key."""
    return bins.join(selected, keys).where(F.abs(F.col("distance_m") - F.col("selected_m")) <= half_width)


def nearest_k(bins: DataFrame, selected: str = "selected_bin", k: int = 3, keys=KEYS) -> DataFrame:
    """The k bins nearest the selected one, lower first on ties."""
    w = W.partitionBy(*keys).orderBy(F.abs(F.col("bin") - F.col(selected)), "bin")
    return bins.withColumn("near", F.row_number().over(w)).where(F.col("near") <= k).drop("near")


def bin_medians(long: DataFrame, keys=KEYS, long_recordings: bool = False) -> DataFrame:
    return medians(long, magnitude("re", "im"), "median_amplitude", [*keys, "bin", "distance_m"], long_recordings)


def select_target(bins: DataFrame, latest_peak: DataFrame, keys=KEYS) -> DataFrame:
    """The best bin by amplitude, phase energy and the latest peak.

    ``bins``: median_amplitude and energy_ratio by bin; ``latest_peak``: peak_m by key.
    """
    all_bins = W.partitionBy(*keys)
    b = beyond_leakage(bins, keys).join(latest_peak, keys)
    floor = b.where("searched").groupBy(*keys).agg((F.median("median_amplitude") + 1e-12).alias("floor"))
    b = b.join(floor, keys)
    amp = F.when(F.col("searched"), F.col("median_amplitude") / F.col("floor")).otherwise(0.0)
    b = b.withColumn("score", amp + 0.15 * F.least(F.greatest("energy_ratio", F.lit(0.0)), F.lit(5.0)))
    near = F.min_by("bin", F.struct(F.abs(F.col("distance_m") - F.col("peak_m")), "bin")).over(all_bins)
    b = b.withColumns({"best": F.max("score").over(all_bins), "peak_bin": near})
    bonus = F.when((F.col("bin") == F.col("peak_bin")) & F.col("searched") & (F.col("peak_m") > 0), 0.5 * F.col("best")).otherwise(0.0)
    return b.withColumn("score", F.col("score") + bonus).groupBy(*keys).agg(F.max_by("bin", F.struct("score", -F.col("bin"))).alias("target_bin"), F.max("score").alias("score"))


def shares(bins: DataFrame, amplitude: str, keys=KEYS) -> DataFrame:
    """Adds ``weight``: a bin's share of the amplitudes of its key; even shares where they sum to 0."""
    w = W.partitionBy(*keys)
    positive = F.greatest(F.col(amplitude), F.lit(0.0))
    total = F.sum(positive).over(w)
    return bins.withColumn("weight", F.when(total > 0, positive / (total + 1e-12)).otherwise(1.0 / F.count("*").over(w)))


def circle_fit(long: DataFrame, keys=KEYS) -> DataFrame:
    """Kasa circle of each bin's samples: centre, radius, relative rms, plausibility, quality.

    Sums about the bin's mean need two passes over the same grouping.
    """
    by = [*keys, "bin"]
    w = W.partitionBy(*by)
    d = long.withColumns({"mx": F.avg("re").over(w), "my": F.avg("im").over(w)})
    u, v = F.col("re") - F.col("mx"), F.col("im") - F.col("my")
    r2 = u * u + v * v
    s = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(u * u).alias("suu"), F.sum(v * v).alias("svv"), F.sum(u * v).alias("suv"),
        F.sum(u * r2).alias("su"), F.sum(v * r2).alias("sv"), F.avg(r2).alias("r2"), F.median(magnitude("re", "im")).alias("typical"),
    ).withColumn("det", F.col("suu") * F.col("svv") - F.col("suv") * F.col("suv"))
    ok = F.col("det") > 1e-12
    s = s.withColumns({
        "cu": F.when(ok, (F.col("svv") * F.col("su") - F.col("suv") * F.col("sv")) / F.col("det") / 2).otherwise(0.0),
        "cv": F.when(ok, (F.col("suu") * F.col("sv") - F.col("suv") * F.col("su")) / F.col("det") / 2).otherwise(0.0),
    }).withColumn("radius", F.sqrt(F.greatest(F.col("cu") * F.col("cu") + F.col("cv") * F.col("cv") + F.when(ok, F.col("r2")).otherwise(0.0), F.lit(0.0))))
    fitted = s.select(*by, "n", "det", "radius", "typical", (F.col("mx") + F.col("cu")).alias("cx"), (F.col("my") + F.col("cv")).alias("cy"))
    off = magnitude(F.col("re") - F.col("cx"), F.col("im") - F.col("cy")) - F.col("radius")
    rms = long.join(fitted, by).groupBy(*by).agg(F.sqrt(F.avg(off * off)).alias("rms"))
    out = fitted.join(rms, by).withColumn("rms", F.col("rms") / (F.col("radius") + 1e-12))
    plausible = (F.col("n") >= 8) & (F.col("det") > 1e-12) & (F.col("radius") > 0.05 * F.col("typical")) & (F.col("radius") < 20 * F.col("typical")) & (F.col("rms") < 0.45)
    return out.withColumn("plausible", plausible).withColumn("quality", F.when(plausible, F.least(F.greatest(1 - F.col("rms") / 0.45, F.lit(0.0)), F.lit(1.0))).otherwise(0.25))


def session_plan(configs: DataFrame) -> DataFrame:
    """Sensor settings that fit the line's speed: start point, step, points, sweeps, end.

    Columns start_m, end_m, sweeps, rate_hz, baud, step.
    """
    cap = F.least(F.floor(F.col("baud") / (48 * F.greatest(F.col("rate_hz"), F.lit(1.0)))), F.lit(4095)).cast("long")
    c = configs.withColumns({"cap": cap, "span": F.greatest(F.col("end_m") - F.col("start_m"), F.lit(BASE_STEP)), "asked": F.greatest("sweeps", F.lit(1))})
    most = F.greatest(F.floor(F.col("cap") / F.col("asked")), F.lit(2))
    c = c.withColumn("least_step", F.greatest(F.greatest("step", F.lit(1)), F.ceil(F.col("span") / (BASE_STEP * (most - 1)))))
    step = F.ceil(F.col("least_step") / 24) * 24
    for s in sorted(RANGE_STEPS, reverse=True):
        step = F.when(F.col("least_step") <= s, s).otherwise(step)
    c = c.withColumn("step_length", step.cast("long"))
    c = c.withColumn("num_points", F.greatest(F.ceil(F.col("span") / (BASE_STEP * F.col("step_length"))) + 1, F.lit(2)).cast("long"))
    c = c.withColumn("start_point", F.greatest(F.round(F.col("start_m") / BASE_STEP), F.lit(0.0)).cast("long"))
    sweeps = F.greatest(F.least("asked", F.greatest(F.floor(F.col("cap") / F.col("num_points")), F.lit(1))), F.lit(1)).cast("long")
    end = (F.col("start_point") + (F.col("num_points") - 1) * F.col("step_length")) * BASE_STEP
    return c.withColumns({"sweeps_per_frame": sweeps, "planned_end_m": end}).drop("span", "asked", "least_step")


def presence(amp_ratio: str, n_bins: str, phase_ratio: str) -> tuple[Column, Column]:
    """(score, present) columns."""
    a, p = F.col(amp_ratio), F.col(phase_ratio)
    raw = (a - 1) * 35 + F.least(n_bins, F.lit(5)) * 6 + F.least(F.greatest(p, F.lit(0.0)), F.lit(5.0)) * 10
    score = F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))
    return score, (score >= 20) & ((a >= 1.08) | (p >= 1.30))


def signal_quality(amp_ratio: str, resp_conf: str, heart_conf: str, phase_ratio: str, present: str) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    q = 0.18 * F.log1p(F.greatest(F.col(amp_ratio) - 1, zero)) + 0.22 * F.least(F.col(resp_conf) / 5, one) + 0.22 * F.least(F.col(heart_conf) / 5, one) + 0.20 * F.least(F.greatest(phase_ratio, zero) / 4, one)
    return F.least(F.greatest(q + F.when(F.col(present), 0.18).otherwise(0.0), zero), one)


def clamp_band(low: str | Column, high: str | Column, limits: tuple[float, float], least: float) -> tuple[Column, Column]:
    lo, hi = F.greatest(low, F.lit(limits[0])), F.least(high, F.lit(limits[1]))
    centre = F.least(F.greatest((lo + hi) / 2, F.lit(limits[0] + least / 2)), F.lit(limits[1] - least / 2))
    narrow = hi - lo < least
    return F.when(narrow, F.greatest(F.lit(limits[0]), centre - least / 2)).otherwise(lo), F.when(narrow, F.least(F.lit(limits[1]), centre + least / 2)).otherwise(hi)


def heart_search_band(prior: str, deviation: str) -> tuple[Column, Column]:
    """(low, high) about a prior rate: three deviations (0.12 where unknown), 0.40 Hz at least; the whole band without one."""
    known = F.col(prior).isNotNull() & ~F.isnan(prior) & (F.col(prior) > 0)
    half = F.greatest(F.lit(0.40), 3 * F.coalesce(F.col(deviation), F.lit(0.12)))
    low, high = clamp_band(F.col(prior) - half, F.col(prior) + half, HEART_BAND, 0.80)
    return F.when(known, low).otherwise(HEART_BAND[0]), F.when(known, high).otherwise(HEART_BAND[1])


def presence_of_phase(df: DataFrame, amplitude: str, keys=KEYS) -> DataFrame:
    """Presence score of recordings without profiles: how steady the peak's amplitude is."""
    first = df.groupBy(*keys).agg(F.median(amplitude).alias("_m"))
    spread = df.join(first, keys).groupBy(*keys).agg(F.first("_m").alias("_m"), (1.4826 * F.median(F.abs(F.col(amplitude) - F.col("_m")))).alias("_s"))
    score = F.least(F.greatest(40 * F.col("_m") / (F.col("_s") + F.col("_m") + 1e-9), F.lit(0.0)), F.lit(100.0))
    return spread.select(*keys, score.alias("score"), (score >= 20).alias("present"))


def weighted_bins(scored: DataFrame, most: int = 9, keys=KEYS) -> DataFrame:
    """Weights of the gated bins that stand out by score, and by vital-band energy if any does; the best bin.

    ``scored`` has bin, score, inside, ratio and selected_bin by key. Bins without weight
    are left out. At most ``most`` bins, of equal ones the higher.
    """
    all_bins = W.partitionBy(*keys)
    nearest = F.least(F.greatest("selected_bin", F.min("bin").over(all_bins)), F.max("bin").over(all_bins))
    inside = F.when(F.max(F.col("inside").cast("int")).over(all_bins) == 1, F.col("inside")).otherwise(F.col("bin") == nearest)
    g = scored.withColumn("_in", inside).where("_in").withColumn("_own", F.greatest("score", F.lit(0.0)))
    g = g.withColumn("_own", F.when(F.sum("_own").over(all_bins) > 0, F.col("_own")).otherwise(1.0))
    level = g.groupBy(*keys).agg((F.avg("_own") + 0.2 * F.max("_own")).alias("_high"), F.percentile("_own", 0.65).alias("_cut"))
    g = g.join(level, keys).withColumn("_vital", (F.col("_own") >= F.col("_high")) & (F.col("ratio") >= 1.8))
    picked = F.when(F.max(F.col("_vital").cast("int")).over(all_bins) == 1, F.col("_vital")).otherwise(F.col("_own") >= F.col("_cut"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_own"), F.desc("bin")))
    g = g.withColumn("_picked", picked).where("_picked").withColumn("_rank", rank).where(F.col("_rank") <= most)
    total = F.sum("_own").over(all_bins)
    weight = F.when(total > 0, F.col("_own") / (total + 1e-12)).otherwise(1 / F.count("*").over(all_bins))
    best = F.max_by("bin", F.struct("_own", -F.col("bin"))).over(all_bins)
    return g.select(*keys, "bin", weight.alias("weight"), best.alias("best_bin"), F.count("*").over(all_bins).alias("n_bins"))


def band_for_rate(fs: str, band=FRAME_RESP_BAND, least: float = 0.02) -> tuple[Column, Column]:
    """(low, high) within 92 % of half the rate; null where that is too narrow."""
    low, high = max(band[0], 1e-5), F.least(F.lit(float(band[1])), 0.5 * F.col(fs) * 0.92)
    ok = (F.col(fs) > 0) & (high - low >= least) & (high > low)
    return F.when(ok, F.lit(low)), F.when(ok, high)


def near_harmonic(hz: str, base: str, most: int = 7) -> Column:
    out = F.lit(False)
    for k in range(2, most + 1):
        h = k * F.col(base)
        out = out | ((h >= 0.85 * HEART_BAND[0]) & (h <= 1.05 * HEART_BAND[1]) & (F.abs(F.col(hz) - h) <= F.greatest(F.lit(0.03), 0.02 * h)))
    return out & (F.col(hz) > 0) & (F.col(base) > 0)


def target_or(*names: str) -> Column:
    """The first target that is neither null nor 0."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit(0.0)) for n in names))


def gate_half_width(target: str, low: str, high: str, fallback: float) -> Column:
    known = F.col(target).isNotNull() & F.col(low).isNotNull() & F.col(high).isNotNull()
    return F.when(known, F.greatest(F.abs(F.col(target) - F.col(low)), F.abs(F.col(high) - F.col(target)), F.lit(0.0025))).otherwise(fallback)


def selected_range(first: str, end: str, n: int) -> tuple[Column, Column, Column]:
    """(start, end, centre) of an index range clamped to n bins; the end is exclusive."""
    start = F.least(F.greatest(F.col(first), F.lit(0)), F.lit(max(n - 1, 0)))
    stop = F.least(F.greatest(F.col(end), start + 1), F.lit(n))
    return start, stop, F.least(F.greatest(F.floor((start + stop - 1) / 2), F.lit(0)), F.lit(max(n - 1, 0))).cast("int")
