"""Structured Streaming: live traces with keyed state, persisting, sources, triggers."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import HISTORY_S
from ..functions import trackers
from ..functions.live import FIELDS, LiveTrace
from ..plans import vitals
from ..sources.recordings import decode_array, parse_lines

#: Processing-time triggers of the live views.
TICK, PERSIST, ANALYSE = "50 milliseconds", "750 milliseconds", "1 second"

TRACE_SCHEMA = "session_id string, frame long, selected_index long, target_distance_m double, " + ", ".join(f"{f} double" for f in FIELDS)
_COLUMNS = [f.split()[0] for f in TRACE_SCHEMA.split(", ")]
FRAME_COLUMNS = ["timestamp_ms", "frame", "distances", "real", "imag"]


def _outputs(key: str, rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{"session_id": key, **r} for r in rows], columns=_COLUMNS)


def live_traces(stream: DataFrame, idle: str | None = "10 minutes", **options) -> DataFrame:
    """Traces of every session of a stream of frames, in append mode.

    State is one processor a session (filters of all bins, no history); it is dropped
    when a session is idle, which keeps the query triggering: frames that come after
    that, repeated ones too, start a new trace at time 0. With ``idle`` None it
    stays, and a run over what is available ends. Frames of a micro-batch are ordered by
    number first; late and repeated ones are dropped by the state's monotone rule. The
    rate is estimated in each micro-batch and filters start anew where it moves by more
    than a fifth, so such recordings' traces depend on how frames fall into batches.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        trace = pickle.loads(state.get[0]) if state.exists else LiveTrace(**options)
        rows = pd.concat(list(batches)).sort_values(["frame", "timestamp_ms"], kind="stable")
        out = trace.feed(rows[FRAME_COLUMNS].to_dict("records"))
        state.update((pickle.dumps(trace),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield _outputs(key[0], out)

    own = stream.select(F.col("session_id").cast("string").alias("session_id"), *FRAME_COLUMNS)
    return own.groupBy("session_id").applyInPandasWithState(step, TRACE_SCHEMA, "trace binary", "append", timeout)


def _tracked(stream: DataFrame, step, columns: list[str], out: str, idle: str | None) -> DataFrame:
    """``out`` for every row of a stream of measurements (session_id, seq, ...), in append mode.

    State is the last seq and the tracker's; rows of a micro-batch are taken in order of
    seq, and those not past the last one are dropped.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, own = pickle.loads(state.get[0]) if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        found = []
        for seq, *measurement in zip(rows["seq"].tolist(), *(rows[c].tolist() for c in columns)):
            if last is None or seq > last:
                own, value = step(own, *measurement)
                found.append((key[0], seq, value))
                last = seq
        state.update((pickle.dumps((last, own)),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if found:
            yield pd.DataFrame(found, columns=["session_id", "seq", out])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    own = stream.select(F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq"), *columns)
    return own.groupBy("session_id").applyInPandasWithState(run, f"session_id string, seq long, {out} double", "tracker binary", "append", timeout)


def live_heart_rates(stream: DataFrame, idle: str | None = "10 minutes") -> DataFrame:
    """Tracked heart rates of a stream of measurements: hz, dt_s, confidence, quality."""
    return _tracked(stream, trackers.heart_step, ["hz", "dt_s", "confidence", "quality"], "tracked_hz", idle)


def live_respiration_rates(stream: DataFrame, idle: str | None = "10 minutes") -> DataFrame:
    """Displayed respiration rates of a stream of measurements: hz, confidence, quality, present."""
    return _tracked(stream, trackers.display_step, ["hz", "confidence", "quality", "present"], "shown_hz", idle)


def history_rows(fs: float) -> int:
    """Rows of a live trace that are kept."""
    return max(32, round(HISTORY_S * max(fs, 1.0) * 1.2))


def live_history(traces: DataFrame, fs: float, idle: str | None = "10 minutes") -> DataFrame:
    """The bounded history of each session of a stream of traces (update mode): the last rows, as arrays.

    State is the history itself, cut to ``history_rows``; it is dropped when a session is
    idle, as in :func:`live_traces`.
    """
    most, fields = history_rows(fs), ["frame", *FIELDS]
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = pickle.loads(state.get[0]) if state.exists else None
        new = pd.concat([*([] if old is None else [old]), *batches])[fields]
        kept = new.sort_values(["frame"], kind="stable").tail(most).reset_index(drop=True)
        state.update((pickle.dumps(kept),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([[key[0], *(kept[c].tolist() for c in fields)]], columns=["session_id", *fields])

    schema = "session_id string, frame array<long>, " + ", ".join(f"{f} array<double>" for f in FIELDS)
    return traces.groupBy("session_id").applyInPandasWithState(run, schema, "history binary", "update", timeout)


def recorded_traces(frames: DataFrame, **options) -> DataFrame:
    """The same traces of whole recordings in batch."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["frame", "timestamp_ms"], kind="stable")
        return _outputs(group["session_id"].iloc[0], LiveTrace(**options).feed(rows[FRAME_COLUMNS].to_dict("records")))

    own = frames.select(F.col("session_id").cast("string").alias("session_id"), *FRAME_COLUMNS)
    return own.groupBy("session_id").applyInPandas(run, TRACE_SCHEMA)


def line_stream(spark: SparkSession, path: str, sensor: str, session_id: str) -> DataFrame:
    """Serial lines that arrive as text files, parsed; malformed lines are dropped."""
    lines = spark.readStream.text(path).select(F.lit(session_id).alias("session_id"), F.col("value").alias("line"))
    return parse_lines(lines, sensor)


def frame_stream(spark: SparkSession, path: str) -> DataFrame:
    """Frames that arrive as Parquet with JSON arrays, decoded."""
    schema = "session_id string, timestamp_ms double, frame long, distances string, real string, imag string"
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumns({c: decode_array(c) for c in ("distances", "real", "imag")})


def persist(stream: DataFrame, path: str, checkpoint: str, trigger: str | None = PERSIST) -> StreamingQuery:
    """Append new samples below ``path`` by session; the checkpoint keeps what was written."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).partitionBy("session_id")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def show(traces: DataFrame, sink, checkpoint: str | None = None, trigger: str = TICK) -> StreamingQuery:
    """Hand each tick's new rows of a stream of traces to ``sink(batch, number)``."""
    writer = traces.writeStream.outputMode("append").foreachBatch(sink).trigger(processingTime=trigger)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def horizon(window_s: float) -> float:
    """Seconds of frames that an analysis of a window of the live view covers."""
    return max(window_s + 20.0, 30.0)


#: Ticks without frames after which a session's recent frames are let go.
IDLE_TICKS = 600


def analyse(frames: DataFrame, path: str, checkpoint: str, window_s: float = 10.0, trigger: str | None = ANALYSE, **options) -> StreamingQuery:
    """Vitals of the trailing horizon of every session that got frames, at each tick.

    Frames have columns Timestamp_ms and Frame, as stored. A tick reads the recent frames
    that the one before it left below ``path``/recent, adds its own, and leaves those of
    each session's horizon, so it reads and writes no more than that. Results are appended
    to ``path``/vitals with the tick as request_id, so that stale ones can be told. A tick
    that is run again replaces its own files.
    """

    def tick(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("tick", F.lit(number).cast("long"))
        if _exists(spark, f"{path}/recent/{number - 1}"):
            own = spark.read.schema(own.schema).parquet(f"{path}/recent/{number - 1}").unionByName(own)
        last = own.groupBy("session_id").agg(F.max("Timestamp_ms").alias("last_ms"), F.max("tick").alias("last_tick"))
        recent = own.join(last, "session_id").where((F.col("Timestamp_ms") >= F.col("last_ms") - 1000 * horizon(window_s)) & (F.col("last_tick") > number - IDLE_TICKS))
        recent.select(own.columns).write.mode("overwrite").parquet(f"{path}/recent/{number}")
        kept = spark.read.schema(own.schema).parquet(f"{path}/recent/{number}")
        active = kept.where(F.col("tick") == number).select("session_id").distinct()
        found = vitals.frame_vitals(kept.join(active, "session_id", "left_semi").drop("tick"), **options)
        found.withColumn("request_id", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/vitals/tick={number}")
        if number > 1:  # the one before this may be asked for again
            _path(spark, f"{path}/recent/{number - 2}", "delete", True)

    writer = frames.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def _path(spark: SparkSession, path: str, method: str, *args):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return getattr(p.getFileSystem(spark._jsc.hadoopConfiguration()), method)(p, *args)


def _exists(spark: SparkSession, path: str) -> bool:
    return _path(spark, path, "exists")


def since(rows: DataFrame, offsets: DataFrame | None = None, keys=("session_id",), order: str = "seq") -> DataFrame:
    """Snapshot of stored rows past each session's ``offset``; all rows of sessions without one."""
    if offsets is None:
        return rows
    joined = rows.join(offsets.select(*keys, F.col("offset").alias("_offset")), list(keys), "left")
    return joined.where(F.col("_offset").isNull() | (F.col(order) > F.col("_offset"))).drop("_offset")


def sliding_stats(stream: DataFrame, time: str, value: str, length: str = "10 seconds", slide: str = "1 second", lateness: str = "1 minute") -> DataFrame:
    """Mean, RMS and count by session over sliding event-time windows."""
    own = stream.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", lateness)
    x = F.col(value)
    return own.groupBy("session_id", F.window("at", length, slide).alias("w")).agg(F.avg(x).alias("mean"), F.sqrt(F.avg(x * x)).alias("rms"), F.count("*").alias("n"))
