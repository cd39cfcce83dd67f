"""Capturing a stream of samples into two sinks that agree: stored rows and named CSV files.

A micro-batch has a number and leaves its rows in both sinks under it: rows below
``<store>/<sensor>_samples/batch=<n>``, and the lines' fields as hidden pieces in the CSV
folder, a file a task however many sessions there are. Then a marker says that the batch is whole. A batch that is run again after a crash,
between the sinks too, replaces what it had left, so nothing is there twice. Only
batches up to the marker count, for both sinks. ``finish`` brings the lines of each
session together and writes its named file, one after the other in many tasks.

Work and files of a batch don't grow with what was captured before it.
"""

from __future__ import annotations

import filecmp
import os
from collections.abc import Iterator
from datetime import datetime
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from ..operators.grouped import placed
from ..schemas import COLUMNS, CSV_SCHEMA, FRAME_ARRAYS, STORED, T
from ..shared import written
from ..sources.files import _mounted, hidden_files, line_fields
from ..sources.recordings import LEAST_ROWS, SessionStore, load_session
from .live import PERSIST, _exists, _path

#: Folder of the pieces within the CSV folder; scans and listings don't see it.
PIECES = ".pieces"
#: Files that a task names before it reports them.
GATHERED = 1_000


def _named(folder: str, hidden: str, name: str) -> tuple[str | None, str | None]:
    """A hidden file given its name: (path, error). A second attempt makes the same file."""
    own, path = os.path.join(folder, hidden), os.path.join(folder, name)
    if os.path.exists(path) and not filecmp.cmp(own, path, shallow=False):
        os.remove(own)
        return None, f"{name} is there already"
    os.replace(own, path)
    return path, None


class Capture:
    """Both sinks of one sensor's stream; ``name`` tells captures into the same folders apart."""

    def __init__(self, store: SessionStore, folder: str, sensor: str, name: str = "capture"):
        if sensor not in COLUMNS:
            raise ValueError(f"unknown sensor {sensor}")
        self.spark, self.store, self.sensor = store.spark, store, sensor
        self.folder = _mounted(folder)
        self.rows = f"{store.path}/{name}/{sensor}_samples"
        self.marks = f"{store.path}/{name}/{sensor}_whole"
        self.pieces = f"file://{os.path.abspath(self.folder)}/{PIECES}/{name}-{sensor}"

    # -- batches

    def _store_rows(self, batch: DataFrame, number: int) -> None:
        own = batch.select("session_id", "seq", *(F.col(c).alias(STORED[c]) for c in COLUMNS[self.sensor]))
        own.write.mode("overwrite").parquet(f"{self.rows}/batch={number}")

    def _store_lines(self, batch: DataFrame, number: int) -> None:
        batch.select("session_id", "seq", *line_fields(self.sensor)).write.mode("overwrite").parquet(f"{self.pieces}/batch={number}")

    def add(self, batch: DataFrame, number: int) -> None:
        """A micro-batch: session_id, seq and the sensor's columns. Rows without a session are dropped."""
        own = batch.where("session_id is not null").select(F.col("session_id").cast("long").alias("session_id"), F.col("seq").cast("long").alias("seq"), *COLUMNS[self.sensor])
        own = own.persist()  # read for both sinks; a lost part is read from the source again
        try:
            self._store_rows(own, number)
            self._store_lines(own, number)
        finally:
            own.unpersist()
        _path(self.spark, f"{self.marks}/{number}", "createNewFile")
        if number > 0:
            _path(self.spark, f"{self.marks}/{number - 1}", "delete", False)

    def start(self, stream: DataFrame, checkpoint: str, trigger: str | None = PERSIST) -> StreamingQuery:
        """Run over a stream; a query that is started again with the same checkpoint goes on."""
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()

    # -- results

    def last(self) -> int:
        """The last batch that both sinks have; -1 before the first."""
        if not _exists(self.spark, self.marks):
            return -1
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.marks)
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
        return max((int(s.getPath().getName()) for s in found), default=-1)

    def samples(self) -> DataFrame:
        """Stored rows of whole batches, under stored names, with their ``batch``."""
        kinds = {f.name: f.dataType for f in CSV_SCHEMA[self.sensor]} | (dict.fromkeys(FRAME_ARRAYS, T.ArrayType(T.DoubleType())) if self.sensor == "a121" else {})
        schema = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("seq", T.LongType()), *(T.StructField(STORED[c], kinds[c]) for c in COLUMNS[self.sensor]), T.StructField("batch", T.LongType())])
        last = self.last()
        if last < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.rows).where(F.col("batch") <= last)

    def load(self, session_id: int) -> DataFrame:
        return load_session(self.samples(), session_id, self.sensor)

    def finish(self) -> DataFrame:
        """Name the files of all sessions and enter the sessions in the store, if they aren't: session_id, samples, path, error.

        A session with too few samples has an error and no file; another recording's file
        stays. May be called again, and after more was captured into other sessions.
        """
        folder, sensor, last = self.folder, self.sensor, self.last()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = hidden_files(batches, folder, sensor)
            while found := [(session, n, *_named(folder, hidden, name)) for session, hidden, name, n in islice(files, GATHERED)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types.types)], schema=types)

        sessions = self.samples().groupBy("session_id").agg(F.count("*").alias("samples"))
        done = sessions.limit(0).selectExpr("session_id", "samples", "string(null) path", "string(null) error")
        types = to_arrow_schema(done.schema)
        if last >= 0:
            pieces = self.spark.read.parquet(self.pieces).where(F.col("batch") <= last)
            count = F.coalesce("lines", F.lit(0))
            error = F.when(F.col("samples") < LEAST_ROWS[sensor], f"fewer than {LEAST_ROWS[sensor]} samples").when(count != F.col("samples"), F.concat(count, F.lit(" lines of "), "samples", F.lit(" samples")))
            counted = sessions.join(pieces.groupBy("session_id").agg(F.count("*").alias("lines")), "session_id", "left")
            judged = written(counted.select("session_id", "samples", F.lit(None).cast("string").alias("path"), error.alias("error")), "judged")
            whole = pieces.join(judged.where("error is null").select("session_id"), "session_id", "left_semi")
            ready = placed(whole, ["session_id"], ["batch", "seq"])
            ready = ready.where(F.col(ready.columns[-1]) > 0).select("session_id", *COLUMNS[sensor])
            done = written(judged.where("error is not null").unionByName(ready.mapInArrow(run, done.schema)), "captured")
        now = f"{datetime.now():%Y-%m-%dT%H:%M:%S}"
        new = done.where("error is null").join(self.store.sessions().select(F.col("id").alias("session_id")), "session_id", "left_anti")
        self.store.enter(new.select(F.col("session_id").alias("id"), F.lit(sensor).alias("sensor"), F.lit(now).alias("started_at"), F.lit(now).alias("stopped_at"), F.col("path").alias("csv_path"), F.col("samples").alias("sample_count"), F.lit("{}").alias("stats_json")))
        return done
