"""A session store clustered by session: no exchange where work is by session.

Samples and sessions are tables in as many buckets, hashed by session and sorted. What
groups, windows or joins by session reads a bucket in a task; a filter on a session
reads one bucket. Every append adds a file a bucket; ``compact`` writes the samples anew
with one file each, as the next generation. A generation counts from the marker that
is made when it is whole, so a compaction that breaks off changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COLUMNS, CSV_SCHEMA, FRAME_ARRAYS, SESSIONS, STORED
from .recordings import load_session


def _fields(sensor: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in CSV_SCHEMA[sensor]} | (dict.fromkeys(FRAME_ARRAYS, "array<double>") if sensor == "a121" else {})
    return "session_id bigint, seq bigint, " + ", ".join(f"{STORED[c]} {kinds[c]}" for c in COLUMNS[sensor])


class ClusteredStore:
    """Stored sessions and samples below ``path``. One process compacts at a time, and none appends meanwhile."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._name = f"breathline_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"

    # -- files ------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generation(self, kind: str) -> int:
        p, fs = self._fs(f"{self.path}/{kind}")
        if not fs.exists(p):
            return 0
        whole = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n.removeprefix("whole-")) for n in whole if n.startswith("whole-")), default=0)

    def _table(self, kind: str, fields: str, generation: int) -> str:
        """The table of a generation; it is declared again over the same files by each application."""
        name = f"{self._name}_{kind}_{generation}"
        if not self.spark.catalog.tableExists(name):
            where = f"{self.path}/{kind}/{generation}"
            p, fs = self._fs(where)
            fs.mkdirs(p)
            self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (session_id) SORTED BY (session_id, seq) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return name

    def _append(self, rows: DataFrame, table: str) -> None:
        """One file a bucket: a task has whole buckets."""
        own = rows.select(self.spark.table(table).columns).repartition(self.buckets, "session_id").sortWithinPartitions("session_id", "seq")
        own.write.insertInto(table)

    # -- samples -----------------------------------------------------------------

    def samples(self, sensor: str) -> DataFrame:
        """All stored samples of a sensor, clustered by session."""
        if sensor not in COLUMNS:
            raise ValueError(f"unknown sensor {sensor}")
        return self.spark.table(self._table(f"{sensor}_samples", _fields(sensor), self._generation(f"{sensor}_samples")))

    def append(self, sensor: str, rows: DataFrame) -> None:
        """Rows of any number of sessions: session_id, seq and the recording's columns."""
        if sensor not in COLUMNS:
            raise ValueError(f"unknown sensor {sensor}")
        kind = f"{sensor}_samples"
        stored = rows.select(F.col("session_id").cast("long").alias("session_id"), F.col("seq").cast("long").alias("seq"), *(F.col(c).alias(STORED[c]) for c in COLUMNS[sensor]))
        self._append(stored, self._table(kind, _fields(sensor), self._generation(kind)))

    def load(self, session_id: int, sensor: str) -> DataFrame:
        return load_session(self.samples(sensor), session_id, sensor)

    def files(self, kind: str) -> int:
        """Data files of the samples (``<sensor>_samples``) or ``sessions`` that count."""
        p, fs = self._fs(f"{self.path}/{kind}/{self._generation(kind)}")
        return sum(s.getPath().getName().startswith("part-") for s in fs.listStatus(p)) if fs.exists(p) else 0

    def compact(self, sensor: str) -> None:
        """Write the samples anew, one sorted file a bucket; the former files go when the new ones are whole."""
        kind = f"{sensor}_samples"
        old = self._generation(kind)
        before = self._table(kind, _fields(sensor), old)
        p, fs = self._fs(f"{self.path}/{kind}/{old + 1}")
        fs.delete(p, True)  # of a compaction that broke off
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name}_{kind}_{old + 1}")
        # Read as plain files: Spark leaves out the exchange for a bucketed table, and then reads it unbucketed.
        rows = self.spark.read.schema(self.spark.table(before).schema).parquet(f"{self.path}/{kind}/{old}")
        self._append(rows, self._table(kind, _fields(sensor), old + 1))
        marker, fs = self._fs(f"{self.path}/{kind}/whole-{old + 1}")
        fs.createNewFile(marker)
        self.spark.sql(f"DROP TABLE IF EXISTS {before}")
        p, fs = self._fs(f"{self.path}/{kind}/{old}")
        fs.delete(p, True)

    # -- sessions ------------------------------------------------------------------

    _SESSIONS = SESSIONS.replace("id long", "session_id bigint", 1).replace(" long", " bigint") + ", seq bigint"

    def record(self, sessions: DataFrame) -> None:
        """Store rows of sessions: session_id, any of the other columns, and seq, their version; the latest counts."""
        have = set(sessions.columns)
        names = [f.split() for f in self._SESSIONS.split(", ")]
        rows = sessions.select(*(F.col(n).cast(t).alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in names))
        self._append(rows, self._table("sessions", self._SESSIONS, 0))

    def sessions(self) -> DataFrame:
        """The latest row of each session, clustered like the samples."""
        log = self.spark.table(self._table("sessions", self._SESSIONS, 0))
        names = [n for n in log.columns if n not in ("session_id", "seq")]
        return log.groupBy("session_id").agg(F.max_by(F.struct(*names), "seq").alias("s")).select("session_id", "s.*")

    def joined(self, sensor: str) -> DataFrame:
        """Samples with their session's columns: buckets meet where they lie."""
        return self.samples(sensor).join(self.sessions().hint("merge"), "session_id")
