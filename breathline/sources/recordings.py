"""Scans, line parsing, JSON arrays, catalogue and stores of recordings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import COLUMNS, CSV_SCHEMA, FRAME_ARRAYS, SESSIONS, STORED, detect_sensor, require_columns

#: File names of a sensor's recordings; the batch scan of imu files is wider than the catalogue.
BATCH_GLOB = {"radar": "radar_raw_*.csv", "imu": "respiratory_*_raw_*.csv", "a121": "a121_sparse_iq_*.csv"}
CATALOGUE_GLOB = BATCH_GLOB | {"imu": "respiratory_6axis_raw_*.csv"}
LINE_FIELDS = {"radar": 3, "imu": 6}
LEAST_ROWS = {"radar": 10, "imu": 10, "a121": 1}


def decode_array(c: str | Column) -> Column:
    """JSON text as array of doubles; empty or null text is empty, malformed text an error."""
    c = F.col(c) if isinstance(c, str) else c
    parsed = F.from_json(c, "array<double>")
    return F.when(c.isNull() | (c == ""), F.array().cast("array<double>")).when(parsed.isNull(), F.raise_error(F.concat(F.lit("malformed array: "), c)).cast("array<double>")).otherwise(parsed)


def encode_array(c: str | Column) -> Column:
    """Compact JSON text, values rounded to 8 decimals."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_json(F.transform(c, lambda x: F.round(x, 8)))


def scan_csv(spark: SparkSession, path: str, sensor: str, glob: str | None = None) -> DataFrame:
    """All recordings of a folder or file: session_id is the file, seq the line order within it.

    The header is checked on one file; columns are matched by name.
    """
    glob = glob or (None if path.endswith(".csv") else BATCH_GLOB[sensor])
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    header = reader.csv(path)
    require_columns(header.columns, sensor)
    types = {f.name: f.dataType for f in CSV_SCHEMA[sensor]}
    # A line's place: Spark reads a file's lines in order within a split; splits of a file follow each other.
    df = header.select(*(F.col(c).try_cast(types[c]).alias(c) for c in COLUMNS[sensor]), F.col("_metadata.file_name").alias("session_id"), F.col("_metadata.file_block_start").alias("block"))
    df = df.withColumn("seq", (F.col("block") * 1_000_000 + F.monotonically_increasing_id() % (1 << 33)).cast("long")).drop("block")
    return df.withColumns({c: decode_array(c) for c in FRAME_ARRAYS}) if sensor == "a121" else df


def open_csv(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(sensor, rows) of one file, told by its header."""
    sensor = detect_sensor(spark.read.option("header", True).csv(path).columns)
    return sensor, scan_csv(spark, path, sensor, "*.csv")


def parse_lines(df: DataFrame, sensor: str, line: str = "line", time_ms: Column | None = None) -> DataFrame:
    """Serial lines as columns; lines without exactly the sensor's fields, all numbers, are dropped.

    The accelerometer's lines carry no time; the host's is put before them.
    """
    n, names = LINE_FIELDS[sensor], COLUMNS[sensor]
    if sensor == "imu":
        names = names[1:]
    parts = F.split(F.trim(F.col(line)), ",")
    df = df.withColumn("_p", F.transform(parts, lambda p: F.trim(p).try_cast("double")))
    good = (F.size("_p") == n) & F.forall("_p", lambda p: p.isNotNull())
    fields = [F.col("_p")[i].alias(c) for i, c in enumerate(names)]
    if sensor == "imu":
        fields.insert(0, (time_ms if time_ms is not None else F.unix_millis(F.current_timestamp()).cast("double")).alias("Time_ms"))
    return df.where(good).select(*[c for c in df.columns if c not in (line, "_p")], *fields)


def scale_imu_counts(df: DataFrame) -> DataFrame:
    """Little-endian byte pairs (low, high) of six axes as g and degrees a second."""
    def axis(name: str, scale: float) -> Column:
        raw = F.col(f"{name}_hi") * 256 + F.col(f"{name}_lo")
        return (F.when(raw >= 32768, raw - 65536).otherwise(raw) * scale / 1000).alias(name)

    keep = [c for c in df.columns if not c.endswith(("_lo", "_hi"))]
    return df.select(*keep, *(axis(a, 0.061) for a in ("ax", "ay", "az")), *(axis(g, 8.75) for g in ("gx", "gy", "gz")))


def rank_ports(ports: DataFrame) -> DataFrame:
    """Likely frame-sensor ports, best first, by words in their description."""
    text = F.lower(F.concat_ws(" ", *(c for c in ("device", "description", "manufacturer", "product", "interface", "hwid") if c in ports.columns)))
    has = lambda *words: F.lit(False) if not words else sum((text.contains(w).cast("int") for w in words), F.lit(0)) > 0
    points = [(20, ("ch342", "wch", "usb-enhanced")), (20, ("acconeer", "a121", "waveshare")), (10, ("interface a", "serial-a", "-a")), (-10, ("interface b", "serial-b", "-b"))]
    score = sum((F.when(has(*words), p).otherwise(0) for p, words in points), F.lit(0))
    return ports.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "device")


def ordered_ports(available: list[str], preferred: str | None = None) -> list[str]:
    """The preferred port first if it is there, then the others, last one first."""
    first = [preferred] if preferred and preferred in available else []
    return list(dict.fromkeys([*first, *reversed(available)]))


def save_csv(df: DataFrame, path: str, sensor: str, order: str = "seq") -> str:
    """Write one recording to a file of its own, named by the time; too few rows are an error. Its path."""
    from .files import file_name, save_recordings

    if df.limit(LEAST_ROWS[sensor]).count() < LEAST_ROWS[sensor]:
        raise ValueError(f"fewer than {LEAST_ROWS[sensor]} samples")
    stamp = f"{datetime.now():%Y-%m-%d_%H-%M-%S}"
    save_recordings(df.withColumn("session_id", F.lit(stamp)), path, sensor, order=order)
    return f"{path.rstrip('/')}/{file_name(sensor, stamp)}"


def list_files(spark: SparkSession, path: str, sensor: str) -> DataFrame:
    """Catalogue entries of a folder, names descending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", CATALOGUE_GLOB[sensor]).load(path).select("path")
    return files.select(F.lit("file").alias("source"), F.lit(sensor).alias("sensor"), F.element_at(F.split("path", "/"), -1).alias("label"), F.lit("").alias("samples"), "path").orderBy(F.desc("label"))


def catalogue(sessions: DataFrame, *files: DataFrame) -> DataFrame:
    """All recordings: files by sensor and stored sessions, kept side by side."""
    stored = newest_sessions(sessions).select(
        F.lit("store").alias("source"), "sensor", F.col("started_at").alias("label"), F.coalesce(F.nullif(F.col("sample_count"), F.lit(0)).cast("string"), F.lit("")).alias("samples"), F.concat(F.lit("session #"), F.col("id").cast("string")).alias("path")
    )
    for f in files:
        stored = f.unionByName(stored)
    return stored


def newest_sessions(sessions: DataFrame, n: int = 500) -> DataFrame:
    return sessions.orderBy(F.desc("id")).limit(n)


def load_session(samples: DataFrame, session_id: int, sensor: str) -> DataFrame:
    """A stored session under the recording's column names, in stored order; the key reaches the scan."""
    back = {v: k for k, v in STORED.items()}
    names = [STORED[c] for c in COLUMNS[sensor]]
    out = samples.where(F.col("session_id") == session_id).select("session_id", "seq", *(F.col(n).alias(back[n] if back[n] in COLUMNS[sensor] else n) for n in names))
    return out.orderBy("seq")


class SessionStore:
    """Sessions and samples as Parquet: sessions are appended, the latest row of an id counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(SESSIONS + ", version timestamp").parquet(f"{self.path}/sessions")
        except Exception as e:  # nothing was stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SESSIONS + ", version timestamp")

    def sessions(self) -> DataFrame:
        fields = [f.split()[0] for f in SESSIONS.split(", ")]
        latest = self._log().groupBy("id").agg(F.max_by(F.struct(*fields), "version").alias("s"))
        return latest.select("s.*")

    def _append(self, **row) -> None:
        df = self.spark.createDataFrame([tuple(row.get(f.split()[0]) for f in SESSIONS.split(", "))], SESSIONS)
        df.withColumn("version", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/sessions")

    def enter(self, sessions: DataFrame) -> None:
        """Rows of any number of sessions, with the columns of ``SESSIONS``."""
        names = [f.split() for f in SESSIONS.split(", ")]
        rows = sessions.select(*(F.col(n).cast(t).alias(n) for n, t in names))
        rows.withColumn("version", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/sessions")

    def _claimed(self, number: int) -> bool:
        """Whether this writer is the one that created the id's marker, which the file system lets only one do."""
        jvm = self.spark._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{self.path}/ids/{number}")
        return marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(marker)

    def create(self, sensor: str, csv_path: str | None = None) -> int:
        if sensor not in COLUMNS:
            raise ValueError(f"unknown sensor {sensor}")
        new = (self._log().agg(F.max("id")).first()[0] or 0) + 1
        while not self._claimed(new):  # by another writer
            new += 1
        self._append(id=new, sensor=sensor, started_at=f"{datetime.now():%Y-%m-%dT%H:%M:%S}", csv_path=csv_path, sample_count=0, stats_json="{}")
        return new

    def append(self, session_id: int, sensor: str, rows: DataFrame) -> None:
        """Samples under stored names, with ``seq`` in the order given; an unknown sensor is an error."""
        if sensor not in COLUMNS:
            raise ValueError(f"unknown sensor {sensor}")
        out = rows.select("seq", *(F.col(c).alias(STORED[c]) for c in COLUMNS[sensor])).withColumn("session_id", F.lit(session_id).cast("long"))
        out.write.mode("append").partitionBy("session_id").parquet(f"{self.path}/{sensor}_samples")

    def finish(self, session_id: int, sample_count: int, stats: dict[str, float]) -> None:
        import json

        old = self.sessions().where(F.col("id") == session_id).first()
        if old is None:
            raise ValueError(f"no session {session_id}")
        self._append(**old.asDict() | {"stopped_at": f"{datetime.now():%Y-%m-%dT%H:%M:%S}", "sample_count": sample_count, "stats_json": json.dumps(stats)})

    def load(self, session_id: int, sensor: str) -> DataFrame:
        return load_session(self.spark.read.parquet(f"{self.path}/{sensor}_samples"), session_id, sensor)


def latest_results(results: DataFrame, current: Column, key: str = "session_id") -> DataFrame:
    """Analysis results whose request is still the current one; the newest of them."""
    w = W.partitionBy(key).orderBy(F.desc("request_id"))
    return results.where(F.col("request_id") == current).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
