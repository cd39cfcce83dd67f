"""Recordings as named CSV files: one file a session, and folders read file by file.

The sink is a Python data source. Rows come clustered by session; a task writes each of
its sessions to a hidden file and reports it. Only when every task has succeeded does
the driver give the files their names, so a scan never sees half a recording.

A folder is read as lines. Every file's header tells where its columns are, so files may
order them differently or have more; a file that can't be read is a row with its error
and doesn't stop the others.
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.grouped import placed, starts
from ..schemas import COLUMNS, CSV_SCHEMA, FRAME_ARRAYS
from ..shared import written
from .recordings import BATCH_GLOB, LEAST_ROWS, encode_array

#: Bytes up to which a file is read as one value and not by its lines.
SMALL = 1 << 20
#: Part of a recording's name before its id.
PREFIX = {sensor: glob.replace("_*_", "_6axis_").replace("*.csv", "") for sensor, glob in BATCH_GLOB.items()}


def file_name(sensor: str, session: object) -> str:
    """The file of a session; an id that is such a name already stays."""
    name = str(session)
    if not fnmatch.fnmatch(name, BATCH_GLOB[sensor]):
        name = f"{PREFIX[sensor]}{name}.csv"
    if "/" in name or "\0" in name or session is None:
        raise ValueError(f"no file can have the name of session {session!r}")
    return name


def session_of(name: str | Column, sensor: str) -> Column:
    """The session that a file is named after; the whole name where it isn't one of this sink's."""
    name = F.col(name) if isinstance(name, str) else name
    found = F.regexp_extract(name, f"^{PREFIX[sensor]}(.+)\\.csv$", 1)
    return F.when(found == "", name).otherwise(found)


@dataclass
class Reported(WriterCommitMessage):
    """The hidden files that a task wrote, each with its name."""

    files: list[tuple[str, str]] = field(default_factory=list)


def hidden_files(batches: Iterator[pa.RecordBatch], folder: str, sensor: str) -> Iterator[tuple[object, str, str, int]]:
    """(session, hidden file, its name to be, lines) of each session of sorted batches, once its file is written."""
    os.makedirs(folder, exist_ok=True)
    options = pyarrow.csv.WriteOptions(include_header=False, quoting_style="needed")
    out, found, lines = None, (None, "", ""), 0
    try:
        for batch in batches:
            at = starts(batch, ["session_id"]) if batch.num_rows else []
            for a, b in zip(at, [*at[1:], batch.num_rows]):
                own = batch.slice(int(a), int(b - a))
                session = own.column("session_id")[0].as_py()
                if out is None or session != found[0]:
                    if out:
                        out.close()
                        out = None
                        yield *found, lines
                    name = file_name(sensor, session)
                    found, lines = (session, f".{name}.{uuid.uuid4().hex}", name), 0
                    out = open(os.path.join(folder, found[1]), "wb")
                    out.write((",".join(COLUMNS[sensor]) + "\n").encode())
                pyarrow.csv.write_csv(own.select(COLUMNS[sensor]), out, options)
                lines += own.num_rows
        if out:
            out.close()
            out = None
            yield *found, lines
    finally:
        if out:  # broken off
            out.close()
            os.remove(os.path.join(folder, found[1]))


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, sensor: str, overwrite: bool):
        self.folder, self.sensor, self.overwrite = folder, sensor, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Reported:
        done = Reported()
        try:
            for _, hidden, name, _ in hidden_files(iterator, self.folder, self.sensor):
                done.files.append((hidden, name))
        except BaseException:
            self.abort([done])
            raise
        return done

    def commit(self, messages: list[Reported | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        twice = {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else set()
        there = [] if self.overwrite else [n for n in names if os.path.exists(os.path.join(self.folder, n))]
        if twice or there:
            self.abort(messages)
            raise ValueError(f"more than one session would be {min(twice)}" if twice else f"{there[0]} is there already")
        for hidden, name in files:
            os.replace(os.path.join(self.folder, hidden), os.path.join(self.folder, name))

    def abort(self, messages: list[Reported | None]) -> None:
        for hidden, _ in (f for m in messages if m for f in m.files):
            if os.path.exists(os.path.join(self.folder, hidden)):
                os.remove(os.path.join(self.folder, hidden))


class RecordingFiles(DataSource):
    """``df.write.format("recordings").option("sensor", ...).save(folder)``: session_id and the sensor's columns, a session's rows together and in order."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options["sensor"], overwrite)


def _mounted(path: str) -> str:
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"named files are written to folders that all executors have mounted, not to {path}")
    return path.rstrip("/")


def line_fields(sensor: str) -> list[Column]:
    """The sensor's columns as the fields of a line: arrays as JSON text."""
    return [encode_array(c).alias(c) if c in FRAME_ARRAYS and sensor == "a121" else F.col(c) for c in COLUMNS[sensor]]


def save_recordings(df: DataFrame, path: str, sensor: str, key: str = "session_id", order: str = "seq", overwrite: bool = False) -> None:
    """Write every session to its own named file below ``path``, a folder that all executors have mounted.

    A session with too few rows, without a name, or whose file is there already is an
    error, and nothing is written. Arrays become JSON text.
    """
    if sensor not in COLUMNS:
        raise ValueError(f"unknown sensor {sensor}")
    least = LEAST_ROWS[sensor]
    few = df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") < least) | F.col(key).isNull()).first()
    if few:
        raise ValueError(f"session {few[0]} has fewer than {least} samples" if few[0] is not None else "rows without a session")
    # Rows that are together by their session stay so; only of these types no two values have one text.
    session = F.col(key) if dict(df.dtypes)[key] in ("bigint", "int", "smallint", "tinyint", "string") else F.col(key).cast("string")
    own = df.select(session.alias("session_id"), F.col(order).alias("_order"), *line_fields(sensor))
    df.sparkSession.dataSource.register(RecordingFiles)
    ready = placed(own, ["session_id"], ["_order"])
    place = ready.columns[-1]
    ready.where(F.col(place) > 0).drop(place, "_order").withColumn("session_id", F.col("session_id").cast("string")).write.format("recordings").option("sensor", sensor).mode("overwrite" if overwrite else "append").save(_mounted(path))


def scan_files(spark: SparkSession, path: str, sensor: str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of all recordings of a folder or file.

    Rows: session_id (the file), seq (the line's place) and the sensor's columns. Problems:
    session_id and error of files that are empty, lack columns, hold no samples or have
    malformed arrays; they give no rows. A field that isn't a number is null.
    """
    glob = glob or ("*.csv" if path.endswith(".csv") else BATCH_GLOB[sensor])
    name, size = F.col("_metadata.file_name").alias("session_id"), F.col("_metadata.file_size")
    read = lambda kind: spark.read.format(kind).option("pathGlobFilter", glob).load(path)
    # A line's place: a file's lines are read in order within a split; its splits follow each other.
    seq = F.col("_metadata.file_block_start") * 1_000_000 + F.monotonically_increasing_id() % (1 << 33)
    text = read("text")
    # Spark's own list of the files: empty ones are not read.
    files = spark.createDataFrame([(n,) for n in sorted({unquote(f.rsplit("/", 1)[-1]) for f in text.inputFiles()})], "session_id string")
    lines = text.where(size > SMALL).select(name, seq.cast("long").alias("seq"), F.col("value").alias("line")).where(F.trim("line") != "")
    found = lines.groupBy("session_id").agg(F.min_by("line", "seq").alias("header"), F.min("seq").alias("first"), (F.count("*") > 1).alias("more"))
    # To open a file for its lines takes several times as long as to read a small one whole, which also has its header at hand.
    small = read("binaryFile").where(size <= SMALL).select(name, F.col("content").cast("string").alias("content"))
    small = small.withColumn("content", F.when(F.startswith("content", F.lit("\ufeff")), F.expr("substring(content, 2)")).otherwise(F.col("content")))
    header = F.nullif(F.regexp_extract("content", " *[^\r\n ][^\r\n]*", 0), F.lit(""))
    first = F.size(F.split(F.regexp_extract("content", "^[\r\n ]*", 0), "[\r\n]+")) - 1
    small_heads = small.select("session_id", header.alias("header"), first.cast("long").alias("first"), F.col("content").rlike("[^\r\n ][^\r\n]*[\r\n][\r\n ]*[^\r\n ]").alias("more"))
    wanted = F.array(*(F.lit(c) for c in COLUMNS[sensor]))
    names_of = lambda header: F.transform(F.split(header, ","), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    names = names_of("header")
    lacks = F.array_except(wanted, names)
    error = (
        F.when(F.col("header").isNull(), F.lit("the file is empty"))
        .when(F.size(lacks) > 0, F.concat(F.lit(f"missing {sensor} columns: "), F.array_join(lacks, ", ")))
        .when(~F.col("more"), F.lit("the file has no samples"))
    )
    heads = files.join(found.unionByName(small_heads), "session_id", "left").select("session_id", "first", names.alias("names"), error.alias("error"))
    heads = written(heads.repartition("session_id"), "headers")  # one row a file
    problems = heads.where("error is not null").select("session_id", "error")
    most = heads.where("error is null").agg(F.max(F.size("names"))).first()[0] or 1
    parsed = F.from_csv("line", ", ".join(f"c{i} string" for i in range(most)), {"mode": "PERMISSIVE"})
    places = F.transform(wanted, lambda c: F.array_position("names", c).cast("int") - 1).alias("places")
    of_large = lines.join(heads.where("error is null").select("session_id", "first", places), "session_id")
    whole = small.withColumn("names", names_of(header)).where(F.size(F.array_except(wanted, "names")) == 0)
    # what a file has once is computed before its lines are
    whole = whole.select("session_id", first.cast("long").alias("first"), places, F.split("content", "[\r\n]+").alias("lines"))
    of_small = whole.select("session_id", "first", "places", F.posexplode("lines").alias("seq", "line")).where(F.trim("line") != "")
    samples = of_large.unionByName(of_small.withColumn("seq", F.col("seq").cast("long"))).where(F.col("seq") > F.col("first"))
    fields = F.when(F.contains("line", F.lit('"')), F.transform(F.array(parsed), lambda p: F.array(*(p[f"c{i}"] for i in range(most))))[0]).otherwise(F.split("line", ","))
    samples = samples.withColumn("fields", fields)
    types = {f.name: f.dataType for f in CSV_SCHEMA[sensor]}
    rows = samples.select("session_id", "seq", *(F.get("fields", F.col("places")[i]).try_cast(types[c]).alias(c) for i, c in enumerate(COLUMNS[sensor])))
    if sensor != "a121":
        return rows, problems
    decoded = rows.withColumns({c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<double>")).otherwise(F.from_json(c, "array<double>")) for c in FRAME_ARRAYS})
    malformed = " or ".join(f"{c} is null" for c in FRAME_ARRAYS)
    bad = written(decoded.where(malformed).select("session_id").distinct(), "malformed")
    return decoded.join(bad, "session_id", "left_anti"), problems.unionByName(bad.withColumn("error", F.lit("malformed array")))


def analyse_files(spark: SparkSession, path: str, sensor: str, analyse, glob: str | None = None) -> DataFrame:
    """``analyse`` over all recordings of a folder, and a row with its error for each file that can't be read."""
    rows, problems = scan_files(spark, path, sensor, glob)
    return analyse(rows).unionByName(problems, allowMissingColumns=True)
