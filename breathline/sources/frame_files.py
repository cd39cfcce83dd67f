"""Binary files of sweeps, one a session, in batch and as a stream with many partitions.

A file is a header (magic, counts of subframes, sweeps and points, rate, start of the
session, distances) and records of one size: the sensor's tick and 16-bit complex values.
So a record's place is known without reading what is before it: a file is dealt to
tasks by ranges of records, and the driver looks at sizes only. An unfinished record
waits for its end. Files without the magic are left out.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MAGIC, SUFFIX = b"SWEEPS01", ".sweeps"
_HEAD = struct.Struct("<8sIII4xdddd")
_FRAME = "struct<re: array<array<double>>, im: array<array<double>>>"
SCHEMA = f"session_id string, seq long, tick_s double, rate_hz double, start_ms double, distances array<double>, frame {_FRAME}, subframes array<{_FRAME}>"


@dataclass(frozen=True)
class Layout:
    """What all records of a file share; ``subframes`` 0 stands for plain frames."""

    subframes: int
    sweeps: int
    points: int
    rate_hz: float
    start_ms: float
    start_m: float
    step_m: float

    @property
    def record(self) -> np.dtype:
        return np.dtype([("tick", "<f8"), ("iq", "<i2", (max(self.subframes, 1), self.sweeps, self.points, 2))])

    def head(self) -> bytes:
        return _HEAD.pack(MAGIC, self.subframes, self.sweeps, self.points, self.rate_hz, self.start_ms, self.start_m, self.step_m)


def encoded(layout: Layout, ticks: np.ndarray, iq: np.ndarray) -> bytes:
    """Records of a file; ``iq`` is (records, subframes or 1, sweeps, points, 2)."""
    out = np.zeros(len(ticks), layout.record)
    out["tick"], out["iq"] = ticks, iq
    return out.tobytes()


def layout_of(path: str) -> Layout | None:
    """A file's layout; None while its header isn't whole, and for other files."""
    with open(path, "rb") as f:
        data = f.read(_HEAD.size)
    if len(data) < _HEAD.size or not data.startswith(MAGIC):
        return None
    return Layout(*_HEAD.unpack(data)[1:])


@dataclass
class Range(InputPartition):
    name: str
    first: int
    end: int


def _lists(values: pa.Array, size: int) -> pa.Array:
    n = len(values) // size
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), values)


def _frames(iq: np.ndarray, layout: Layout) -> pa.Array:
    """Structs of re and im, each an array of sweeps."""
    parts = [_lists(_lists(pa.array(iq[..., k].astype(np.float64).ravel()), layout.points), layout.sweeps) for k in (0, 1)]
    return pa.StructArray.from_arrays(parts, ["re", "im"])


class _Files:
    """Reading of ranges, shared by batch and stream."""

    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")
        self.most = int(options.get("rangeBytes", 32 << 20))
        self.layouts: dict[str, Layout] = {}

    def counts(self) -> dict[str, int]:
        """Whole records of each file by now."""
        found = {}
        for entry in sorted(os.scandir(self.folder), key=lambda e: e.name):
            if not entry.name.endswith(SUFFIX) or entry.name.startswith("."):
                continue
            layout = self.layouts.get(entry.name) or layout_of(entry.path)
            if layout:
                self.layouts[entry.name] = layout
                found[entry.name] = (entry.stat().st_size - _HEAD.size) // layout.record.itemsize
        return found

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        out = []
        for name, n in end.items():
            layout = self.layouts.get(name) or layout_of(os.path.join(self.folder, name))
            each = max(1, self.most // layout.record.itemsize)
            a = start.get(name, 0)
            out += [Range(name, k, min(k + each, n)) for k in range(a, n, each)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        path = os.path.join(self.folder, partition.name)
        layout = layout_of(path)
        kind = layout.record
        session = partition.name.removesuffix(SUFFIX)
        distances = layout.start_m + layout.step_m * np.arange(layout.points)
        each = max(1, (4 << 20) // (4 * kind.itemsize))  # values grow from 2 to 8 bytes
        with open(path, "rb") as f:
            f.seek(_HEAD.size + partition.first * kind.itemsize)
            for k in range(partition.first, partition.end, each):
                n = min(each, partition.end - k)
                data = np.frombuffer(f.read(n * kind.itemsize), kind)
                if len(data) < n:
                    raise OSError(f"{path} lost records that were there")
                frames = _frames(data["iq"], layout)
                if layout.subframes:
                    plain, subframes = pa.nulls(n, frames.type), _lists(frames, layout.subframes)
                else:
                    plain, subframes = frames, pa.nulls(n, pa.list_(frames.type))
                columns = {
                    "session_id": pa.array([session] * n, pa.string()), "seq": pa.array(np.arange(k, k + n, dtype=np.int64)), "tick_s": pa.array(data["tick"]),
                    "rate_hz": pa.array(np.full(n, layout.rate_hz)), "start_ms": pa.array(np.full(n, layout.start_ms)),
                    "distances": _lists(pa.array(np.tile(distances, n)), layout.points), "frame": plain, "subframes": subframes,
                }
                yield pa.RecordBatch.from_pydict(columns)


class BatchReader(_Files, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges({}, self.counts())


class StreamReader(_Files, DataSourceStreamReader):
    """Offsets are records of each file; the ranges of a batch are read by as many tasks."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.counts()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start, end)


class SweepFiles(DataSource):
    """``spark.dataSource.register(SweepFiles)``; then format ``sweep_files`` with option ``path``, a folder that all executors have mounted."""

    @classmethod
    def name(cls) -> str:
        return "sweep_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)
