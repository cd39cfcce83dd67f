"""A streaming source of serial lines: a character device, a pipe or a growing file.

Offsets count bytes. A file is read again from any offset. A device gives its bytes
once: lines are kept until the next read, so that a batch can be planned again; what a
stopped query had not written is lost, as it is on the line itself. A line longer than
``maxBytes`` is dropped as a whole and doesn't hold up the next.
"""

from __future__ import annotations

import os
import select
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class LineReader(SimpleDataSourceStreamReader):
    """Whole lines from a byte offset on; an unfinished last line waits for its end."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most
        self.device = os.path.exists(path) and not stat.S_ISREG(os.stat(path).st_mode)
        self.handle: int | None = None
        self.rest, self.at, self.skips = b"", 0, False
        self.kept: list[tuple[int, str]] = []

    def initialOffset(self) -> dict:
        return {"at": 0}

    # -- files

    def _lines(self, start: int, end: int | None) -> tuple[list[tuple[int, str]], int]:
        if not os.path.exists(self.path):
            return [], start
        with open(self.path, "rb") as f:
            f.seek(start)
            data = f.read(self.most if end is None else end - start)
            if end is None and len(data) == self.most and b"\n" not in data:
                return self._past_long_line(f, start)
        data = data[: data.rfind(b"\n") + 1]
        return _split(data, start, self.most), start + len(data)

    def _past_long_line(self, f, start: int) -> tuple[list, int]:
        while chunk := f.read(self.most):
            if b"\n" in chunk:
                return [], f.tell() - len(chunk) + chunk.index(b"\n") + 1
        return [], start  # its end is still to come

    # -- devices

    def _arrived(self) -> list[tuple[int, str]]:
        """Whole lines that the device has by now."""
        if self.handle is None:
            self.handle = os.open(self.path, os.O_RDONLY | os.O_NONBLOCK | os.O_NOCTTY)
        data, start = self.rest, self.at
        while len(data) < self.most and select.select([self.handle], [], [], 0)[0]:
            try:
                chunk = os.read(self.handle, 65_536)
            except BlockingIOError:
                break
            if not chunk:
                break
            data += chunk
        cut = data.rfind(b"\n") + 1
        lines, self.rest, self.at = data[:cut], data[cut:], start + cut
        if self.skips and cut:  # the end of a line that was too long
            first = lines.index(b"\n") + 1
            lines, start, self.skips = lines[first:], start + first, False
        if len(self.rest) >= self.most:
            self.rest, self.at, self.skips = b"", self.at + len(self.rest), True
        return _split(lines, start, self.most)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not self.device:
            lines, at = self._lines(start["at"], None)
            return iter(lines), {"at": at}
        base = max(start["at"], self.at) - self.at if self.handle is None else 0
        self.at += base  # a query that goes on after a stop counts from its last offset
        lines = self._arrived()
        self.kept = [x for x in self.kept if x[0] >= start["at"]] + lines
        return iter(lines), {"at": self.at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if self.device:
            return iter([x for x in self.kept if start["at"] <= x[0] < end["at"]])
        return iter(self._lines(start["at"], end["at"])[0])


def _split(data: bytes, start: int, most: int) -> list[tuple[int, str]]:
    at, out = start, []
    for line in data.splitlines(keepends=True):
        if len(line) <= most:
            out.append((at, line.decode("utf-8", "ignore").strip()))
        at += len(line)
    return out


class SerialLines(DataSource):
    """``spark.dataSource.register(SerialLines)``; then format ``serial_lines`` with option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "serial_lines"

    def schema(self) -> str:
        return "offset long, line string"

    def simpleStreamReader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("maxBytes", 1 << 20)))
