"""The live view of range-profile sessions as one stream with state by element.

Frames, control rows and results are united into one stream of events by session. The
state of a session is a view of constant size and its recent frames, one map entry a
second: a micro-batch writes the view and the seconds it brought, however long the
history is, and removes those beyond the horizon. Both expire when a session is idle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.view import CONTROL, FRAME, OUTPUT, RESULT, Recent, View, viewed

#: Columns of each kind of event, besides session_id and at_ms.
COLUMNS = {
    CONTROL: "app_state string, target_distance_m double, half_width_m double",
    FRAME: "timestamp_ms double, frame long, distances array<double>, real array<double>, imag array<double>",
    RESULT: "request_id long, resp_hz double, resp_confidence double, heart_hz double, heart_confidence double, signal_quality double, present boolean",
}
_FIELDS = [tuple(f.split()) for ddl in COLUMNS.values() for f in ddl.split(", ")]
_NAMES = [f.split()[0] for f in OUTPUT.split(", ")]
#: Milliseconds without events after which a session's state is let go.
IDLE_MS = 600_000


def events(kind: str, rows: DataFrame) -> DataFrame:
    """Rows of one kind as events; ``at_ms`` is when they came, of frames by default their own time."""
    own = {f.split()[0] for f in COLUMNS[kind].split(", ")}
    at = F.col("at_ms") if "at_ms" in rows.columns else F.col("timestamp_ms")
    columns = [(F.col(n) if n in own else F.lit(None)).cast(t).alias(n) for n, t in _FIELDS]
    return rows.select(F.col("session_id").cast("string").alias("session_id"), F.lit(kind).alias("kind"), at.cast("double").alias("at_ms"), *columns)


def united(frames: DataFrame, controls: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """One stream, or table, of the events of all sessions."""
    out = events(FRAME, frames)
    for kind, rows in ((CONTROL, controls), (RESULT, results)):
        if rows is not None:
            out = out.unionByName(events(kind, rows))
    return out


def _plain(rows: pd.DataFrame) -> list[dict]:
    """Rows as dicts without missing values; a missing target or frame number is absent."""
    return [{k: v for k, v in r.items() if v is not None and not (isinstance(v, float) and v != v)} for r in rows.to_dict("records")]


def _frame(key: str, out: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{"session_id": key, **r} for r in out], columns=_NAMES)


class ViewProcessor(StatefulProcessor):
    """Events of a micro-batch into a session's view."""

    def __init__(self, window_s: float, idle_ms: int | None):
        self.window_s, self.idle_ms = window_s, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.view = handle.getValueState("view", "view binary", self.idle_ms)
        self.recent = handle.getMapState("recent", "second long", "frames binary", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = [r for part in rows for r in _plain(part)]
        view = pickle.loads(self.view.get()[0]) if self.view.exists() else View(self.window_s)
        recent = Recent()
        seconds = {int(r["timestamp_ms"] // 1000) for r in own if r["kind"] == FRAME}

        def fetch(wanted) -> None:
            for s in wanted:
                if s not in recent and self.recent.containsKey((s,)):
                    recent[s] = pickle.loads(self.recent.getValue((s,))[0])

        fetch(s for s in seconds if s in view.seconds)
        view, out = viewed(view, own, recent, lambda: fetch(view.seconds))
        for s in recent.changed:
            self.recent.updateValue((s,), (pickle.dumps(recent[s]),))
        for s in recent.gone:
            if self.recent.containsKey((s,)):
                self.recent.removeKey((s,))
        self.view.update((pickle.dumps(view),))
        if out:
            yield _frame(key[0], out)

    def close(self) -> None:
        pass


def live_view(stream: DataFrame, window_s: float = 10.0, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Outputs of the view of every session of a stream of events, in append mode.

    kind ``trace``: a frame's signals and the strongest rates of the trailing window;
    ``request``: an analysis is asked for, since the target changed; ``rates``: the shown
    and tracked rates after a current result. The state store must be RocksDB's. State
    that expires keeps the query triggering; with ``idle_ms`` None it stays, and a run over
    what is available ends.
    """
    mode = "ProcessingTime" if idle_ms else "None"
    return stream.groupBy("session_id").transformWithStateInPandas(ViewProcessor(window_s, idle_ms), StructType.fromDDL(OUTPUT), "Append", mode)


def recorded_view(table: DataFrame, window_s: float = 10.0) -> DataFrame:
    """The same outputs of whole tables of events in batch."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _frame(rows["session_id"].iloc[0], viewed(View(window_s), _plain(rows), Recent())[1])

    return table.groupBy("session_id").applyInPandas(run, OUTPUT)
