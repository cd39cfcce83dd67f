"""The live view of a range-profile session as steps over its events.

Events are control rows (the selector's state, target and gate), frames, and results of
analyses. A target counts only while the selector estimates a breathing rate. A change
of target starts a new trace, seeded with the recent frames, lets the tracked rates go,
and asks for a new analysis: results that answer an older request are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from ..constants import FRAME_RESP_BAND, GATE_HALF_WIDTH, HEART_BAND, RATE_WINDOW_S
from . import trackers
from .live import FIELDS, LiveTrace
from .sliding import SlidingSpectrum

#: The selector's state in which its target counts; fixed value.
ESTIMATING = "ESTIMATE_BREATHING_RATE"
#: Seconds between results where there was none before.
FIRST_STEP_S = 0.25
CONTROL, FRAME, RESULT = "control", "frame", "result"
_RANK = {CONTROL: 0, FRAME: 1, RESULT: 2}

OUTPUT = (
    "session_id string, kind string, trace long, request_id long, frame long, target_distance_m double, "
    + ", ".join(f"{f} double" for f in FIELDS)
    + ", resp_peak_hz double, heart_peak_hz double, shown_resp_hz double, tracked_heart_hz double"
)


class Recent(dict):
    """Frames by whole second. What changed is noted, so that a store writes only that."""

    def __init__(self, *args):
        super().__init__(*args)
        self.changed: set[int] = set()
        self.gone: set[int] = set()

    def add(self, second: int, rows: list[dict]) -> None:
        self[second] = [*self.get(second, []), *rows]
        self.changed.add(second)

    def before(self, seconds: Iterable[int], first: int) -> None:
        """Let go of the seconds before ``first``."""
        for s in [s for s in seconds if s < first]:
            self.pop(s, None)
            self.changed.discard(s)
            self.gone.add(s)


@dataclass
class View:
    """What a session's view knows, but for its recent frames: of one size however long it lasts."""

    window_s: float = 10.0
    target: float | None = None
    half_width: float = GATE_HALF_WIDTH
    request: int = 0
    trace: int = 0
    chain: LiveTrace = field(default_factory=LiveTrace)
    resp: SlidingSpectrum | None = None
    heart: SlidingSpectrum | None = None
    lock: trackers.Lock | None = None
    display: trackers.Display | None = None
    last_result_ms: float | None = None
    seconds: tuple[int, ...] = ()

    @property
    def horizon_s(self) -> float:
        return max(30.0, RATE_WINDOW_S, self.window_s)


def _asked(view: View, kind: str, **values) -> dict:
    return {"kind": kind, "trace": view.trace, "request_id": view.request, "target_distance_m": view.target} | values


def control(view: View, row: dict, recent: Recent) -> tuple[View, list[dict]]:
    """A control row: (view, outputs)."""
    given = row.get("target_distance_m")
    counts = row.get("app_state") == ESTIMATING and given is not None and math.isfinite(given) and given > 0
    target = float(given) if counts else None
    half = row.get("half_width_m")
    half = GATE_HALF_WIDTH if half is None or not math.isfinite(half) or half <= 0 else float(half)
    if target == view.target:
        view.chain.half_width = half
        return replace(view, half_width=half), []
    view = replace(view, target=target, half_width=half, request=view.request + 1, trace=view.trace + 1, lock=None, display=None, last_result_ms=None)
    view.chain, view.resp, view.heart = LiveTrace(target, target is not None, half), None, None
    seed = [r for s in sorted(recent) for r in recent[s]]
    if seed:
        first = seed[-1]["timestamp_ms"] - 1000 * view.horizon_s
        seed = [r for r in seed if r["timestamp_ms"] >= first]
    return view, [_asked(view, "request"), *_traced(view, seed)]


def _traced(view: View, rows: list[dict]) -> list[dict]:
    out = []
    for r in view.chain.feed(rows):
        n = round(view.chain.fs * view.horizon_s)
        if view.resp is None or (view.resp.fs, view.resp.n) != (view.chain.fs, n):
            view.resp, view.heart = (SlidingSpectrum(n, view.chain.fs, band) for band in (FRAME_RESP_BAND, HEART_BAND))
        view.resp.push(r["resp_signal"])
        view.heart.push(r["heart_signal"])
        own = {f: r[f] for f in FIELDS} | {"frame": r["frame"], "target_distance_m": r["target_distance_m"]}
        out.append(_asked(view, "trace", **own, resp_peak_hz=view.resp.peak()[0], heart_peak_hz=view.heart.peak()[0]))
    return out


def framed(view: View, rows: list[dict], recent: Recent) -> tuple[View, list[dict]]:
    """Frames that came together: (view, outputs). Repeated and late ones are dropped."""
    last, new = view.chain.last_frame, []
    for r in rows:  # before the rate is estimated from them
        number = r.get("frame")
        if number is None or last is None or number > last:
            new.append(r)
            last = last if number is None else number
    out = _traced(view, new)
    for r in new:
        second = int(r["timestamp_ms"] // 1000)
        recent.add(second, [r])
    if new:
        known = {*view.seconds, *recent}
        recent.before(known, int(new[-1]["timestamp_ms"] // 1000 - view.horizon_s))
        view = replace(view, seconds=tuple(sorted(known - recent.gone)))
    return view, out


def answered(view: View, row: dict) -> tuple[View, list[dict]]:
    """The result of an analysis: (view, outputs); one of an older request changes nothing."""
    if row["request_id"] != view.request:
        return view, []
    present = bool(row["present"])
    display, shown = trackers.display_step(view.display, row["resp_hz"], row["resp_confidence"], row["signal_quality"], present)
    if not present:
        return replace(view, display=display, lock=None), [_asked(view, "rates", shown_resp_hz=shown, tracked_heart_hz=0.0)]
    step = FIRST_STEP_S if view.last_result_ms is None else (row["at_ms"] - view.last_result_ms) / 1000
    lock, tracked = trackers.heart_step(view.lock, row["heart_hz"], step, row["heart_confidence"], row["signal_quality"])
    view = replace(view, display=display, lock=lock, last_result_ms=row["at_ms"])
    return view, [_asked(view, "rates", shown_resp_hz=shown, tracked_heart_hz=tracked)]


def in_order(events: Iterable[dict]) -> list[dict]:
    """By time; at one time control rows first, then frames by number, then results."""
    return sorted(events, key=lambda e: (e["at_ms"], _RANK[e["kind"]], e.get("frame") or 0))


def viewed(view: View, events: list[dict], recent: Recent, load=lambda: None) -> tuple[View, list[dict]]:
    """The view after some events and what it gives out; ``load`` fetches the recent frames when a control row may need them."""
    out, loaded, held = [], False, []

    def flush():
        nonlocal view, held
        if held:
            view, more = framed(view, held, recent)
            out.extend(more)
            held = []

    for e in in_order(events):
        if e["kind"] == FRAME:
            held.append(e)
            continue
        flush()
        if e["kind"] == CONTROL:
            if not loaded:
                load()
                loaded = True
            view, more = control(view, e, recent)
        else:
            view, more = answered(view, e)
        out.extend(more)
    flush()
    return view, out
