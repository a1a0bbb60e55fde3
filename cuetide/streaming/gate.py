"""Change-triggered sampling of a stream of signals: which frames are worth a reading.

The same state machine serves a batch (one source after another) and a stream (state kept per
source), so both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame

CHANGE, STEADY, STRUCTURAL, PERIOD, SETTLE, LONGEST = 0.02, 0.015, 0.012, 2.0, 0.033, 0.35
_SCHEMA = "source_id {kind}, start_time double, signal double, reason string"


@dataclass
class Gate:
    """What is remembered of a source between frames."""

    base: float | None = None
    read_at: float = 0.0
    last: float = 0.0
    since: float | None = None
    steady: int = 0

    def see(self, signal: float, at: float) -> str | None:
        """Why the frame should be read, or None."""
        if self.base is None:
            return self._read(signal, at, "first_frame")
        change, step = abs(signal - self.base), abs(signal - self.last)
        self.last = signal
        if self.since is None:
            if change <= CHANGE:
                return self._read(signal, at, "periodic_confirmation") if at - self.read_at >= PERIOD else None
            self.since, self.steady = at, int(step <= STEADY)
            return None
        if change <= CHANGE:
            self.since = None
            return None
        self.steady = self.steady + 1 if step <= STEADY else 0
        waited = at - self.since
        if not (self.steady >= 1 and waited >= SETTLE - 1e-4 or waited >= LONGEST):
            return None
        if change >= STRUCTURAL:
            return self._read(signal, at, "change_detected")
        self.base, self.since = signal, None
        return None

    def _read(self, signal: float, at: float, reason: str) -> str:
        self.base, self.last, self.read_at, self.since, self.steady = signal, signal, at, None, 0
        return reason


def _pass(gate: Gate, frame: pd.DataFrame) -> list[tuple]:
    out = []
    for r in frame.sort_values("start_time", kind="stable").itertuples():
        if reason := gate.see(r.signal, r.start_time):
            out.append((r.source_id, r.start_time, r.signal, reason))
    return out


def triggers(frames: DataFrame) -> DataFrame:
    """``source_id, start_time, signal, reason`` of the frames to read, from a batch."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_pass(Gate(), frame), columns=["source_id", "start_time", "signal", "reason"])

    kind = frames.schema["source_id"].dataType.simpleString()
    return frames.select("source_id", "start_time", "signal").groupBy("source_id").applyInPandas(run, _SCHEMA.format(kind=kind))


def stream_triggers(frames: DataFrame) -> DataFrame:
    """The same over a stream whose frames come in order within a source."""

    def run(key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        gate = Gate(*[None if pd.isna(x) else x for x in state.get]) if state.exists else Gate()
        gate.steady = int(gate.steady or 0)
        rows = [r for chunk in [pd.concat(list(chunks))] for r in _pass(gate, chunk)]
        state.update(tuple(asdict(gate).values()))
        yield pd.DataFrame(rows, columns=["source_id", "start_time", "signal", "reason"])

    kind = frames.schema["source_id"].dataType.simpleString()
    held = "base double, read_at double, last double, since double, steady int"
    return frames.select("source_id", "start_time", "signal").groupBy("source_id").applyInPandasWithState(run, _SCHEMA.format(kind=kind), held, "append", "NoTimeout")
