"""Change-triggered sampling on frames: two scores a step, against the frame that was read last.

The mean difference is cheap and opens a candidate; once it has settled, the structural difference decides whether
text changed. A change of shape is a change. What is refused moves the base, so that a drift isn't asked about again.
"""

from __future__ import annotations

from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.images import structural_difference
from .gate import CHANGE, LONGEST, PERIOD, SETTLE, STEADY, STRUCTURAL


def mean_difference(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a.astype(np.float64) - b.astype(np.float64)).mean() / 255.0)


class FrameGate:
    """What is remembered of a source between frames (grey, or colour with three bytes a pixel)."""

    STATE: ClassVar[str] = "base binary, before binary, height int, width int, read_at double, since double, steady int"
    OUT: ClassVar[str] = "start_time double, id long, decision string, difference double, structural double"

    def __init__(self):
        self.base = self.before = self.since = None
        self.read_at, self.steady = 0.0, 0

    @classmethod
    def restored(cls, state: tuple) -> FrameGate:
        gate = cls()
        base, before, height, width, gate.read_at, since, gate.steady = state
        gate.base, gate.before = cls._pixels(height, width, bytes(base)), cls._pixels(height, width, bytes(before))
        gate.since = None if since is None or np.isnan(since) else since
        return gate

    def state(self) -> tuple:
        height, width = self.base.shape[:2]
        return self.base.tobytes(), self.before.tobytes(), height, width, self.read_at, self.since, self.steady

    @staticmethod
    def _pixels(height: int, width: int, raw: bytes) -> np.ndarray:
        flat = np.frombuffer(raw, np.uint8)
        return flat.reshape((height, width) if len(flat) == height * width else (height, width, 3))

    def _read(self, frame: np.ndarray, at: float, why: str, *scores: float | None) -> tuple:
        self.base, self.read_at, self.since = frame, at, None
        return (why, *scores)

    def see(self, at: float, height: int, width: int, raw: bytes) -> tuple | None:
        """``decision, difference, structural`` where the frame is read or a candidate ends, else None."""
        frame, told = self._pixels(height, width, raw), None
        if self.base is None:
            told = self._read(frame, at, "first_frame", None, None)
        elif frame.shape != self.base.shape:
            told = self._read(frame, at, "change_detected", None, None)
        else:
            told = self._compare(frame, at)
        self.before = frame
        return told

    def _compare(self, frame: np.ndarray, at: float) -> tuple | None:
        change, calm = mean_difference(self.base, frame), mean_difference(self.before, frame) <= STEADY
        if self.since is None:
            if change > CHANGE:
                self.since, self.steady = at, int(calm)
            elif at - self.read_at >= PERIOD:
                return self._read(frame, at, "periodic_confirmation", change, 0.0)
            return None
        if change <= CHANGE:
            self.since, self.steady = None, 0
            return "reverted_to_baseline", change, None
        self.steady = self.steady + 1 if calm else 0
        waited = at - self.since
        if waited < LONGEST and not (self.steady >= 1 and waited >= SETTLE - 1e-4):
            return None
        self.steady, structural = 0, structural_difference(self.base, frame)
        if structural >= STRUCTURAL:
            return self._read(frame, at, "change_detected", change, structural)
        self.base, self.since = frame, None
        return "below_structural_threshold", change, structural


def decisions(frames: DataFrame) -> DataFrame:
    """``source_id, start_time, id, decision, difference, structural`` of a batch of ``..., height, width, pixels``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        gate, out = FrameGate(), []
        for r in frame.sort_values(["start_time", "id"], kind="stable").itertuples():
            if told := gate.see(r.start_time, r.height, r.width, bytes(r.pixels)):
                out.append((r.source_id, r.start_time, r.id, *told))
        return pd.DataFrame(out, columns=["source_id", "start_time", "id", "decision", "difference", "structural"])

    kind = frames.schema["source_id"].dataType.simpleString()
    return frames.select("source_id", "start_time", "id", "height", "width", "pixels").groupBy("source_id").applyInPandas(run, f"source_id {kind}, {FrameGate.OUT}")
