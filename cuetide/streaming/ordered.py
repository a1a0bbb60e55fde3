"""State machines over streams whose rows come out of order: state and timers by source, rows in the order of time.

Rows wait in a list state until the watermark has passed them; then a timer hands them over in order. A row behind
the watermark is late and dropped. A row that marks the end of its source (``ended``) hands over all that waits, and
lets the machine give out what it holds. Machines keep typed state of their own, so a query that starts again from its
checkpoint goes on where it was.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.frames import StateGrouper
from .frame_gate import FrameGate

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep state with timers, which only this store can."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Event time of second 0 in milliseconds: the engine drops rows at or before a first watermark of 0.
ORIGIN = 10**12


def _ms(seconds: float) -> int:
    return math.ceil(seconds * 1000) + ORIGIN


class Ordered(StatefulProcessor):
    """``columns`` of a row after its key: the first is its time in seconds, the second decides between equal times."""

    columns: tuple[str, ...]
    whole: tuple[str, ...]
    row: str
    out: tuple[str, ...]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.prepare(handle)

    def prepare(self, handle) -> None:
        """Declares the machine's own state."""

    def advance(self, rows: list[tuple], ended: bool) -> Iterable[tuple]:
        """What the machine gives out for ``rows`` in order, and at the end of its source."""
        raise NotImplementedError

    def _frame(self, key, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(key[0], *r) for r in found], columns=["source_id", *self.out])

    def _hand_over(self, rows: list[tuple], upto: int | None) -> list[tuple]:
        """Those of ``rows`` that are due, in order; the others wait, with a timer."""
        rows = sorted(rows, key=lambda r: r[:2])
        due = [r for r in rows if upto is None or _ms(r[0]) <= upto]
        rest = rows[len(due) :]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(_ms(rest[0][0]))
        else:
            self.waiting.clear()
        return due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, new, ended = timerValues.getCurrentWatermarkInMs(), [], False
        for frame in rows:
            ended = ended or bool(frame["ended"].any())
            frame = frame[~frame["ended"].astype(bool)]
            frame = frame.astype(dict.fromkeys(self.whole, "int64"))  # nulls of end marks make them floats
            new += [tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in r) for r in frame[list(self.columns)].itertuples(index=False, name=None) if _ms(r[0]) > passed]
        if ended:
            held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
            yield from self._frame(key, list(self.advance(self._hand_over(held + new, None), True)))
        elif new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(_ms(r[0]) for r in new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            due = self._hand_over([tuple(r) for r in self.waiting.get()], timerValues.getCurrentWatermarkInMs())
            if due:
                yield from self._frame(key, list(self.advance(due, False)))

    def close(self) -> None:
        pass


class VisualStates(Ordered):
    """Runs of like signatures: a state is given out when the next begins, the last at the end of its source."""

    columns, row = ("start_time", "id", "signature"), "start_time double, id long, signature array<boolean>"
    whole = ("id",)
    out = ("kind", "start_time", "end_time", "n", "representative")

    def __init__(self, threshold: float):
        self.threshold = threshold

    def prepare(self, handle) -> None:
        self.members = handle.getListState("members", self.row)

    def advance(self, rows, ended):
        grouper = StateGrouper(self.threshold)
        for at, _, cells in self.members.get() if self.members.exists() else ():
            grouper.push(at, list(cells))
        for at, _, cells in rows:
            if (closed := grouper.push(at, list(cells))) is not None:
                yield closed
        if ended and (closed := grouper.flush()) is not None:
            yield closed
        if grouper.held:
            self.members.put([(at, 0, [bool(c) for c in cells]) for at, cells, _ in grouper.held])
        else:
            self.members.clear()


class FrameTriggers(Ordered):
    """Which frames to read, and why others that began a change are not: the confirmed frame is kept as bytes."""

    columns, row = ("start_time", "id", "height", "width", "pixels"), "start_time double, id long, height int, width int, pixels binary"
    whole = ("id", "height", "width")
    out = ("start_time", "id", "decision", "difference", "structural")

    def prepare(self, handle) -> None:
        self.held = handle.getValueState("gate", FrameGate.STATE)

    def advance(self, rows, ended):
        gate = FrameGate.restored(tuple(self.held.get())) if self.held.exists() else FrameGate()
        for at, row_id, height, width, pixels in rows:
            if told := gate.see(at, height, width, bytes(pixels)):
                yield (at, row_id, *told)
        self.held.update(gate.state())


def _started(frames: DataFrame, machine: Ordered, schema: str, delay: str) -> DataFrame:
    rows = frames if "ended" in frames.columns else frames.withColumn("ended", F.lit(False))
    timed = rows.select("source_id", *machine.columns, "ended", F.timestamp_millis(F.ceil(F.col("start_time") * 1000) + ORIGIN).alias("at")).withWatermark("at", delay)
    kind = frames.schema["source_id"].dataType.simpleString()
    return timed.groupBy("source_id").transformWithStateInPandas(machine, f"source_id {kind}, {schema}", "Append", "eventTime")


def stream_states(frames: DataFrame, threshold: float, delay: str) -> DataFrame:
    """Visual states of a stream of ``source_id, start_time, id, signature`` and, at a source's end, a row with ``ended``."""
    return _started(frames, VisualStates(threshold), "kind string, start_time double, end_time double, n long, representative double", delay)


def stream_frame_triggers(frames: DataFrame, delay: str) -> DataFrame:
    """:func:`frame_gate.decisions` of a stream of ``source_id, start_time, id, height, width, pixels``."""
    return _started(frames, FrameTriggers(), FrameGate.OUT, delay)
