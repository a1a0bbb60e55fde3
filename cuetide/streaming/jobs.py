"""Evidence jobs: which frames are read, by whom, and what becomes of it, in batch and in stream.

Recognisers and detectors are factories, called once a task, so a model loads once; what they return are plain
rows. Evidence is appended as each micro-batch ends, so a job that is stopped keeps what it found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames as frame_ops
from ..operators.regions import reading_order
from ..sources import store
from . import gate

INSTANT = 0.001
PROFILES = ("production_trigger", "dense", "experimental_hybrid")


@dataclass
class Region:
    """What a recogniser read at one place of a frame."""

    text: str
    confidence: float | None = None
    language: str | None = None
    polygon: list[tuple[float, float]] | None = None


class Recogniser(Protocol):
    name: str

    def read(self, frame) -> list[Region]: ...


class Detector(Protocol):
    def find(self, frame) -> list[list[tuple[float, float]]]: ...


class EngineError(RuntimeError):
    """An engine failed; its own error is the cause."""


def chosen(candidates: list[Callable], probe=None):
    """The first engine that starts and passes a real probe; each is a factory. None does: an error that names them all."""
    wrong = []
    for make in candidates:
        try:
            engine = make()
            if probe is not None:
                probe(engine)
            return engine
        except Exception as e:  # noqa: BLE001  an engine may fail in any way
            wrong.append(f"{getattr(make, '__name__', make)}: {e}")
    raise EngineError("no engine works: " + "; ".join(wrong))


def in_order(regions: list[Region]) -> list[Region]:
    """Regions with a place in reading order; if one has none, as they came."""
    if any(not r.polygon for r in regions):
        return regions
    return [regions[k] for k in reading_order([list(r.polygon[0]) for r in regions])]


_EVIDENCE = "id string, start_time double, end_time double, text string, confidence double, language string, trigger string, place int"


def read_frames(frames: DataFrame, recogniser: Callable[[], Recogniser], key: str = "source_id") -> DataFrame:
    """One row for each region with text of each frame (``start_time, reason, frame``), or a blank one for a frame without."""
    kind = frames.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = recogniser()
        for batch in batches:
            out = []
            for source, at, reason, frame in batch.itertuples(index=False):
                try:
                    found = [r for r in in_order(engine.read(frame)) if r.text]
                except Exception as e:
                    raise EngineError(f"{engine.name} failed at {at}") from e
                for k, r in enumerate(found or [Region("")]):
                    out.append((source, f"{source}@{at:.6f}/{k}", at, at + INSTANT, r.text, r.confidence, r.language, reason, k))
            yield pd.DataFrame(out, columns=[key, "id", "start_time", "end_time", "text", "confidence", "language", "trigger", "place"])

    return frames.select(key, "start_time", "reason", "frame").mapInPandas(run, f"{key} {kind}, {_EVIDENCE}")


def triggered(frames: DataFrame, profile: str = "production_trigger", detector: Callable | None = None, key: str = "source_id") -> DataFrame:
    """The frames (``start_time, signal, frame``) that a profile reads, with the ``reason``.

    ``experimental_hybrid`` needs a detector and is refused without one: it never falls back.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    if profile == "dense":
        return frames.withColumn("reason", F.lit("dense"))
    if profile == "experimental_hybrid":
        if detector is None:
            raise ValueError("experimental_hybrid needs a detector; it does not fall back")
        found = frame_ops.scheduled(frames.select(key, "start_time", "signal"), key, tail=True)
    else:
        found = gate.triggers(frames.select(F.col(key).alias("source_id"), "start_time", "signal")).withColumnRenamed("source_id", key).drop("signal")
    return frames.join(found, [key, "start_time"])


def evidence(frames: DataFrame, recogniser: Callable[[], Recogniser], *, profile: str = "production_trigger", detector: Callable | None = None, key: str = "source_id") -> DataFrame:
    """Frames to observations by one profile."""
    return read_frames(triggered(frames, profile, detector, key), recogniser, key)


def metrics(frames: DataFrame, found: DataFrame, key: str = "source_id") -> DataFrame:
    """``key, frames, calls, observations, reduction`` of a job."""
    n = frames.groupBy(key).agg(F.count("*").alias("frames"))
    m = found.groupBy(key).agg(F.count_distinct("start_time").alias("calls"), F.count_if(F.col("text") != "").alias("observations"))
    out = n.join(m, key, "left").fillna(0, ["calls", "observations"])
    return out.withColumn("reduction", 1 - F.col("calls") / F.col("frames"))


def append_stream(observations: DataFrame, path: str, checkpoint: str, run_id: str, key: str = "source_id"):
    """Starts appending a stream's observations under ``run_id``; each micro-batch is whole or absent."""

    def add(batch: DataFrame, _: int) -> None:
        store.append(batch.withColumn("evidence_run_id", F.lit(run_id)), path, key, "evidence_run_id")

    return observations.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Job:
    """A streaming query's life in the words queued, running, cancel_requested, succeeded, failed, cancelled."""

    def __init__(self, start: Callable):
        self._start, self._query, self._asked = start, None, False

    @property
    def state(self) -> str:
        if self._query is None:
            return "cancelled" if self._asked else "queued"
        if self._query.isActive:
            return "cancel_requested" if self._asked else "running"
        if self._query.exception() is not None:
            return "failed"
        return "cancelled" if self._asked else "succeeded"

    def run(self, seconds: float | None = None) -> str:
        if not self._asked:
            self._query = self._start()
            try:
                self._query.awaitTermination(seconds)
            except Exception:  # noqa: BLE001  the state tells
                pass
        return self.state

    def cancel(self) -> None:
        self._asked = True
        if self._query is not None and self._query.isActive:
            self._query.stop()
