"""Operators over frames of a source: readings of one frame, sampling walks, visual states, signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK, SAME_STATE = 0.01, 0.06
CANDIDATE, SENTINEL = 0.03, 1.0


def same_frame(regions: DataFrame, key: str = "source_id") -> DataFrame:
    """The regions of one frame as one reading, in reading order (top, left, then arrival).

    ``id, frame, text, confidence, seq, top, bottom, left``; a null ``frame`` stands alone. A line break parts regions
    whose heights do not overlap, if both have a place; else they join without one.
    """
    part = F.struct(F.coalesce("top", F.lit(0.0)).alias("y"), F.coalesce("left", F.lit(0.0)).alias("x"), F.col("seq"), F.col("id"), F.col("text"), F.col("top"), F.col("bottom"))
    frame = F.coalesce(F.col("frame").cast("string"), F.concat(F.lit("id:"), F.col("id").cast("string")))
    rows = regions.groupBy(key, frame.alias("frame")).agg(F.sort_array(F.collect_list(part)).alias("parts"), F.avg("confidence").alias("confidence"))
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("bottom"), F.lit(True).alias("first"))

    def add(acc, p):
        apart = F.coalesce(F.least(acc["bottom"], p["bottom"]) - F.greatest(acc["top"], p["top"]) <= 0, F.lit(False))
        # least and greatest skip nulls, so both places are asked for
        placed = acc["top"].isNotNull() & p["top"].isNotNull()
        mark = F.when(~acc["first"] & placed & apart, "\n").otherwise("")
        return F.struct(F.concat(acc["text"], mark, p["text"]).alias("text"), p["top"].alias("top"), p["bottom"].alias("bottom"), F.lit(False).alias("first"))

    text = F.aggregate("parts", start, add, lambda acc: acc["text"])
    return rows.select(key, "frame", F.concat(F.lit("combined-"), F.col("parts")[0]["id"].cast("string")).alias("id"), text.alias("text"), "confidence", F.transform("parts", lambda p: p["id"]).alias("member_ids"))


def frame_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays; different sizes: 1."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total / F.size(a)).otherwise(1.0)


def signature_distance(a: Column, b: Column) -> Column:
    """Share of cells that differ; different sizes: 1."""
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))
    return F.when(F.size(a) != F.size(b), 1.0).when(F.size(a) == 0, 0.0).otherwise(differ / F.size(a))


def is_blank(signature: Column, threshold: float = BLANK) -> Column:
    """Fewer set cells than ``threshold`` of them; no cells: blank."""
    return (F.size(signature) == 0) | (F.size(F.filter(signature, lambda x: x)) / F.size(signature) < threshold)


def fps_walk(times: list[float], fps: float) -> list[int]:
    """Places kept by a grid that moves one step a kept frame, so that it catches up after a gap."""
    out: list[int] = []
    due = None
    for k, t in enumerate(times):
        if due is None or t >= due:
            due = (t if due is None else due) + 1 / fps
            out.append(k)
    return out


def schedule(times: list[float], distances, tail: bool = False) -> Iterator[tuple[int, str]]:
    """(place, reason) of the frames to look at closely; with ``tail`` also the last one, as the range's boundary.

    ``distances(k, anchor)`` compares two frames cheaply; the anchor is the frame looked at last.
    """
    anchor, follow = None, False
    for k, t in enumerate(times):
        if anchor is None:
            reason = "bootstrap"
        elif follow:
            reason = "candidate_followup"
        elif distances(k, anchor) > CANDIDATE:
            reason = "candidate"
        elif t - times[anchor] >= SENTINEL:
            reason = "sentinel"
        else:
            continue
        follow = reason == "candidate"
        anchor = k
        yield k, reason
    if tail and times and anchor != len(times) - 1:
        yield len(times) - 1, "boundary"


def _grouped(rows: DataFrame, columns: list[str], fold, names: list[str], schema: str, key: str) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start_time", kind="stable")
        out = [(frame[key].iloc[0], *r) for r in fold(frame)]
        return pd.DataFrame(out, columns=[key, *names])

    return rows.select(key, "start_time", *columns).groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def sampled(frames: DataFrame, fps: float, key: str = "source_id") -> DataFrame:
    """The frames (``start_time``) that a walk at ``fps`` keeps."""

    def fold(frame):
        times = frame["start_time"].tolist()
        return [(times[k],) for k in fps_walk(times, fps)]

    return _grouped(frames, [], fold, ["start_time"], "start_time double", key)


def scheduled(frames: DataFrame, key: str = "source_id", tail: bool = False) -> DataFrame:
    """``start_time, reason`` of the frames (``start_time, signal``) to look at closely."""

    def fold(frame):
        times, signal = frame["start_time"].tolist(), frame["signal"].tolist()
        return [(times[k], reason) for k, reason in schedule(times, lambda a, b: abs(signal[a] - signal[b]), tail)]

    return _grouped(frames, ["signal"], fold, ["start_time", "reason"], "start_time double, reason string", key)


def visual_states(cells: list, threshold: float = SAME_STATE) -> list[tuple[int, int, bool]]:
    """(first, last, blank) of runs of signatures; a run goes on by blankness or nearness to its first signature."""
    out: list[tuple[int, int, bool]] = []
    for k, cell in enumerate(cells):
        blank = not len(cell) or sum(cell) / len(cell) < BLANK
        if out:
            a, _, was = out[-1]
            first = cells[a]
            far = len(first) != len(cell) or sum(x != y for x, y in zip(first, cell, strict=True)) > threshold * len(cell)
            if was == blank and (blank or not far):
                out[-1] = (a, k, blank)
                continue
        out.append((k, k, blank))
    return out


def medoid(cells: list) -> int:
    """The place of the signature nearest to all others; ties: the earliest; unlike sizes differ wholly."""
    if len({len(c) for c in cells}) > 1:
        apart = lambda a, b: 1.0 if len(a) != len(b) else sum(x != y for x, y in zip(a, b, strict=True)) / max(1, len(a))
        return int(np.argmin([sum(apart(a, b) for b in cells) for a in cells]))
    x = np.asarray([list(c) for c in cells], float).reshape(len(cells), -1)
    on = x.sum(0)
    return int(np.argmin(x @ (len(cells) - on) + (1 - x) @ on))  # cells that others have otherwise


def grouped_states(frames: DataFrame, threshold: float = SAME_STATE, key: str = "source_id") -> DataFrame:
    """``kind, start_time, end_time, n, representative`` (its medoid's time) of the visual states of ``start_time, signature``."""

    def fold(frame):
        times, cells = frame["start_time"].tolist(), frame["signature"].tolist()
        return [("blank" if blank else "subtitle", times[a], times[b], b - a + 1, times[a + medoid(cells[a : b + 1])]) for a, b, blank in visual_states(cells, threshold)]

    return _grouped(frames, ["signature"], fold, ["kind", "start_time", "end_time", "n", "representative"], "kind string, start_time double, end_time double, n long, representative double", key)


class StateGrouper:
    """Visual states of frames pushed one by one: a state is given out when the next begins, the last by :meth:`flush`."""

    def __init__(self, threshold: float = SAME_STATE):
        self.threshold, self.held = threshold, []

    def push(self, at: float, cells: list) -> tuple | None:
        blank = not len(cells) or sum(cells) / len(cells) < BLANK
        closed = None
        if self.held:
            _, first, was = self.held[0]
            far = len(first) != len(cells) or sum(x != y for x, y in zip(first, cells, strict=True)) > self.threshold * len(cells)
            if was != blank or not blank and far:
                closed = self.flush()
        self.held.append((at, cells, blank))
        return closed

    def flush(self) -> tuple | None:
        """``kind, start, end, n, representative`` of what is held."""
        if not self.held:
            return None
        held, self.held = self.held, []
        return ("blank" if held[0][2] else "subtitle", held[0][0], held[-1][0], len(held), held[medoid([c for _, c, _ in held])][0])


def mass_distance(a: Column, b: Column) -> Column:
    """Absolute difference over the sum of two coverage arrays; no mass: 0; different sizes: 1."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    mass = total(a) + total(b)
    return F.when(F.size(a) != F.size(b), 1.0).when(mass <= 1e-9, 0.0).otherwise(apart / mass)


def occupancy_distance(a: Column, b: Column, band: int) -> Column:
    """Share of differing cells over the bands of ``band`` cells that either signature has ink in; none: 0."""
    cells = F.zip_with(a, b, lambda x, y: F.struct((x | y).alias("ink"), (x != y).alias("differ")))
    bands = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / band).cast("int") - 1, F.lit(0))), lambda k: F.slice(cells, k * band + 1, F.lit(band)))
    used = F.flatten(F.filter(bands, lambda x: F.exists(x, lambda c: c["ink"])))
    return F.when(F.size(a) != F.size(b), 1.0).when(F.size(used) == 0, 0.0).otherwise(F.size(F.filter(used, lambda c: c["differ"])) / F.size(used))


def shift_tolerant_distance(a: Column, b: Column, height: int, width: int, dy: int = 1, dx: int = 2) -> Column:
    """The least :func:`mass_distance` over whole-cell shifts of ``b``; cells that come in are empty.

    Both are ``height`` rows of ``width`` cells.
    """

    def shifted(y: int, x: int) -> Column:
        cell = lambda k: F.when((F.floor(k / width) - y).between(0, height - 1) & (k % width - x).between(0, width - 1), F.get(b, (k - y * width - x).cast("int"))).otherwise(F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), cell)

    moves = [(y, x) for y in range(-dy, dy + 1) for x in range(-dx, dx + 1)]
    return F.when(F.size(a) != F.size(b), 1.0).otherwise(F.least(*[mass_distance(a, shifted(*m)) for m in moves]))
