"""Filters, projections, review actions and merges of cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import overlapping

PROTECTED = ("approved", "rejected", "needs_review")
ORDER = ("start_time", "end_time", "id")


def protected() -> Column:
    return F.col("review_state").isin(*PROTECTED)


def eligible(cues: DataFrame) -> DataFrame:
    """Cues that no person and no earlier cleaning has decided on."""
    return cues.where(F.col("review_state") == "pending")


def kept(cues: DataFrame) -> DataFrame:
    return cues.where(F.col("review_state") != "rejected")


def searched(cues: DataFrame, query: str) -> DataFrame:
    """Cues with the trimmed, lower-cased query in some layer; an empty one matches all."""
    wanted = query.strip().lower()
    return cues if not wanted else cues.where(F.exists("layers", lambda x: F.contains(F.lower(x["text"]), F.lit(wanted))))


def in_range(cues: DataFrame, start: float, end: float) -> DataFrame:
    if not 0 <= start < end:
        raise ValueError("a range is 0 <= start < end")
    return cues.where((F.col("start_time") >= start) & (F.col("start_time") < end))


def merge_incremental(existing: DataFrame, new: DataFrame, start: float, end: float) -> DataFrame:
    """``existing`` with the range's pending cues replaced by ``new``; what a person decided on stays.

    Old cues stay outside the range, when protected or straddling its ends; new ones are
    taken unless they overlap a protected cue of their source.
    """
    outside = (F.col("end_time") <= start) | (F.col("start_time") >= end)
    straddles = (F.col("start_time") < start) | (F.col("end_time") > end)
    taken = overlapping(new, existing.where(protected()), id_col="id", anti=True)
    return existing.where(outside | protected() | straddles).unionByName(taken)


def queue_label(layers: Column) -> Column:
    """The first two layers as ``language: text``; more are counted."""
    shown = F.array_join(F.transform(F.slice(layers, 1, 2), lambda x: F.concat(x["language"], F.lit(": "), x["text"])), " | ")
    return F.when(F.size(layers) > 2, F.concat(shown, F.lit(" +"), (F.size(layers) - 2).cast("string"), F.lit(" layers"))).otherwise(shown)


def nudge(cues: DataFrame, seconds: float, chosen: Column) -> DataFrame:
    """Chosen cues move by ``seconds``, to milliseconds, and need review."""
    moved = {c: F.when(chosen, F.round(F.col(c) + seconds, 3)).otherwise(F.col(c)) for c in ("start_time", "end_time")}
    return cues.withColumns({"review_state": F.when(chosen, "needs_review").otherwise(F.col("review_state"))} | moved)


def split(cues: DataFrame, at: Column) -> DataFrame:
    """Cues that hold ``at`` strictly inside become two with the same layers, both in need of review."""
    inside = (at > F.col("start_time")) & (at < F.col("end_time"))
    part = lambda name, a, b: F.struct(F.concat("id", F.lit(name)).alias("id"), a.alias("start_time"), b.alias("end_time"), F.lit("needs_review").alias("review_state"))
    whole = F.struct(F.col("id"), F.col("start_time"), F.col("end_time"), F.col("review_state"))
    parts = F.when(inside, F.array(part("-a", F.col("start_time"), at), part("-b", at, F.col("end_time")))).otherwise(F.array(whole))
    rest = [c for c in cues.columns if c not in ("id", "start_time", "end_time", "review_state")]
    return cues.select(F.explode(parts).alias("part"), *rest).select("part.*", *rest)


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """``a`` and ``b`` (structs with ``id, start_time, end_time, layers``) as one cue each.

    Layers meet by language, in the first cue's order and then the second's; texts join by a line break.
    """
    extra = F.filter("b.layers", lambda y: ~F.exists("a.layers", lambda x: x["language"] == y["language"]))

    def met(x):
        same = F.filter("b.layers", lambda y: y["language"] == x["language"])
        text = F.when(F.size(same) > 0, F.concat(x["text"], F.lit("\n"), F.get(same, F.lit(0))["text"])).otherwise(x["text"])
        return F.struct(x["language"].alias("language"), text.alias("text"))

    layers = F.concat(F.transform("a.layers", met), extra)
    return pairs.select(F.col("a.id").alias("id"), F.least("a.start_time", "b.start_time").alias("start_time"), F.greatest("a.end_time", "b.end_time").alias("end_time"), F.lit("needs_review").alias("review_state"), layers.alias("layers"))
