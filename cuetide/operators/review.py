"""Review of cues: normalisation flags, evidence texts, priorities from diagnostics, the risk of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import review, text

#: Flags of a rolling-caption diagnosis in the order shown, with their labels, and the other texts.
FLAGS = (
    ("source_order", "Source order issue"), ("collision", "Timing collision"), ("ambiguous", "Segmentation ambiguous"),
    ("growth", "Rolling growth consolidated"), ("sliding", "Sliding overlap consolidated"), ("repetition", "Repetition collapsed"),
)
UNTOUCHED, TOUCHED = "Preserved 1:1 — no reconstruction required", "Normalization: "
BADGES = {"approved": "✓ Approved", "rejected": "✕ Discarded", "needs_review": "⚠ Needs Review", "pending": "○ Pending"}
LOW_RISK = ("dedupe_exact_lines", "remove_persistent_overlay_line", "strip_persistent_overlay_edge", "drop_high_confidence_machine_token")
MEDIUM_RISK = ("absorb_redundant_micro_fragment", "prune_short_latin_extra_line", "prune_transient_lines")
#: Flags that say the reconstruction is not sure; the others are confident repairs.
UNSURE = ("source_order", "collision", "ambiguous")


def _any(names, held=lambda n: F.col(n)) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | F.coalesce(held(name), F.lit(False))
    return out


def with_diagnostics(cues: DataFrame, diagnostics: DataFrame, key: str = "id") -> DataFrame:
    """``cues`` with the flags of their diagnosis and ``diagnosed``: whether there is one."""
    found = diagnostics.select(key, *[name for name, _ in FLAGS]).withColumn("diagnosed", F.lit(True))
    return cues.join(found, key, "left").withColumn("diagnosed", F.coalesce("diagnosed", F.lit(False)))


def preserved() -> Column:
    """A diagnosis exists and none of its flags is up."""
    return F.col("diagnosed") & ~_any(name for name, _ in FLAGS)


def kind_line() -> Column:
    """What happened to a cue, in words; without a diagnosis null."""
    labels = F.array_compact(F.array(*[F.when(F.col(name), label) for name, label in FLAGS]))
    said = F.when(F.size(labels) == 0, UNTOUCHED).otherwise(F.concat(F.lit(TOUCHED), F.array_join(labels, ", ")))
    return F.when(F.col("diagnosed"), said)


def badge(state: Column) -> Column:
    out = F.lit(BADGES["pending"])
    for name in ("needs_review", "rejected", "approved"):
        out = F.when(state == name, BADGES[name]).otherwise(out)
    return out


def queue_item(start: Column, level: Column, state: Column, label: Column) -> Column:
    return F.concat(F.format_string("[%.2fs] [%s] [", start, level), badge(state), F.lit("] "), label)


def rolling_signals(key: str = "id") -> dict[str, Column]:
    """Review components of a rolling-caption diagnosis: only what stayed unsure counts."""
    nothing = F.lit(None).cast("double")
    return review.components(nothing, _any(UNSURE), F.lit(False), F.lit(False))


def multilingual_signals(confidence: Column, missing: Column, ambiguous: Column) -> dict[str, Column]:
    """Review components of a cue of several languages, from the numbers of missing and ambiguous ones."""
    return review.components(confidence, F.lit(False), missing > 0, ambiguous > 0)


def evidence(cues: DataFrame, observations: DataFrame, key: str = "source_id") -> DataFrame:
    """Each cue (``id, ids``) with its observations in time order: ``parts`` of ``start_time, end_time, id, text``.

    Ids without an observation drop out; a cue without any keeps an empty array.
    """
    held = cues.select("id", F.explode("ids").alias("observation_id")).join(observations.select(F.col("id").alias("observation_id"), "start_time", "end_time", "text"), "observation_id")
    parts = held.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start_time", "observation_id", "end_time", "text"))).alias("parts"))
    return cues.join(parts, "id", "left").withColumn("parts", F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)))


def span_text(start: Column, end: Column) -> Column:
    return F.format_string("%.3fs – %.3fs", start, end)


def raw_stream(parts: Column) -> Column:
    """The evidence of a cue, a line each."""
    lines = F.transform(parts, lambda p: F.concat(p["observation_id"], F.lit("  "), F.format_string("%.3fs–%.3fs  ", p["start_time"], p["end_time"]), p["text"]))
    return F.when(F.size(parts) == 0, "No source observations recorded for this Cue.").otherwise(F.array_join(lines, "\n"))


def explanation(ids: Column, cue_id: Column, kind: Column) -> Column:
    """Which observations became the cue, and what happened to it."""
    none = F.concat(F.lit("Reconstructed Cue "), cue_id, F.lit(" has no recorded source observations."))
    base = F.when(F.size(ids) == 0, none).otherwise(F.concat(F.lit("Source observations "), F.array_join(ids, " + "), F.lit("\n→ Reconstructed Cue "), cue_id))
    return F.concat_ws("\n", base, kind)


def collision_track(parts: Column, cue_id: Column, start: Column, end: Column, collision: Column) -> Column:
    lines = F.transform(parts, lambda p: F.concat(F.lit("Source "), p["observation_id"], F.lit(": "), span_text(p["start_time"], p["end_time"])))
    own = F.concat(F.lit("Reconstructed "), cue_id, F.lit(": "), span_text(start, end))
    marked = F.when(F.coalesce(collision, F.lit(False)), F.array(F.lit("⚠ Timing collision — flagged for review"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(lines, F.array(own), marked), "\n")


def timeline(cues: DataFrame) -> DataFrame:
    """Spans of each cue and its evidence from the start of both on: ``id, role, start, end, duration``."""
    first = F.least(F.col("start_time"), F.coalesce(F.array_min(F.transform("parts", lambda p: p["start_time"])), F.col("start_time")))
    last = F.greatest(F.col("end_time"), F.coalesce(F.array_max(F.transform("parts", lambda p: p["end_time"])), F.col("end_time")))
    own = F.struct(F.when(F.coalesce("collision", F.lit(False)), "collision").otherwise("reconstructed").alias("role"), F.col("start_time").alias("a"), F.col("end_time").alias("b"))
    spans = F.concat(F.transform("parts", lambda p: F.struct(F.lit("source").alias("role"), p["start_time"].alias("a"), p["end_time"].alias("b"))), F.array(own))
    rows = cues.select("id", first.alias("first"), last.alias("last"), F.explode(spans).alias("span"))
    return rows.select("id", "span.role", (F.col("span.a") - F.col("first")).alias("start"), (F.col("span.b") - F.col("first")).alias("end"), (F.col("last") - F.col("first")).alias("duration"))


def purged(cues: DataFrame, selected: Column | None = None) -> DataFrame:
    """Without rejected cues; with a selection only its rejected cues go."""
    gone = F.col("review_state") == "rejected"
    return cues.where(~(gone if selected is None else gone & selected))


def failure_class(components: dict[str, Column]) -> Column:
    """Which kind of evidence a priority had: the confidence, others, both, none."""
    low = components["low_confidence"] > 0
    other = F.lit(False)
    for name, part in components.items():
        if name != "low_confidence":
            other = other | (part > 0)
    return F.when(low & other, "low_confidence_and_other_signal").when(low, "low_confidence_only").when(other, "other_signal_only").otherwise("no_signal")


def risk(action: Column, reasons: Column, size: Column, loses: Column) -> Column:
    """``low``, ``medium`` or ``review``: how far a cleaner's change asks for a second look."""
    within = lambda *names: F.size(F.array_except(reasons, F.array(*map(F.lit, names)))) == 0
    merge = F.when(F.coalesce(loses, F.lit(False)), "review").when(within("robust_similarity") & (size <= 4), "low").when(F.array_contains(reasons, "character_order_scramble"), "medium")
    merge = merge.when(within("robust_similarity", "fragment_or_line_coverage") & (size <= 8), "medium").otherwise("review")
    return F.when(action.isin(*LOW_RISK), "low").when(action.isin(*MEDIUM_RISK), "medium").when(action == "merge_state_cluster", merge).otherwise("review")


def detail(columns: list[str]) -> Column:
    """``name: value`` lines of an observation; a null reads None."""
    return F.array_join(F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns]), "\n")


def summary(start: Column, said: Column) -> Column:
    short = F.when(F.length(said) > 40, F.concat(F.substring(said, 1, 37), F.lit("..."))).otherwise(said)
    return F.concat(F.format_string("%.3fs  ", start), short)


def processing_range(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """The range asked for, the whole duration by default; a start below 0, an end before it or beyond the media is an error."""
    a, b = F.coalesce(start, F.lit(0.0)), F.coalesce(end, duration)
    wrong = F.when(a < 0, "start_time must not be negative").when(b <= a, "end_time must be after start_time").when(b > duration, "end_time exceeds the media's duration")
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("double")).otherwise(a)
    return checked, F.when(wrong.isNotNull(), F.raise_error(wrong).cast("double")).otherwise(b)


def whole_media(start: Column, end: Column) -> Column:
    return start.isNull() & end.isNull()


def required(cues: DataFrame, ids: list[str]) -> DataFrame:
    """``cues``; an id that none has is an error of the query, not a row left out."""
    known = cues.agg(F.collect_set(F.when(F.col("id").isin(*ids), F.col("id"))).alias("known"))  # as long as ``ids``
    missing = F.array_except(F.array(*map(F.lit, ids)).cast("array<string>"), F.col("known"))
    checked = known.select(F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("unknown cue ids: "), F.array_join(missing, ", "))).cast("boolean")).otherwise(F.lit(True)))
    return cues.where(checked.scalar())


def shared_lines(cues: DataFrame) -> DataFrame:
    """``id, line`` of lines that stand under more than one layer of a cue: whose they are can't be told."""
    layers = cues.select("id", F.posexplode("layers").alias("layer", "held"))
    rows = layers.select("id", "layer", F.explode(text.lines(F.col("held.text"))).alias("line"))
    return rows.groupBy("id", "line").agg(F.count_distinct("layer").alias("n")).where("n > 1").select("id", "line")
