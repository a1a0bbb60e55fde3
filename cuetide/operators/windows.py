"""Operators over time-ordered rows of a source: windows, runs, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranks


def in_order(key: str = "source_id"):
    return W.partitionBy(key).orderBy("start_time", "id")


def next_text(rows: DataFrame, key: str = "source_id") -> DataFrame:
    """With ``next_text``: the next non-blank text of the source, or null."""
    after = in_order(key).rowsBetween(1, W.unboundedFollowing)
    return rows.withColumn("next_text", F.first(F.nullif("text", F.lit("")), ignorenulls=True).over(after))


def runs(rows: DataFrame, starts: Column, key: str = "source_id", name: str = "run") -> DataFrame:
    """With ``run``: how many rows so far satisfy ``starts``."""
    return rows.withColumn(name, F.sum(starts.cast("int")).over(in_order(key).rowsBetween(W.unboundedPreceding, 0)))


def vote(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The majority of ``value`` per group; ties go to the highest confidence (null: -1), then to the earliest.

    Two aggregations with map-side combine: groups of any size never meet in a window.
    """
    first = F.min(F.struct("start_time", "id"))
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("votes"), F.max(F.coalesce("confidence", F.lit(-1.0))).alias("best"), first.alias("first"))
    total = F.sum("votes").alias("n")
    rank = F.struct((-F.col("votes")).alias("v"), (-F.col("best")).alias("c"), F.col("first.start_time").alias("t"), F.col("first.id").alias("i"))
    return counted.groupBy(*by).agg(F.min_by(value, rank).alias(value), F.max("votes").alias("top"), total, F.count("*").alias("n_distinct"))


def consensus_cues(rows: DataFrame, key: str = "source_id") -> DataFrame:
    """Runs of equal non-blank text as cues, blanks belonging to the run before them."""
    said = rows.where(F.col("text") != "")
    before = F.lag("text").over(in_order(key))
    said = runs(said, before.isNull() | (before != F.col("text")), key)
    out = said.groupBy(key, "run").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.first("text").alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("n"))
    spoken = vote(said.where(F.col("language").isNotNull()), [key, "run"], "language").select(key, "run", "language", F.col("n_distinct").alias("n_languages"))
    return out.join(spoken, [key, "run"], "left").withColumn("language", F.coalesce("language", F.lit("und"))).withColumn("n_languages", F.coalesce("n_languages", F.lit(0)))


def consolidate(cues: DataFrame, gap: float = 0.15, key: str = "source_id") -> DataFrame:
    """Neighbours of equal, non-empty trimmed text merge if the next starts within ``gap`` after the merged end.

    The merged end is the greatest end so far within the row of equal texts. Of ``language`` and
    ``observation_ids``, if there are such columns, the first is kept and all are joined in order.
    """
    order = in_order(key)
    text = F.trim("text")
    changed = F.coalesce(text != F.lag(text).over(order), F.lit(True)) | (text == "")
    rows = runs(cues, changed, key, "same")
    inside = W.partitionBy(key, "same").orderBy("start_time", "id")
    reach = F.max("end_time").over(inside.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("breaks", F.coalesce(F.col("start_time") > reach + gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("part", F.sum("breaks").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    first = F.struct("start_time", "id")
    more = []
    if "language" in cues.columns:
        more.append(F.min_by("language", first).alias("language"))
    if "observation_ids" in cues.columns:
        held = F.sort_array(F.collect_list(F.struct("start_time", "id", "observation_ids")))  # one recording's cues of one text
        more.append(F.array_distinct(F.flatten(F.transform(held, lambda x: x["observation_ids"]))).alias("observation_ids"))
    return rows.groupBy(key, "same", "part").agg(F.min_by("id", first).alias("id"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.min_by(text, first).alias("text"), F.count("*").alias("n"), *more)


def run_lengths(rows: DataFrame, value: str, key: str = "source_id") -> DataFrame:
    """Run-length encoding: ``key, run, value, start_time, end_time, n``."""
    before = F.lag(value).over(in_order(key))
    held = runs(rows, F.lag("id").over(in_order(key)).isNull() | ~before.eqNullSafe(F.col(value)), key)
    return held.groupBy(key, "run").agg(F.first(value).alias(value), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count("*").alias("n"))


def gaps(rows: DataFrame, key: str = "source_id") -> DataFrame:
    """The greatest gap between consecutive starts; fewer than two rows: 0."""
    step = F.col("start_time") - F.lag("start_time").over(in_order(key))
    return rows.select(key, step.alias("gap")).groupBy(key).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap"))


def trailing_mean(rows: DataFrame, value: str, seconds: float, key: str = "source_id") -> DataFrame:
    """With ``mean``: the mean of ``value`` over the trailing ``seconds``, both ends included."""
    # in whole microseconds, so equal times compare equal
    at = F.round(F.col("start_time") * 1e6).cast("long")
    frame = W.partitionBy(key).orderBy(at).rangeBetween(-round(seconds * 1e6), 0)
    return rows.withColumn("mean", F.avg(value).over(frame))


def crowded(rows: DataFrame, seconds: float, key: str = "source_id") -> DataFrame:
    """With ``n_near``: rows that start within ``seconds`` from each row's start on, itself included."""
    at = F.round(F.col("start_time") * 1e6).cast("long")
    return rows.withColumn("n_near", F.count("*").over(W.partitionBy(key).orderBy(at).rangeBetween(0, round(seconds * 1e6))))


def segments(rows: DataFrame, value: str, least: float, key: str = "source_id") -> DataFrame:
    """Run lengths; a run shorter than ``least`` between two different others is a ``transition``.

    Runs of one value that only transitions part are one again, and those transitions go.
    """
    held = run_lengths(rows, value, key)
    order = W.partitionBy(key).orderBy("run")
    between = F.coalesce(F.lag(value).over(order) != F.lead(value).over(order), F.lit(False))
    held = held.withColumn("transition", between & (F.col("end_time") - F.col("start_time") < least))
    # the last lasting run before each run, itself left out, tells whether a new part begins
    before = F.last(F.when(~F.col("transition"), F.struct(value)), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    held = held.withColumn("before", before)
    opens = ~F.col("transition") & (F.col("before").isNull() | (F.col(f"before.{value}") != F.col(value)))
    held = held.withColumn("part", F.sum(opens.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy(key, "part")
    last = F.max(F.when(~F.col("transition"), F.col("run"))).over(whole)
    held = held.withColumn("inside", F.col("transition") & (F.col("run") < last)).where(~F.col("inside"))
    alone = F.when(F.col("transition"), F.col("run")).otherwise(F.lit(-1))
    out = held.groupBy(key, "part", alone.alias("alone")).agg(F.first(value).alias(value), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.first("transition").alias("transition"))
    return out.select(key, value, "start_time", "end_time", "transition")


def ambiguities(runs: DataFrame, value: str, *, unreadable: float, seconds: float, most: int, key: str = "source_id") -> DataFrame:
    """``key, run, unreadable, crowded``: blank runs of ``unreadable`` seconds or more; more than ``most`` runs that start within ``seconds``."""
    blank = (F.col(value) == "") & (F.col("end_time") - F.col("start_time") >= unreadable)
    return crowded(runs, seconds, key).select(key, "run", blank.alias("unreadable"), (F.col("n_near") > most).alias("crowded"))


def curated(rows: DataFrame, winner: str, key: str = "source_id", also: Column | None = None) -> DataFrame:
    """First, last and the middle rows that differ from ``winner``; if none does, the middle row; and those ``also`` asked for."""
    order, whole = in_order(key), W.partitionBy(key)
    k, n = F.row_number().over(order) - 1, F.count("*").over(whole)
    rows = rows.withColumn("k", k).withColumn("n", n).withColumn("odd", (F.col("k") > 0) & (F.col("k") < F.col("n") - 1) & (F.col("text") != F.col(winner)))
    rows = rows.withColumn("any_odd", F.max("odd").over(whole))
    middle = ~F.col("any_odd") & (F.col("k") == F.floor(F.col("n") / 2))
    return rows.where((F.col("k") == 0) | (F.col("k") == F.col("n") - 1) | F.col("odd") | middle | (F.lit(False) if also is None else also)).drop("n", "odd", "any_odd")


def top_fraction(rows: DataFrame, score: str, share: float, total: int | None = None) -> DataFrame:
    """The first ``max(1, round(n * share))`` rows by falling score, ids breaking ties; ranks are made by ranges."""
    n = rows.count() if total is None else total
    down = rows.withColumn("__down", -F.col(score))
    return ranks.top_rows(down, ["__down", "id"], max(1, round(n * share))).select(*rows.columns)
