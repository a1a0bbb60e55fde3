"""Mixing sources to target weights.

Every document gets a hash-random key from its id and text; within its source the documents stand in
the order of their keys. Keys are uniform, so equal ranges of the key space are the range partitions of
that sort: totals of (source, range) are summed map-side, and a prefix sum over the 4096 ranges of
a source finds the one in which its budget ends. If that holds more than ``RANGE_ROWS`` rows, its own
4096 ranges are summed next, and so on. What lies before the last such range is taken whole, what lies
after it isn't; only its few documents are sorted, and a prefix sum among them makes the cut exact: whole
epochs first, then documents in key order up to the budget, the last of them in part. No other
row is shuffled, however hot its source.

A source never goes beyond ``max_epochs`` times its size; what it can't use is dealt to the
others by weight until nothing is above its bound (water filling, in closed form over one row a source).

Edge cases: null text: size 0, never taken; a null source is a source of its own, last;
a null document id has a key like any other; rows that repeat an id have keys of their own unless their texts
are equal too, and such rows stand for one another (only if a cut falls among them, one task holds them all);
an empty table gives an empty mix; all sizes 0: all targets 0; columns of other names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

#: Hexadecimal digits of the key that number the ranges of a source, and of the range that a cut falls in.
DIGITS = 3
#: A cut's range is narrowed until it holds at most so many rows, or its rows share a key.
RANGE_ROWS = 100_000
#: The table of cuts, one row a source, is broadcast up to so many rows.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 3) -> DataFrame:
    """``source, source_size`` with each source's ``weight`` and ``target``.

    One row per source; sources stand in code point order, null last, and weights repeat.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight)
    bound = F.col("source_size") * F.lit(max_epochs)
    by_bound = W.orderBy((bound / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("all_size", F.sum("source_size").over(W.partitionBy()))
    rows = rows.withColumn("share", (F.col("all_size") - F.coalesce(F.sum(bound).over(before), F.lit(0))) / F.sum("weight").over(by_bound.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("full", F.col("share") * F.col("weight") >= bound)
    # full sources form a prefix of that order; the first one that isn't full sets the level of the rest
    level = F.min(F.when(~F.col("full"), F.struct((bound / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("share").alias("level")))).over(W.partitionBy())
    target = F.when(F.col("full"), bound.cast("double")).otherwise(level["level"] * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def _cuts(bins: DataFrame, aims: DataFrame) -> DataFrame:
    """``aims`` with the range ``at`` in which what is ``left`` ends, what is left at its start, and its rows ``n``."""
    by_bin = W.partitionBy("none", "source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    before = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(by_bin), F.lit(0)))
    ends = before.join(aims, ["none", "source"]).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("bin_size")))
    ends = ends.select("none", "source", F.concat("at", "bin").alias("new_at"), (F.col("left") - F.col("before")).alias("new_left"), F.col("rows").alias("new_n"))
    found = aims.join(ends, ["none", "source"], "left")
    return found.select("none", "source", "source_size", "target", "epochs", F.coalesce("new_at", "at").alias("at"), F.coalesce("new_left", "left").alias("left"), F.coalesce("new_n", "n").alias("n"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 3, seed: str = "mix", range_rows: int = RANGE_ROWS, broadcast_sources: int = BROADCAST_SOURCES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_rows: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken``; with ``keep_rows`` also ``row``, the input row.

    ``taken`` counts the words the mix takes from the document, repeats counted.
    """
    held = [F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")] if keep_rows else []
    text = F.col(text_col).cast("string")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("source"), key.alias("key"), *held)

    def totals(some: DataFrame, depth: int) -> DataFrame:
        sized = some.select("none", "source", F.substring("key", depth + 1, DIGITS).alias("bin"), words(F.col("text")).alias("size"))
        return written(sized.groupBy("none", "source", "bin").agg(F.sum("size").alias("bin_size"), F.count("*").alias("rows")), "mixing-ranges")

    bins = totals(rows, 0)
    aims = bins.groupBy("none", "source").agg(F.sum("bin_size").alias("source_size"))
    aims = targets(aims.select(F.when(~F.col("none"), F.col("source")).alias("source"), "source_size"), weights, max_epochs)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), "source_size", "target", epochs.alias("epochs"), F.lit("").alias("at"), (budget - epochs * F.col("source_size")).alias("left"), F.lit(None).cast("long").alias("n"))
    cuts, depth = written(_cuts(bins, aims), "mixing-cuts"), DIGITS
    n_sources, most = cuts.agg(F.count("*"), F.max("n")).first()
    side = F.broadcast if n_sources <= broadcast_sources else lambda x: x
    starts = F.substring(F.col("key"), F.lit(1), F.length("at"))
    while most and most > range_rows and depth + DIGITS <= 30:
        wide = cuts.where((F.col("n") > range_rows) & (F.length("at") == depth)).select("none", "source", "at")
        some = rows.join(side(wide), ["none", "source"]).where(starts == F.col("at")).drop("at")
        cuts, depth = written(_cuts(totals(some, depth), cuts), "mixing-cuts"), depth + DIGITS
        most = cuts.where(F.length("at") == depth).agg(F.max("n")).first()[0]

    placed = rows.join(side(cuts.drop("n")), ["none", "source"])
    cut_here = (F.col("at") != "") & (starts == F.col("at"))
    size = words(F.col("text")).alias("size")
    extra = F.when((F.col("at") != "") & (starts < F.col("at")), F.col("size")).otherwise(F.lit(0))
    kept = ["doc_id", "size", "source_size", "target", "epochs"] + ["row"] * keep_rows
    whole = placed.where(~cut_here).select("*", size).select(*kept, extra.alias("extra"))
    inside = W.partitionBy("none", "source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    near = placed.where(cut_here).select("*", size).drop("text")
    near = near.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    near = near.select(*kept, F.least(F.greatest(F.col("left") - F.col("before"), F.lit(0)), F.col("size")).alias("extra"))
    taken = F.least(F.col("epochs") * F.col("size") + F.col("extra"), F.col("size") * max_epochs).cast("long")
    return whole.unionAll(near).select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(["row"] if keep_rows else []))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each part ends where a word ends
    return F.array_join(F.slice(parts, 1, F.greatest(n.cast("int"), F.lit(0))), "")
