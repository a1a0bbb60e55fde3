"""Split captions with a garbled piece between, machine tokens and extra lines, in columns where they can be."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, lines
from .likeness import Likeness
from .windows import in_order

GAP, MICRO, TOKEN = 0.10, 0.50, 0.20


def edge_corrupted(fragment: Column, caption: Column) -> Column:
    """Without its first or its last character, the shorter compact text starts or ends the caption's."""
    a, b = compact(fragment), compact(caption)
    fits = lambda part: b.startswith(part) | b.endswith(part)
    n = F.length(a)
    return (n >= 2) & (n < F.length(b)) & (fits(F.substring(a, F.lit(2), n - 1)) | fits(F.substring(a, F.lit(1), n - 1)))


def machine_token(text: Column, seconds: Column) -> Column:
    """A very short reading of one line with letters and digits mixed."""
    c = compact(text)
    return (seconds <= TOKEN) & F.length(c).between(2, 4) & c.rlike(r"\p{L}") & c.rlike(r"\p{Nd}") & (F.size(lines(text)) == 1)


def collapse_bursts(cues: DataFrame, key: str = "source_id") -> DataFrame:
    """``caption, garble, caption`` becomes the caption over both spans, in need of review, and the garble.

    ``id, start_time, end_time, text, review_state, origins`` (places in the source, ascending). Bursts share no cue: of
    overlapping ones every second is taken, counted from the first of their chain.
    """
    order = in_order(key)
    b, c = (F.lead(F.struct(*cues.columns), k).over(order) for k in (1, 2))
    rows = cues.withColumn("b", b).withColumn("c", c)
    first = F.coalesce(F.size("origins") > 0, F.lit(False)) & (F.size("b.origins") == 1) & (F.size("c.origins") > 0)
    chain = F.concat("origins", "b.origins", "c.origins")
    follows = chain == F.sequence(F.element_at(chain, 1), F.element_at(chain, 1) + F.size(chain) - 1)
    gap = lambda x, y: (y - x).between(0.0, GAP)
    pending = F.forall(F.array("review_state", "b.review_state", "c.review_state"), lambda s: s == "pending")
    same = (F.col("text") == F.col("c.text")) & (F.col("text") != F.col("b.text"))
    near = gap(F.col("end_time"), F.col("b.start_time")) & gap(F.col("b.end_time"), F.col("c.start_time")) & (F.col("b.end_time") - F.col("b.start_time") <= MICRO)
    held = F.lit(True)
    if "layers" in cues.columns:  # the three rest on observations of their own
        ids = [F.flatten(F.transform(F.col(p + "layers"), lambda x: x["observation_ids"])) for p in ("", "b.", "c.")]
        held = F.forall(F.array(*map(F.size, ids)), lambda n: n > 0) & (F.size(F.array_distinct(F.concat(*ids))) == F.size(F.array_distinct(ids[0])) + F.size(F.array_distinct(ids[1])) + F.size(F.array_distinct(ids[2])))
    rows = rows.withColumn("likely", F.coalesce(first & same & pending & near & follows & held, F.lit(False)))
    # ahead of the windows, as it holds a function in Arrow batches, which get texts only where it matters
    rows = rows.withColumn("garbled", edge_corrupted(F.when(F.col("likely"), F.col("b.text")), F.when(F.col("likely"), F.col("text"))))
    burst = F.coalesce(F.col("likely") & F.col("garbled"), F.lit(False))
    # a burst two cues after one shares its last cue; one cue after can't be, for texts alternate
    rows = rows.withColumn("burst", burst).withColumn("k", F.row_number().over(order))
    before = F.lag("burst", 2).over(order)
    opens = F.when(F.col("burst") & ~F.coalesce(before, F.lit(False)), F.col("k"))
    rows = rows.withColumn("since", F.last(opens, ignorenulls=True).over(order))
    rows = rows.withColumn("burst", F.col("burst") & ((F.col("k") - F.col("since")) % 4 == 0))
    rows = rows.withColumn("gone", F.coalesce(F.lag("burst", 2).over(order), F.lit(False)))
    take = lambda name, merged: F.when(F.col("burst"), merged).otherwise(F.col(name)).alias(name)
    made = {"end_time": F.greatest("end_time", "c.end_time"), "review_state": F.lit("needs_review"), "origins": F.array_union("origins", "c.origins")}
    if "layers" in cues.columns:
        made["layers"] = F.zip_with("layers", "c.layers", lambda x, y: x.withField("observation_ids", F.array_union(x["observation_ids"], y["observation_ids"])))
    return rows.where(~F.col("gone")).select(*[take(x, made[x]) if x in made else x for x in cues.columns])


def without_short_extras(text: str, like: Likeness | None = None) -> str:
    """Drops short Latin lines unlike any long Latin line, where a cue has a long Latin and a long CJK line."""
    like = like or Likeness()
    rows = like.lines(text)
    latin = [x for x in rows if x.latin and not x.han]
    long = [x for x in latin if len(x.compact) >= 12]
    if len(rows) < 3 or not long or not any(x.han and len(x.compact) >= 6 for x in rows):
        return text
    extra = {x for x in latin if len(x.compact) <= 10 and not any(like.reaches(x.compact, y.compact, 0.70) for y in long)}
    return "\n".join(x.shown for x in rows if x not in extra) if 0 < len(extra) < len(rows) else text


def pruned_extras(cues: DataFrame, column: str = "text") -> DataFrame:
    """``cues`` with short Latin extra lines dropped from ``column``."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        like = Likeness()
        return pd.Series([None if x is None else without_short_extras(x, like) for x in rows])

    return cues.withColumn(column, run(column))
