"""Text regions of frames: boxes, lines, neighbours, regions of interest, coordinates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Least vertical overlap of one line's boxes, lines kept, bands, persistence, width and margin of a proposal.
LINE_OVERLAP, MAX_LINES = 0.3, 4
BAND, PERSISTENCE, WIDTH, MARGIN = 0.05, 0.5, 0.15, 0.25
SAME_ROW = 10.0


def bounds(points: Column) -> Column:
    """``x0, y0, x1, y1`` of an array of ``x, y``; no points: null."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when(F.size(points) > 0, box)


def vertically_overlapping(a: Column, b: Column, least: float = LINE_OVERLAP) -> Column:
    """The common height is ``least`` or more of the lower box's."""
    common = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    height = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return (common > 0) & (height > 0) & (common / height >= least)


def intersects(a: Column, b: Column) -> Column:
    return (F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])) & (F.least(a["y1"], b["y1"]) > F.greatest(a["y0"], b["y0"]))


def lines(boxes: Column) -> Column:
    """Boxes as text lines from top to bottom: each joins the last line if it overlaps that enough."""
    plain = F.transform(boxes, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b["x1"].alias("x1"), b["y1"].alias("y1")))
    ordered = F.sort_array(plain)

    start = F.slice(ordered, 1, 1)

    def step(found, box):
        last = F.element_at(found, -1)
        joined = F.struct(F.least(last["y0"], box["y0"]).alias("y0"), F.least(last["x0"], box["x0"]).alias("x0"), F.greatest(last["x1"], box["x1"]).alias("x1"), F.greatest(last["y1"], box["y1"]).alias("y1"))
        grown = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(joined))
        return F.when(vertically_overlapping(last, box), grown).otherwise(F.concat(found, F.array(box)))

    return F.when(F.size(boxes) == 0, start).otherwise(F.aggregate(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), start, step))


def neighbours(regions: DataFrame, frame: str, *, id_col: str = "id") -> DataFrame:
    """``frame, a, b, gap``: the nearest regions above or below each (columns ``x0, y0, x1, y1``), ties kept.

    Their widths overlap, their heights don't. A frame holds few regions, so pairs within it are few.
    """
    side = lambda p: regions.select(F.col(frame).alias("frame"), F.col(id_col).alias(p), F.struct("x0", "y0", "x1", "y1").alias(p + "_box"))
    pairs = side("a").join(side("b"), "frame").where("a != b")
    a, b = F.col("a_box"), F.col("b_box")
    pairs = pairs.where((F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])) & (F.least(a["y1"], b["y1"]) <= F.greatest(a["y0"], b["y0"])))
    pairs = pairs.withColumn("gap", F.greatest(a["y0"], b["y0"]) - F.least(a["y1"], b["y1"]))
    return pairs.withColumn("k", F.rank().over(W.partitionBy("frame", "a").orderBy("gap"))).where("k = 1").select("frame", "a", "b", "gap")


def correspondence(regions: DataFrame, reference: DataFrame, frame: str, *, id_col: str = "id") -> DataFrame:
    """``frame, a, b``: each region and the reference's region of its frame, where both meet no other."""
    side = lambda rows, p: rows.select(F.col(frame).alias("frame"), F.col(id_col).alias(p), F.struct("x0", "y0", "x1", "y1").alias(p + "_box"))
    met = side(regions, "a").join(side(reference, "b"), "frame").where(intersects(F.col("a_box"), F.col("b_box")))
    alone = lambda c: F.count("*").over(W.partitionBy("frame", c)) == 1
    return met.withColumn("one", alone("a") & alone("b")).where("one").select("frame", "a", "b")


def propose_roi(boxes: DataFrame, key: str, probe: str) -> DataFrame:
    """``key, probes, boxes_used, y0, y1``: where captions stand, from ``x0, y0, x1, y1`` in shares of the frame.

    Bands of a twentieth count if enough probes have a box there and it is wide enough; those in the lower half
    give the region, with a margin of a quarter of a line.
    """
    n = boxes.groupBy(key).agg(F.count_distinct(probe).alias("probes"))
    held = boxes.withColumn("band", F.floor((F.col("y0") + F.col("y1")) / 2 / BAND).cast("int"))
    stats = held.groupBy(key, "band").agg(F.count_distinct(probe).alias("seen"), F.percentile(F.col("x1") - F.col("x0"), F.lit(0.5)).alias("width"))
    kept = stats.join(n, key).where((F.col("seen") >= PERSISTENCE * F.col("probes")) & (F.col("width") >= WIDTH) & ((F.col("band") + 0.5) * BAND > 0.5))
    used = held.join(kept.select(key, "band"), [key, "band"]).groupBy(key).agg(F.count("*").alias("boxes_used"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)).alias("height"))
    out = n.join(used, key, "left")
    return out.select(key, "probes", F.coalesce("boxes_used", F.lit(0)).cast("long").alias("boxes_used"), F.greatest(F.lit(0.0), F.col("top") - MARGIN * F.col("height")).alias("y0"), F.least(F.lit(1.0), F.col("bottom") + MARGIN * F.col("height")).alias("y1"))


def envelopes(boxes: DataFrame, by: list[str]) -> DataFrame:
    return boxes.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def contains(roi: tuple[Column, Column, Column, Column], box: tuple[Column, Column, Column, Column], tolerance: float = 1e-6) -> Column:
    (a, b, c, e), (x0, y0, x1, y1) = roi, box
    return (x0 >= a - tolerance) & (y0 >= b - tolerance) & (x1 <= c + tolerance) & (y1 <= e + tolerance)


def frame_rect(widget_w: Column, widget_h: Column, video_w: Column, video_h: Column) -> dict[str, Column]:
    """Where a video stands inside a widget that keeps its aspect: ``x, y, w, h``."""
    usable = (widget_w > 0) & (widget_h > 0) & (video_w > 0) & (video_h > 0)
    wide = widget_w / widget_h > video_w / video_h
    w = F.when(wide, widget_h * (video_w / video_h)).otherwise(widget_w)
    h = F.when(wide, widget_h).otherwise(widget_w / (video_w / video_h))
    zero = F.lit(0.0)
    pick = lambda good, bad: F.when(usable, good).otherwise(bad)
    return {"x": pick((widget_w - w) / 2, zero), "y": pick((widget_h - h) / 2, zero), "w": pick(w, F.greatest(zero, widget_w)), "h": pick(h, F.greatest(zero, widget_h))}


def half_even(value: Column, places: int = 4) -> Column:
    """``value`` (0 or more) to ``places`` decimals by its exact binary value, ties to even; doubles all the way.

    A product with a power of ten is inexact, so near a tie the sign of the exact remainder decides: the value is
    split into halves of 26 bits, whose products with a small integer are exact.
    """
    scale = 10.0**places

    def rounded(v: Column) -> Column:
        high = v * 134217729.0 - (v * 134217729.0 - v)  # 2^27 + 1
        whole = F.floor(v * scale).cast("double")
        over = (high * (2 * scale) - (whole * 2.0 + 1.0)) + (v - high) * (2 * scale)  # twice the distance from the tie
        up = (over > 0) | (over == 0) & (whole % 2 == 1)
        return (whole + F.when(up, 1.0).otherwise(0.0)) / scale

    return F.transform(F.array(value), rounded)[0]  # the value is named once, however long its expression


def to_roi(ax: Column, ay: Column, bx: Column, by: Column, rect: dict[str, Column]) -> dict[str, Column]:
    """Two dragged points as a region in shares of the frame, clamped to it; an empty frame: the whole."""
    clamp = lambda v, start, size: F.greatest(start, F.least(start + size, v))
    x0, x1 = (clamp(f(ax, bx), rect["x"], rect["w"]) for f in (F.least, F.greatest))
    y0, y1 = (clamp(f(ay, by), rect["y"], rect["h"]) for f in (F.least, F.greatest))
    empty = (rect["w"] <= 0) | (rect["h"] <= 0)
    share = lambda v, size, whole: F.when(empty, F.lit(whole)).otherwise(half_even(v / size))
    return {"x": share(x0 - rect["x"], rect["w"], 0.0), "y": share(y0 - rect["y"], rect["h"], 0.0), "width": share(x1 - x0, rect["w"], 1.0), "height": share(y1 - y0, rect["h"], 1.0)}


def to_pixels(roi: dict[str, Column], rect: dict[str, Column]) -> dict[str, Column]:
    return {"x": rect["x"] + roi["x"] * rect["w"], "y": rect["y"] + roi["y"] * rect["h"], "width": roi["width"] * rect["w"], "height": roi["height"] * rect["h"]}


def lookup_range(position: Column, tolerance: float = 0.05) -> tuple[Column, Column]:
    """The span of time in which the frame at a playback position is looked for."""
    return F.greatest(F.lit(0.0), position - tolerance), position + tolerance


def reading_order(boxes: list[list[float]]) -> list[int]:
    """Places of polygons (their first points ``x, y``) as read: by height, then from the left within ``SAME_ROW`` pixels.

    Each box moves left past higher-standing neighbours of about its height; the relation is not transitive, so
    no sort can express it.
    """
    order = sorted(range(len(boxes)), key=lambda k: (boxes[k][1], boxes[k][0]))
    for end in range(1, len(order)):
        at = end
        while at and abs(boxes[order[at]][1] - boxes[order[at - 1]][1]) < SAME_ROW and boxes[order[at]][0] < boxes[order[at - 1]][0]:
            order[at - 1 : at + 1] = order[at], order[at - 1]
            at -= 1
    return order


def reading_places(firsts: Column) -> Column:
    """:func:`reading_order` of an array of first points, each an array of ``x, y``."""

    @F.pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else reading_order([list(p) for p in x]) for x in rows])

    return run(firsts)
