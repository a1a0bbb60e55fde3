"""Queries over regions of frames: lines, neighbours, proposals, coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions
from ..sources import model
from .queries import _OBS, _obs, query

#: Boxes of a supplier's frames (probes: orders), from the items' numbers.
_BOXES = """boxes AS (SELECT l_suppkey AS source_id, l_orderkey AS probe, l_orderkey * 10 + l_linenumber AS id, l_linenumber * 0.12::DOUBLE AS y0, l_linenumber * 0.12::DOUBLE + 0.02 + l_tax::DOUBLE AS y1,
  l_discount::DOUBLE AS x0, l_discount::DOUBLE + 0.05 + l_quantity::DOUBLE / 60 AS x1 FROM lineitem)"""


def _boxes(spark, d):
    y0, x0 = F.col("l_linenumber") * F.lit(0.12), F.col("l_discount").cast("double")
    return model.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("probe"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        y0.alias("y0"), (y0 + 0.02 + F.col("l_tax").cast("double")).alias("y1"), x0.alias("x0"), (x0 + 0.05 + F.col("l_quantity").cast("double") / 60).alias("x1"),
    )


@query(f"""WITH RECURSIVE {_BOXES}, k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY y0, x0, x1, y1) AS k FROM boxes),
f AS (SELECT probe, k, 1 AS line, y0, y1 FROM k WHERE k = 1
  UNION ALL SELECT k.probe, k.k, CASE WHEN j THEN line ELSE line + 1 END, CASE WHEN j THEN least(a, k.y0) ELSE k.y0 END, CASE WHEN j THEN greatest(b, k.y1) ELSE k.y1 END
  FROM (SELECT f.probe, f.k, f.line, f.y0 AS a, f.y1 AS b, k.y0, k.y1, k.k AS nk, least(f.y1, k.y1) - greatest(f.y0, k.y0) > 0 AND (least(f.y1, k.y1) - greatest(f.y0, k.y0)) / least(f.y1 - f.y0, k.y1 - k.y0) >= 0.3 AS j FROM f JOIN k ON k.probe = f.probe AND k.k = f.k + 1) s JOIN k ON k.probe = s.probe AND k.k = s.nk)
SELECT probe, max(line)::INT AS n, round(max(y1), 6) AS bottom FROM f GROUP BY probe""")
def im8_lines(spark, d):
    """IM8 F23 F24 SO8: boxes of a frame as text lines."""
    boxes = _boxes(spark, d).groupBy("probe").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes")).withColumn("lines", regions.lines(F.col("boxes")))
    return boxes.select("probe", F.size("lines").alias("n"), F.round(F.array_max(F.transform("lines", lambda x: x["y1"])), 6).alias("bottom"))


@query(f"""WITH {_BOXES}, p AS (SELECT a.probe, a.id AS a, b.id AS b, greatest(a.y0, b.y0) - least(a.y1, b.y1) AS gap FROM boxes a JOIN boxes b ON a.probe = b.probe AND a.id <> b.id AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) <= greatest(a.y0, b.y0)),
k AS (SELECT *, rank() OVER (PARTITION BY probe, a ORDER BY gap) AS k FROM p) SELECT probe AS frame, a, b, round(gap, 6) AS gap FROM k WHERE k = 1""")
def jn11_neighbours(spark, d):
    """JN11: the regions next above or below each region."""
    return regions.neighbours(_boxes(spark, d), "probe").withColumn("gap", F.round("gap", 6))


@query(f"""WITH {_BOXES}, m AS (SELECT a.probe, a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.probe = b.probe AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1 + 0.06) > greatest(a.y0, b.y0 + 0.06)),
c AS (SELECT *, count(*) OVER (PARTITION BY probe, a) AS na, count(*) OVER (PARTITION BY probe, b) AS nb FROM m) SELECT probe AS frame, a, b FROM c WHERE na = 1 AND nb = 1""")
def jn12_correspondence(spark, d):
    """JN12: regions that meet exactly one of a shifted reference frame, and it them."""
    rows = _boxes(spark, d)
    return regions.correspondence(rows, rows.withColumns({"y0": F.col("y0") + 0.06, "y1": F.col("y1") + 0.06}), "probe")


@query(f"""WITH {_BOXES}, n AS (SELECT source_id, count(DISTINCT probe) AS probes FROM boxes GROUP BY source_id), h AS (SELECT *, floor((y0 + y1) / 2 / 0.05)::INT AS band FROM boxes),
s AS (SELECT source_id, band, count(DISTINCT probe) AS seen, quantile_cont(x1 - x0, 0.5) AS width FROM h GROUP BY ALL),
k AS (SELECT s.* FROM s JOIN n USING (source_id) WHERE seen >= 0.5 * probes AND width >= 0.15 AND (band + 0.5) * 0.05 > 0.5),
u AS (SELECT source_id, count(*) AS boxes_used, min(y0) AS top, max(y1) AS bottom, quantile_cont(y1 - y0, 0.5) AS height FROM h JOIN k USING (source_id, band) GROUP BY source_id)
SELECT source_id, probes, coalesce(boxes_used, 0) AS boxes_used, round(greatest(0.0, top - 0.25 * height), 6) AS y0, round(least(1.0, bottom + 0.25 * height), 6) AS y1 FROM n LEFT JOIN u USING (source_id)""".replace("greatest(0.0, top - 0.25 * height)", "CASE WHEN top IS NULL THEN 0.0 ELSE greatest(0.0, top - 0.25 * height) END").replace("least(1.0, bottom + 0.25 * height)", "CASE WHEN top IS NULL THEN 1.0 ELSE least(1.0, bottom + 0.25 * height) END"))
def ag16_proposed_roi(spark, d):
    """AG16: where captions stand; without a band that counts, the whole height."""
    return regions.propose_roi(_boxes(spark, d), "source_id", "probe").withColumns({"y0": F.round("y0", 6), "y1": F.round("y1", 6)})


@query(f"""WITH {_BOXES}, e AS (SELECT source_id, probe, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY ALL)
SELECT source_id, count(*) AS states, count(*) FILTER (x0 >= -1e-6 AND y0 >= 0.3 - 1e-6 AND x1 <= 0.9 + 1e-6 AND y1 <= 1 + 1e-6) AS contained FROM e GROUP BY source_id""")
def ag17_contained(spark, d):
    """AG17: how many states' envelopes a region holds."""
    rows = regions.envelopes(_boxes(spark, d), ["source_id", "probe"])
    inside = regions.contains(tuple(map(F.lit, (0.0, 0.3, 0.9, 1.0))), tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    return rows.groupBy("source_id").agg(F.count("*").alias("states"), F.count_if(inside).alias("contained"))


def _half_even(v: str) -> str:
    """The SQL of ``regions.half_even`` to four decimals: DuckDB's own rounding multiplies first, so it errs near ties."""
    high, whole = f"(({v}) * 134217729.0 - (({v}) * 134217729.0 - ({v})))", f"floor(({v}) * 10000.0)"
    over = f"(({high} * 20000.0 - (2.0 * {whole} + 1.0)) + (({v}) - {high}) * 20000.0)"
    return f"(({whole} + CASE WHEN {over} > 0 OR ({over} = 0 AND {whole} % 2 = 1) THEN 1.0 ELSE 0.0 END) / 10000.0)"


@query(f"""WITH v AS (SELECT p_partkey AS id, 640.0::DOUBLE AS ww, 400.0::DOUBLE AS wh, p_size * 20.0::DOUBLE AS vw, 480.0::DOUBLE AS vh, p_partkey % 640 * 1.0::DOUBLE AS ax, p_partkey % 400 * 1.0::DOUBLE AS ay, 600.0::DOUBLE AS bx, p_size * 8.0::DOUBLE AS b_y FROM part),
r AS (SELECT *, CASE WHEN ww / wh > vw / vh THEN wh * (vw / vh) ELSE ww END AS w, CASE WHEN ww / wh > vw / vh THEN wh ELSE ww / (vw / vh) END AS h FROM v), o AS (SELECT *, (ww - w) / 2 AS x, (wh - h) / 2 AS y FROM r),
c AS (SELECT *, greatest(x, least(x + w, least(ax, bx))) AS x0, greatest(x, least(x + w, greatest(ax, bx))) AS x1, greatest(y, least(y + h, least(ay, b_y))) AS y0, greatest(y, least(y + h, greatest(ay, b_y))) AS y1 FROM o),
q AS (SELECT *, ((x0 - x) / w)::DOUBLE AS sx, ((y0 - y) / h)::DOUBLE AS sy, ((x1 - x0) / w)::DOUBLE AS sw, ((y1 - y0) / h)::DOUBLE AS sh FROM c)
SELECT id, {_half_even('sx')} AS roi_x, {_half_even('sy')} AS roi_y, {_half_even('sw')} AS roi_width, {_half_even('sh')} AS roi_height, round(x + {_half_even('sx')} * w, 1) AS pixel_x, round(greatest(0.0, ax / 10 - 0.05), 6) AS look_from, round(ax / 10 + 0.05, 6) AS look_to FROM q""".replace("134217729.0", "134217729.0::DOUBLE").replace("10000.0", "10000.0::DOUBLE").replace("20000.0", "20000.0::DOUBLE").replace("(2.0 *", "(2.0::DOUBLE *").replace("+ 1.0)", "+ 1.0::DOUBLE)"))
def prj2_roi(spark, d):
    """PRJ2 PRJ3: dragged points as a region of a letter-boxed video; the span of time around a position."""
    t = model.table(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    rect = regions.frame_rect(F.lit(640.0), F.lit(400.0), size * 20.0, F.lit(480.0))
    ax, ay = (key % 640).cast("double"), (key % 400).cast("double")
    roi = regions.to_roi(ax, ay, F.lit(600.0), size * 8.0, rect)
    start, end = regions.lookup_range(ax / 10)
    return t.select(key.alias("id"), *[c.alias(f"roi_{name}") for name, c in roi.items()], F.round(regions.to_pixels(roi, rect)["x"], 1).alias("pixel_x"), F.round(start, 6).alias("look_from"), F.round(end, 6).alias("look_to"))


@query()
def so4_reading_order(spark, d):
    """SO4: boxes of a frame in reading order, those of about one height from the left."""
    rows = _boxes(spark, d).groupBy("probe").agg(F.sort_array(F.collect_list(F.struct("id", (F.col("x0") * 1000).alias("x"), (F.col("y0") * 100).alias("y")))).alias("boxes"))
    places = regions.reading_places(F.transform("boxes", lambda b: F.array(b["x"], b["y"])))
    return rows.withColumn("places", places).select("probe", F.transform("places", lambda k: F.get("boxes", k)["id"]).alias("ids"))


@query(f"WITH {_OBS} SELECT source_id, id, round((0.299 * (id % 256) + 0.587 * (source_id % 256) + 0.114 * (id % 100)) / 255, 9) AS luminance FROM obs")
def im17_luminance(spark, d):
    """IM17: the brightness of red, green and blue."""
    from ..operators.images import luminance_column

    return _obs(spark, d).select("source_id", "id", F.round(luminance_column(F.col("id") % 256, F.col("source_id") % 256, F.col("id") % 100), 9).alias("luminance"))
