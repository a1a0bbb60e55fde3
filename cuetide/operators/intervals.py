"""Joins on intervals, points and nearest values, within a key.

Intervals are cut into bins of ``width``; equal key and bin make an equi-join, which shuffles
and spills like any other, and a residual condition keeps what truly meets. A pair that
shares several bins is kept in the first common one only, so nothing is made distinct afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bins' width by default; spans much longer than it make many rows, so callers with such spans choose their own.
WIDTH = 60.0


def _bins(rows: DataFrame, prefix: str, width: float) -> DataFrame:
    first, last = (F.floor(F.col(f"{prefix}{end}_time") / width) for end in ("start", "end"))
    return rows.withColumn(f"{prefix}first", first).withColumn("bin", F.explode(F.sequence(first, last)))


def _named(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    return rows.select(F.col(key).alias("join_key"), *[F.col(c).alias(prefix + c) for c in rows.columns])


def binned(spans: DataFrame, key: str = "source_id", width: float = WIDTH) -> DataFrame:
    """``spans`` with ``join_key`` and a row for each ``bin``, columns prefixed with ``s_``."""
    return _bins(_named(spans, key, "s_"), "s_", width).drop("s_first")


def overlap_join(a: DataFrame, b: DataFrame, *, key: str = "source_id", width: float = WIDTH) -> DataFrame:
    """Pairs that overlap, half-open: columns of ``a`` as ``a_*``, of ``b`` as ``b_*``."""
    left, right = _bins(_named(a, key, "a_"), "a_", width), _bins(_named(b, key, "b_"), "b_", width)
    pairs = left.join(right, ["join_key", "bin"]).where((F.col("a_start_time") < F.col("b_end_time")) & (F.col("a_end_time") > F.col("b_start_time")))
    return pairs.where(F.col("bin") == F.greatest("a_first", "b_first")).drop("join_key", "bin", "a_first", "b_first")


def overlapping(a: DataFrame, b: DataFrame, *, id_col: str, key: str = "source_id", width: float = WIDTH, anti: bool = False) -> DataFrame:
    """Rows of ``a`` that overlap some row of ``b``, or with ``anti`` none."""
    left, right = _bins(_named(a.select(key, id_col, "start_time", "end_time"), key, "a_"), "a_", width), _bins(_named(b.select(key, "start_time", "end_time"), key, "b_"), "b_", width)
    meets = (left["join_key"] == right["join_key"]) & (left["bin"] == right["bin"]) & (F.col("a_start_time") < F.col("b_end_time")) & (F.col("a_end_time") > F.col("b_start_time"))
    hit = left.join(right, meets, "left_semi").select(F.col(f"a_{key}").alias(key), F.col(f"a_{id_col}").alias(id_col)).distinct()
    return a.join(hit, [key, id_col], "left_anti" if anti else "left_semi")


def best_overlap(a: DataFrame, b: DataFrame, *, a_id: str, b_id: str, key: str = "source_id", width: float = WIDTH) -> DataFrame:
    """For each row of ``a`` the row of ``b`` that overlaps it most; ties: the earliest, then the smallest id."""
    pairs = overlap_join(a, b, key=key, width=width)
    much = F.least("a_end_time", "b_end_time") - F.greatest("a_start_time", "b_start_time")
    order = W.partitionBy(f"a_{a_id}").orderBy(much.desc(), "b_start_time", f"b_{b_id}")
    return pairs.withColumn("overlap", much).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def covering(points: DataFrame, spans: DataFrame, *, point_id: str, span_id: str, at: str = "at", key: str = "source_id", width: float = WIDTH) -> DataFrame:
    """For each point the first span that covers it, both ends included; points without one drop out."""
    left = _named(points, key, "p_").withColumn("bin", F.floor(F.col(f"p_{at}") / width))
    right = _bins(_named(spans, key, "s_"), "s_", width)
    pairs = left.join(right, ["join_key", "bin"]).where(F.col(f"p_{at}").between(F.col("s_start_time"), F.col("s_end_time")))
    # a point lies in one bin, where the join has its pairs already: the window moves none of them
    order = W.partitionBy("join_key", "bin", f"p_{point_id}").orderBy("s_start_time", "s_end_time", f"s_{span_id}")
    return pairs.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k", "bin", "join_key", "s_first")


def told(points: DataFrame, spans: DataFrame, found: dict[str, Column], *, point_id: str, at: str = "at", key: str = "source_id", width: float = WIDTH) -> DataFrame:
    """Every point as ``key, point_id`` with aggregates over the spans that cover it, both ends included (columns ``s_*``).

    One join and no shuffle after it, as a point lies in one bin; repeated points stay as many.
    """
    left = points.select(F.col(key).alias("join_key"), F.col(point_id), F.col(at).alias("p_at"), F.floor(F.col(at) / width).alias("bin"), F.monotonically_increasing_id().alias("row"))
    right = binned(spans, key, width)
    meets = (left["join_key"] == right["join_key"]) & (left["bin"] == right["bin"]) & left["p_at"].between(right["s_start_time"], right["s_end_time"])
    rows = left.join(right.drop(f"s_{key}"), meets, "left").groupBy(left["join_key"], left["bin"], "row", point_id)
    return rows.agg(*[c.alias(name) for name, c in found.items()]).withColumnRenamed("join_key", key).drop("bin", "row")


def count_meeting(a: DataFrame, b: DataFrame, *, key: str = "source_id", id_col: str, width: float = WIDTH) -> DataFrame:
    """``n``: how many rows of ``a`` overlap some row of ``b``.

    A row of one bin counts where it is met; only the ids of rows in several bins are shuffled once more, as each
    must count once.
    """
    alone = F.floor(F.col("start_time") / width) == F.floor(F.col("end_time") / width)
    few = a.select(key, "start_time", "end_time", F.when(~alone, F.col(id_col)).alias("id"), (~alone).alias("many"))
    left, right = _bins(_named(few, key, "a_"), "a_", width), _bins(_named(b.select(key, "start_time", "end_time"), key, "b_"), "b_", width)
    meets = (left["join_key"] == right["join_key"]) & (left["bin"] == right["bin"]) & (F.col("a_start_time") < F.col("b_end_time")) & (F.col("a_end_time") > F.col("b_start_time"))
    hit = left.join(right, meets, "left_semi").groupBy("join_key", "bin", "a_many", "a_id").agg(F.count("*").alias("n"))
    # a row met in several bins is in each of them as often as it repeats
    hit = hit.groupBy("a_many", F.when(F.col("a_many"), F.col("join_key")).alias("of"), "a_id").agg(F.when(F.col("a_many"), F.max("n")).otherwise(F.sum("n")).alias("n"))
    return hit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def reached(spans: DataFrame, points: DataFrame, *, span_id: str, at: str = "at", tolerance: float = 0.0, key: str = "source_id", width: float = WIDTH) -> DataFrame:
    """``span_id, n``: how many points lie in each span widened by ``tolerance``, ends included; none: 0."""
    wide = spans.select(key, span_id, (F.col("start_time") - tolerance).alias("start_time"), (F.col("end_time") + tolerance).alias("end_time"))
    left = _bins(_named(wide, key, "s_"), "s_", width)
    right = points.select(F.col(key).alias("join_key"), F.col(at).alias("p_at"), F.floor(F.col(at) / width).alias("bin"))
    # a point lies in one bin only, so no pair is met twice
    met = left.join(right, ["join_key", "bin"]).where(F.col("p_at").between(F.col("s_start_time"), F.col("s_end_time")))
    counts = met.groupBy(F.col(f"s_{span_id}").alias(span_id)).agg(F.count("*").alias("n"))
    return spans.select(span_id).join(counts, span_id, "left").select(span_id, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def nearest(points: DataFrame, others: DataFrame, *, at: str = "at", value: str = "value", key: str = "source_id") -> DataFrame:
    """Each point with the nearest other row of its key, before or after; ties: the earlier one.

    One sort of both sides by time instead of a join.
    """
    side = points.select(F.col(key), F.col(at).alias("t"), F.lit(None).cast(others.schema[value].dataType).alias("v"), F.struct(*points.columns).alias("p"))
    both = side.unionByName(others.select(F.col(key), F.col(at).alias("t"), F.col(value).alias("v")), allowMissingColumns=True)
    known = F.when(F.col("p").isNull(), F.struct(F.col("t").alias("t"), F.col("v").alias("v")))
    order = W.partitionBy(key).orderBy("t", F.col("p").isNotNull(), "v")
    back = F.last(known, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    # of several rows after the point at the same time the first counts
    ahead = F.first(known, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    out = both.withColumn("back", back).withColumn("ahead", ahead).where(F.col("p").isNotNull())
    closer = F.when(F.col("ahead").isNull() | (F.col("t") - F.col("back.t") <= F.col("ahead.t") - F.col("t")), F.col("back")).otherwise(F.col("ahead"))
    return out.select("p.*", closer["t"].alias("nearest_at"), closer["v"].alias("nearest_value"))
