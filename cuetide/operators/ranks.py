"""Exact ranks and quantiles of groups of any size: no group, and no order, needs a task of its own.

Equal rows are counted first, map-side, so a value that half of a group has is one row. What is left is dealt over
range partitions of (group, order) and written; the totals of a group's partitions, a few short rows, give each
partition the ranks before it by a prefix sum, and a partition sums its own rows. The bounds of the ranges are
sampled, but any bounds give the same ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written


def ranked(rows: DataFrame, group: list[str], order: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """``group, order, n, before``: how often a row's order stands in its group, and how many rows of it come before.

    Nulls come first, as in an ascending sort. ``keep``: aggregates of equal rows to keep beside their number.
    """
    counted = rows.groupBy(*group, *order).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (keep or {}).items()])
    placed = written(counted.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id()), "ranked")
    totals = placed.groupBy(*group, "part").agg(F.sum("n").alias("all"))
    ahead = W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*group, "part", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("start"))
    inside = W.partitionBy(*group, "part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("l")
    same = F.col("l.part") == F.col("s.part")
    for g in group:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"s.{g}"))
    return local.join(starts.alias("s"), same).select("l.*", (F.col("local") + F.col("start")).alias("before")).drop("part", "local")


def quantiles(rows: DataFrame, group: list[str], value: str, wanted: dict[str, float], *, lower: bool = False) -> DataFrame:
    """``group`` with a column for each of ``wanted`` (name -> share): between the two nearest ranks, or ``lower`` the one below.

    Null values don't count; a group that has none but nulls gets nulls.
    """
    here = ranked(rows.where(F.col(value).isNotNull()), group, [value])
    sizes = rows.groupBy(*group).agg(F.count(value).alias("size"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}"))
    both = sizes.alias("s").join(here.alias("r"), same, "left")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))

    out = []
    for name, share in wanted.items():
        place = (F.col("size") - 1) * F.lit(share)
        low = F.floor(place)
        if lower:
            out.append(at(F.floor(place + 1e-9)).alias(name))  # a product just below a whole rank is that rank
        else:
            # linear between neighbours
            part = F.max(place - low)
            out.append((at(low) + (at(F.ceil(place)) - at(low)) * part).alias(name))
    return both.groupBy(*[F.col(f"s.{g}").alias(g) for g in group]).agg(*out)


def top_rows(rows: DataFrame, order: list[str], most: int, group: list[str] | None = None) -> DataFrame:
    """The first ``most`` rows (of each group) by ``order``, which must tell all rows apart."""
    keep = {c: F.first(c) for c in rows.columns if c not in [*order, *(group or [])]}
    return ranked(rows, group or [], order, keep).where(F.col("before") < most).drop("n", "before")
