"""The evidence and cue tables that the operators work on, from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSTANT = 0.001
STATES = ("pending", "approved", "rejected", "needs_review")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(events: DataFrame) -> DataFrame:
    """Readings of instants: ``source_id, id, start_time, end_time, text, confidence, trigger, language``.

    A blank reading has an empty text; a missing confidence or language is null.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(1e6)
    return events.select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("id"), start.alias("start_time"), (start + INSTANT).alias("end_time"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("text"),
        F.when(k % 7 != 0, F.least(F.col("value") / 500, F.lit(1.0))).alias("confidence"),
        F.element_at(F.array(F.lit("first_frame"), F.lit("change_detected"), F.lit("periodic_confirmation")), k % 3 + 1).alias("trigger"),
        F.when(k % 4 != 0, F.element_at(F.array(F.lit("en"), F.lit("zh"), F.lit("ja")), k % 4)).alias("language"),
    )


def cues(conversations: DataFrame) -> DataFrame:
    """Cues of one layer: ``source_id, id, start_time, end_time, review_state, layers``."""
    n = F.col("conv_id") + F.col("turn")
    start = F.col("turn").cast("double") * 2
    layer = F.struct(F.col("role").alias("language"), F.col("text").alias("text"))
    return conversations.select(
        F.col("conv_id").alias("source_id"), F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("id"), start.alias("start_time"), (start + F.when(n % 2 == 0, 2.5).otherwise(1.5)).alias("end_time"),
        F.element_at(F.array(*map(F.lit, STATES)), (n % 4 + 1).cast("int")).alias("review_state"), F.array(layer).alias("layers"),
    )


def spans(orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth spans of orders and predicted spans of their items, in days, keyed by customer.

    An item has no key of its own in the table; order, line, part, supplier and day make one.
    """
    day = lambda c: F.datediff(c, F.lit("1992-01-01").cast("date")).cast("double")
    truth = orders.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("truth_id"), day("o_orderdate").alias("start_time"), (day("o_orderdate") + 30).alias("end_time"))
    items = lineitem.join(orders.select("o_orderkey", "o_custkey"), lineitem["l_orderkey"] == F.col("o_orderkey"))
    found = items.select(F.col("o_custkey").alias("source_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))).alias("found_id"), day("l_shipdate").alias("start_time"), (day("l_shipdate") + 7).alias("end_time"))
    return truth, found
