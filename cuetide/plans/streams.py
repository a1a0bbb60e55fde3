"""Queries of streams and of frames as bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import model
from ..sources.shared import folder
from ..streaming import frame_gate, ordered
from . import evidence, queries
from .queries import query


def _frames(spark, d):
    """Readings as flat grey frames, brighter by value; every fifth minute another shape."""
    t = model.table(spark, d, "events")
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(1e6)
    wide = F.floor(at / 60) % 5 == 0
    level = F.floor(F.col("value") / 4).cast("int") % 128 * 2  # even, so that no score meets a bound
    return t.select(F.col("user_id").alias("source_id"), at.alias("start_time"), F.col("event_id").alias("id"), F.when(wide, 4).otherwise(8).alias("height"), F.when(wide, 16).otherwise(8).alias("width"), F.unhex(F.repeat(F.lpad(F.hex(level), 2, "0"), 64)).alias("pixels"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS source_id, event_id AS id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t, (floor(value / 4)::INT % 128 * 2) / 255.0::DOUBLE AS g FROM events),
k AS (SELECT *, floor(t / 60) % 5 = 0 AS wide, row_number() OVER (PARTITION BY source_id ORDER BY t, id) AS k FROM e),
f AS (SELECT source_id, k, id, t, g AS base, wide, t AS read_at, g AS last, NULL::DOUBLE AS since, 0 AS steady, 'first_frame' AS decision, NULL::DOUBLE AS difference, NULL::DOUBLE AS structural FROM k WHERE k = 1
  UNION ALL SELECT source_id, k, id, t, CASE WHEN reshaped OR periodic OR settled THEN g ELSE base END, now_wide, CASE WHEN reshaped OR periodic OR settled AND form >= 0.012 THEN t ELSE read_at END, g,
    CASE WHEN opens THEN t WHEN since IS NOT NULL AND NOT reshaped AND NOT back AND NOT settled THEN since END, CASE WHEN opens THEN calm::INT WHEN since IS NOT NULL AND NOT reshaped AND NOT back AND NOT settled THEN steady2 ELSE 0 END,
    CASE WHEN reshaped THEN 'change_detected' WHEN periodic THEN 'periodic_confirmation' WHEN back THEN 'reverted_to_baseline' WHEN settled AND form >= 0.012 THEN 'change_detected' WHEN settled THEN 'below_structural_threshold' END,
    CASE WHEN NOT reshaped AND (periodic OR back OR settled) THEN change END, CASE WHEN reshaped THEN NULL WHEN periodic THEN 0.0 WHEN settled THEN form END
  FROM (SELECT *, NOT reshaped AND since IS NULL AND change <= 0.02 AND t - read_at >= 2 AS periodic, NOT reshaped AND since IS NULL AND change > 0.02 AS opens, NOT reshaped AND since IS NOT NULL AND change <= 0.02 AS back,
      NOT reshaped AND since IS NOT NULL AND change > 0.02 AND (steady2 >= 1 AND t - since >= 0.033 - 1e-4 OR t - since >= 0.35) AS settled, CASE WHEN change >= 0.2 THEN change ELSE 0.0 END AS form FROM
    (SELECT *, CASE WHEN calm THEN steady + 1 ELSE 0 END AS steady2 FROM (SELECT k.source_id, k.k, k.id, k.t, k.g, k.wide AS now_wide, f.wide <> k.wide AS reshaped, f.base, f.read_at, f.since, f.steady, abs(k.g - f.base) AS change, abs(k.g - f.last) <= 0.015 AS calm FROM f JOIN k ON k.source_id = f.source_id AND k.k = f.k + 1))))
SELECT source_id, t AS start_time, id, decision, round(difference, 6) AS difference, round(structural, 6) AS structural FROM f WHERE decision IS NOT NULL""")
def sm1_frame_gate(spark, d):
    """SM1 SM9 IM1: frames to read by two scores and by shape, with candidates that were refused, and why."""
    return frame_gate.decisions(_frames(spark, d)).withColumns({c: F.round(c, 6) for c in ("difference", "structural")})


@query(queries.oracle_sql()["wn9_visual_states"])
def sm4_stream_states(spark, d):
    """SM4 WN9 WN23: the visual states of a stream, started anew for each of its three parts on one checkpoint.

    Signatures come out of order, up to 20 seconds late and over the edges of parts; the last part ends every source.
    """
    base = folder(spark, "states")
    rows = model.table(spark, d, "embeddings").select(F.col("label").alias("source_id"), F.col("vec_id").cast("double").alias("start_time"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x > 0).alias("signature"), F.lit(False).alias("ended"))
    high = rows.agg(F.max("id")).first()[0]
    if high is None:
        return evidence.wn9_visual_states(spark, d)
    late = F.col("id") + F.col("id") * 7 % 20
    part = F.least(F.floor(late * 3 / (high + 1)), F.lit(2))
    ends = rows.select("source_id").distinct().select("source_id", F.lit(float(high)).alias("start_time"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<boolean>").alias("signature"), F.lit(True).alias("ended"))
    rows.withColumn("part", part).unionAll(ends.withColumn("part", F.lit(2).cast("long"))).write.partitionBy("part").parquet(f"{base}/all")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    with ordered.state_store(spark):
        for k in range(3):
            spark.read.schema(kinds).parquet(f"{base}/all/part={k}").write.parquet(f"{base}/in/part={k}")
            stream = ordered.stream_states(spark.readStream.schema(kinds).parquet(f"{base}/in/part=*"), 0.4, "25 seconds")
            stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
