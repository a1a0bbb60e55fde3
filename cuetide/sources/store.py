"""Evidence and cue tables as Parquet folders, partitioned by source, and the changes made to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, *by: str) -> None:
    """Adds rows; sources are spread so that each makes few files."""
    rows.repartition(*by).write.mode("append").partitionBy(*by).parquet(path)


def replace_sources(rows: DataFrame, path: str, key: str = "source_id") -> None:
    """Replaces whole sources that ``rows`` holds; other sources stay."""
    rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def without_sources(rows: DataFrame, gone: DataFrame, key: str = "source_id") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def of_sources(rows: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """The observations of listed sources by time; no source listed: none."""
    return rows.join(sources.select(key), key, "left_semi").orderBy("start_time", "id")


def with_state(cues: DataFrame, chosen: Column, state: str) -> DataFrame:
    return cues.withColumn("review_state", F.when(chosen, state).otherwise(F.col("review_state")))


def with_layer_text(cues: DataFrame, chosen: Column, language: str, text: str) -> DataFrame:
    """Chosen cues' layer of ``language`` says ``text`` and the cue needs review; a chosen cue without it is an error."""
    has = F.exists("layers", lambda x: x["language"] == language)
    lacks = F.raise_error(F.concat(F.lit(f"no layer of {language} in cue "), F.col("id").cast("string")))
    edited = F.transform("layers", lambda x: F.when(x["language"] == language, x.withField("text", F.lit(text))).otherwise(x))
    kind = cues.schema["layers"].dataType
    layers = F.when(~chosen, F.col("layers")).when(has, edited).otherwise(lacks.cast(kind))
    return cues.withColumns({"layers": layers, "review_state": F.when(chosen, "needs_review").otherwise(F.col("review_state"))})


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` put in the place of those with their key."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    k = F.row_number().over(W.partitionBy(key).orderBy(F.col("_turn").desc()))
    return both.withColumn("_k", k).where("_k = 1").drop("_k", "_turn")


def layer_rows(cues: DataFrame) -> DataFrame:
    return cues.select("source_id", F.col("id").alias("cue_id"), F.posexplode("layers").alias("position", "layer")).select("source_id", "cue_id", "position", "layer.*")


def checked(cues: DataFrame) -> DataFrame:
    """With ``problem``: why a cue is not valid, or null."""
    problem = F.when(F.coalesce(F.col("start_time"), F.lit(-1.0)) < 0, "negative start").when(~F.coalesce(F.col("end_time") > F.col("start_time"), F.lit(False)), "empty span").when(F.size("layers") == 0, "no layer")
    return cues.withColumn("problem", problem)


SEPARATOR = "\x1f"
#: Fixed values of the identity evidence's contract.
IDENTITY_VERSION, CONTRACT, ROLE, PAYLOAD = "caption-identity-v1", "caption_identity_contract", "caption_identity_role", "caption_identity_payload"
_BLOCK = "struct<text:string,bounds:array<double>,region_ids:array<string>>"
IDENTITY_SCHEMA = (
    "version string, envelope struct<id:string,observed_start:double,observed_end:double,representative_pts:double,observations:array<struct<index:int,pts:double,frame_reference:string>>>, "
    f"probes array<struct<observation_index:int,pts:double,reason:string,raw_region_ids:array<string>,blocks:array<{_BLOCK}>,alternatives:array<{_BLOCK}>,selected_text:string,partition_ambiguous:boolean>>, "
    "identities array<struct<selected_text:string,support_pts:array<double>,alternatives:array<string>>>, boundary_brackets array<array<double>>, unqueried_intervals array<array<double>>, "
    "all_observations_probed boolean, correspondence_ambiguous boolean, selection_ambiguous boolean, stop_reason string, probe_budget int, selection_rationale string, coordinate_space string"
)


def encoded_detail(detail: Column) -> Column:
    """A map as ``k=v`` parts."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(detail)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), SEPARATOR)


def decoded_detail(raw: Column) -> Column:
    """Parts are cut at their first ``=``; an empty text is an empty map."""
    parts = F.filter(F.split(raw, SEPARATOR), lambda p: p != "")
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("value"))))


def encoded_geometry(points: Column) -> Column:
    """``x,y`` parts; null stays null, no points are an empty text."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"], p["y"])), SEPARATOR)


def decoded_geometry(raw: Column) -> Column:
    parts = F.filter(F.split(raw, SEPARATOR), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, ",", 1).cast("double").alias("x"), F.substring_index(p, ",", -1).cast("double").alias("y")))


def member_ids(detail: Column, own: Column) -> Column:
    """The observations that a combined one stands for; else its own id."""
    held = F.try_element_at(detail, F.lit("member_observation_ids"))
    return F.coalesce(F.split(held, SEPARATOR), F.array(own))


def entity(rows: DataFrame) -> DataFrame:
    """Stored columns as an observation: ``roi`` is a whole box or null, ``detail`` a map, ``geometry`` points."""
    roi = F.when(F.col("roi_x").isNotNull(), F.struct(F.col("roi_x").alias("x"), F.col("roi_y").alias("y"), F.col("roi_width").alias("width"), F.col("roi_height").alias("height")))
    made = rows.withColumns({"roi": roi, "detail": decoded_detail(F.col("detail")), "geometry": decoded_geometry(F.col("geometry"))})
    return made.drop("roi_x", "roi_y", "roi_width", "roi_height")


def with_layers(cues: DataFrame, layers: DataFrame) -> DataFrame:
    """``cues`` with their layers (``cue_id, position, language, text``) in order of position."""
    held = layers.groupBy(F.col("cue_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("position", "language", "text"))).alias("layers"))
    joined = cues.join(held, "id", "left")
    empty = F.array().cast("array<struct<language:string,text:string>>")
    return joined.withColumn("layers", F.coalesce(F.transform("layers", lambda x: F.struct(x["language"].alias("language"), x["text"].alias("text"))), empty))


def track_groups(rows: DataFrame, key: str, language: str, position: str) -> DataFrame:
    """``id, languages`` of each group, languages in order of position, groups by id."""
    out = rows.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(F.struct(position, language))).alias("held"))
    return out.select("id", F.transform("held", lambda x: x[language]).alias("languages")).orderBy("id")


MANIFEST = "entries array<struct<id:string,video_path:string,segment_start_seconds:double,segment_end_seconds:double,languages:array<string>,visibility:string,ground_truth_cues:array<struct<start_time:double,end_time:double,text:string,language:string>>,notes:string>>"


def manifest(docs: DataFrame, column: str = "doc") -> DataFrame:
    """The entries of JSON manifests; a missing field, an empty segment or an id that occurs twice is an error."""
    rows = docs.select(F.explode(F.from_json(column, MANIFEST, {"mode": "FAILFAST"})["entries"]).alias("e")).select("e.*")
    lacks = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in ("id", "video_path", "segment_start_seconds", "segment_end_seconds", "languages", "visibility", "ground_truth_cues")])
    wrong = F.when(lacks != "", F.concat(F.lit("manifest entry lacks "), lacks)).when(F.col("segment_end_seconds") <= F.col("segment_start_seconds"), F.concat(F.lit("empty segment in entry "), "id"))
    twice = F.when(F.count("*").over(W.partitionBy("id")) > 1, F.concat(F.lit("duplicate entry id "), "id"))
    return rows.withColumn("wrong", F.coalesce(wrong, twice)).withColumn("id", F.when(F.col("wrong").isNull(), F.col("id")).otherwise(F.raise_error("wrong").cast("string"))).drop("wrong")


def identity_evidence(detail: Column) -> Column:
    """The evidence document in an observation's detail: null without a contract or for raw probes; another version is an error."""
    version = F.try_element_at(detail, F.lit(CONTRACT))
    stated = F.from_json(F.try_element_at(detail, F.lit(PAYLOAD)), IDENTITY_SCHEMA, {"mode": "FAILFAST"})
    unknown = F.raise_error(F.concat(F.lit("unsupported caption identity version "), version))
    kind = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _schema(IDENTITY_SCHEMA)) + ">"
    known = F.when(F.try_element_at(detail, F.lit(ROLE)) == "envelope", stated)
    return F.when(version.isNull(), F.lit(None).cast(kind)).when(version != IDENTITY_VERSION, unknown.cast(kind)).otherwise(known)


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def migrated(spark, path: str, migrations: list) -> DataFrame:
    """The table at ``path`` after every migration (a function of the table, the first of None) that it has not had.

    Each version is a folder of its own and complete once its marker is there, so a broken one is made again and
    none is ever half applied; a version beyond the known ones is refused.
    """
    done = [v for v in range(1, len(migrations) + 2) if _exists(spark, f"{path}/v{v}/_SUCCESS")]
    if done and done[-1] > len(migrations):
        raise ValueError("the table is newer than the known migrations")
    now = spark.read.parquet(f"{path}/v{done[-1]}") if done else None
    for version in range(done[-1] + 1 if done else 1, len(migrations) + 1):
        made = migrations[version - 1](spark if now is None else now)
        made.write.mode("overwrite").parquet(f"{path}/v{version}")
        now = spark.read.schema(made.schema).parquet(f"{path}/v{version}")
    return now


def _exists(spark, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def save_run(rows: DataFrame, path: str, run: int) -> None:
    """Keeps ``rows`` as what holds after ``run``; earlier runs stay beside it."""
    rows.write.mode("overwrite").parquet(f"{path}/run-{run:08d}")


def _runs(spark, path: str) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    return sorted(r for r in found if r.startswith("run-") and _exists(spark, f"{path}/{r}/_SUCCESS"))


def latest_run(spark, path: str) -> DataFrame | None:
    """What holds now: the rows of the last whole run, or None."""
    runs = _runs(spark, path)
    return spark.read.parquet(f"{path}/{runs[-1]}") if runs else None


def discard_latest_run(spark, path: str) -> DataFrame | None:
    """Back to what held before the last run."""
    if runs := _runs(spark, path):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{runs[-1]}")
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return latest_run(spark, path)
