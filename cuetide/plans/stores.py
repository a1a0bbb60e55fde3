"""Queries of sources and stores: files, lookups, layers, codecs, manifests, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import captions, model, store
from .queries import _CUES, _OBS, _cues, _obs, query


@query(f"""WITH {_CUES}, k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_time, end_time, id) - 1 AS k FROM cues WHERE review_state <> 'rejected')
SELECT source_id, k::INT AS source_index, source_id || '.srt:' || k AS id, start_time, end_time, trim(regexp_replace(text, '</?[A-Za-z][^>]*>|\\{{[^}}]*\\}}', '', 'g'), ' ' || chr(10) || chr(9)) AS text FROM k""")
def src1_captions(spark, d):
    """SRC1 SRC2 SNK1: cues written as SRT files and parsed again."""
    files = captions.caption_files(_cues(spark, d)).select("source_id", F.concat("source_id", F.lit(".srt")).alias("name"), "body")
    good, _ = captions.parsed(files)
    return good


@query(f"WITH {_CUES} SELECT source_id, count(*) AS cues, min(start_time) AS start_time, max(end_time) AS end_time FROM cues WHERE review_state <> 'rejected' GROUP BY source_id")
def src1_webvtt(spark, d):
    """SRC1 SNK1: the same by way of WebVTT."""
    files = captions.caption_files(_cues(spark, d), "vtt").select("source_id", F.concat("source_id", F.lit(".vtt")).alias("name"), "body")
    good, _ = captions.parsed(files)
    return good.groupBy("source_id").agg(F.count("*").alias("cues"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


@query()
def src3_reconstructed(spark, d):
    """SRC3: caption files to whole cues with what was done to them."""
    files = captions.caption_files(_cues(spark, d)).select("source_id", F.concat("source_id", F.lit(".srt")).alias("name"), "body")
    return captions.reconstructed(files)[0]


@query(f"WITH {_OBS} SELECT source_id, id, text FROM obs WHERE id = 7")
def src6_get(spark, d):
    """SRC6: one observation by its id."""
    return _obs(spark, d).where(F.col("id") == 7).select("source_id", "id", "text")


@query(f"WITH {_CUES} SELECT source_id, id, start_time, end_time, role || '=' || text || '|note=' || review_state AS layers FROM cues")
def src9_cues_with_layers(spark, d):
    """SRC9 SO1: cues with their layers in order of position."""
    rows = _cues(spark, d)
    layers = store.layer_rows(rows).select("cue_id", "position", "language", "text").unionAll(rows.select("id", F.lit(1), F.lit("note"), "review_state"))
    out = store.with_layers(rows.select("source_id", "id", "start_time", "end_time"), layers)
    return out.select("source_id", "id", "start_time", "end_time", F.array_join(F.transform("layers", lambda x: F.concat(x["language"], F.lit("="), x["text"])), "|").alias("layers"))


@query("SELECT r_name AS id, string_agg(n_name, ',' ORDER BY n_nationkey) AS languages FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def src10_track_groups(spark, d):
    """SRC10: groups with their languages in order."""
    rows = model.table(spark, d, "nation").join(model.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return store.track_groups(rows, "r_name", "n_name", "n_nationkey").select("id", F.array_join("languages", ",").alias("languages"))


@query(f"WITH {_CUES} SELECT source_id::VARCHAR AS id, 0.0::DOUBLE AS segment_start_seconds, max(end_time) AS segment_end_seconds, count(*) AS n FROM cues GROUP BY source_id")
def src11_manifest(spark, d):
    """SRC11: entries of JSON manifests, checked."""
    cue = F.struct("start_time", "end_time", F.col("layers")[0]["text"].alias("text"), F.col("layers")[0]["language"].alias("language"))
    entry = _cues(spark, d).groupBy("source_id").agg(F.collect_list(cue).alias("ground_truth_cues"), F.max("end_time").alias("segment_end_seconds"))
    entry = entry.select(F.to_json(F.struct(F.array(F.struct(F.col("source_id").cast("string").alias("id"), F.lit("v.mp4").alias("video_path"), F.lit(0.0).alias("segment_start_seconds"), "segment_end_seconds", F.array(F.lit("en")).alias("languages"), F.lit("public").alias("visibility"), "ground_truth_cues")).alias("entries"))).alias("doc"))
    return store.manifest(entry).select("id", "segment_start_seconds", "segment_end_seconds", F.size("ground_truth_cues").cast("long").alias("n"))


@query("SELECT page_id, lower(replace(url, '\\', '/')) AS source_id FROM pages")
def src12_source_key(spark, d):
    return model.table(spark, d, "pages").select("page_id", captions.source_key(F.col("url")).alias("source_id"))


@query(f"WITH {_OBS} SELECT source_id, id, 'caption-identity-v1' AS version, start_time, text FROM obs WHERE trigger = 'first_frame'")
def src13_identity(spark, d):
    """SRC13 SNK12: identity documents written as JSON and read again; raw probes have none."""
    rows = _obs(spark, d)
    frame = F.struct(F.lit(0).alias("index"), F.col("start_time").alias("pts"), F.lit("f").alias("frame_reference"))
    envelope = F.struct(F.col("id").cast("string").alias("id"), F.col("start_time").alias("observed_start"), F.col("start_time").alias("observed_end"), F.col("start_time").alias("representative_pts"), F.array(frame).alias("observations"))
    payload = F.to_json(F.struct(F.lit(store.IDENTITY_VERSION).alias("version"), envelope.alias("envelope"), F.col("text").alias("stop_reason")))
    role = F.when(F.col("trigger") == "first_frame", "envelope").otherwise("probe")
    detail = F.create_map(F.lit(store.CONTRACT), F.lit(store.IDENTITY_VERSION), F.lit(store.ROLE), role, F.lit(store.PAYLOAD), payload)
    found = rows.select("source_id", "id", store.identity_evidence(detail).alias("e")).where("e is not null")
    return found.select("source_id", "id", "e.version", F.col("e.envelope.observed_start").alias("start_time"), F.col("e.stop_reason").alias("text"))


@query(f"""WITH {_OBS} SELECT source_id, id, 'language=' || coalesce(language, '-') || chr(31) || 'state_trigger=' || trigger AS raw, trigger, CASE WHEN confidence IS NULL THEN NULL ELSE 1 END::INT AS points, id || '' AS members FROM obs""")
def f26_codecs(spark, d):
    """F25 F26 VAL2 WN22: stored details and points, and back."""
    detail = F.create_map(F.lit("state_trigger"), F.col("trigger"), F.lit("language"), F.coalesce("language", F.lit("-")))
    points = F.when(F.col("confidence").isNotNull(), F.array(F.struct(F.col("confidence").alias("x"), F.col("start_time").alias("y"))))
    rows = _obs(spark, d).withColumns({"raw": store.encoded_detail(detail), "shape": store.encoded_geometry(points)})
    held = store.entity(rows.select("source_id", "id", "raw", F.col("raw").alias("detail"), F.col("shape").alias("geometry"), *[F.lit(None).cast("double").alias(f"roi_{c}") for c in ("x", "y", "width", "height")]))
    members = store.member_ids(F.col("detail"), F.col("id").cast("string"))
    return held.select("source_id", "id", "raw", F.element_at("detail", "state_trigger").alias("trigger"), F.when(F.col("geometry").isNotNull(), F.size("geometry")).alias("points"), F.array_join(members, ",").alias("members"))
