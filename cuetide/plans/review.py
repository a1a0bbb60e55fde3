"""Queries of review: flags, evidence texts, priorities, risks, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import review as scores
from ..functions import text
from ..operators import cues as cue_ops
from ..operators import review, windows
from ..sources import model, store
from .queries import _CUES, _OBS, _cues, _obs, query

_DIAG = """diag AS (SELECT conv_id || '-' || turn AS id, n % 11 = 0 AS source_order, n % 9 = 0 AS collision, n % 10 = 0 AS ambiguous, n % 5 = 0 AS growth, n % 7 = 0 AS sliding, n % 13 = 0 AS repetition
  FROM (SELECT *, conv_id * 3 + turn AS n FROM conversations) WHERE role = 'assistant')"""
_GROUPS = f"""{_CUES}, groups AS (SELECT source_id || '/' || (from_ / 6)::BIGINT AS id, min(start_time) AS start_time, max(end_time) AS end_time, list(id ORDER BY start_time, id) AS ids,
  bool_or((source_id + start_time::BIGINT) % 5 = 0) AS collision FROM (SELECT *, floor(start_time / 6) * 6 AS from_ FROM cues) GROUP BY source_id, from_)"""


def _diagnostics(spark, d):
    n = F.col("conv_id") * 3 + F.col("turn")
    flags = {"source_order": 11, "collision": 9, "ambiguous": 10, "growth": 5, "sliding": 7, "repetition": 13}
    return model.table(spark, d, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), *[(n % k == 0).alias(name) for name, k in flags.items()])


def _diagnosed(spark, d):
    return review.with_diagnostics(_cues(spark, d), _diagnostics(spark, d))


def _evidence(spark, d):
    """Cues of three turns each, their evidence the turns."""
    cues = _cues(spark, d).select("source_id", "id", "start_time", "end_time", F.col("layers")[0]["text"].alias("text"))
    part = F.floor(F.col("start_time") / 6)
    groups = cues.groupBy("source_id", part.alias("part")).agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.transform(F.sort_array(F.collect_list(F.struct("start_time", "id"))), lambda x: x["id"]).alias("ids"),
        F.bool_or((F.col("source_id") + F.col("start_time").cast("long")) % 5 == 0).alias("collision"),
    )
    groups = groups.select(F.concat_ws("/", "source_id", "part").alias("id"), "start_time", "end_time", "ids", "collision")
    return review.evidence(groups, cues)


@query(f"WITH {_CUES} SELECT source_id, id, start_time FROM cues WHERE review_state = 'pending'")
def flt3_eligible(spark, d):
    """FLT3 FLT4 ST5: cues that a cleaner may touch."""
    return cue_ops.eligible(_cues(spark, d)).select("source_id", "id", "start_time")


@query(f"WITH {_CUES}, {_DIAG} SELECT c.source_id, c.id, coalesce(NOT (source_order OR collision OR ambiguous OR growth OR sliding OR repetition), false) AS preserved FROM cues c LEFT JOIN diag USING (id)")
def flt7_preserved(spark, d):
    return _diagnosed(spark, d).select("source_id", "id", review.preserved().alias("preserved"))


@query(f"""WITH {_CUES}, {_DIAG}, k AS (SELECT c.source_id, c.id, source_order IS NOT NULL AS known, list_filter([CASE WHEN source_order THEN 'Source order issue' END, CASE WHEN collision THEN 'Timing collision' END,
  CASE WHEN ambiguous THEN 'Segmentation ambiguous' END, CASE WHEN growth THEN 'Rolling growth consolidated' END, CASE WHEN sliding THEN 'Sliding overlap consolidated' END, CASE WHEN repetition THEN 'Repetition collapsed' END], lambda x: x IS NOT NULL) AS labels
  FROM cues c LEFT JOIN diag USING (id))
SELECT source_id, id, CASE WHEN NOT known THEN NULL WHEN len(labels) = 0 THEN 'Preserved 1:1 — no reconstruction required' ELSE 'Normalization: ' || array_to_string(labels, ', ') END AS line FROM k""")
def prj6_kind_line(spark, d):
    return _diagnosed(spark, d).select("source_id", "id", review.kind_line().alias("line"))


@query(f"WITH {_CUES} SELECT source_id, id FROM cues WHERE NOT (review_state = 'rejected' AND role = 'user')")
def flt8_purge(spark, d):
    """FLT8: discarded cues go, of a selection only its own."""
    return review.purged(_cues(spark, d), F.col("layers")[0]["language"] == "user").select("source_id", "id")


@query(f"""WITH {_CUES}, p AS (SELECT *, CASE WHEN role = 'user' THEN 'high' ELSE 'none' END AS level FROM cues)
SELECT source_id, id, '[' || printf('%.2f', start_time) || 's] [' || level || '] [' || CASE review_state WHEN 'approved' THEN '✓ Approved' WHEN 'rejected' THEN '✕ Discarded' WHEN 'needs_review' THEN '⚠ Needs Review' ELSE '○ Pending' END || '] ' || role || ': ' || text AS item FROM p""")
def prj4_queue_item(spark, d):
    """PRJ4 PRJ5: a queue's line: time, level, badge and label."""
    level = F.when(F.col("layers")[0]["language"] == "user", "high").otherwise("none")
    item = review.queue_item(F.col("start_time"), level, F.col("review_state"), cue_ops.queue_label(F.col("layers")))
    return _cues(spark, d).select("source_id", "id", item.alias("item"))


@query(f"""WITH {_GROUPS}, p AS (SELECT g.id, g.start_time, g.end_time, g.ids, g.collision, c.id AS oid, c.start_time AS s, c.end_time AS e, c.text FROM (SELECT *, unnest(ids) AS x FROM groups) g JOIN cues c ON c.id = g.x)
SELECT id, string_agg(oid || '  ' || printf('%.3f', s) || 's–' || printf('%.3f', e) || 's  ' || text, chr(10) ORDER BY s, oid) AS stream,
  'Source observations ' || array_to_string(any_value(ids), ' + ') || chr(10) || '→ Reconstructed Cue ' || id AS explanation,
  string_agg('Source ' || oid || ': ' || printf('%.3f', s) || 's – ' || printf('%.3f', e) || 's', chr(10) ORDER BY s, oid) || chr(10) || 'Reconstructed ' || id || ': ' || printf('%.3f', any_value(start_time)) || 's – ' || printf('%.3f', any_value(end_time)) || 's'
    || CASE WHEN any_value(collision) THEN chr(10) || '⚠ Timing collision — flagged for review' ELSE '' END AS track
FROM p GROUP BY id""")
def prj7_evidence_texts(spark, d):
    """PRJ7 JN7: a cue's evidence, its lineage and its track of spans, in words."""
    rows = _evidence(spark, d)
    return rows.select("id", review.raw_stream(F.col("parts")).alias("stream"), review.explanation(F.col("ids"), F.col("id"), F.lit(None).cast("string")).alias("explanation"), review.collision_track(F.col("parts"), F.col("id"), F.col("start_time"), F.col("end_time"), F.col("collision")).alias("track"))


@query(f"""WITH {_GROUPS}, p AS (SELECT g.id, g.start_time AS a, g.end_time AS b, g.collision, c.start_time AS s, c.end_time AS e FROM (SELECT *, unnest(ids) AS x FROM groups) g JOIN cues c ON c.id = g.x)
SELECT id, 'source' AS role, s - a AS start, e - a AS "end", b - a AS duration FROM p
UNION ALL SELECT id, CASE WHEN collision THEN 'collision' ELSE 'reconstructed' END, 0.0, end_time - start_time, end_time - start_time FROM groups""")
def prj8_timeline(spark, d):
    return review.timeline(_evidence(spark, d))


@query(f"""WITH {_CUES}, c AS (SELECT *, start_time - 2 < 0 AS bad FROM cues) SELECT source_id, count(*) AS source_cues, count(*) FILTER (bad) AS warnings, count(*) FILTER (NOT bad AND review_state <> 'rejected') AS output_cues FROM c GROUP BY source_id""")
def prj9_profile(spark, d):
    """PRJ9: events read, warned of and put out, by source."""
    rows = _cues(spark, d).withColumns({"start_time": F.col("start_time") - 2, "end_time": F.col("end_time") - 2})
    bad = F.col("problem").isNotNull()
    return store.checked(rows).groupBy("source_id").agg(F.count("*").alias("source_cues"), F.count_if(bad).alias("warnings"), F.count_if(~bad & (F.col("review_state") != "rejected")).alias("output_cues"))


@query(f"""WITH {_CUES}, {_DIAG}, s AS (SELECT c.source_id, c.id, CASE WHEN coalesce(source_order OR collision OR ambiguous, false) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM cues c LEFT JOIN diag USING (id))
SELECT source_id, id, score, CASE WHEN score > 0 THEN 'high' ELSE 'none' END AS level FROM s""")
def qa2_rolling_priority(spark, d):
    """QA2 of rolling captions: only what stayed unsure asks for review."""
    score = scores.score(review.rolling_signals())
    return _diagnosed(spark, d).select("source_id", "id", score.alias("score"), scores.level(score).alias("level"))


@query(f"""WITH {_OBS}, g AS (SELECT source_id, avg(confidence) AS confidence, 3 - count(DISTINCT language) AS missing, count(*) FILTER (language IS NULL AND text <> '') AS ambiguous FROM obs GROUP BY source_id),
p AS (SELECT *, CASE WHEN confidence < 0.9 THEN least(1.0, (0.9 - confidence) / 0.9) ELSE 0.0 END AS low, CASE WHEN missing > 0 THEN 1.0 ELSE 0.0 END AS miss, CASE WHEN ambiguous > 0 THEN 1.0 ELSE 0.0 END AS amb FROM g)
SELECT source_id, round(least(1.0, coalesce(low, 0.0) + miss + amb), 9) AS score, CASE WHEN coalesce(low, 0) > 0 AND miss + amb > 0 THEN 'low_confidence_and_other_signal' WHEN coalesce(low, 0) > 0 THEN 'low_confidence_only' WHEN miss + amb > 0 THEN 'other_signal_only' ELSE 'no_signal' END AS class FROM p""")
def qa2_multilingual_priority(spark, d):
    """QA2 of several languages, AG20: missing and ambiguous languages and which evidence the priority had."""
    rows = _obs(spark, d).groupBy("source_id").agg(F.avg("confidence").alias("confidence"), (3 - F.count_distinct("language")).alias("missing"), F.count_if(F.col("language").isNull() & (F.col("text") != "")).alias("ambiguous"))
    parts = review.multilingual_signals(F.col("confidence"), F.col("missing"), F.col("ambiguous"))
    return rows.select("source_id", F.round(scores.score(parts), 9).alias("score"), review.failure_class(parts).alias("class"))


@query(f"""WITH {_CUES}, p AS (SELECT source_id, id, start_time, length(text) % 100 / 100 AS score FROM cues), n AS (SELECT *, lead(score) OVER w AS next_score, lead(id) OVER w AS next_id FROM p WINDOW w AS (PARTITION BY source_id ORDER BY start_time, id))
SELECT source_id, id, next_id, greatest(score, next_score) AS score FROM n WHERE next_id IS NOT NULL""")
def qa8_merged_priority(spark, d):
    """QA8: two cues that become one keep the higher priority."""
    rows = _cues(spark, d).select("source_id", "id", "start_time", (F.length(F.col("layers")[0]["text"]) % 100 / 100).alias("score"))
    after = F.lead(F.struct("id", "score")).over(windows.in_order())
    return rows.withColumn("b", after).where("b is not null").select("source_id", "id", F.col("b.id").alias("next_id"), F.greatest("score", "b.score").alias("score"))


@query(f"WITH {_CUES} SELECT source_id, max(end_time) AS duration, 0.0::DOUBLE AS start, max(end_time) AS \"end\", true AS whole FROM cues GROUP BY source_id")
def flt1_resolved(spark, d):
    """FLT1 VAL4: a source's range by default is the whole of it."""
    rows = _cues(spark, d).groupBy("source_id").agg(F.max("end_time").alias("duration"))
    none = F.lit(None).cast("double")
    start, end = review.processing_range(none, none, F.col("duration"))
    return rows.select("source_id", "duration", start.alias("start"), end.alias("end"), review.whole_media(none, none).alias("whole"))


@query("""WITH a AS (SELECT doc_id, ['dedupe_exact_lines', 'prune_transient_lines', 'merge_state_cluster', 'preserve_complementary_evidence_cluster', 'unheard_of'][n_chars % 5 + 1] AS action,
  CASE n_chars % 3 WHEN 0 THEN ['robust_similarity'] WHEN 1 THEN ['robust_similarity', 'fragment_or_line_coverage'] ELSE ['character_order_scramble'] END AS reasons, n_chars % 11 AS size, n_chars % 17 = 0 AS loses FROM documents),
r AS (SELECT CASE WHEN action = 'dedupe_exact_lines' THEN 'low' WHEN action = 'prune_transient_lines' THEN 'medium' WHEN action <> 'merge_state_cluster' THEN 'review' WHEN loses THEN 'review' WHEN reasons = ['robust_similarity'] AND size <= 4 THEN 'low'
  WHEN list_contains(reasons, 'character_order_scramble') THEN 'medium' WHEN NOT list_contains(reasons, 'character_order_scramble') AND size <= 8 THEN 'medium' ELSE 'review' END AS risk FROM a)
SELECT risk, count(*) AS n FROM r GROUP BY risk""")
def ag19_risk_report(spark, d):
    """AG19: the changes of a cleaner by the risk that they carry."""
    n = F.col("n_chars")
    action = F.element_at(F.array(*map(F.lit, ("dedupe_exact_lines", "prune_transient_lines", "merge_state_cluster", "preserve_complementary_evidence_cluster", "unheard_of"))), (n % 5 + 1).cast("int"))
    some = lambda *names: F.array(*map(F.lit, names))
    reasons = F.when(n % 3 == 0, some("robust_similarity")).when(n % 3 == 1, some("robust_similarity", "fragment_or_line_coverage")).otherwise(some("character_order_scramble"))
    rows = model.table(spark, d, "documents").select(review.risk(action, reasons, n % 11, n % 17 == 0).alias("risk"))
    return rows.groupBy("risk").agg(F.count("*").alias("n"))


@query(f"WITH {_OBS} SELECT trigger, count(*) AS n, round(avg(confidence), 4) AS mean, round(1000 * max(confidence), 2) AS most, '{{\"trigger\":\"' || trigger || '\",\"n\":' || count(*) || '}}' AS report FROM obs GROUP BY trigger")
def ag22_report(spark, d):
    """AG22: rounded facts of each kind of call, also as JSON."""
    rows = _obs(spark, d).groupBy("trigger").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean"), F.round(F.max("confidence") * 1000, 2).alias("most"))
    return rows.withColumn("report", F.to_json(F.struct("trigger", "n")))


@query(f"""WITH {_CUES} SELECT source_id, id, printf('%.3f', start_time) || 's  ' || CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS summary,
  'text: ' || text || chr(10) || 'language: ' || role || chr(10) || 'confidence: None' AS detail FROM cues""")
def prj10_detail(spark, d):
    """PRJ10: an observation as one line and as a list of its fields."""
    rows = _cues(spark, d).select("source_id", "id", "start_time", F.col("layers")[0]["text"].alias("text"), F.col("layers")[0]["language"].alias("language"), F.lit(None).cast("double").alias("confidence"))
    return rows.select("source_id", "id", review.summary(F.col("start_time"), F.col("text")).alias("summary"), review.detail(["text", "language", "confidence"]).alias("detail"))


@query(f"WITH {_CUES} SELECT source_id, id FROM cues")
def qa9_known(spark, d):
    """QA9: cues, after a check that ids asked for are known."""
    rows = _cues(spark, d)
    return review.required(rows, []).select("source_id", "id")


@query(f"""WITH {_CUES}, l AS (SELECT source_id || '/' || role AS id, 0 AS layer, unnest(string_split(text, chr(10))) AS line FROM cues UNION ALL SELECT source_id || '/' || role, 1, unnest(string_split(text, chr(10))) FROM cues WHERE review_state = 'pending')
SELECT id, trim(line) AS line FROM l WHERE trim(line) <> '' GROUP BY id, trim(line) HAVING count(DISTINCT layer) > 1""")
def f29_shared_lines(spark, d):
    """F29 F14: lines under more than one layer of a cue."""
    rows = _cues(spark, d).select(F.concat_ws("/", F.col("source_id"), F.col("layers")[0]["language"]).alias("id"), F.col("layers")[0]["text"].alias("text"), "review_state")
    every = rows.groupBy("id").agg(F.concat_ws("\n", F.collect_list("text")).alias("a"), F.concat_ws("\n", F.collect_list(F.when(F.col("review_state") == "pending", F.col("text")))).alias("b"))
    layer = lambda c: F.struct(F.lit(c).alias("language"), F.col(c).alias("text"))
    return review.shared_lines(every.select("id", F.array(layer("a"), layer("b")).alias("layers")))
