"""Queries over evidence: frames, fuzzy scores, stored tables, reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import bursts, evaluation, frames, fuzzy, intervals, layers, ranks, windows
from ..sources import captions, model, store
from .queries import _CUES, _OBS, _SPANS, _cues, _obs, _spans, query

_REGIONS = """regions AS (SELECT conv_id AS source_id, conv_id || '-' || turn AS id, conv_id || '/' || turn // 3 AS frame, turn AS seq, text,
  CASE WHEN turn % 5 <> 0 THEN (turn * 7 % 4)::DOUBLE END AS top, CASE WHEN turn % 5 <> 0 THEN (turn * 7 % 4)::DOUBLE + 1.5 END AS bottom, (turn % 2)::DOUBLE AS left_, turn / 100 AS confidence FROM conversations)"""
_PAIRS = """pairs AS (SELECT vec_id, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)"""


def _regions(spark, d):
    t = model.table(spark, d, "conversations")
    top = F.when(F.col("turn") % 5 != 0, (F.col("turn") * 7 % 4).cast("double"))
    return t.select(
        F.col("conv_id").alias("source_id"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat_ws("/", F.col("conv_id"), F.floor(F.col("turn") / 3)).alias("frame"), F.col("turn").alias("seq"), "text",
        top.alias("top"), (top + 1.5).alias("bottom"), (F.col("turn") % 2).cast("double").alias("left"), (F.col("turn") / 100).alias("confidence"),
    )


@query(f"""WITH {_REGIONS}, o AS (SELECT *, lag(top) OVER w AS top0, lag(bottom) OVER w AS bottom0, row_number() OVER w AS k FROM regions WINDOW w AS (PARTITION BY source_id, frame ORDER BY coalesce(top, 0), coalesce(left_, 0), seq)),
p AS (SELECT *, CASE WHEN k > 1 AND top IS NOT NULL AND top0 IS NOT NULL AND least(bottom, bottom0) - greatest(top, top0) <= 0 THEN chr(10) ELSE '' END || text AS piece FROM o)
SELECT source_id, frame, 'combined-' || first(id ORDER BY k) AS id, string_agg(piece, '' ORDER BY k) AS text, round(avg(confidence), 9) AS confidence, string_agg(id, ' ' ORDER BY k) AS members FROM p GROUP BY source_id, frame""")
def ag5_same_frame(spark, d):
    """AG5 SO3 F24: regions of one frame in reading order as one reading."""
    found = frames.same_frame(_regions(spark, d))
    return found.select("source_id", "frame", "id", "text", F.round("confidence", 9).alias("confidence"), F.array_join("member_ids", " ").alias("members"))


@query(f"""WITH {_PAIRS} SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / len(a), 6) AS difference,
  round(len(list_filter(list_zip(a, b), lambda p: (p[1] > 0) <> (p[2] > 0))) / len(a), 9) AS distance, len(list_filter(a, lambda x: x > 0)) / len(a) < 0.5 AS blank FROM pairs WHERE b IS NOT NULL""")
def im1_frame_difference(spark, d):
    """IM1 IM4 FLT12: a frame against the one before it, by value and by cell."""
    rows = model.table(spark, d, "embeddings")
    rows = rows.withColumn("b", F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))).where("b is not null")
    cells = lambda c: F.transform(c, lambda x: x > 0)
    return rows.select("vec_id", F.round(frames.frame_difference(F.col("embedding"), F.col("b")), 6).alias("difference"), F.round(frames.signature_distance(cells("embedding"), cells("b")), 9).alias("distance"), frames.is_blank(cells("embedding"), 0.5).alias("blank"))


@query("""WITH RECURSIVE k AS (SELECT label AS source_id, vec_id, list_transform(embedding, lambda x: x > 0) AS c, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
b AS (SELECT *, len(list_filter(c, lambda x: x)) / 64 < 0.01 AS blank FROM k),
f AS (SELECT source_id, k, 1 AS run, c AS anchor, blank AS was FROM b WHERE k = 1
  UNION ALL SELECT source_id, k, CASE WHEN goes THEN run ELSE run + 1 END, CASE WHEN goes THEN anchor ELSE c END, blank FROM (SELECT b.source_id, b.k, b.c, b.blank, f.run, f.anchor, b.blank = f.was AND (b.blank OR len(list_filter(list_zip(f.anchor, b.c), lambda z: z[1] <> z[2])) <= 0.4 * 64) AS goes FROM f JOIN b ON b.source_id = f.source_id AND b.k = f.k + 1)),
m AS (SELECT f.source_id, f.run, f.was, b.vec_id, b.c FROM f JOIN b ON b.source_id = f.source_id AND b.k = f.k),
d AS (SELECT x.source_id, x.run, x.vec_id, sum(len(list_filter(list_zip(x.c, y.c), lambda z: z[1] <> z[2]))) AS total FROM m x JOIN m y ON x.source_id = y.source_id AND x.run = y.run GROUP BY ALL),
r AS (SELECT source_id, run, first(vec_id ORDER BY total, vec_id) AS r FROM d GROUP BY ALL)
SELECT m.source_id, CASE WHEN any_value(was) THEN 'blank' ELSE 'subtitle' END AS kind, min(vec_id)::DOUBLE AS start_time, max(vec_id)::DOUBLE AS end_time, count(*) AS n, any_value(r)::DOUBLE AS representative FROM m JOIN r USING (source_id, run) GROUP BY m.source_id, m.run""")
def wn9_visual_states(spark, d):
    """WN9 WN23 SO7: visual states of the signatures of each source, near their first one, each with its medoid."""
    rows = model.table(spark, d, "embeddings").select(F.col("label").alias("source_id"), F.col("vec_id").cast("double").alias("start_time"), F.transform("embedding", lambda x: x > 0).alias("signature"))
    return frames.grouped_states(rows, 0.4)


@query(f"""WITH RECURSIVE {_OBS}, k AS (SELECT source_id, start_time, row_number() OVER (PARTITION BY source_id ORDER BY start_time) AS k FROM obs),
f AS (SELECT *, start_time + 3600 AS due, true AS kept FROM k WHERE k = 1 UNION ALL SELECT k.source_id, k.start_time, k.k, CASE WHEN k.start_time >= f.due THEN f.due + 3600 ELSE f.due END, k.start_time >= f.due FROM f JOIN k ON k.source_id = f.source_id AND k.k = f.k + 1)
SELECT source_id, start_time FROM f WHERE kept""")
def wn17_fps_walk(spark, d):
    """WN17: frames that a fixed rate keeps, catching up after gaps."""
    return frames.sampled(_obs(spark, d).select("source_id", "start_time"), 1 / 3600)


@query(f"""WITH RECURSIVE {_OBS}, k AS (SELECT source_id, start_time AS t, coalesce(confidence, 0) AS g, row_number() OVER (PARTITION BY source_id ORDER BY start_time) AS k, count(*) OVER (PARTITION BY source_id) AS n FROM obs),
f AS (SELECT source_id, k, t, n, g AS anchor, t AS seen, false AS follow, 'bootstrap' AS reason FROM k WHERE k = 1
  UNION ALL SELECT source_id, k, t, n, CASE WHEN why IS NULL THEN anchor ELSE g END, CASE WHEN why IS NULL THEN seen ELSE t END, coalesce(why = 'candidate', follow AND false), why FROM
    (SELECT k.source_id, k.k, k.t, k.n, k.g, f.anchor, f.seen, f.follow, CASE WHEN f.follow THEN 'candidate_followup' WHEN abs(k.g - f.anchor) > 0.03 THEN 'candidate' WHEN k.t - f.seen >= 1 THEN 'sentinel' END AS why FROM f JOIN k ON k.source_id = f.source_id AND k.k = f.k + 1))
SELECT source_id, t AS start_time, coalesce(reason, 'boundary') AS reason FROM f WHERE reason IS NOT NULL OR k = n""")
def sm3_schedule(spark, d):
    """SM3: which frames are looked at closely, and why; the last one closes the range."""
    return frames.scheduled(_obs(spark, d).select("source_id", "start_time", F.coalesce("confidence", F.lit(0.0)).alias("signal")), tail=True)


_NEXT = r"""n AS (SELECT conv_id || '-' || turn AS id, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
c AS (SELECT id, regexp_replace(lower(a), '[^\p{L}\p{N}]', '', 'g') AS a, regexp_replace(lower(b), '[^\p{L}\p{N}]', '', 'g') AS b FROM n WHERE b IS NOT NULL)"""


def _next(spark, d):
    rows = model.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("a"), F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("b"))
    return rows.where("b is not null")


@query()
def f7_fuzzy_scores(spark, d):
    """F5-F8 F10-F13: sequence, bigram, line and state scores of neighbouring turns."""
    found = fuzzy.state_scores(_next(spark, d), "id", "a", "b")
    return found.select("id", *[F.round(c, 9).alias(c) for c in found.columns if c != "id"])


@query(f"""WITH {_NEXT}, g AS (SELECT id, unnest(list_transform(generate_series(1, length(a) - 1), lambda k: substring(a, k::BIGINT, 2))) AS g, 1 AS x, 0 AS y FROM c WHERE length(a) > 1 UNION ALL SELECT id, unnest(list_transform(generate_series(1, length(b) - 1), lambda k: substring(b, k::BIGINT, 2))), 0, 1 FROM c WHERE length(b) > 1),
s AS (SELECT id, g, sum(x) AS x, sum(y) AS y FROM g GROUP BY id, g), t AS (SELECT id, sum(least(x, y)) AS shared, sum(x + y) AS total FROM s GROUP BY id)
SELECT c.id, round(CASE WHEN length(a) > 1 AND length(b) > 1 THEN 2 * shared / total END, 9) AS dice FROM c LEFT JOIN t ON t.id = c.id""")
def f8_dice(spark, d):
    """F6 F8: bigrams that neighbouring turns share, by their compact texts."""
    rows = _next(spark, d).select("id", text.compact(F.col("a")).alias("a"), text.compact(F.col("b")).alias("b"))
    return fuzzy.dice(rows, "id").select("id", F.round("dice", 9).alias("dice"))


@query(r"""WITH RECURSIVE w AS (SELECT page_id, list_filter(string_split_regex(regexp_replace(url, '[/.:?#&=-]+', ' ', 'g'), '\s+'), lambda x: x <> '') AS a, ['http', 'example', 'org', 'en'] AS b FROM pages),
d AS (SELECT page_id, a, b, 0 AS i, [0, 1, 2, 3, 4]::INT[] AS r FROM w
  UNION ALL SELECT page_id, a, b, i + 1, [i + 1, c1, c2, c3, least(r[5] + 1, c3 + 1, r[4] + CASE WHEN a[i + 1] = b[4] THEN 0 ELSE 1 END)] FROM (SELECT *, least(r[4] + 1, c2 + 1, r[3] + CASE WHEN a[i + 1] = b[3] THEN 0 ELSE 1 END) AS c3 FROM (SELECT *, least(r[3] + 1, c1 + 1, r[2] + CASE WHEN a[i + 1] = b[2] THEN 0 ELSE 1 END) AS c2 FROM
    (SELECT *, least(r[2] + 1, i + 2, r[1] + CASE WHEN a[i + 1] = b[1] THEN 0 ELSE 1 END) AS c1 FROM d WHERE i < len(a)))))
SELECT page_id, round(CASE WHEN len(a) = 0 THEN 1.0 ELSE r[5] / len(a) END, 9) AS wer FROM d WHERE i = len(a)""")
def f3_word_error_rate(spark, d):
    """F3 F31 EV1: edit distance over words."""
    words = F.regexp_replace("url", "[/.:?#&=-]+", " ")
    return model.table(spark, d, "pages").select("page_id", F.round(fuzzy.word_error_rate(words, F.lit("http example org en")), 9).alias("wer"))


@query(r"""WITH l AS (SELECT doc_id, unnest(p.l) AS line, unnest(generate_series(1, len(p.l))) AS pos FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e]|\x{85}|\x{2028}|\x{2029}') AS l FROM documents WHERE text IS NOT NULL) p),
t AS (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(translate(lower(line), '—–', '--'), '\s+', ' ', 'g') ORDER BY pos) AS k FROM t WHERE line <> ''),
s AS (SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5 FROM k WHERE k = 1 GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(text_md5, md5('')) AS text_md5, coalesce(n, 0) AS n FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id) WHERE text IS NOT NULL""")
def f21_dedupe_lines(spark, d):
    """F21 F14: lines once each."""
    rows = model.table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return rows.select("doc_id", F.md5(text.without_repeated_lines(F.col("text"))).alias("text_md5"), F.size(text.lines(F.col("text"))).cast("long").alias("n"))


@query(r"""SELECT doc_id, regexp_matches(text, '[\x{4E00}-\x{9FFF}]') AS han, regexp_matches(lower(text), '[a-z]') AS latin FROM documents""")
def f15_script_profile(spark, d):
    """which scripts a text holds."""
    return model.table(spark, d, "documents").select("doc_id", text.script_profile(F.col("text")).alias("p")).select("doc_id", "p.han", "p.latin")


@query(r"""WITH w AS (SELECT page_id, regexp_extract(url, '/([^/]*)$', 1) AS a, regexp_extract(url, '([^/]*)/[^/]*$', 1) AS b FROM pages), v AS (SELECT page_id, regexp_replace(lower(a), '[^\p{L}\p{N}]', '', 'g') AS a, regexp_replace(lower(b), '[^\p{L}\p{N}]', '', 'g') AS b FROM w)
SELECT page_id, round(CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_filter(list_distinct(string_split(a, '')), lambda c: c <> ''), lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))))), 0) / (length(a) + length(b)) END, 9) AS similarity FROM v""")
def f9_multiset(spark, d):
    rows = model.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/([^/]*)$", 1).alias("a"), F.regexp_extract("url", "([^/]*)/[^/]*$", 1).alias("b"))
    rows = rows.select("page_id", text.compact(F.col("a")).alias("a"), text.compact(F.col("b")).alias("b"))
    return rows.select("page_id", F.round(text.multiset_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{3040}-\x{30FF}]') THEN 'kana' WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') AND regexp_matches(text, '[A-Za-z]') THEN NULL
  WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'han' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' END AS script FROM documents""")
def f16_dominant_script(spark, d):
    return model.table(spark, d, "documents").select("doc_id", text.dominant_script(F.col("text")).alias("script"))


@query(f"""WITH {_CUES} SELECT source_id, id, CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS summary, CASE review_state WHEN 'approved' THEN '[ok]' WHEN 'rejected' THEN '[x]' WHEN 'needs_review' THEN '[?]' ELSE '' END AS badge, left(sha256(text), 8) AS short FROM cues""")
def prj10_summary(spark, d):
    """PRJ5 PRJ10 F28: a cue's short text, badge and hash."""
    said = F.col("layers")[0]["text"]
    state = F.col("review_state")
    badge = F.when(state == "approved", "[ok]").when(state == "rejected", "[x]").when(state == "needs_review", "[?]").otherwise("")
    return _cues(spark, d).select("source_id", "id", F.when(F.length(said) > 40, F.concat(F.substring(said, 1, 37), F.lit("..."))).otherwise(said).alias("summary"), badge.alias("badge"), F.substring(F.sha2(said, 256), 1, 8).alias("short"))


@query(f"""WITH {_CUES}, p AS (SELECT id, 'high' AS level FROM cues WHERE (source_id + start_time::BIGINT) % 3 = 0)
SELECT c.source_id, c.id, coalesce(level, 'none') AS level, CASE WHEN review_state = 'needs_review' THEN true WHEN review_state IN ('approved', 'rejected') THEN false ELSE level IS NOT NULL END AS review_needed FROM cues c LEFT JOIN p ON c.id = p.id""")
def flt6_review_needed(spark, d):
    """FLT6 JN8: cues with their priority, missing as none, and whether a person should look."""
    rows = _cues(spark, d).select("source_id", "id", "start_time", "review_state")
    known = rows.where((F.col("source_id") + F.col("start_time").cast("long")) % 3 == 0).select("id", F.lit("high").alias("level"))
    state, level = F.col("review_state"), F.coalesce("level", F.lit("none"))
    needed = F.when(state == "needs_review", True).when(state.isin("approved", "rejected"), False).otherwise(level != "none")
    return rows.join(known, "id", "left").select("source_id", "id", level.alias("level"), needed.alias("review_needed"))


@query(f"""WITH {_OBS}, c AS (SELECT source_id, trigger, list(id ORDER BY start_time, id) AS ids FROM obs GROUP BY source_id, trigger), e AS (SELECT source_id, trigger, ids, unnest(ids) AS id FROM c)
SELECT e.source_id, e.trigger, array_to_string(any_value(ids), ',') AS ids, count(*) AS n, round(max(o.start_time), 6) AS last FROM e JOIN obs o ON e.id = o.id WHERE o.text <> '' GROUP BY e.source_id, e.trigger""")
def jn7_evidence(spark, d):
    """JN7 AG21 ST2: the observations behind each cue by their ids, each once, in the order first seen; ids without a row go."""
    obs = _obs(spark, d)
    seen = F.transform(F.sort_array(F.collect_list(F.struct("start_time", "id"))), lambda x: x["id"])
    cues = obs.groupBy("source_id", "trigger").agg(F.array_distinct(seen).alias("ids"))
    held = cues.select("source_id", "trigger", "ids", F.explode("ids").alias("id")).join(obs.where("text <> ''").select("id", "start_time"), "id")
    return held.groupBy("source_id", "trigger").agg(F.array_join(F.first("ids"), ",").alias("ids"), F.count("*").alias("n"), F.round(F.max("start_time"), 6).alias("last"))


@query(f"WITH {_CUES} SELECT source_id, id, start_time FROM cues WHERE source_id % 4 <> 1")
def snk7_delete_sources(spark, d):
    """SNK7 JN10: all cues but those of some sources."""
    rows = _cues(spark, d)
    return store.without_sources(rows, rows.where("source_id % 4 = 1").select("source_id").distinct()).select("source_id", "id", "start_time")


@query(f"WITH {_CUES} SELECT source_id, id, CASE WHEN start_time = 4 THEN 'approved' ELSE review_state END AS review_state FROM cues")
def snk8_update_state(spark, d):
    """SNK8 QA3."""
    return store.with_state(_cues(spark, d), F.col("start_time") == 4, "approved").select("source_id", "id", "review_state")


@query(f"WITH {_CUES} SELECT id, start_time + CASE WHEN source_id % 3 = 0 THEN 100 ELSE 0 END AS start_time FROM cues UNION ALL SELECT 'x' || id, start_time + 100 FROM cues WHERE source_id % 3 = 0")
def snk9_upsert(spark, d):
    rows = _cues(spark, d).select("id", "start_time", (F.col("source_id") % 3 == 0).alias("moved"))
    late = rows.where("moved").withColumn("start_time", F.col("start_time") + 100)
    return store.upserted(rows.drop("moved"), late.drop("moved").unionAll(late.select(F.concat(F.lit("x"), "id"), "start_time")))


@query(f"WITH {_CUES} SELECT source_id, id AS cue_id, 0 AS position, role AS language, CASE WHEN role = 'user' AND start_time = 0 THEN 'edited' ELSE text END AS text FROM cues")
def snk5_layers(spark, d):
    """SNK5 QA4: cues' layers as rows, after an edit of one language."""
    rows = _cues(spark, d)
    return store.layer_rows(store.with_layer_text(rows, (F.col("start_time") == 0) & F.exists("layers", lambda x: x["language"] == "user"), "user", "edited"))


@query(f"WITH {_CUES} SELECT source_id, id, CASE WHEN start_time - 2 < 0 THEN 'negative start' WHEN end_time - 2 <= start_time - 2 THEN 'empty span' END AS problem FROM cues")
def val1_checked(spark, d):
    rows = _cues(spark, d).withColumns({"start_time": F.col("start_time") - 2, "end_time": F.col("end_time") - 2})
    return store.checked(rows).select("source_id", "id", "problem")


@query(f"WITH {_OBS} SELECT source_id, id, start_time FROM obs ORDER BY start_time, id")
def src8_in_order(spark, d):
    """SRC7 SRC8 SO2: observations of listed sources, here of all, in order."""
    rows = _obs(spark, d)
    return store.of_sources(rows, rows.select("source_id").distinct()).select("source_id", "id", "start_time")


@query("SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, sum(n_chars)::BIGINT AS total, round(quantile_cont(n_chars, 0.05), 6) AS p05, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(sqrt(quantile_cont(n_chars, 0.05) * quantile_cont(n_chars, 0.95)), 6) AS threshold FROM documents GROUP BY source")
def ag18_quantiles(spark, d):
    """AG11 AG18: group means, sums, quantiles and the threshold between them."""
    rows = model.table(spark, d, "documents").select("source", "n_chars")
    told = rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.sum("n_chars").alias("total"))
    found = ranks.quantiles(rows, ["source"], "n_chars", {"p05": 0.05, "p95": 0.95}).withColumnRenamed("source", "of")
    met = told.join(found, told["source"].eqNullSafe(found["of"])).drop("of")
    return met.withColumns({"threshold": F.round(F.sqrt(F.col("p05") * F.col("p95")), 6), "p05": F.round("p05", 6), "p95": F.round("p95", 6)})


@query("WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) AS p95 FROM s WHERE k = floor(95 * (n - 1) / 100) + 1 GROUP BY event_type")
def ev14_lower_rank(spark, d):
    """EV14: the 95th percentile as the lower nearest rank."""
    rows = model.table(spark, d, "events").where("value is not null")
    return ranks.quantiles(rows, ["event_type"], "value", {"p95": 0.95}, lower=True)


@query(f"""WITH {_SPANS}, n AS (SELECT t.source_id, truth_id, t.s, t.e, count(f.s) AS n FROM truth t LEFT JOIN found f ON f.source_id = t.source_id AND f.s BETWEEN t.s - 2 AND t.e + 2 GROUP BY ALL),
l AS (SELECT *, lead(n) OVER (PARTITION BY source_id ORDER BY s, e, truth_id) AS after FROM n), c AS (SELECT source_id, count(*) AS calls FROM found GROUP BY source_id),
g AS (SELECT source_id, bool_and(after IS NULL OR n > 0 AND after > 0) AS recall_complete, count(*) FILTER (n = 0) AS swallowed, count(*) FILTER (n > 0) AS representatives FROM l GROUP BY source_id)
SELECT g.*, coalesce(calls, 0) AS calls, recall_complete AND swallowed = 0 AND representatives <= 20 AND coalesce(calls, 0) <= 20 AS passed, CASE WHEN coalesce(calls, 0) = 0 THEN 0.0 ELSE round(1 - representatives / calls, 9) END AS reduction FROM g LEFT JOIN c USING (source_id)""")
def ev10_verdict(spark, d):
    """EV10 AG15: a source passes if every transition is bracketed, no state swallowed, and representatives and calls are few."""
    truth, found = _spans(spark, d)
    return evaluation.verdict(truth, found.select("source_id", "found_id", F.col("start_time").alias("at")), state_id="truth_id", tolerance=2.0)


@query(f"WITH {_CUES}, m AS (SELECT round((start_time + end_time) / 2, 3) AS middle, role, text, source_id FROM cues) SELECT source_id, middle, min(CASE WHEN role = 'user' THEN text END) AS user_text, min(CASE WHEN role = 'assistant' THEN text END) AS assistant_text FROM m GROUP BY source_id, middle")
def ag13_points(spark, d):
    """AG13: texts by language at each cue's middle."""
    rows = _cues(spark, d).select("source_id", F.round((F.col("start_time") + F.col("end_time")) / 2, 3).alias("middle"), F.col("layers")[0].alias("layer"))
    of = lambda who: F.min(F.when(F.col("layer.language") == who, F.col("layer.text")))
    return rows.groupBy("source_id", "middle").agg(of("user").alias("user_text"), of("assistant").alias("assistant_text"))


@query(f"WITH {_OBS}, s AS (SELECT *, lag(text) OVER (PARTITION BY source_id ORDER BY start_time, id) AS before FROM obs) SELECT source_id, id, before || '>' || text AS change FROM s WHERE before <> text")
def wn19_transitions(spark, d):
    """WN19: consecutive readings that differ."""
    before = F.lag("text").over(windows.in_order())
    return _obs(spark, d).withColumn("before", before).where("before <> text").select("source_id", "id", F.concat("before", F.lit(">"), "text").alias("change"))


@query()
def lg4_layers(spark, d):
    """LG1-LG4 LG8 AG6 JN6: which expected language each line of a frame belongs to."""
    rows = _regions(spark, d).withColumn("language", F.when(F.col("seq") % 2 == 0, "zh").otherwise("en"))
    return layers.assigned(rows, ["zh", "ja", "en"])


@query(f"WITH {_CUES} SELECT source_id, id, start_time, end_time, text, review_state, (start_time / 2)::INT AS origin FROM cues")
def wn11_bursts(spark, d):
    """WN11 FLT9: captions split by a garbled piece. Turns last too long to be one; fixtures hold the cases."""
    rows = _cues(spark, d).select("source_id", "id", "start_time", "end_time", F.col("layers")[0]["text"].alias("text"), "review_state", F.array((F.col("start_time") / 2).cast("int")).alias("origins"))
    return bursts.collapse_bursts(rows).withColumn("origin", F.col("origins")[0]).drop("origins")


@query(f"WITH {_CUES} SELECT source_id, id FROM (SELECT *, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS c FROM cues) WHERE NOT (end_time - start_time <= 0.2 AND length(c) BETWEEN 2 AND 4 AND regexp_matches(c, '\\p{{L}}') AND regexp_matches(c, '[0-9]') AND NOT contains(trim(text, chr(10)), chr(10)))")
def flt10_machine_tokens(spark, d):
    """FLT10: cues but the very short ones that read as machine tokens."""
    token = bursts.machine_token(F.col("layers")[0]["text"], F.col("end_time") - F.col("start_time"))
    return _cues(spark, d).where(~token).select("source_id", "id")


@query(f"""WITH RECURSIVE {_CUES}, k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_time, end_time, id) AS k FROM cues WHERE review_state <> 'rejected'),
f AS (SELECT source_id, k, start_time AS anchor, true AS due, text FROM k WHERE k = 1 UNION ALL SELECT k.source_id, k.k, CASE WHEN k.start_time - f.anchor >= 6 THEN k.start_time ELSE f.anchor END, k.start_time - f.anchor >= 6, k.text FROM f JOIN k ON k.source_id = f.source_id AND k.k = f.k + 1)
SELECT source_id, string_agg(CASE WHEN due THEN '## ' || strftime(make_timestamp((anchor * 1e6)::BIGINT), '%H:%M:%S') || chr(10) ELSE '' END || text || chr(10), '' ORDER BY k) AS body FROM f GROUP BY source_id""")
def snk3_reading_transcript(spark, d):
    return captions.reading_transcript(_cues(spark, d), gap=6.0)


@query(f"""WITH {_PAIRS}, c AS (SELECT vec_id, list_transform(a, lambda x: abs(x)::DOUBLE) AS m, list_transform(b, lambda x: abs(x)::DOUBLE) AS n, list_transform(a, lambda x: x > 0.15) AS s, list_transform(b, lambda x: x > 0.15) AS t FROM pairs WHERE b IS NOT NULL),
u AS (SELECT *, list_filter(generate_series(1, 64), lambda i: list_bool_or(list_concat(s[(i - 1) // 8 * 8 + 1 : (i - 1) // 8 * 8 + 8], t[(i - 1) // 8 * 8 + 1 : (i - 1) // 8 * 8 + 8]))) AS used FROM c)
SELECT vec_id, round(list_sum(list_transform(list_zip(m, n), lambda p: abs(p[1] - p[2]))) / (list_sum(m) + list_sum(n)), 6) AS mass, round(CASE WHEN len(used) = 0 THEN 0 ELSE len(list_filter(used, lambda i: s[i] <> t[i])) / len(used) END, 9) AS occupancy FROM u""")
def im5_signature_distances(spark, d):
    """IM5, of IM13 the mass distance: signatures compared by their ink's mass and over occupied bands."""
    rows = model.table(spark, d, "embeddings")
    rows = rows.withColumn("b", F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))).where("b is not null")
    # components are floats and so is the bound: as a double, 0.15 lies below the float next to it
    ink, cells = (lambda c: F.transform(c, lambda x: F.abs(x))), (lambda c: F.transform(c, lambda x: x > F.lit(0.15).cast("float")))
    return rows.select("vec_id", F.round(frames.mass_distance(ink("embedding"), ink("b")), 6).alias("mass"), F.round(frames.occupancy_distance(cells("embedding"), cells("b"), 8), 9).alias("occupancy"))


def _reached(spark, d):
    truth, found = _spans(spark, d)
    return intervals.reached(truth, found.select("source_id", F.col("start_time").alias("at")), span_id="truth_id", tolerance=2.0)


@query(f"WITH {_SPANS} SELECT truth_id FROM truth t WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.source_id = t.source_id AND f.s BETWEEN t.s - 2 AND t.e + 2)")
def jn16_uncovered(spark, d):
    """JN16 EV9: states that no observation reaches, within a tolerance."""
    return _reached(spark, d).where("n = 0").select("truth_id")


@query(f"WITH {_SPANS}, n AS (SELECT truth_id, count(f.s) AS n FROM truth t LEFT JOIN found f ON f.source_id = t.source_id AND f.s BETWEEN t.s - 2 AND t.e + 2 GROUP BY truth_id) SELECT n AS representatives, count(*) AS states, sum(greatest(0, n - 1))::BIGINT AS excess FROM n GROUP BY n")
def ev9_representatives(spark, d):
    """EV9: how many representatives states have, and those beyond one."""
    return _reached(spark, d).groupBy(F.col("n").alias("representatives")).agg(F.count("*").alias("states"), F.sum(F.greatest(F.lit(0), F.col("n") - 1)).cast("long").alias("excess"))
