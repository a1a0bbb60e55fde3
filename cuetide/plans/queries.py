"""The engine's queries, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import review, text
from ..operators import cues as cue_ops
from ..operators import folds, intervals, ranks, windows
from ..sources import captions, model
from ..streaming import gate

_OBS = """obs AS (
  SELECT user_id AS source_id, event_id AS id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS start_time,
    date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 + 0.001 AS end_time, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS text,
    CASE WHEN k % 7 <> 0 THEN least(value / 500, 1.0) END AS confidence, ['first_frame', 'change_detected', 'periodic_confirmation'][k % 3 + 1] AS trigger,
    CASE WHEN k % 4 <> 0 THEN ['en', 'zh', 'ja'][k % 4] END AS language
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))"""
_CUES = """cues AS (
  SELECT conv_id AS source_id, conv_id || '-' || turn AS id, turn * 2.0::DOUBLE AS start_time, turn * 2.0::DOUBLE + CASE WHEN (conv_id + turn) % 2 = 0 THEN 2.5 ELSE 1.5 END::DOUBLE AS end_time,
    ['pending', 'approved', 'rejected', 'needs_review'][(conv_id + turn) % 4 + 1] AS review_state, role, text FROM conversations)"""
_SPANS = """truth AS (
  SELECT o_custkey AS source_id, o_orderkey AS truth_id, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS s, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE + 30 AS e FROM orders),
found AS (
  SELECT o_custkey AS source_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)) AS found_id, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE AS s, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE + 7 AS e
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def _obs(spark, d):
    return model.observations(model.table(spark, d, "events"))


def _cues(spark, d):
    return model.cues(model.table(spark, d, "conversations"))


def _spans(spark, d):
    return model.spans(model.table(spark, d, "orders"), model.table(spark, d, "lineitem"))


_RUNS = f"""{_OBS}, said AS (SELECT *, lag(text) OVER w AS before FROM obs WHERE text <> '' WINDOW w AS (PARTITION BY source_id ORDER BY start_time, id)),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> text THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start_time, id) AS run FROM said)"""


@query(f"""WITH {_RUNS}, lv AS (SELECT source_id, run, language, count(*) AS votes, max(coalesce(confidence, -1)) AS best, min((start_time, id)) AS first FROM runs WHERE language IS NOT NULL GROUP BY ALL),
l AS (SELECT source_id, run, first(language ORDER BY votes DESC, best DESC, first) AS language, count(*) AS n_languages FROM lv GROUP BY ALL),
c AS (SELECT source_id, run, min(start_time) AS start_time, max(end_time) AS end_time, any_value(text) AS text, avg(confidence) AS confidence, count(*) AS n FROM runs GROUP BY source_id, run)
SELECT c.source_id, c.run::BIGINT AS run, start_time, end_time, text, round(confidence, 9) AS confidence, n, coalesce(language, 'und') AS language,
  round(s, 9) AS score, CASE WHEN s >= 0.66 THEN 'high' WHEN s >= 0.33 THEN 'medium' WHEN s > 0 THEN 'low' ELSE 'none' END AS level
FROM (SELECT c.*, language, least(1.0, coalesce(CASE WHEN confidence < 0.9 THEN least(1.0, (0.9 - confidence) / 0.9) ELSE 0.0 END, 0.0) + CASE WHEN coalesce(n_languages, 0) > 1 THEN 1 ELSE 0 END + CASE WHEN language IS NULL THEN 1 ELSE 0 END)::DOUBLE AS s
  FROM c LEFT JOIN l ON l.source_id = c.source_id AND l.run = c.run) c""")
def consensus_cues(spark, d):
    """WN2 WN3 AG1-AG4 QA1: runs of equal readings as cues with a voted language and a review priority."""
    found = windows.consensus_cues(_obs(spark, d))
    parts = review.components(F.col("confidence"), F.col("n_languages") > 1, F.col("language") == "und", F.lit(False))
    score = review.score(parts)
    return found.select("source_id", "run", "start_time", "end_time", "text", F.round("confidence", 9).alias("confidence"), "n", "language", F.round(score, 9).alias("score"), review.level(score).alias("level"))


@query(f"WITH {_OBS} SELECT source_id, id, start_time, first(CASE WHEN text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY start_time, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_text FROM obs".replace("first(", "first_value("))
def wn2_next_text(spark, d):
    return windows.next_text(_obs(spark, d)).select("source_id", "id", "start_time", "next_text")


#: State runs by a recursive query: one step for each reading that is not blank.
_STATES = f"""{_OBS}, o AS (SELECT *, row_number() OVER w AS k, first_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY start_time, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM obs WINDOW w AS (PARTITION BY source_id ORDER BY start_time, id)),
b AS (SELECT *, row_number() OVER w AS j, coalesce(k - lag(k) OVER w > 1, false) AS had FROM o WHERE text <> '' WINDOW w AS (PARTITION BY source_id ORDER BY k)),
f AS (SELECT source_id, j, k, 1 AS run, text AS anchor, false AS cut, false AS mute FROM b WHERE j = 1
  UNION ALL SELECT source_id, j, k, run + CASE WHEN cut OR opens THEN 1 ELSE 0 END, CASE WHEN cut OR opens THEN text ELSE anchor END, cut, NOT cut AND switch AND nxt IS NULL
  FROM (SELECT *, had AND sim < 0.5 AS cut, CASE WHEN switch THEN nxt IS NOT NULL AND 1 - levenshtein(text, nxt) / greatest(length(text), length(nxt)) >= 0.5 ELSE sim < 0.5 END AS opens
    FROM (SELECT b.*, f.run, f.anchor, 1 - levenshtein(f.anchor, b.text) / greatest(length(f.anchor), length(b.text)) AS sim, b.trigger IN ('first_frame', 'change_detected') AND b.text <> f.anchor AS switch FROM f JOIN b ON b.source_id = f.source_id AND b.j = f.j + 1))),
x AS (SELECT o.*, f.run, f.mute, last_value(f.run IGNORE NULLS) OVER (PARTITION BY o.source_id ORDER BY o.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held, first_value(f.cut IGNORE NULLS) OVER (PARTITION BY o.source_id ORDER BY o.k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ncut,
  count(*) FILTER (o.nxt IS NULL AND o.text = '') OVER (PARTITION BY o.source_id) AS tail FROM o LEFT JOIN f ON f.source_id = o.source_id AND f.k = o.k),
m AS (SELECT * FROM x WHERE text <> '' OR held IS NOT NULL AND CASE WHEN ncut IS NULL THEN tail = 1 ELSE NOT ncut END),
bl AS (SELECT source_id, held, min(start_time) AS at FROM x WHERE text = '' AND held IS NOT NULL AND CASE WHEN ncut IS NULL THEN tail >= 2 ELSE ncut END GROUP BY ALL),
nx AS (SELECT source_id, run - 1 AS held, min(start_time) AS at FROM x WHERE run > 1 GROUP BY ALL),
v AS (SELECT source_id, held, text, count(*) AS votes, max(coalesce(confidence, -1)) AS best, min(k) AS first FROM m WHERE text <> '' AND NOT mute GROUP BY ALL),
t AS (SELECT source_id, held, first(text ORDER BY votes DESC, best DESC, first) AS text, max(votes) AS n_votes, count(*) AS n_distinct FROM v GROUP BY ALL),
lv AS (SELECT source_id, held, language, count(*) AS votes, max(coalesce(confidence, -1)) AS best, min(k) AS first FROM m WHERE text <> '' AND NOT mute AND language IS NOT NULL GROUP BY ALL),
l AS (SELECT source_id, held, first(language ORDER BY votes DESC, best DESC, first) AS language FROM lv GROUP BY ALL),
g AS (SELECT source_id, held, 'cue-' || first(id ORDER BY k) AS id, min(start_time) AS start_time, last(end_time ORDER BY k) AS last_end, string_agg(id::VARCHAR, ',' ORDER BY k) AS ids, count(*) AS n_members, avg(confidence) FILTER (text <> '') AS confidence FROM m GROUP BY ALL),
cue AS (SELECT g.source_id, g.id, g.start_time, coalesce(bl.at, nx.at, last_end) AS end_time, t.text, coalesce(l.language, 'und') AS language, g.ids, n_members::INT AS n_members, n_votes::INT AS n_votes, n_distinct::INT AS n_distinct, round(confidence, 9) AS confidence
  FROM g JOIN t USING (source_id, held) LEFT JOIN l USING (source_id, held) LEFT JOIN bl USING (source_id, held) LEFT JOIN nx USING (source_id, held))"""


@query(f"WITH RECURSIVE {_STATES} SELECT * FROM cue")
def wn1_state_runs(spark, d):
    """WN1 AG3: visual states by a stateful fold with an anchor, as cues."""
    return folds.consensus(_obs(spark, d)).withColumns({"ids": F.array_join("observation_ids", ","), "confidence": F.round("confidence", 9)}).drop("observation_ids")


@query(f"""WITH RECURSIVE {_STATES}, p AS (SELECT *, lag(text) OVER w AS before, lag(end_time) OVER w AS reach FROM cue WINDOW w AS (PARTITION BY source_id ORDER BY start_time, id)),
q AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> text OR start_time > reach + 0.15 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start_time, id) AS part FROM p)
SELECT source_id, first(id ORDER BY start_time, id) AS id, min(start_time) AS start_time, max(end_time) AS end_time, any_value(text) AS text, first(language ORDER BY start_time, id) AS language, string_agg(ids, ',' ORDER BY start_time, id) AS ids, count(*) AS n FROM q GROUP BY source_id, part""")
def wn5_reconstruct(spark, d):
    """WN5 WN20: states, votes and neighbours of equal text as cues."""
    rows = folds.reconstructed(_obs(spark, d))
    return rows.select("source_id", "id", "start_time", "end_time", "text", "language", F.array_join("observation_ids", ",").alias("ids"), "n")


@query("""WITH RECURSIVE k AS (SELECT conv_id AS source_id, turn AS seq, conv_id || '-' || turn AS id, turn * 2.0::DOUBLE AS s, turn * 2.0::DOUBLE + 2.5 AS e, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT source_id, k, 1 AS run, text AS said, e AS last_end, 'first' AS flag FROM k WHERE k = 1
  UNION ALL SELECT source_id, k, CASE WHEN goes THEN run ELSE run + 1 END, CASE WHEN goes THEN said || substring(text, o + 1) ELSE text END, e,
    CASE WHEN goes THEN CASE WHEN o = length(text) THEN 'repetition' WHEN o = length(said) AND length(text) > o THEN 'growth' ELSE 'sliding' END WHEN gap < 0 AND o = 0 THEN 'collision' WHEN gap < 0 THEN 'ambiguous' ELSE 'first' END
  FROM (SELECT *, o > 0 AND (gap < 0 AND (o >= 2 OR o = length(said)) OR gap >= 0 AND gap <= 1 AND o = length(text)) AS goes FROM
    (SELECT k.source_id, k.k, k.e, k.text, f.run, f.said, k.s - f.last_end AS gap, coalesce(list_max(list_filter(generate_series(1, least(length(f.said), length(k.text))), lambda n: right(f.said, n::BIGINT) = left(k.text, n::BIGINT))), 0)::BIGINT AS o FROM f JOIN k ON k.source_id = f.source_id AND k.k = f.k + 1)))
SELECT source_id, 'cue-' || first(id ORDER BY k) AS id, min(s) AS start_time, max(e) AS end_time, last(said ORDER BY k) AS text, string_agg(id, ',' ORDER BY k) AS observation_ids, coalesce(array_to_string(list_sort(list_distinct(list(flag) FILTER (flag <> 'first'))), ','), '') AS flags FROM f JOIN k USING (source_id, k) GROUP BY source_id, run""")
def wn6_rolling_captions(spark, d):
    """WN6-WN8 WN21: rolling captions folded into whole cues."""
    rows = model.table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("id"), (F.col("turn") * 2.0).alias("start_time"), (F.col("turn") * 2.0 + 2.5).alias("end_time"), "text")
    return folds.rolling(rows).withColumns({"observation_ids": F.array_join("observation_ids", ","), "flags": F.array_join("flags", ",")})


_SIGNALS = "k AS (SELECT user_id AS source_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t, value / 500 AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query(f"""WITH RECURSIVE {_SIGNALS},
f AS (SELECT source_id, k, t, g, g AS base, t AS read_at, g AS last, NULL::DOUBLE AS since, 0 AS steady, 'first_frame' AS reason FROM k WHERE k = 1
  UNION ALL SELECT source_id, k, t, g, CASE WHEN periodic OR settled THEN g ELSE base END, CASE WHEN periodic OR settled AND change >= 0.012 THEN t ELSE read_at END, g, CASE WHEN opens THEN t WHEN since IS NOT NULL AND change > 0.02 AND NOT settled THEN since END,
    CASE WHEN opens THEN calm::INT WHEN since IS NOT NULL AND change > 0.02 AND NOT settled THEN steady2 ELSE 0 END, CASE WHEN periodic THEN 'periodic_confirmation' WHEN settled AND change >= 0.012 THEN 'change_detected' END
  FROM (SELECT *, since IS NULL AND change <= 0.02 AND t - read_at >= 2 AS periodic, since IS NULL AND change > 0.02 AS opens, since IS NOT NULL AND change > 0.02 AND (steady2 >= 1 AND t - since >= 0.033 - 1e-4 OR t - since >= 0.35) AS settled FROM
    (SELECT *, CASE WHEN calm THEN steady + 1 ELSE 0 END AS steady2 FROM (SELECT k.source_id, k.k, k.t, k.g, f.base, f.read_at, f.since, f.steady, abs(k.g - f.base) AS change, abs(k.g - f.last) <= 0.015 AS calm FROM f JOIN k ON k.source_id = f.source_id AND k.k = f.k + 1))))
SELECT source_id, t AS start_time, g AS signal, reason FROM f WHERE reason IS NOT NULL""")
def sm1_change_gate(spark, d):
    """SM1 SM9: change-triggered sampling, in batch."""
    return gate.triggers(model.table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("double").alias("start_time") / 1e6, (F.col("value") / 500).alias("signal")).toDF("source_id", "start_time", "signal"))


@query(f"""WITH {_CUES}, x AS (SELECT *, lag(trim(text)) OVER w AS before, trim(text) AS t FROM cues WINDOW w AS (PARTITION BY source_id ORDER BY start_time, id)),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> t OR t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start_time, id) AS same FROM x),
b AS (SELECT *, CASE WHEN start_time > max(end_time) OVER (PARTITION BY source_id, same ORDER BY start_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.15 THEN 1 ELSE 0 END AS br FROM s),
p AS (SELECT *, sum(br) OVER (PARTITION BY source_id, same ORDER BY start_time, id) AS part FROM b)
SELECT source_id, first(id ORDER BY start_time, id) AS id, min(start_time) AS start_time, max(end_time) AS end_time, any_value(t) AS text, count(*) AS n FROM p GROUP BY source_id, same, part""")
def wn4_consolidate(spark, d):
    found = windows.consolidate(_cues(spark, d).select("source_id", "id", "start_time", "end_time", F.col("layers")[0]["text"].alias("text")))
    return found.select("source_id", "id", "start_time", "end_time", "text", "n")


@query(f"""WITH {_OBS}, x AS (SELECT *, row_number() OVER w AS k, lag(text) OVER w AS before FROM obs WINDOW w AS (PARTITION BY source_id ORDER BY start_time, id)),
r AS (SELECT *, sum(CASE WHEN k = 1 OR before <> text THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start_time, id) AS run FROM x)
SELECT source_id, run::BIGINT AS run, any_value(text) AS text, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS n FROM r GROUP BY source_id, run""")
def wn12_run_lengths(spark, d):
    return windows.run_lengths(_obs(spark, d), "text")


@query(f"WITH {_OBS} SELECT source_id, id, count(*) OVER (PARTITION BY source_id ORDER BY round(start_time * 1e6)::BIGINT RANGE BETWEEN CURRENT ROW AND 3600000000 FOLLOWING) AS n_near FROM obs")
def wn13_crowded(spark, d):
    return windows.crowded(_obs(spark, d), 3600.0).select("source_id", "id", "n_near")


@query(f"WITH {_CUES} SELECT source_id, id, lead(id) OVER (PARTITION BY source_id ORDER BY start_time, id) AS next_id FROM cues")
def wn15_next_cue(spark, d):
    return _cues(spark, d).select("source_id", "id", F.lead("id").over(windows.in_order()).alias("next_id"))


@query(f"WITH {_OBS} SELECT source_id, id, round(avg(confidence) OVER (PARTITION BY source_id ORDER BY round(start_time * 1e6)::BIGINT RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 9) AS mean FROM obs")
def wn16_trailing_mean(spark, d):
    return windows.trailing_mean(_obs(spark, d), "confidence", 86400.0).select("source_id", "id", F.round("mean", 9).alias("mean"))


@query(f"""WITH {_OBS}, x AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_time, id) - 1 AS k, count(*) OVER (PARTITION BY source_id) AS n FROM obs),
y AS (SELECT *, k > 0 AND k < n - 1 AND text <> 'click' AS odd FROM x), z AS (SELECT *, bool_or(odd) OVER (PARTITION BY source_id) AS any_odd FROM y)
SELECT source_id, id, k, text FROM z WHERE k = 0 OR k = n - 1 OR odd OR (NOT any_odd AND k = n // 2)""")
def wn18_curated(spark, d):
    return windows.curated(_obs(spark, d).withColumn("winner", F.lit("click")), "winner").select("source_id", "id", F.col("k").cast("long").alias("k"), "text")


@query(f"WITH {_OBS}, g AS (SELECT source_id, start_time - lag(start_time) OVER (PARTITION BY source_id ORDER BY start_time, id) AS gap FROM obs) SELECT source_id, coalesce(max(gap), 0.0) AS max_gap FROM g GROUP BY source_id")
def ag14_max_gap(spark, d):
    return windows.gaps(_obs(spark, d))


@query(f"""WITH {_OBS}, v AS (SELECT source_id, text, count(*) AS votes, max(coalesce(confidence, -1)) AS best, min((start_time, id)) AS first FROM obs GROUP BY ALL)
SELECT source_id, first(text ORDER BY votes DESC, best DESC, first) AS text, max(votes) AS top, sum(votes)::BIGINT AS n, count(*) AS n_distinct FROM v GROUP BY source_id""")
def ag1_vote(spark, d):
    return windows.vote(_obs(spark, d), ["source_id"], "text")


@query(f"WITH {_OBS} SELECT trigger, count(*) AS n, round(avg(confidence), 9) AS mean, round(quantile_cont(confidence, 0.5), 9) AS median, round(quantile_cont(confidence, 0.95), 9) AS p95 FROM obs GROUP BY trigger")
def ag10_trigger_counts(spark, d):
    rows = _obs(spark, d).select("trigger", "confidence")
    told = rows.groupBy("trigger").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("mean"))
    found = ranks.quantiles(rows, ["trigger"], "confidence", {"median": 0.5, "p95": 0.95}).withColumnRenamed("trigger", "of")
    return told.join(found, told["trigger"].eqNullSafe(found["of"])).select("trigger", "n", "mean", F.round("median", 9).alias("median"), F.round("p95", 9).alias("p95"))


@query(f"WITH {_CUES} SELECT source_id, id, start_time, end_time, review_state, role || ': ' || text AS label FROM cues WHERE review_state <> 'rejected'")
def prj4_queue_label(spark, d):
    return cue_ops.kept(_cues(spark, d)).select("source_id", "id", "start_time", "end_time", "review_state", cue_ops.queue_label(F.col("layers")).alias("label"))


@query(f"WITH {_CUES} SELECT source_id, id FROM cues WHERE contains(lower(text), 'the')")
def flt5_search(spark, d):
    return cue_ops.searched(_cues(spark, d), " The ").select("source_id", "id")


@query(f"WITH {_CUES} SELECT source_id, id, start_time FROM cues WHERE start_time >= 2 AND start_time < 8")
def flt1_range(spark, d):
    return cue_ops.in_range(_cues(spark, d), 2.0, 8.0).select("source_id", "id", "start_time")


@query(f"""WITH {_CUES}, new AS (SELECT source_id, 'n' || id AS id, start_time + 0.25 AS start_time, end_time + 0.25 AS end_time FROM cues WHERE start_time >= 2 AND end_time <= 9)
SELECT source_id, id, start_time, end_time, review_state FROM cues WHERE end_time <= 2 OR start_time >= 10 OR review_state <> 'pending' OR start_time < 2 OR end_time > 10
UNION ALL SELECT source_id, id, start_time, end_time, 'pending' FROM new n WHERE NOT EXISTS (SELECT 1 FROM cues c WHERE c.source_id = n.source_id AND c.review_state <> 'pending' AND n.start_time < c.end_time AND n.end_time > c.start_time)""")
def st1_incremental_merge(spark, d):
    old = _cues(spark, d).select("source_id", "id", "start_time", "end_time", "review_state")
    new = old.where("start_time >= 2 and end_time <= 9").select("source_id", F.concat(F.lit("n"), "id").alias("id"), (F.col("start_time") + 0.25).alias("start_time"), (F.col("end_time") + 0.25).alias("end_time"), F.lit("pending").alias("review_state"))
    return cue_ops.merge_incremental(old, new, 2.0, 10.0)


@query(f"WITH {_CUES} SELECT source_id, id, CASE WHEN review_state = 'pending' THEN round(start_time + 0.125, 3) ELSE start_time END AS start_time, CASE WHEN review_state = 'pending' THEN round(end_time + 0.125, 3) ELSE end_time END AS end_time, CASE WHEN review_state = 'pending' THEN 'needs_review' ELSE review_state END AS review_state FROM cues")
def qa5_nudge(spark, d):
    return cue_ops.nudge(_cues(spark, d), 0.125, F.col("review_state") == "pending").select("source_id", "id", "start_time", "end_time", "review_state")


@query(f"""WITH {_CUES} SELECT source_id, id || '-a' AS id, start_time, 4.5::DOUBLE AS end_time, 'needs_review' AS review_state FROM cues WHERE start_time < 4.5 AND end_time > 4.5
UNION ALL SELECT source_id, id || '-b', 4.5, end_time, 'needs_review' FROM cues WHERE start_time < 4.5 AND end_time > 4.5
UNION ALL SELECT source_id, id, start_time, end_time, review_state FROM cues WHERE NOT (start_time < 4.5 AND end_time > 4.5)""")
def qa6_split(spark, d):
    return cue_ops.split(_cues(spark, d), F.lit(4.5)).select("source_id", "id", "start_time", "end_time", "review_state")


@query(f"""WITH {_CUES} SELECT a.source_id, a.id, least(a.start_time, b.start_time) AS start_time, greatest(a.end_time, b.end_time) AS end_time,
  CASE WHEN a.role = b.role THEN a.role || '=' || a.text || chr(10) || b.text ELSE a.role || '=' || a.text || '|' || b.role || '=' || b.text END AS layers
FROM cues a JOIN cues b ON a.source_id = b.source_id AND b.start_time = a.start_time + 2""")
def qa7_merge(spark, d):
    rows = _cues(spark, d)
    pairs = rows.select("source_id", F.struct(*rows.columns).alias("a"), F.lead(F.struct(*rows.columns)).over(windows.in_order()).alias("b"))
    pairs = pairs.where(F.col("b").isNotNull() & (F.col("b.start_time") == F.col("a.start_time") + 2))
    merged = cue_ops.merge_pairs(pairs)
    layers = F.array_join(F.transform("layers", lambda x: F.concat(x["language"], F.lit("="), x["text"])), "|")
    return merged.select(F.split("id", "-")[0].cast("long").alias("source_id"), "id", "start_time", "end_time", layers.alias("layers"))


@query(f"WITH {_SPANS} SELECT truth_id, found_id, least(t.e, f.e) - greatest(t.s, f.s) AS overlap FROM truth t JOIN found f ON t.source_id = f.source_id AND t.s < f.e AND t.e > f.s")
def jn_overlap_join(spark, d):
    truth, found = _spans(spark, d)
    much = F.least("a_end_time", "b_end_time") - F.greatest("a_start_time", "b_start_time")
    return intervals.overlap_join(truth, found).select(F.col("a_truth_id").alias("truth_id"), F.col("b_found_id").alias("found_id"), much.alias("overlap"))


@query(f"WITH {_SPANS} SELECT truth_id FROM truth t WHERE NOT EXISTS (SELECT 1 FROM found f WHERE t.source_id = f.source_id AND t.s < f.e AND t.e > f.s)")
def jn1_interval_anti(spark, d):
    truth, found = _spans(spark, d)
    return intervals.overlapping(truth, found, id_col="truth_id", anti=True).select("truth_id")


@query(f"""WITH {_SPANS} SELECT truth_id, found_id, overlap FROM (SELECT truth_id, found_id, least(t.e, f.e) - greatest(t.s, f.s) AS overlap,
  row_number() OVER (PARTITION BY truth_id ORDER BY least(t.e, f.e) - greatest(t.s, f.s) DESC, f.s, found_id) AS k FROM truth t JOIN found f ON t.source_id = f.source_id AND t.s < f.e AND t.e > f.s) WHERE k = 1""")
def jn3_best_overlap(spark, d):
    truth, found = _spans(spark, d)
    return intervals.best_overlap(truth, found, a_id="truth_id", b_id="found_id").select(F.col("a_truth_id").alias("truth_id"), F.col("b_found_id").alias("found_id"), "overlap")


@query(f"""WITH {_SPANS} SELECT found_id, truth_id FROM (SELECT found_id, truth_id, row_number() OVER (PARTITION BY found_id ORDER BY t.s, t.e, truth_id) AS k FROM found f JOIN truth t ON t.source_id = f.source_id AND f.s BETWEEN t.s AND t.e) WHERE k = 1""")
def jn4_covering(spark, d):
    truth, found = _spans(spark, d)
    points = found.select("source_id", "found_id", F.col("start_time").alias("at"))
    return intervals.covering(points, truth, point_id="found_id", span_id="truth_id").select(F.col("p_found_id").alias("found_id"), F.col("s_truth_id").alias("truth_id"))


@query(f"""WITH {_SPANS}, t AS (SELECT source_id, s, min(truth_id) AS v FROM truth GROUP BY ALL)
SELECT found_id, v AS truth_id FROM (SELECT found_id, v, row_number() OVER (PARTITION BY f.source_id, found_id, f.s ORDER BY abs(t.s - f.s), t.s) AS k FROM (SELECT DISTINCT * FROM found) f JOIN t ON t.source_id = f.source_id) WHERE k = 1""")
def jn5_nearest(spark, d):
    truth, found = _spans(spark, d)
    points = found.select("source_id", "found_id", F.col("start_time").alias("at")).distinct()
    others = truth.groupBy("source_id", F.col("start_time").alias("at")).agg(F.min("truth_id").alias("value"))
    return intervals.nearest(points, others).select("found_id", F.col("nearest_value").alias("truth_id"))


@query(f"WITH {_OBS} SELECT source_id, id, text, CASE WHEN text = '' THEN 0 ELSE levenshtein('purchase', text) END AS distance, round(1 - levenshtein('purchase', text) / greatest(8, length(text)), 9) AS similarity, round(levenshtein('purchase', text) / 8, 9) AS cer FROM obs")
def f1_similarity(spark, d):
    word = F.lit("purchase")
    return _obs(spark, d).select("source_id", "id", "text", F.when(F.col("text") == "", 0).otherwise(F.levenshtein(word, "text")).cast("long").alias("distance"), F.round(text.character_similarity(word, F.col("text")), 9).alias("similarity"), F.round(text.character_error_rate(word, F.col("text")), 9).alias("cer"))


@query(r"""WITH w AS (SELECT page_id, regexp_extract(url, '/([^/]*)$', 1) AS a, regexp_extract(url, '([^/]*)/[^/]*$', 1) AS b FROM pages)
SELECT page_id, a, b, coalesce(list_max(list_filter(generate_series(1, least(length(a), length(b))), lambda k: right(b, k::BIGINT) = left(a, k::BIGINT))), 0)::INT AS overlap,
  round(CASE WHEN length(x) > 0 AND length(y) > 0 AND (contains(x, y) OR contains(y, x)) THEN least(length(x), length(y)) / greatest(length(x), length(y)) ELSE 0.0 END, 9) AS containment
FROM (SELECT *, regexp_replace(lower(a), '[^\p{L}\p{N}]', '', 'g') AS x, regexp_replace(lower(b), '[^\p{L}\p{N}]', '', 'g') AS y FROM w)""")
def f4_overlap(spark, d):
    rows = model.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/([^/]*)$", 1).alias("a"), F.regexp_extract("url", "([^/]*)/[^/]*$", 1).alias("b"))
    return rows.select("page_id", "a", "b", text.overlap_length(F.col("b"), F.col("a")).alias("overlap"), F.round(text.containment_ratio(text.compact(F.col("a")), text.compact(F.col("b"))), 9).alias("containment"))


@query(f"WITH {_CUES}, c AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_time, end_time, id) AS number FROM cues WHERE review_state <> 'rejected') SELECT source_id, number::INT AS number, number || chr(10) || strftime(make_timestamp((start_time * 1e6)::BIGINT), '%H:%M:%S,%g') || ' --> ' || strftime(make_timestamp((end_time * 1e6)::BIGINT), '%H:%M:%S,%g') || chr(10) || text || chr(10) AS block FROM c")
def snk1_srt(spark, d):
    return captions.srt_blocks(_cues(spark, d))


@query(f"WITH {_CUES} SELECT source_id, id, '[' || strftime(make_timestamp((start_time * 1e6)::BIGINT), '%H:%M:%S') || ']' || chr(10) || text AS block FROM cues WHERE review_state <> 'rejected'")
def snk2_transcript(spark, d):
    return captions.transcript(_cues(spark, d))


@query("SELECT doc_id AS id, quality, n_chars FROM documents JOIN labels USING (doc_id) ORDER BY n_chars DESC, doc_id LIMIT (SELECT greatest(1, round_even(count(*) * 0.1, 0))::BIGINT FROM documents JOIN labels USING (doc_id))")
def ev5_top_fraction(spark, d):
    rows = model.table(spark, d, "documents").join(model.table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "quality", "n_chars")
    return windows.top_fraction(rows, "n_chars", 0.1)


@query("SELECT source, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed FROM documents JOIN labels USING (doc_id) GROUP BY source")
def ev6_pass_fail(spark, d):
    rows = model.table(spark, d, "documents").select("doc_id", "source").join(model.table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
