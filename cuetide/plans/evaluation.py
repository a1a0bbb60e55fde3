"""Queries of evaluation: recovery, timing, languages, transitions, calibration, costs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, frames, windows
from ..sources import model
from .queries import _CUES, _OBS, _RUNS, _SPANS, _cues, _obs, _spans, query

_MEETS = "EXISTS (SELECT 1 FROM {b} y WHERE y.source_id = x.source_id AND x.s < y.e AND x.e > y.s)"


def _points(found):
    return found.select("source_id", "found_id", F.col("start_time").alias("at"))


@query(f"WITH {_SPANS} SELECT (SELECT count(*) FILTER ({_MEETS.format(b='truth')}) / count(*) FROM found x) AS precision, (SELECT count(*) FILTER ({_MEETS.format(b='found')}) / count(*) FROM truth x) AS recall")
def ev2_precision_recall(spark, d):
    """EV2 JN2: shares of spans that meet one of the other side."""
    truth, found = _spans(spark, d)
    return evaluation.precision_recall(truth, found, truth_id="truth_id", found_id="found_id")


@query(f"""WITH {_SPANS}, k AS (SELECT t.s AS ts, t.e AS te, f.s AS fs, f.e AS fe, row_number() OVER (PARTITION BY truth_id ORDER BY least(t.e, f.e) - greatest(t.s, f.s) DESC, f.s, found_id) AS k FROM truth t JOIN found f ON t.source_id = f.source_id AND t.s < f.e AND t.e > f.s)
SELECT coalesce(avg(abs(ts - fs)), 0.0) AS start_error, coalesce(avg(abs(te - fe)), 0.0) AS end_error, count(*) AS matched FROM k WHERE k = 1""")
def ev3_timing_error(spark, d):
    truth, found = _spans(spark, d)
    return evaluation.timing_error(truth, found, truth_id="truth_id", found_id="found_id")


@query(r"""WITH p AS (SELECT page_id AS id, regexp_extract(url, '/([^/]*)$', 1) AS a, regexp_extract(url, '([^/]*)/[^/]*$', 1) AS b FROM pages),
truth AS (SELECT id, 'a' AS language, a AS text FROM p UNION ALL SELECT id, 'b', b FROM p),
got AS (SELECT id, 'a' AS language, CASE WHEN id % 2 = 0 THEN '' ELSE a END AS text FROM p UNION ALL SELECT id, 'b', CASE WHEN id % 4 = 0 THEN a WHEN id % 4 = 2 THEN b ELSE '' END FROM p),
lost AS (SELECT t.* FROM truth t WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.id = t.id AND g.language = t.language AND g.text <> ''))
SELECT l.id, l.language, CASE WHEN bool_or(g.language <> l.language AND CASE WHEN length(l.text) = 0 THEN CASE WHEN length(g.text) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(l.text, g.text) / length(l.text) END < 0.2) THEN 'wrong_assignment' ELSE 'missing' END AS error
FROM lost l JOIN got g ON g.id = l.id GROUP BY l.id, l.language""")
def ev4_layer_errors(spark, d):
    """EV4: languages not recovered, and whether their text stands under another one."""
    p = model.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "/([^/]*)$", 1).alias("a"), F.regexp_extract("url", "([^/]*)/[^/]*$", 1).alias("b"))
    said = F.when(F.col("id") % 4 == 0, F.col("a")).when(F.col("id") % 4 == 2, F.col("b")).otherwise("")
    got = p.select("id", F.lit("a").alias("language"), F.when(F.col("id") % 2 == 0, "").otherwise(F.col("a")).alias("text")).unionAll(p.select("id", F.lit("b"), said))
    truth = p.select("id", F.lit("a").alias("language"), F.col("a").alias("text")).unionAll(p.select("id", F.lit("b"), "b"))
    return evaluation.layer_errors(truth, got)


@query(f"""WITH {_SPANS}, p AS (SELECT source_id, found_id, s AS at FROM found), h AS (SELECT p.*, EXISTS (SELECT 1 FROM truth t WHERE t.source_id = p.source_id AND p.at BETWEEN t.s AND t.e) AS hit FROM p),
r AS (SELECT source_id, count(*) AS points, count(*) FILTER (hit) AS matched FROM h GROUP BY source_id)
SELECT *, matched / points AS recall, CASE WHEN source_id % 3 = 0 THEN 'completed' WHEN source_id % 3 = 1 THEN CASE WHEN matched / points >= 0.98 THEN 'completed_via_timeout_cancel' ELSE 'partial_timeout' END ELSE 'failed' END AS completion FROM r""")
def ev7_point_recall(spark, d):
    """EV7 JN4: verified instants that a span covers, and how far the job came."""
    truth, found = _spans(spark, d)
    rows = evaluation.point_recall(_points(found), truth, point_id="found_id", cue_id="truth_id")
    state = F.element_at(F.array(F.lit("succeeded"), F.lit("cancelled"), F.lit("failed")), (F.col("source_id") % 3 + 1).cast("int"))
    return rows.withColumn("completion", evaluation.completion(state, F.col("recall")))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (quality = 0) AS wanted FROM labels), r AS (SELECT seed, quality, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || doc_id), doc_id::VARCHAR) AS k FROM labels, generate_series(0, 19) s(seed))
SELECT count(*) FILTER (quality = 0) / 20 / greatest(1, any_value(wanted)) AS recall FROM r, n WHERE k <= greatest(1, round_even(n * 0.2, 0))""")
def ev8_random_baseline(spark, d):
    """EV8: how much a random top fifth finds, over 20 orders."""
    return evaluation.random_recall(model.table(spark, d, "labels").withColumnRenamed("doc_id", "id"), F.col("quality") == 0, 0.2)


@query(f"""WITH {_OBS}, g AS (SELECT source_id, count(*) AS frames, count(*) FILTER (trigger = 'change_detected') AS representatives, count(*) FILTER (text <> '') * 0.01 AS seconds FROM obs GROUP BY source_id)
SELECT source_id, round(seconds + representatives * 0.25, 6)::DOUBLE AS sparse_seconds, round(frames * 0.25, 6)::DOUBLE AS dense_seconds, round(1 - (seconds + representatives * 0.25) / (frames * 0.25), 9)::DOUBLE AS saved FROM g""")
def ev11_cost(spark, d):
    """EV11: seconds of a sparse and of a dense pass."""
    rows = _obs(spark, d).groupBy("source_id").agg(F.count("*").alias("frames"), F.count_if(F.col("trigger") == "change_detected").alias("representatives"), (F.count_if(F.col("text") != "") * 0.01).alias("seconds"))
    figures = evaluation.cost(F.col("seconds"), F.col("representatives"), F.col("frames"), 0.25)
    return rows.select("source_id", *[F.round(c, 9 if name == "saved" else 6).alias(name) for name, c in figures.items()])


@query(f"WITH {_SPANS} SELECT source_id, found_id FROM found f WHERE EXISTS (SELECT 1 FROM truth t WHERE t.source_id = f.source_id AND f.s > t.s + 2 AND f.s < t.e - 2)")
def ev12_held_candidates(spark, d):
    truth, found = _spans(spark, d)
    return evaluation.held_candidates(_points(found), truth, point_id="found_id", margin=2.0)


@query(f"""WITH {_RUNS}, r AS (SELECT source_id, run, max(end_time) - min(start_time) AS span, min(start_time) AS start_time, count(*) AS frames, count(confidence) AS readable FROM runs GROUP BY source_id, run),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(span, 6), start_time) AS k FROM r)
SELECT source_id, frames, readable FROM k WHERE k = 1""")
def ev13_shortest_state(spark, d):
    """EV13: frames of each source's shortest state, and those with a reading."""
    said = _obs(spark, d).where("text <> ''")
    before = F.lag("text").over(windows.in_order())
    runs = windows.runs(said, before.isNull() | (before != F.col("text"))).groupBy("source_id", "run").agg((F.max("end_time") - F.min("start_time")).alias("span"), F.min("start_time").alias("start_time"), F.count("*").alias("frames"), F.count("confidence").alias("readable"))
    shortest = F.min_by(F.struct("frames", "readable"), F.struct(F.round("span", 6), "start_time"))
    return runs.groupBy("source_id").agg(shortest.alias("s")).select("source_id", "s.frames", "s.readable")


@query(f"""WITH {_OBS}, said AS (SELECT * FROM obs WHERE text <> ''), v AS (SELECT source_id, text, count(*) AS votes, max(coalesce(confidence, -1)) AS best, min((start_time, id)) AS first FROM said GROUP BY ALL),
w AS (SELECT source_id, first(text ORDER BY votes DESC, best DESC, first) AS voted FROM v GROUP BY source_id), f AS (SELECT source_id, first(text ORDER BY start_time, id) AS single FROM said GROUP BY source_id)
SELECT source_id, voted, single, round((levenshtein('purchase', single) - levenshtein('purchase', voted)) / 8, 9) AS gain FROM w JOIN f USING (source_id)""")
def ev15_consensus_gain(spark, d):
    """EV15: the error rate of a single frame less that of the vote."""
    said = _obs(spark, d).where("text <> ''")
    voted = windows.vote(said, ["source_id"], "text").select("source_id", F.col("text").alias("voted"))
    single = said.groupBy("source_id").agg(F.min_by("text", F.struct("start_time", "id")).alias("single"))
    cer = lambda c: text.character_error_rate(F.lit("purchase"), F.col(c))
    return voted.join(single, "source_id").select("source_id", "voted", "single", F.round(cer("single") - cer("voted"), 9).alias("gain"))


@query(f"WITH {_CUES} SELECT source_id, id, start_time, end_time, CASE WHEN role = 'user' THEN role END AS language, text FROM cues")
def ev17_ground_truth(spark, d):
    """EV17: true cues from JSON, their language optional."""
    rows = _cues(spark, d).select("source_id", "id", F.to_json(F.struct("start_time", "end_time", F.col("layers")[0]["text"].alias("text"), F.when(F.col("layers")[0]["language"] == "user", F.col("layers")[0]["language"]).alias("language"))).alias("doc"))
    parsed = F.from_json("doc", "start_time double, end_time double, text string, language string", {"mode": "FAILFAST"})
    return rows.select("source_id", "id", parsed.alias("cue")).select("source_id", "id", "cue.start_time", "cue.end_time", "cue.language", "cue.text")


@query("""WITH f AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS sig FROM embeddings),
p AS (SELECT a.label - b.label AS apart, len(list_filter(list_zip(a.sig, b.sig), lambda p: p[1] <> p[2])) / 64 AS distance FROM f a JOIN f b ON a.vec_id < b.vec_id AND abs(a.label - b.label) <= 1)
SELECT CASE WHEN apart = 0 THEN 'same' ELSE 'adjacent' END AS kind, count(*) AS n, min(distance) AS least, max(distance) AS most, round(quantile_cont(distance, 0.5), 9) AS median FROM p GROUP BY apart = 0""")
def jn14_state_pairs(spark, d):
    """JN14 AG18: distances of all pairs of frames of one state and of neighbouring ones, for the threshold between them."""
    rows = model.table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x > 0).alias("sig"))
    pairs = evaluation.pair_distances(rows, id_col="vec_id", state="label", signature="sig").where("n > 0")
    told = pairs.groupBy("kind").agg(F.sum("n").alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most"))
    # a distance is one of a few shares, so its counts give the median
    below = W.partitionBy("kind").orderBy("distance")
    placed = pairs.withColumn("upto", F.sum("n").over(below)).join(told.select("kind", F.col("n").alias("all")), "kind")
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("distance")))
    middle = placed.groupBy("kind").agg(F.round((at(F.floor((F.col("all") - 1) / 2)) + at(F.ceil((F.col("all") - 1) / 2))) / 2, 9).alias("median"))
    return told.join(middle, "kind").select("kind", "n", "least", "most", "median")


@query("WITH n AS (SELECT count(*) AS n, count(*) FILTER (quality = 0) AS wanted FROM documents JOIN labels USING (doc_id)), r AS (SELECT quality, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents JOIN labels USING (doc_id)) SELECT count(*) FILTER (quality = 0) / greatest(1, any_value(wanted)) AS recall FROM r, n WHERE k <= greatest(1, round_even(n * 0.1, 0))")
def ev5_recall(spark, d):
    """EV5 SO5: how much of what is wanted the top tenth by a score holds."""
    rows = model.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "doc_id", "n_chars").join(model.table(spark, d, "labels"), "doc_id")
    return evaluation.top_recall(rows, "n_chars", F.col("quality") == 0, 0.1)


@query(f"""WITH {_SPANS}, l AS (SELECT found_id, truth_id, row_number() OVER (PARTITION BY found_id ORDER BY t.s, t.e, truth_id) AS k FROM found f LEFT JOIN truth t ON t.source_id = f.source_id AND f.s BETWEEN t.s AND t.e)
SELECT l.found_id, CASE WHEN NOT EXISTS (SELECT 1 FROM truth t WHERE t.source_id = f.source_id AND f.s BETWEEN t.e - 1 AND t.e + 1) THEN truth_id END AS label FROM l JOIN found f ON f.found_id = l.found_id WHERE k = 1""")
def jn15_interval_label(spark, d):
    """JN15: the state at an instant; a transition window there vetoes."""
    truth, found = _spans(spark, d)
    near = truth.select("source_id", "truth_id", (F.col("end_time") - 1).alias("start_time"), (F.col("end_time") + 1).alias("end_time"))
    return evaluation.interval_label(_points(found), truth, near, point_id="found_id", state_id="truth_id")


@query(f"""WITH {_OBS}, x AS (SELECT *, row_number() OVER w AS k, lag(text) OVER w AS before FROM obs WINDOW w AS (PARTITION BY source_id ORDER BY start_time, id)),
r AS (SELECT *, sum(CASE WHEN k = 1 OR before <> text THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start_time, id) AS run FROM x),
g AS (SELECT source_id, run, any_value(text) AS text, min(start_time) AS a, max(end_time) AS b FROM r GROUP BY source_id, run),
m AS (SELECT *, coalesce(lag(text) OVER w <> lead(text) OVER w, false) AND b - a < 600 AS passing FROM g WINDOW w AS (PARTITION BY source_id ORDER BY run)),
s AS (SELECT *, lag(text) OVER (PARTITION BY source_id ORDER BY run) AS last_text FROM m WHERE NOT passing),
n AS (SELECT *, sum(CASE WHEN last_text IS NULL OR last_text <> text THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY run) AS part FROM s),
t AS (SELECT source_id, any_value(text) AS text, min(a) AS start_time, max(b) AS end_time, min(run) AS f, max(run) AS l FROM n GROUP BY source_id, part)
SELECT source_id, text, start_time, end_time, false AS transition FROM t
UNION ALL SELECT m.source_id, m.text, m.a, m.b, true FROM m WHERE passing AND NOT EXISTS (SELECT 1 FROM t WHERE t.source_id = m.source_id AND m.run > t.f AND m.run < t.l)""")
def wn12_segments(spark, d):
    """WN12: run lengths, with short runs between different ones as transitions and what they part merged again."""
    return windows.segments(_obs(spark, d), "text", 600.0)


@query(f"""WITH {_OBS}, x AS (SELECT *, row_number() OVER w AS k, lag(text) OVER w AS before FROM obs WINDOW w AS (PARTITION BY source_id ORDER BY start_time, id)),
r AS (SELECT *, sum(CASE WHEN k = 1 OR before <> text THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start_time, id) AS run FROM x),
g AS (SELECT source_id, run, any_value(text) AS text, min(start_time) AS a, max(end_time) AS b FROM r GROUP BY source_id, run)
SELECT source_id, run::BIGINT AS run, text = '' AND b - a >= 60 AS unreadable, count(*) OVER (PARTITION BY source_id ORDER BY round(a * 1e6)::BIGINT RANGE BETWEEN CURRENT ROW AND 7200000000 FOLLOWING) > 3 AS crowded FROM g""")
def wn13_ambiguities(spark, d):
    """WN13: long unreadable runs, and too many runs that start close together."""
    return windows.ambiguities(windows.run_lengths(_obs(spark, d), "text"), "text", unreadable=60.0, seconds=7200.0, most=3)


@query(f"""WITH {_OBS}, v AS (SELECT *, CASE WHEN confidence < 0.6 THEN 'EARLIER' WHEN confidence >= 0.6 THEN 'LATER' ELSE 'ambiguous' END AS verdict FROM obs),
f AS (SELECT *, bool_and(verdict = 'EARLIER') OVER (PARTITION BY source_id ORDER BY start_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lead, bool_and(verdict = 'LATER') OVER (PARTITION BY source_id ORDER BY start_time, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM v),
b AS (SELECT source_id, max(start_time) FILTER (lead) AS "offset", min(start_time) FILTER (tail) AS onset FROM f GROUP BY source_id)
SELECT *, coalesce("offset" < onset, false) AS resolved FROM b""")
def wn14_boundary(spark, d):
    """WN14: where a state surely ends and the next surely begins."""
    c = F.col("confidence")
    return evaluation.boundary(_obs(spark, d), F.when(c < 0.6, "EARLIER").when(c >= 0.6, "LATER").otherwise("ambiguous"))


@query("""WITH c AS (SELECT label, vec_id, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS value, unnest(generate_series(0, 63)) AS cell FROM embeddings)
SELECT label AS source_id, vec_id, cell::INT AS cell, round(avg(value) OVER (PARTITION BY label, cell ORDER BY vec_id RANGE BETWEEN 10 PRECEDING AND CURRENT ROW), 6) AS trailing, round(avg(value) OVER (PARTITION BY label, cell ORDER BY vec_id RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS centred FROM c""")
def wn16_cell_means(spark, d):
    """WN16: each cell's mean over the trailing and over the centred window, both ends included."""
    rows = model.table(spark, d, "embeddings").select(F.col("label").alias("source_id"), "vec_id", F.posexplode("embedding").alias("cell", "value"))
    by = W.partitionBy("source_id", "cell").orderBy("vec_id")
    mean = lambda a, b: F.round(F.avg(F.col("value").cast("double")).over(by.rangeBetween(a, b)), 6)
    return rows.select("source_id", "vec_id", "cell", mean(-10, 0).alias("trailing"), mean(-5, 5).alias("centred"))


@query(f"""WITH {_OBS}, v AS (SELECT source_id, text, count(*) AS votes, max(coalesce(confidence, -1)) AS best, min((start_time, id)) AS first FROM obs GROUP BY ALL),
w AS (SELECT source_id, first(text ORDER BY votes DESC, best DESC, first) AS winner FROM v GROUP BY source_id),
x AS (SELECT o.*, winner, row_number() OVER (PARTITION BY source_id ORDER BY start_time, id) - 1 AS k, count(*) OVER (PARTITION BY source_id) AS n FROM obs o JOIN w USING (source_id)),
y AS (SELECT *, k > 0 AND k < n - 1 AND text <> winner AS odd FROM x), z AS (SELECT *, bool_or(odd) OVER (PARTITION BY source_id) AS any_odd FROM y)
SELECT source_id, id, k, text FROM z WHERE k = 0 OR k = n - 1 OR odd OR (NOT any_odd AND k = n // 2) OR trigger = 'first_frame'""")
def wn18_curated_by_vote(spark, d):
    """WN18 AG1: the rows that show why a text won, with the envelope rows."""
    obs = _obs(spark, d)
    won = windows.vote(obs, ["source_id"], "text").select("source_id", F.col("text").alias("winner"))
    rows = windows.curated(obs.join(won, "source_id"), "winner", also=F.col("trigger") == "first_frame")
    return rows.select("source_id", "id", F.col("k").cast("long").alias("k"), "text")


@query(f"""WITH {_SPANS}, n AS (SELECT t.source_id, truth_id, t.s, t.e, count(f.s) AS n FROM truth t LEFT JOIN found f ON f.source_id = t.source_id AND f.s BETWEEN t.s - 2 AND t.e + 2 GROUP BY ALL),
l AS (SELECT *, lead(n) OVER (PARTITION BY source_id ORDER BY s, e, truth_id) AS after FROM n)
SELECT source_id, count(*) AS transitions, count(*) FILTER (n > 0 AND after > 0) AS bracketed FROM l WHERE after IS NOT NULL GROUP BY source_id""")
def wn19_bracketed(spark, d):
    """WN19: transitions with a point on both sides."""
    truth, found = _spans(spark, d)
    return evaluation.bracketed(truth, _points(found), state_id="truth_id", tolerance=2.0)


@query(f"""WITH {_SPANS}, s AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s, e, truth_id) AS place FROM truth),
x AS (SELECT found_id, (SELECT min(place) FROM s WHERE s.source_id = f.source_id AND f.s BETWEEN s.s - 2 AND s.e + 2) AS a, (SELECT max(place) FROM s WHERE s.source_id = f.source_id AND f.e BETWEEN s.s - 2 AND s.e + 2) AS b FROM found f)
SELECT found_id, a::INT AS first, b::INT AS last FROM x WHERE b - a >= 2""")
def wn19_merge_violations(spark, d):
    """WN19: found spans that swallow a state between two others."""
    truth, found = _spans(spark, d)
    return evaluation.merge_violations(found, truth, group_id="found_id", state_id="truth_id", tolerance=2.0)


@query("""WITH f AS (SELECT label, vec_id // 100 AS w, vec_id, list_transform(embedding, lambda x: x > 0) AS sig FROM embeddings),
t AS (SELECT a.label, a.w, a.vec_id, sum(round(len(list_filter(list_zip(a.sig, b.sig), lambda p: p[1] <> p[2])) / 64, 9)) AS total FROM f a JOIN f b ON a.label = b.label AND a.w = b.w GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY label, w ORDER BY round(total, 6), vec_id) AS k, count(*) OVER (PARTITION BY label, w) AS n FROM t)
SELECT label, w, vec_id, n FROM k WHERE k = 1""")
def so7_medoids(spark, d):
    """SO7 WN23: the frame that stands for its state."""
    rows = model.table(spark, d, "embeddings").select("label", F.floor(F.col("vec_id") / 100).alias("w"), "vec_id", F.transform("embedding", lambda x: x > 0).alias("sig"))
    return evaluation.medoids(rows, ["label", "w"], id_col="vec_id", signature="sig")


@query("""WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, lag(embedding) OVER w AS p, lead(embedding) OVER w AS q FROM embeddings WINDOW w AS (PARTITION BY vec_id // 100 ORDER BY vec_id)),
x AS (SELECT vec_id, v[1:8] AS g, p[1:8] AS gp, q[1:8] AS gq, list_transform(v, lambda x: x > 0) AS c, list_transform(p, lambda x: x > 0) AS cp, list_transform(q, lambda x: x > 0) AS cq FROM n WHERE p IS NOT NULL AND q IS NOT NULL),
m AS (SELECT vec_id, round(list_sum(list_transform(list_zip(g, gp), lambda z: abs(z[1] - z[2]::DOUBLE))) / 8, 6) AS ge, round(list_sum(list_transform(list_zip(g, gq), lambda z: abs(z[1] - z[2]::DOUBLE))) / 8, 6) AS gl,
  len(list_filter(list_zip(c, cp), lambda z: z[1] <> z[2])) AS ce, len(list_filter(list_zip(c, cq), lambda z: z[1] <> z[2])) AS cl FROM x)
SELECT vec_id, ge, gl, CASE WHEN ge < gl AND ce < cl THEN 'EARLIER' WHEN gl < ge AND cl < ce THEN 'LATER' ELSE 'ambiguous' END AS verdict FROM m""")
def f30_assigned(spark, d):
    """whether a frame belongs to the state before or after it, by place and by content."""
    order = W.partitionBy(F.floor(F.col("vec_id") / 100)).orderBy("vec_id")
    rows = model.table(spark, d, "embeddings").select("vec_id", "embedding", F.lag("embedding").over(order).alias("p"), F.lead("embedding").over(order).alias("q")).where("p is not null and q is not null")
    place = lambda c: F.slice(c, 1, 8)
    cells = lambda c: F.transform(c, lambda x: x > 0)
    geometry = [F.round(evaluation.geometry_distance(place("embedding"), place(c)), 6) for c in ("p", "q")]
    content = [frames.signature_distance(cells("embedding"), cells(c)) for c in ("p", "q")]
    return rows.select("vec_id", geometry[0].alias("ge"), geometry[1].alias("gl"), evaluation.assigned_state(F.lit(1), tuple(geometry), tuple(content)).alias("verdict"))
