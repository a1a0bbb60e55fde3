"""Queries of the cue cleaner, of languages and of identity evidence."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bursts, cleaner, identity, layers, overlays, review
from ..sources import model
from .queries import _CUES, _OBS, _cues, _obs, query


def _captions(spark, d):
    """Cues of parts' names in the order of a customer's items, 0.3 seconds apart."""
    items = model.table(spark, d, "lineitem").join(model.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(model.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber"))
    rows = items.select(F.col("o_custkey").alias("source_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), k.alias("k"), F.concat_ws("\n", "p_name", "p_type").alias("text"), "l_returnflag")
    layer = F.struct(F.lit("en").alias("language"), F.col("text").alias("text"), F.array("id").alias("observation_ids"))
    state = F.when(F.col("l_returnflag") == "R", "approved").otherwise("pending")
    return rows.select("source_id", "id", (F.col("k") * 0.3).alias("start_time"), (F.col("k") * 0.3 + 0.28).alias("end_time"), state.alias("review_state"), F.array(layer).alias("layers"))


@query()
def cl3_cleaned(spark, d):
    """CL1-CL12 WN10 AG8 AG9 SO6 ST4 F19 F20: cues after cleaning, protected ones as they were."""
    return cleaner.cleaned(_captions(spark, d))


@query()
def cl13_report(spark, d):
    """CL13 CL15: how many cues the cleaning left of each source."""
    rows = _captions(spark, d)
    return cleaner.report(rows, cleaner.cleaned(rows))


@query()
def cl13_actions(spark, d):
    """CL13 AG19: what the cleaning did, by kind and risk."""
    found = cleaner.actions(_captions(spark, d))
    risk = review.risk(F.col("action"), F.col("reasons"), F.col("size"), F.col("loses"))
    return found.groupBy("action", risk.alias("risk")).agg(F.count("*").alias("n"), F.sum(F.size("origins")).alias("cues"))


@query(f"WITH {_CUES} SELECT source_id, id, text FROM cues")
def flt11_pruned_extras(spark, d):
    """FLT11: turns without short Latin lines beside long ones of both scripts. No turn has both; fixtures hold the cases."""
    return bursts.pruned_extras(_cues(spark, d).select("source_id", "id", F.col("layers")[0]["text"].alias("text")))


@query(f"WITH {_CUES} SELECT source_id, id, role || ':' || text AS key, 1 AS n_ids FROM cues")
def cl14_keys(spark, d):
    """CL14: a cue's layers as one text and its observations as one set."""
    flat = F.array_join(F.transform("layers", lambda x: F.concat(x["language"], F.lit(":"), x["text"])), "|")
    return _cues(spark, d).select("source_id", "id", flat.alias("key"), F.size(F.array_distinct(F.array("id"))).alias("n_ids"))


@query()
def lg7_multilingual(spark, d):
    """LG5-LG7 WN20: cues of several languages from the regions of frames."""
    from .evidence import _regions

    rows = _regions(spark, d).select("*", (F.col("seq") * 2.0).alias("start_time"), (F.col("seq") * 2.0 + 0.001).alias("end_time"), F.lit("periodic_confirmation").alias("trigger"))
    rows = rows.withColumn("language", F.when(F.col("seq") % 2 == 0, "zh").otherwise("en"))
    return layers.reconstructed(rows, ["zh", "en"])


@query()
def id3_verified(spark, d):
    """ID1-ID3 JN11 JN12: probes of each envelope (a source's frames) by a recogniser, with what they leave open."""
    rows = _obs(spark, d).select("source_id", "start_time", "id", "text")
    return identity.verified(rows, budget=5)


@query()
def id4_reconstructed(spark, d):
    """ID4: cues of probed instants, and the time between them that nothing verified."""
    rows = _obs(spark, d).select("source_id", "start_time", "id", "text")
    return identity.reconstructed(identity.verified(rows, budget=5))


@query(f"WITH {_OBS} SELECT source_id, trigger, CASE WHEN count(*) FILTER (confidence IS NULL) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score, CASE WHEN count(*) FILTER (confidence IS NULL) > 0 THEN 'high' ELSE 'none' END AS level FROM obs GROUP BY source_id, trigger")
def id5_restored(spark, d):
    """ID5: a cue that rests on identity evidence asks for review, whatever was edited since."""
    from ..functions import review as scores

    held = _obs(spark, d).groupBy("source_id", "trigger").agg(F.bool_or(F.col("confidence").isNull()).alias("identity"))
    score = scores.score(identity.restored_components(F.col("identity")))
    return held.select("source_id", "trigger", score.alias("score"), scores.level(score).alias("level"))


def _longest(x: str, y: str) -> str:
    """SQL: length and place (negative) of the longest common part of two texts, the first of them in ``x``."""
    return f"list_max(flatten(list_transform(range(1, length({x}) + 1), lambda i: list_filter(list_transform(range(1, length({x}) - i + 2), lambda k: CASE WHEN contains({y}, substr({x}, i, k)) THEN [k, -i] END), lambda z: z IS NOT NULL))))"


def _labels(spark, d):
    """Cues of five series of parts, half a second apart: a name, and the name with kind and size, some in two scripts."""
    t = model.table(spark, d, "part")
    k = F.row_number().over(W.partitionBy(F.col("p_partkey") % 5).orderBy("p_partkey"))
    tail = F.concat_ws(" ", "p_type", "p_size")
    name = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("中"), F.col("p_name"))).otherwise(F.col("p_name"))
    return t.select((F.col("p_partkey") % 5).alias("source_id"), F.col("p_partkey").alias("id"), (k * 0.5).alias("start_time"), (k * 0.5 + 0.4).alias("end_time"), F.concat(name, F.lit("\n"), name, F.lit(" "), tail).alias("text"))


_LABELS = """labels AS (SELECT p_partkey % 5 AS source_id, p_partkey AS id, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) * 0.5 AS start_time, CASE WHEN p_size % 5 = 0 THEN '中' ELSE '' END || p_name AS name, p_type || ' ' || p_size AS tail FROM part),
places AS (SELECT source_id, id, start_time, start_time + 0.4 AS end_time, lower(name) AS key FROM labels UNION SELECT source_id, id, start_time, start_time + 0.4, lower(name || ' ' || tail) FROM labels),
said AS (SELECT DISTINCT source_id, key, replace(key, ' ', '') AS c, contains(key, '中') AS han FROM places)"""
_NEAR = f"""{_LABELS},
close AS (SELECT x.source_id, x.key AS a, y.key AS b, x.c, y.c AS d, list_transform(range(1, length(x.c)), lambda i: substr(x.c, i, 2)) AS g, list_transform(range(1, length(y.c)), lambda i: substr(y.c, i, 2)) AS h
  FROM said x JOIN said y ON x.source_id = y.source_id AND x.key < y.key AND x.han = y.han AND least(length(x.c), length(y.c)) >= 4
  WHERE 2.0 * list_sum(list_transform(list_distinct(string_split(x.c, '')), lambda e: least(length(x.c) - length(replace(x.c, e, '')), length(y.c) - length(replace(y.c, e, ''))))) / (length(x.c) + length(y.c)) >= 0.78),
m AS (SELECT source_id, a, b, c AS x, d AS y, {_longest("c", "d")} AS t FROM close
  UNION ALL SELECT source_id, a, b, x, y, {_longest("x", "y")} FROM (SELECT source_id, a, b, unnest([substr(x, 1, -t[2] - 1), substr(x, t[1] - t[2])]) AS x, unnest([substr(y, 1, strpos(y, substr(x, -t[2], t[1])) - 1), substr(y, strpos(y, substr(x, -t[2], t[1])) + t[1])]) AS y FROM m WHERE t IS NOT NULL) WHERE x <> '' AND y <> ''),
f AS (SELECT source_id, a, b, sum(t[1]) AS n FROM m GROUP BY ALL),
near AS (SELECT source_id, a, b, length(c) AS n, length(d) AS m, greatest(2.0 * f.n / (length(c) + length(d)), 0.99 * 2.0 * list_sum(list_transform(list_distinct(g), lambda e: least(len(list_filter(g, lambda v: v = e)), len(list_filter(h, lambda v: v = e))))) / (length(c) + length(d) - 2)) AS similarity FROM close JOIN f USING (source_id, a, b))"""


@query(f"WITH RECURSIVE {_NEAR} SELECT source_id, a, b, round(similarity, 9) AS similarity FROM near WHERE similarity >= 0.78")
def jn13_near_lines(spark, d):
    """JN13 F7 F8 F10: pairs of a source's lines that are near copies, by a join on their rare bigrams."""
    places = overlays.line_places(_labels(spark, d), "source_id", F.col("text"))
    return overlays.near_copies(places, "source_id", overlays.KIN, overlays.KIN_LEAST).select("source_id", "a", "b", F.round("similarity", 9).alias("similarity"))


_FAMILIES = f"""{_NEAR},
links AS (SELECT source_id, a, b FROM near WHERE similarity >= 0.82 AND least(n, m) >= 5 AND least(n, m) >= 0.82 * greatest(n, m)), ways AS (SELECT * FROM links UNION ALL SELECT source_id, b, a FROM links),
r AS (SELECT DISTINCT source_id, key, key AS node FROM places UNION SELECT r.source_id, r.key, w.b FROM r JOIN ways w ON w.source_id = r.source_id AND w.a = r.node),
roots AS (SELECT source_id, key, min(node) AS family FROM r GROUP BY ALL),
told AS (SELECT source_id, family, count(DISTINCT id) AS n_cues, round(max(end_time) - min(start_time), 3) AS seconds FROM places JOIN roots USING (source_id, key) GROUP BY ALL HAVING n_cues >= 4 AND seconds >= 12)"""


@query(f"WITH RECURSIVE {_FAMILIES} SELECT source_id, key, family, n_cues, seconds::DOUBLE AS seconds FROM roots JOIN told USING (source_id, family)")
def jn13_line_families(spark, d):
    """JN13 CL1: families of near copies that stand on four cues or more over 12 seconds or more."""
    places = overlays.line_places(_labels(spark, d), "source_id", F.col("text"))
    return overlays.families(places, "source_id")[0].drop("joined")


@query()
def cl1_overlay_lines(spark, d):
    """CL1: families with the looser near copies that join them, in the order of lines."""
    places = overlays.line_places(_labels(spark, d), "source_id", F.col("text"))
    members, pairs = overlays.families(places, "source_id")
    return overlays.with_kin(members, pairs, places, "source_id")


@query(f"""WITH RECURSIVE {_FAMILIES}, gone AS (SELECT source_id, key FROM roots JOIN told USING (source_id, family)),
l AS (SELECT source_id, id, 0 AS k, name AS line FROM labels UNION ALL SELECT source_id, id, 1, name || ' ' || tail FROM labels)
SELECT l.source_id, l.id, string_agg(line, chr(10) ORDER BY k) AS text FROM l ANTI JOIN gone ON gone.source_id = l.source_id AND gone.key = lower(l.line) GROUP BY l.source_id, l.id""")
def cl2_without_overlays(spark, d):
    """CL2: cues without the lines of families; cues left empty go."""
    rows = _labels(spark, d)
    members, _ = overlays.families(overlays.line_places(rows, "source_id", F.col("text")), "source_id")
    return overlays.without_lines(rows, "source_id", "text", members).select("source_id", "id", "text")
