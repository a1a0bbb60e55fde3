"""Evaluation: recovery, timing, language and cost figures of found spans against true ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import character_error_rate
from ..sources.shared import written
from . import intervals, ranks
from .frames import frame_difference, signature_distance

WRONG_LAYER, COMPLETE = 0.2, 0.98


def precision_recall(truth: DataFrame, found: DataFrame, *, truth_id: str, found_id: str) -> DataFrame:
    """Shares of found spans that meet a true one and of true spans that a found one meets; without spans 0."""
    def share(rows: DataFrame, others: DataFrame, of: str, name: str) -> DataFrame:
        met = intervals.count_meeting(rows, others, id_col=of)
        return rows.agg(F.count("*").alias("n")).select(F.coalesce(F.try_divide(met.scalar(), F.col("n")), F.lit(0.0)).alias(name))

    return share(found, truth, found_id, "precision").withColumn("recall", share(truth, found, truth_id, "recall").scalar())


def timing_error(truth: DataFrame, found: DataFrame, *, truth_id: str, found_id: str) -> DataFrame:
    """Mean distances of starts and ends over the true spans that have a match; none: 0."""
    pairs = intervals.best_overlap(truth, found, a_id=truth_id, b_id=found_id)
    far = lambda end: F.coalesce(F.avg(F.abs(F.col(f"a_{end}_time") - F.col(f"b_{end}_time"))), F.lit(0.0)).alias(f"{end}_error")
    return pairs.agg(far("start"), far("end"), F.count("*").alias("matched"))


def layer_errors(truth: DataFrame, recovered: DataFrame) -> DataFrame:
    """``id, language, error`` of languages (``id, language, text``) without recovered text.

    ``wrong_assignment`` if another language's text nearly is the true one, else ``missing``.
    """
    own = recovered.where("text <> ''").select("id", "language")
    lost = truth.join(own, ["id", "language"], "left_anti")
    others = recovered.select("id", F.col("language").alias("other"), F.col("text").alias("said"))
    near = (F.col("other") != F.col("language")) & (character_error_rate(F.col("text"), F.col("said")) < WRONG_LAYER)
    met = lost.join(others, "id", "left").groupBy("id", "language").agg(F.coalesce(F.bool_or(near), F.lit(False)).alias("near"))
    return met.select("id", "language", F.when(F.col("near"), "wrong_assignment").otherwise("missing").alias("error"))


def completion(state: Column, coverage: Column) -> Column:
    """How far a job came, from its final state and the share of the range that it covered."""
    stopped = F.when(coverage >= COMPLETE, "completed_via_timeout_cancel").otherwise("partial_timeout")
    return F.when(state == "succeeded", "completed").when(state == "cancelled", stopped).otherwise("failed")


def point_recall(points: DataFrame, cues: DataFrame, *, point_id: str, cue_id: str, key: str = "source_id") -> DataFrame:
    """``key, points, matched, recall``: verified instants (``at``) that a cue covers, by source."""
    held = intervals.told(points, cues, {"hit": F.count("s_start_time") > 0}, point_id=point_id, key=key)
    rows = held.groupBy(key).agg(F.count("*").alias("points"), F.count_if("hit").alias("matched"))
    return rows.withColumn("recall", F.col("matched") / F.col("points"))


def random_recall(rows: DataFrame, target: Column, share: float, *, seeds: int = 20, id_col: str = "id") -> DataFrame:
    """Mean recall of ``target`` rows in a random top share, over ``seeds`` orders by a hash.

    Orders are ranked by ranges, so none needs a task of its own.
    """
    n, n_target = rows.agg(F.count("*"), F.count_if(target)).first()
    drawn = rows.select(F.col(id_col).cast("string").alias("id"), target.alias("wanted"), F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    drawn = drawn.withColumn("key", F.md5(F.concat_ws(":", "seed", "id")))
    top = ranks.top_rows(drawn, ["key", "id"], max(1, round(n * share)), ["seed"])
    found = top.groupBy("seed").agg(F.count_if("wanted").alias("hits"))
    return found.agg((F.sum("hits") / F.lit(seeds) / F.lit(max(1, n_target))).alias("recall"))


def cost(detector_seconds: Column, representatives: Column, frames: Column, latency: float) -> dict[str, Column]:
    """Seconds of a sparse pass, of a dense one, and the share saved."""
    sparse, dense = detector_seconds + representatives * latency, frames * latency
    return {"sparse_seconds": sparse, "dense_seconds": dense, "saved": F.when(dense > 0, 1 - sparse / dense).otherwise(F.lit(0.0))}


def held_candidates(points: DataFrame, states: DataFrame, *, point_id: str, margin: float, key: str = "source_id") -> DataFrame:
    """Points strictly inside some state, ``margin`` away from both its ends: looks that nothing asked for."""
    inner = states.select(key, (F.col("start_time") + margin).alias("start_time"), (F.col("end_time") - margin).alias("end_time")).where("start_time < end_time")
    left = points.withColumnRenamed("at", "p_at").withColumn("join_key", F.col(key)).withColumn("bin", F.floor(F.col("p_at") / intervals.WIDTH))
    right = intervals.binned(inner, key)
    strictly = (left["join_key"] == right["join_key"]) & (left["bin"] == right["bin"]) & (F.col("p_at") > F.col("s_start_time")) & (F.col("p_at") < F.col("s_end_time"))
    return left.join(right, strictly, "left_semi").select(key, point_id)


def interval_label(points: DataFrame, states: DataFrame, transitions: DataFrame, *, point_id: str, state_id: str) -> DataFrame:
    """Each point with the first state that covers it; inside a transition, or in no state, null."""
    span = lambda rows, veto: rows.select("source_id", "start_time", "end_time", F.col(state_id).alias("id"), F.lit(veto).alias("veto"))
    first = F.min(F.when(~F.col("s_veto"), F.struct("s_start_time", "s_end_time", "s_id")))
    found = {"first": first, "veto": F.coalesce(F.bool_or("s_veto"), F.lit(False))}
    rows = intervals.told(points, span(states, False).unionAll(span(transitions, True)), found, point_id=point_id)
    return rows.select(point_id, F.when(~F.col("veto"), F.col("first.s_id")).alias("label"))


def bracketed(states: DataFrame, points: DataFrame, *, state_id: str, tolerance: float, key: str = "source_id") -> DataFrame:
    """``key, transitions, bracketed``: neighbours among a source's states that are both reached by a point."""
    n = intervals.reached(states, points, span_id=state_id, tolerance=tolerance)
    rows = states.join(n, state_id)
    order = W.partitionBy(key).orderBy("start_time", "end_time", state_id)
    after = F.lead("n").over(order)
    return rows.withColumn("after", after).where("after is not null").groupBy(key).agg(F.count("*").alias("transitions"), F.count_if((F.col("n") > 0) & (F.col("after") > 0)).alias("bracketed"))


def verdict(states: DataFrame, points: DataFrame, *, state_id: str, tolerance: float, most: int = 20, target: int = 20, key: str = "source_id") -> DataFrame:
    """Whether each source's looks (``points``) recover all transitions, swallow no state, and are few.

    A state that a point reaches has one representative; ``calls`` counts the points, ``reduction`` what was spared.
    """
    n = states.join(intervals.reached(states, points, span_id=state_id, tolerance=tolerance), state_id)
    after = F.lead("n").over(W.partitionBy(key).orderBy("start_time", "end_time", state_id))
    n = n.withColumn("after", after).groupBy(key).agg(F.bool_and(F.col("after").isNull() | (F.col("n") > 0) & (F.col("after") > 0)).alias("recall_complete"), F.count_if(F.col("n") == 0).alias("swallowed"), F.count_if(F.col("n") > 0).alias("representatives"))
    calls = points.groupBy(key).agg(F.count("*").alias("calls"))
    out = n.join(calls, key, "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    passed = F.col("recall_complete") & (F.col("swallowed") == 0) & (F.col("representatives") <= most) & (F.col("calls") <= target)
    return out.withColumn("passed", passed).withColumn("reduction", F.when(F.col("calls") == 0, 0.0).otherwise(F.round(1 - F.col("representatives") / F.col("calls"), 9)))


def merge_violations(groups: DataFrame, states: DataFrame, *, group_id: str, state_id: str, tolerance: float, key: str = "source_id") -> DataFrame:
    """Groups that reach from one state into another with a whole state between: ``group_id, first, last``."""
    order = W.partitionBy(key).orderBy("start_time", "end_time", state_id)
    wide = states.withColumn("place", F.row_number().over(order)).select(key, "place", (F.col("start_time") - tolerance).alias("start_time"), (F.col("end_time") + tolerance).alias("end_time"))
    spans = intervals.binned(wide, key)

    bins = {end: F.floor(F.col(f"{end}_time") / intervals.WIDTH) for end in ("start", "end")}
    ends = groups.select(F.col(key).alias("join_key"), group_id, "start_time", "end_time", (bins["start"] == bins["end"]).alias("alone"), F.explode(F.array_distinct(F.array(*bins.values()))).alias("bin"))
    covers = lambda end: F.col(f"{end}_time").between(F.col("s_start_time"), F.col("s_end_time"))
    place = lambda end, pick: pick(F.when(covers(end), F.col("s_place"))).alias(end)
    met = ends.join(spans, ["join_key", "bin"]).where(covers("start") | covers("end"))
    # where both ends lie in one bin the join has all that counts; only other groups are shuffled once more
    met = met.groupBy("join_key", "bin", group_id, "alone").agg(place("start", F.min), place("end", F.max))
    met = met.where(~F.col("alone") | (F.col("end") - F.col("start") >= 2)).groupBy(group_id).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return met.where(F.col("end") - F.col("start") >= 2).select(group_id, F.col("start").alias("first"), F.col("end").alias("last"))


def top_recall(rows: DataFrame, score: str, target: Column, share: float) -> DataFrame:
    """``recall``: how much of ``target`` the first ``max(1, round(n * share))`` rows by falling ``score`` hold; none wanted: 0."""
    n, wanted = rows.agg(F.count("*"), F.count_if(target)).first()
    top = ranks.top_rows(rows.select("id", (-F.col(score)).alias("down"), target.alias("wanted")), ["down", "id"], max(1, round(n * share)))
    return top.agg((F.count_if("wanted") / F.lit(max(1, wanted))).alias("recall"))


#: Frames in a block; a pair of blocks is one task's work.
BLOCK = 1024


def pair_distances(frames: DataFrame, *, id_col: str, state: str, signature: str, block: int = BLOCK) -> DataFrame:
    """``kind, distance, n`` over all pairs of frames of one state (``same``) and of neighbouring ones (``adjacent``).

    States are whole numbers, signatures arrays of booleans of one size. A state's frames are dealt by their id over
    blocks of about ``block``; each pair of blocks is compared once, as a matrix inside a task, and only counts of
    distances (as many as a signature has cells) leave it. So no pair becomes a row, and a hot state is many pairs of
    blocks.
    """
    held = frames.where(F.col(state).isNotNull() & F.col(signature).isNotNull()).select(F.col(id_col).alias("id"), F.col(state).cast("long").alias("state"), F.col(signature).alias("sig"))
    sizes = written(held.groupBy("state").agg((F.ceil(F.count("*") / block) - 1).cast("int").alias("last")), "state-sizes")
    told = sizes.join(sizes.select((F.col("state") - 1).alias("state"), F.col("last").alias("above")), "state", "left").join(sizes.select((F.col("state") + 1).alias("state"), F.col("last").alias("below")), "state", "left")
    blocks = held.join(told, "state").groupBy("state", F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int").alias("block"), "last", "above", "below").agg(F.collect_list("sig").alias("sigs"))
    cell = lambda s, t, i, j: F.struct(s.alias("s"), t.alias("t"), i.alias("i"), j.alias("j"))
    me, b = F.col("state"), F.col("block")
    mine = F.transform(F.sequence(F.lit(0), F.col("last")), lambda j: cell(me, me, F.least(b, j), F.greatest(b, j)))
    over = lambda c, f: F.when(F.col(c).isNull(), F.array().cast("array<struct<s:bigint,t:bigint,i:int,j:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.col(c)), f))
    cells = F.concat(mine, over("above", lambda j: cell(me, me + 1, b, j)), over("below", lambda j: cell(me - 1, me, j, b)))
    dealt = blocks.select("state", "block", "sigs", F.explode(cells).alias("cell"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        c = frame["cell"].iloc[0]
        made = {(r.state, r.block): np.asarray([list(x) for x in r.sigs], np.int32) for r in frame.itertuples()}
        x, y = made.get((c["s"], c["i"])), made.get((c["t"], c["j"]))
        if x is None or y is None:  # a block that got no frame
            return pd.DataFrame({"kind": [], "distance": [], "n": []})
        apart = x @ (1 - y).T + (1 - x) @ y.T
        found = apart[np.triu_indices(len(x), 1)] if (c["s"], c["i"]) == (c["t"], c["j"]) else apart.ravel()
        values, n = np.unique(found, return_counts=True)
        return pd.DataFrame({"kind": "same" if c["s"] == c["t"] else "adjacent", "distance": values / max(1, x.shape[1]), "n": n})

    counted = dealt.groupBy("cell").applyInPandas(run, "kind string, distance double, n long")
    return counted.groupBy("kind", "distance").agg(F.sum("n").alias("n"))


def medoids(frames: DataFrame, group: list[str], *, id_col: str, signature: str) -> DataFrame:
    """The member of each group (a visual state's frames) that is nearest to all others; ties: the earliest."""
    side = lambda p: frames.select(*group, F.col(id_col).alias(p + "id"), F.col(signature).alias(p + "sig"))
    totals = side("a_").join(side("b_"), group).groupBy(*group, "a_id").agg(F.sum(F.round(signature_distance(F.col("a_sig"), F.col("b_sig")), 9)).alias("total"))
    return totals.groupBy(*group).agg(F.min_by("a_id", F.struct(F.round("total", 6), "a_id")).alias(id_col), F.count("*").alias("n"))


def boundary(rows: DataFrame, verdict: Column, key: str = "source_id") -> DataFrame:
    """``offset``: the last of the leading EARLIER rows; ``onset``: the first of the trailing LATER rows; ``resolved``."""
    order = W.partitionBy(key).orderBy("start_time", "id")
    held = rows.withColumn("verdict", verdict)
    lead = F.min((F.col("verdict") == "EARLIER").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    tail = F.min((F.col("verdict") == "LATER").cast("int")).over(order.rowsBetween(0, W.unboundedFollowing))
    held = held.withColumn("lead", lead).withColumn("tail", tail)
    out = held.groupBy(key).agg(F.max(F.when(F.col("lead") == 1, F.col("start_time"))).alias("offset"), F.min(F.when(F.col("tail") == 1, F.col("start_time"))).alias("onset"))
    return out.withColumn("resolved", F.coalesce(F.col("offset") < F.col("onset"), F.lit(False)))


def geometry_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two boxes' lists; other counts, or none: 1."""
    return F.when(F.size(a) == 0, 1.0).otherwise(frame_difference(a, b))


def assigned_state(lines: Column, geometry: tuple[Column, Column], content: tuple[Column, Column]) -> Column:
    """EARLIER or LATER if place and content agree, else ambiguous; each pair holds the distances to both."""
    (ge, gl), (ce, cl) = geometry, content
    return F.when(lines == 0, "ambiguous").when((ge < gl) & (ce < cl), "EARLIER").when((gl < ge) & (cl < ce), "LATER").otherwise("ambiguous")


def recorded(rows: DataFrame) -> DataFrame:
    """What a costly detector returned, written once to the shared folder: variants replay it, whatever executor is lost."""
    return written(rows, "recorded")
