"""Lines that stay on screen: a similarity join of a source's lines, families by components, near copies.

Two lines are near copies if their matcher ratio, or 0.99 of their bigrams' Dice coefficient, reaches a bound s.
With M matched characters of la + lb, the ratio is 2M / (la + lb). The matched blocks are parted by characters that
aren't matched, so there are at most la + lb - 2M + 1 of them, and M less their number are bigrams that both lines hold:
3M - (la + lb) - 1 or more. So two near copies share ``shared_least`` bigrams, counted with repeats, and their lengths
differ by s / (2 - s) at most. Ordering each line's bigrams by how rare they are, near copies share one among
the first ones (all but ``shared_least`` less one); that is the join. Rare bigrams first keep it narrow. Lines that hold
one such bigram meet in cells of ``CELL`` by ``CELL`` lines, whatever a bigram's lines are; there counts of characters and
of bigrams, as arrays, bound the score of all pairs at once. What is left is scored once for each two texts, however
many groups hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import written
from . import fuzzy
from .components import components
from .likeness import Likeness, kept_shared

#: Near copies and families of them.
SAME, KIN, LEAST, KIN_LEAST, CUES, SECONDS = 0.82, 0.78, 5, 4, 4, 12.0
#: Lines at a side of a cell; buckets of characters and of bigrams (shared buckets only raise a bound); pairs looked at at once.
CELL, CHARACTERS, BIGRAMS, AT_ONCE = 1024, 80, 256, 1 << 15


def line_places(cues: DataFrame, group: str, cue_text: Column) -> DataFrame:
    """``group, id, start_time, end_time, key, place``: the normalised lines of cues, each once a cue, in order."""
    shown = cues.select(group, "id", "start_time", "end_time", F.posexplode(text.lines(cue_text)).alias("k", "line"))
    keyed = shown.select(group, "id", "start_time", "end_time", "k", text.normalized(F.col("line")).alias("key")).where("key <> ''")
    return keyed.groupBy(group, "id", "key").agg(F.first("start_time").alias("start_time"), F.first("end_time").alias("end_time"), F.min("k").alias("k"))


def _shared_least(length: Column, bound: float) -> Column:
    """Bigrams that a text of ``length`` shares at least with any near copy."""
    together = length * (1 + bound / (2 - bound))
    return F.greatest(F.lit(1), F.ceil((1.5 * bound - 1) * together - 1 - 1e-9))


def _counts(texts: list[str], width: int, buckets: int) -> np.ndarray:
    """How often each text holds the characters (``width`` 1) or bigrams (2) of each bucket."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), sizes)
    if width == 2:
        whole = rows[:-1] == rows[1:]
        codes, rows = (codes[:-1] * 31 + codes[1:])[whole], rows[:-1][whole]
    counted = np.bincount(rows * buckets + codes % buckets, minlength=len(texts) * buckets).reshape(-1, buckets)
    return counted.astype(np.uint8 if sizes.max() < 256 else np.int32)


def _may_reach(x: list[str], y: list[str], bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and ``y`` of the pairs whose score may reach ``bound``: no pair that does is missing."""
    n, m = np.array([len(t) for t in x]), np.array([len(t) for t in y])
    a, b = _counts(x, 1, CHARACTERS), _counts(y, 1, CHARACTERS)
    shared = np.zeros((len(x), len(y)), np.promote_types(a.dtype, b.dtype))
    for k in np.flatnonzero(a.any(axis=0) & b.any(axis=0)):
        shared += np.minimum(a[:, k, None], b[None, :, k])
    # a shared bigram is a shared character too, so this holds for either score
    left, right = np.nonzero(2.0 * shared >= bound * (n[:, None] + m[None, :] - 2) - 1e-9)
    a, b, kept = _counts(x, 2, BIGRAMS), _counts(y, 2, BIGRAMS), []
    for at in range(0, len(left), AT_ONCE):
        i, j = left[at : at + AT_ONCE], right[at : at + AT_ONCE]
        both, total, chars = np.minimum(a[i], b[j]).sum(axis=1, dtype=np.int64), n[i] + m[j], 2.0 * shared[i, j]
        by_matcher = (chars >= bound * total - 1e-9) & (both >= 1.5 * bound * total - total - 1 - 1e-9)
        alike_long = np.minimum(n[i], m[j]) >= (bound / (2 - bound) - 1e-9) * np.maximum(n[i], m[j])
        kept.append(alike_long & (by_matcher | (0.99 * 2 * both >= bound * (total - 2) - 1e-9)))
    hit = np.concatenate(kept) if kept else np.zeros(0, bool)
    return left[hit], right[hit]


def _cell_pairs(cell: pd.DataFrame, i: int, j: int, bound: float) -> Iterator[tuple[str, str, str, str]]:
    """``a, b, letters_a, letters_b`` of a cell's pairs (a < b) that may reach ``bound``."""
    rows = list(zip(cell["key"], cell["letters"], cell["block"], strict=True))
    one = [r for r in rows if r[2] == i]
    two = one if i == j else [r for r in rows if r[2] == j]
    if len(one) * len(two) <= 64:
        met = combinations(one, 2) if i == j else product(one, two)
        near = ((p, q) for p, q in met if 2 * kept_shared(p[1], q[1]) >= bound * (len(p[1]) + len(q[1]) - 2) - 1e-9)
    else:
        left, right = _may_reach([r[1] for r in one], [r[1] for r in two], bound)
        near = ((one[x], two[y]) for x, y in zip(left.tolist(), right.tolist(), strict=True) if i != j or x < y)
    for p, q in near:
        (a, x, _), (b, y, _) = (p, q) if p[0] < q[0] else (q, p)
        yield a, b, x, y


def near_copies(lines: DataFrame, group: str, bound: float, least: int) -> DataFrame:
    """``group, a, b, similarity`` (a < b) of all pairs of a group's different ``key`` that reach ``bound``.

    ``least``: the fewest letters of a line that takes part. The lines are few characters long; a group may be any number.
    """
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes make much work here
    said = lines.select(group, "key").distinct().select(group, "key", text.compact(F.col("key")).alias("letters"))
    said = said.withColumn("script", F.concat(F.col("letters").rlike("[一-鿿]").cast("int"), F.col("letters").rlike("[a-z]").cast("int"))).where(F.length("letters") >= least)
    said = said.withColumn("n", F.length("letters"))
    line = [group, "key", "letters", "script", "n"]
    grams = said.select(*line, F.explode(fuzzy.bigrams(F.col("letters"))).alias("gram")).groupBy(*line, "gram").agg(F.count("*").alias("times"))
    grams = grams.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("time")).drop("times")
    rarity = grams.groupBy("gram").agg(F.count("*").alias("seen"))
    ordered = grams.join(rarity, "gram").groupBy(*line).agg(F.sort_array(F.collect_list(F.struct("seen", "gram", "time"))).alias("all"))
    first = F.slice("all", F.lit(1), F.greatest(F.lit(1), F.col("n") - _shared_least(F.col("n"), bound)).cast("int"))
    prefix = written(ordered.select(group, "key", "letters", "script", F.explode(first).alias("g")).select(group, "key", "letters", "script", "g.gram", "g.time"), "prefixes")
    token = [group, "script", "gram", "time"]
    blocks = prefix.groupBy(*token).agg(F.count("*").alias("held")).where("held > 1").select(*token, F.ceil(F.col("held") / CELL).alias("blocks"))
    dealt = prefix.join(blocks, token).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    dealt = dealt.select(*token, "key", "letters", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cell = [*token, "i", "j"]
    dealt = dealt.select(*token, "key", "letters", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held = [group, "a", "b", "letters_a", "letters_b"], None

        def found(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for (of, _, _, _, i, j), some in rows.groupby(cell, sort=False):
                out = [(of, *p) for p in _cell_pairs(some, i, j, bound)]
                if out:
                    yield pd.DataFrame(out, columns=names)

        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[cell] == rows[cell].iloc[-1]).all(axis=1)
            yield from found(rows[~last])
            held = rows[last]  # its cell may go on in the next batch
        if held is not None:
            yield from found(held)

    kind = said.schema[group].dataType.simpleString()
    sorted_cells = dealt.repartition(tasks, *cell).sortWithinPartitions(*cell)
    met = written(sorted_cells.mapInPandas(pairs, f"{group} {kind}, a string, b string, letters_a string, letters_b string").distinct(), "met-lines")

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([Likeness.alike(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    texts = ["letters_a", "letters_b"]
    scores = met.select(*texts).repartition(tasks, *texts).distinct().withColumn("similarity", alike(*texts)).where(F.col("similarity") >= bound)
    return met.join(scores, texts).select(group, "a", "b", "similarity", F.length("letters_a").alias("n"), F.length("letters_b").alias("m"))


def families(places: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """The lines that are overlays, and the near copies that they were found by.

    ``group, key, family`` (its least key), ``joined`` (0: of the family itself, else the round in which a looser near
    copy joined it), ``n_cues, seconds`` of the family. A family is a component of near copies that stands on ``CUES``
    cues or more over ``SECONDS`` or more.
    """
    places, pairs = written(places, "line-places"), written(near_copies(places, group, KIN, KIN_LEAST), "near-lines")
    strict = pairs.where((F.col("similarity") >= SAME) & (F.least("n", "m") >= LEAST) & (F.least("n", "m") >= SAME * F.greatest("n", "m")))
    roots = components(strict, group).withColumnRenamed("id", "key")
    rooted = places.join(roots, [group, "key"], "left").withColumn("family", F.coalesce("component", "key"))
    told = rooted.groupBy(group, "family").agg(F.countDistinct("id").alias("n_cues"), F.round(F.max("end_time") - F.min("start_time"), 3).alias("seconds"))
    told = told.where((F.col("n_cues") >= CUES) & (F.col("seconds") >= SECONDS))
    members = rooted.select(group, "key", "family").distinct().join(told, [group, "family"])
    return members.select(group, "key", "family", F.lit(0).alias("joined"), "n_cues", "seconds"), pairs


def with_kin(members: DataFrame, pairs: DataFrame, places: DataFrame, group: str) -> DataFrame:
    """:func:`families` and the looser near copies of their lines, which join the first family that has one.

    Lines come in the order of their first cue and place in it; families in that of their first line. A line sees
    the lines of families and what joined before it, so each round settles the lines whose earlier neighbours are settled.
    """
    first = places.groupBy(group, "key").agg(F.min(F.struct("start_time", "id", "k")).alias("first"))
    rank = members.join(first, [group, "key"]).groupBy(group, "family").agg(F.min("first").alias("rank"))
    both = pairs.select(group, F.col("a").alias("key"), F.col("b").alias("other")).unionAll(pairs.select(group, "b", "a"))
    # only lines that aren't in a family can join one
    open_ = both.join(members.select(group, "key"), [group, "key"], "left_anti").join(first, [group, "key"]).join(first.select(group, F.col("key").alias("other"), F.col("first").alias("came")), [group, "other"])
    base = members.select(group, F.col("key").alias("other"), "family").join(rank, [group, "family"])
    held = open_.join(base, [group, "other"]).groupBy(group, "key").agg(F.min(F.struct("rank", "family")).alias("best"))
    held = written(held.select("*", F.lit(1).alias("joined")), "kin")
    later = written(open_.join(members.select(group, F.col("key").alias("other")), [group, "other"], "left_anti").where("came < first").select(group, "key", "other"), "kin-links")
    step = 1
    while True:
        step += 1
        seen = later.join(held.select(group, F.col("key").alias("other"), "best"), [group, "other"]).groupBy(group, "key").agg(F.min("best").alias("near"))
        new = held.select(group, "key", "best", "joined").join(seen, [group, "key"], "full").select(group, "key", F.least("best", "near").alias("best"), F.when(F.col("best").isNull() | (F.col("near") < F.col("best")), step).otherwise(F.col("joined")).alias("joined"))
        held = written(new, "kin")
        if not held.where(F.col("joined") == step).limit(1).count():
            break
    told = members.select(group, "family", "n_cues", "seconds").distinct()
    more = held.select(group, "key", F.col("best.family").alias("family"), "joined").join(told, [group, "family"])
    return members.unionByName(more)


def without_lines(cues: DataFrame, group: str, cue_text: str, gone: DataFrame) -> DataFrame:
    """CL2: cues without the lines whose key is in ``gone``; cues that have no line left go."""
    shown = cues.select(group, "id", F.posexplode(text.lines(F.col(cue_text))).alias("k", "line")).withColumn("key", text.normalized(F.col("line")))
    kept = shown.join(gone.select(group, "key").distinct(), [group, "key"], "left_anti").groupBy(group, "id").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("kept"))
    return cues.join(kept, [group, "id"]).withColumn(cue_text, F.array_join(F.col("kept.line"), "\n")).select(*cues.columns)
