"""URL filters by a cascade of Bloom filters, in DataFrame operations only.

Listed keys are rule strings (``host`` and the start of a path). A page's keys are all pairs
of a suffix of its host (by label) and a start of its path as long as some rule's path; the
corpus's key universe is the set of those. Level 1 encodes the listed keys, level 2 those keys of
the whole universe that are not listed and still pass level 1, level 3 the listed keys that
pass level 2, and so on until nothing passes. Within that universe membership is exact, and
a page is judged by probing bits: no join, no list in the plan.

Size: level 1 gets enough bits a key that only about as many of the universe's keys pass as
are listed, so every level is proportional to the list, whatever the corpus; the list is a
literal argument, at most ``MAX_RULES`` long. Levels reach the executors as one-row
subqueries.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and gets
the default verdict; equal rules count once, block before allow; no rules: all get the default;
an empty table stays empty; other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

MAX_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every suffix of the host with every start of the path that is as long as one of ``lengths``."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat(h, p)))))


class Level:
    """One Bloom filter: ``bits`` in words of 64, in a one-row table."""

    def __init__(self, keys: DataFrame, n: int, rate: float, number: int):
        self.bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        self.hashes, self.number = max(1, round(-math.log2(rate))), number
        places = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("place"))
        words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("cast(place & 63 as int)"))).alias("bits"))
        every = keys.sparkSession.range((self.bits + 63) // 64).withColumnRenamed("id", "word")  # as long as the filter itself
        row = every.join(words, "word", "left").agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))))["bits"].alias("words"))
        self.table = written(row, f"bloom-{number}")

    def _places(self, key: Column) -> list[Column]:
        h, step = F.shiftright(F.xxhash64(F.lit(self.number), key), 2), F.shiftright(F.xxhash64(key, F.lit(self.number)), 9)  # their sums can't overflow
        return [F.pmod(h + F.lit(j) * step, F.lit(self.bits)) for j in range(self.hashes)]

    def has(self, key: Column, words: Column) -> Column:
        found = F.lit(True)
        for place in self._places(key):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            found &= F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return found


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (both: a column ``key``)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        self.levels: list[Level] = []
        n = listed.count()
        if not n:
            return
        all_keys = max(1, universe.agg(F.approx_count_distinct("key")).first()[0])
        mine, other, first = listed, universe.join(F.broadcast(listed), "key", "left_anti"), True
        rate = min(0.5, 0.7 * n / all_keys)
        while n:
            level = Level(mine, n, rate, len(self.levels) + 1)
            self.levels.append(level)
            passing = other.withColumn("words", level.table.scalar()).where(level.has(F.col("key"), F.col("words"))).select("key")
            passing = written(passing.distinct() if first else passing, "cascade")
            mine, other, first, rate, n = passing, mine, False, 0.5, passing.count()

    def with_words(self, rows: DataFrame, prefix: str) -> DataFrame:
        """``rows`` with each level's words, one-row subqueries, as columns for :meth:`has`."""
        return rows.withColumns({f"{prefix}{k}": level.table.scalar() for k, level in enumerate(self.levels, 1)}) if self.levels else rows

    def has(self, key: Column, prefix: str) -> Column:
        """The last level that a key passes decides: an odd one holds listed keys."""
        inside = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            inside = F.when(self.levels[k - 1].has(key, F.col(f"{prefix}{k}")), inside).otherwise(F.lit(k % 2 == 0))
        return inside


def _listed(spark: SparkSession, keys: list[str]) -> DataFrame:
    if not keys:
        return spark.range(0).select(F.lit("").alias("key"))
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))


def judge(pages: DataFrame, allow: list[tuple[str, str]], block: list[tuple[str, str]], *, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict``: the longest rule that fits, else ``default``.

    A rule (host, start of a path) fits its host and all its subdomains.
    """
    if len(allow) + len(block) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, p in [*allow, *block]}) or [0]
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    lists = {"block": sorted({h + p for h, p in block})}
    lists["allow"] = sorted({h + p for h, p in allow}.difference(lists["block"]))
    cascades = {k: Cascade(_listed(spark, v), universe) for k, v in lists.items()}
    for name, cascade in cascades.items():
        keyed = cascade.with_words(keyed, name)
    hits = F.array_sort(F.filter(F.transform("keys", lambda k: F.struct((-F.length(k)).alias("rest"), k.alias("rule"), F.when(cascades["block"].has(k, "block"), "block").when(cascades["allow"].has(k, "allow"), "allow").alias("verdict"))), lambda x: x["verdict"].isNotNull()))
    best = F.get(hits, F.lit(0))
    return keyed.select("page_id", "host", "path", best.alias("best")).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
