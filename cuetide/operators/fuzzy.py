"""Fuzzy scores of pairs of texts, as columns; the sequence matcher and counts of bigrams run in Arrow batches."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, containment_ratio, lines, nfkc

#: The weights of the combined scores and the longest line that weighs more than a shorter one.
BIGRAMS, WHOLE, LINES, HELD, LONGEST_WEIGHT = 0.99, 0.55, 0.45, 0.98, 40
#: Cells of the largest table of runs, of two bytes.
MOST_CELLS = 1 << 22


def matched(a: str, b: str) -> float:
    """``SequenceMatcher(None, a, b, autojunk=False).ratio()``; both empty 1, one empty 0.

    A table of the runs of equal characters from each two places on makes each longest block a maximum over a part of
    it, the first one by ``a``, then by ``b``, as the matcher takes it; texts of too large a table go to the matcher.
    """
    if not a or not b or a == b:
        return float(a == b)
    if len(a) * len(b) > MOST_CELLS:
        return SequenceMatcher(None, a, b, autojunk=False).ratio()
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    same, run = (x[:, None] == y).astype(np.int16), np.zeros((len(a) + 1, len(b) + 1), np.int16)
    for i in range(len(a) - 1, -1, -1):
        np.multiply(run[i + 1, 1:] + 1, same[i], out=run[i, :-1])
    down = np.minimum(np.arange(max(len(a), len(b)), 0, -1), 1 << 14).astype(np.int16)  # no run is longer than the shorter text
    size, parts = 0, [(0, len(a), 0, len(b))]
    while parts:
        a0, a1, b0, b1 = parts.pop()
        # a run ends where its part does
        held = np.minimum(np.minimum(run[a0:a1, b0:b1], down[len(down) - (b1 - b0) :]), down[len(down) - (a1 - a0) :, None])
        i, j = divmod(int(held.argmax()), b1 - b0)
        k = int(held[i, j])
        if k:
            size += k
            parts += [p for p in ((a0, a0 + i, b0, b0 + j), (a0 + i + k, a1, b0 + j + k, b1)) if p[0] < p[1] and p[2] < p[3]]
    return 2.0 * size / (len(a) + len(b))


def shared_bigrams(a: str, b: str) -> float | None:
    """Dice coefficient of the bigrams of two texts, with multiplicity; None if one is shorter than a bigram."""
    if len(a) < 2 or len(b) < 2:
        return None
    x, y = (Counter(zip(s, s[1:], strict=False)) for s in (a, b))
    return 2.0 * sum(min(n, y[g]) for g, n in x.items() if g in y) / (len(a) + len(b) - 2)


def sequence(a: Column, b: Column) -> Column:
    """Matcher ratio of two compact texts; both empty 1, one empty 0."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else matched(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def bigrams(text: Column) -> Column:
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda k: F.substring(text, k, F.lit(2)))
    return F.when(F.length(text) > 1, some).otherwise(F.array().cast("array<string>"))


def dice_of(a: Column, b: Column) -> Column:
    """Dice coefficient of the bigrams of two short compact texts of one row, with multiplicity; null below a bigram.

    Each different bigram of ``a`` is counted in both lists, so this is for lines; whole texts go by :func:`dice`.
    """
    x, y = bigrams(a), bigrams(b)
    count = lambda some, g: F.size(F.filter(some, lambda v: v == g))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, g: n + F.least(count(x, g), count(y, g)))
    return F.when((F.length(a) > 1) & (F.length(b) > 1), 2.0 * shared / (F.length(a) + F.length(b) - 2))


def dice(pairs: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """``key, dice``: shared bigrams of two compact texts with multiplicity; null if one is shorter than a bigram.

    Counted row by row, so nothing is shuffled and a row costs no more than its texts' length.
    """

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else shared_bigrams(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return pairs.select(key, run(F.col(a), F.col(b)).alias("dice"))


def _compact_lines(text: Column) -> Column:
    """The compact forms of a text's lines; they go through NFKC as one text, as it keeps line feeds."""
    some = lines(text)
    shown = F.transform(F.split(nfkc(F.array_join(some, "\n")), "\n"), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", ""))
    return F.when(F.size(some) > 0, shown).otherwise(F.array().cast("array<string>"))


def _robust(a: str, b: str) -> float:
    ratio, grams = matched(a, b), shared_bigrams(a, b)
    return max(ratio, BIGRAMS * (ratio if grams is None else grams))


def _by_lines(x, y) -> float | None:
    """Both ways' mean of each line's best match, weighted by its length up to ``LONGEST_WEIGHT``."""
    if x is None or y is None or not len(x) or not len(y):
        return None
    met = {p: _robust(*p) for p in set(product(x, y))}

    def one_way(some, others, at):
        weights = [max(1, min(LONGEST_WEIGHT, len(p))) for p in some]
        return sum(w * max(met[(p, q) if at else (q, p)] for q in others) for w, p in zip(weights, some, strict=True)) / sum(weights)

    return (one_way(x, y, True) + one_way(y, x, False)) / 2


def state_scores(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, sequence, dice, robust, lines, containment, state`` of pairs of texts.

    ``lines`` averages both ways the best match of each line, weighted by its length up to ``LONGEST_WEIGHT``. Each row
    is scored where it lies, each two texts and each two different lines once.
    """

    @F.pandas_udf("sequence double, dice double, lines double")
    def run(p: pd.Series, q: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for s, t, some, others in zip(p, q, x, y, strict=True):
            known = s is not None and t is not None
            rows.append((matched(s, t) if known else None, shared_bigrams(s, t) if known else None, _by_lines(some, others) if known else None))
        return pd.DataFrame(rows, columns=["sequence", "dice", "lines"], dtype="float64")

    whole = pairs.select(key, compact(F.col(a)).alias("a"), compact(F.col(b)).alias("b"), _compact_lines(F.col(a)).alias("x"), _compact_lines(F.col(b)).alias("y"))
    scores = whole.select(key, run("a", "b", "x", "y").alias("of"), containment_ratio(F.col("a"), F.col("b")).alias("containment"))
    scores = scores.select(key, "containment", "of.sequence", F.coalesce("of.dice", "of.sequence").alias("dice"), "of.lines")
    out = scores.withColumn("robust", F.greatest("sequence", BIGRAMS * F.col("dice"))).withColumn("lines", F.coalesce("lines", "robust"))
    return out.select(key, "sequence", "dice", "robust", "lines", "containment", F.greatest("robust", WHOLE * F.col("robust") + LINES * F.col("lines"), HELD * F.col("containment")).alias("state"))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over words by the reference's number of words; an empty reference: 0 if the other is empty too, else 1.

    Words become single characters, the same for equal words of a pair, and the engine's edit distance does the rest.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    a, b = words(reference), words(hypothesis)
    known = F.array_distinct(F.concat(a, b))
    # one unit of UTF-16 from U+1000 on, below the surrogates: 51 199 different words in a pair of texts
    letter = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 4095), 4, "0")), "UTF-16BE")
    coded = lambda x: F.array_join(F.transform(x, letter), "")
    most = F.when(F.size(known) > 51_199, F.raise_error(F.lit("too many different words")).cast("double"))
    empty = F.when(F.size(b) == 0, 0.0).otherwise(1.0)
    return F.when(F.size(a) == 0, empty).otherwise(F.coalesce(most, F.levenshtein(coded(a), coded(b)) / F.size(a)))
