"""Text functions over columns, on code points; all stay in the engine."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def character_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance / reference length; an empty reference: 0 if the other is empty too, else 1."""
    empty = F.when(F.length(hypothesis) == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(F.length(reference) == 0, empty).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def overlap_length(previous: Column, current: Column) -> Column:
    """The most characters that end ``previous`` and start ``current``."""
    most = F.least(F.length(previous), F.length(current))
    sizes = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda k: F.substring(previous, F.length(previous) - k + 1, k) == F.substring(current, F.lit(1), k))
    return F.coalesce(F.array_max(fits), F.lit(0))


def nfkc(text: Column) -> Column:
    """Compatibility composition, which the engine lacks, in Arrow batches."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x) for x in rows])

    return run(text)


def normalized(text: Column) -> Column:
    """NFKC, lower case, long dashes as hyphens, runs of white space as one space, none at the ends."""
    plain = F.translate(F.lower(nfkc(text)), "—–", "--")
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", " "), "^ | $", "")


def compact(text: Column) -> Column:
    """The normalised text's letters and digits only."""
    return F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]", "")


def script_profile(text: Column) -> Column:
    """``han, latin``: whether the compact text holds either."""
    c = compact(text)
    return F.struct(c.rlike("[一-鿿]").alias("han"), c.rlike("[a-z]").alias("latin"))


def containment_ratio(a: Column, b: Column) -> Column:
    """Of two compact texts: shorter over longer length if one text holds the other, else 0."""
    holds = (F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a))
    return F.when(holds, F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(F.lit(0.0))


def multiset_similarity(a: Column, b: Column) -> Column:
    """Of two compact texts: twice the shared characters, with multiplicity, over all characters; both empty: 1."""
    chars = F.array_distinct(F.split(a, ""))
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda s, c: s + F.least(count(a, c), count(b, c)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(shared * 2.0 / total)


def lines(text: Column) -> Column:
    """Trimmed lines that are not empty, cut at every line end of Unicode and at information separators."""
    parts = F.split(text, r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def without_repeated_lines(text: Column) -> Column:
    """Each line once, where its normalised form is first seen; null: empty.

    Lines are sorted by their forms, so equal ones are neighbours, and the first ones back by place. The sorted array is
    bound to a variable: an expression inside a function of elements would be worked out for each of them.
    """
    key = lambda x: F.regexp_replace(F.translate(F.lower(x), "—–", "--"), r"(?U)\s+", " ")
    held = F.sort_array(F.transform(lines(text), lambda x, k: F.struct(key(x).alias("key"), k.alias("k"), x.alias("line"))))
    firsts = F.get(F.transform(F.array(held), lambda t: F.filter(t, lambda x, i: (i == 0) | (x["key"] != F.get(t, i - 1)["key"]))), F.lit(0))
    shown = F.sort_array(F.transform(firsts, lambda x: F.struct(x["k"].alias("k"), x["line"].alias("line"))))
    return F.coalesce(F.array_join(F.transform(shown, lambda x: x["line"]), "\n"), F.lit(""))


def dominant_script(text: Column) -> Column:
    """kana before all; han with Latin is undecided (null); then han, latin, null."""
    kana, han, latin = (text.rlike(p) for p in ("[぀-ヿ]", "[一-鿿]", "[A-Za-z]"))
    return F.when(kana, "kana").when(han & latin, F.lit(None).cast("string")).when(han, "han").when(latin, "latin")


def clock(seconds: Column) -> Column:
    """``HH:MM:SS``, truncated."""
    s = F.floor(seconds).cast("long")
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", part(F.floor(s / 3600)), part(F.floor(s / 60) % 60), part(s % 60))


def subtitle_time(seconds: Column, mark: str = ",") -> Column:
    """``HH:MM:SS,mmm`` from seconds rounded half-even to milliseconds."""
    ms = F.bround(seconds * 1000, 0).cast("long")
    return F.concat(clock(F.floor(ms / 1000)), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))
