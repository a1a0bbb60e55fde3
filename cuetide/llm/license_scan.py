"""Licences in texts: rolling word k-grams vote for diagonals of known texts.

1. Texts become word numbers of the templates' vocabulary. A word of no template matches nothing, so a document is
   kept as its stretches of known words; they are written once, with a row number.
2. The hashes of all rolling k-grams of the stretches are joined to the templates' places (a table as small as the
   templates, so it is broadcast). Phrases have k = 2, passages k = 5.
3. Hits are summed by (document, template, diagonal); the diagonal is the document's place less the template's.
4. Neighbouring diagonals of a passage (up to ``drift`` words apart: words put in or left out) make one span.
5. Each span is verified on the words: a phrase must stand there whole, of a passage ``share`` of its words must lie
   on the span's diagonals, over a span that isn't longer than its words by more than the same share.

Templates are a parameter, at most ``MAX_WORDS`` words in all (an error beyond).

Skew: rows are keyed by document and template; a frequent passage is as many groups as documents hold it.

Edge cases: a null or empty text has no words, no labels and score 0; a null id stays null; repeated rows are rows of
their own; an empty table gives none; further columns are not looked at.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .license_texts import PASSAGES, PHRASES

#: Words of all templates together; their places are broadcast.
MAX_WORDS = 50_000
#: ASCII letters and digits stay (capitals lowered), other ASCII parts words, other bytes stay.
_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


class Templates:
    """Phrases (``exact``) and passages as numbers of their words, from 1; 0 is any other word."""

    def __init__(self, phrases: list[tuple[str, str]], passages: list[tuple[str, str]]):
        self.labels = [label for label, _ in (*phrases, *passages)]
        self.exact = [True] * len(phrases) + [False] * len(passages)
        words = [words_of(t.encode()) for _, t in (*phrases, *passages)]
        if sum(map(len, words)) > MAX_WORDS:
            raise ValueError(f"templates may have {MAX_WORDS} words in all")
        if any(len(w) < (2 if e else 5) for w, e in zip(words, self.exact, strict=True)):
            raise ValueError("a phrase has two words or more, a passage five")
        self.number = {w: k + 1 for k, w in enumerate(sorted({x for t in words for x in t}))}
        self.ids = [[self.number[x] for x in t] for t in words]


def stretches(docs: DataFrame, templates: Templates, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, parts``: each document's stretches of two or more known words, with their first place."""
    number = templates.number

    def run(batches):
        for batch in batches:
            sizes, counts, starts, lengths, flat = [], [], [], [], []
            for text in batch.column(1):
                words = words_of(text.as_buffer().to_pybytes())
                ids = np.fromiter(map(number.get, words, repeat(0)), np.int32, len(words))
                known = np.concatenate([[False], ids > 0, [False]])
                edge = np.flatnonzero(known[1:] != known[:-1])
                first, last = edge[::2], edge[1::2]
                long = last - first >= 2
                first, last = first[long], last[long]
                sizes.append(len(words))
                counts.append(len(first))
                starts.append(first)
                lengths.append(last - first)
                flat += [ids[a:b] for a, b in zip(first, last, strict=True)]
            if not sizes:
                continue
            at = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
            words = pa.ListArray.from_arrays(at(np.concatenate(lengths)), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
            parts = pa.StructArray.from_arrays([pa.array(np.concatenate(starts).astype(np.int64)), words], names=["start", "ids"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at(counts), parts)], names=["doc_id", "n_words", "parts"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, parts array<struct<start: long, ids: array<int>>>")


def _grams(ids: Column, k: int) -> Column:
    """The hashes of all rolling ``k``-grams, in turn."""
    places = F.sequence(F.lit(1), F.greatest(F.size(ids) - (k - 1), F.lit(1)))
    return F.when(F.size(ids) >= k, F.transform(places, lambda i: F.xxhash64(F.slice(ids, i, k))))


def hits(rows: DataFrame, templates: Templates) -> DataFrame:
    """``row, template, diagonal, votes``: the join of all k-grams with the templates' places, summed by diagonal."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(t, exact, ids) for t, (exact, ids) in enumerate(zip(templates.exact, templates.ids, strict=True))], "template int, exact boolean, ids array<int>")
    parts = rows.select("row", F.explode("parts").alias("p")).select("row", "p.start", "p.ids")
    out = None
    for k, exact in ((2, True), (5, False)):
        places = known.where(F.col("exact") == exact).select("template", F.posexplode(_grams(F.col("ids"), k)).alias("place", "gram"))
        seen = parts.select("row", "start", F.posexplode(_grams(F.col("ids"), k)).alias("at", "gram"))
        met = seen.join(F.broadcast(places), "gram").select("row", "template", (F.col("start") + F.col("at") - F.col("place")).alias("diagonal"))
        out = met if out is None else out.unionAll(met)
    return out.groupBy("row", "template", "diagonal").agg(F.count("*").alias("votes"))


def spans(votes: DataFrame, templates: Templates, drift: int) -> DataFrame:
    """Per document its candidate spans ``row, found: array<struct<template, diagonals>>``; a phrase's are single."""
    exact = [k for k, e in enumerate(templates.exact) if e]
    order = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("template").isin(exact) | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > drift, F.lit(True))
    span = F.sum(apart.cast("int")).over(order)
    need = F.when(F.col("template").isin(exact), F.element_at(F.array(*[F.lit(len(x) - 1) for x in templates.ids]), F.col("template") + 1)).otherwise(F.lit(1))
    merged = votes.where(F.col("votes") >= need).withColumn("span", span).groupBy("row", "template", "span").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    return merged.groupBy("row").agg(F.collect_list(F.struct("template", "diagonals")).alias("found"))


def aligned(words: dict[int, np.ndarray], ids: np.ndarray, diagonals: list[int]) -> tuple[int, int, int]:
    """How many template words lie on the diagonals, and the first and last place of the document that they take."""
    m = len(ids)
    low, high = diagonals[0], diagonals[-1] + m
    text = np.zeros(high - low, np.int64)
    for start, part in words.items():
        a, b = max(start, low), min(start + len(part), high)
        if a < b:
            text[a - low : b - low] = part[a - start : b - start]
    hit = np.stack([text[d - low : d - low + m] == ids for d in diagonals])
    # a word that only happens to agree has no neighbour on its diagonal that agrees too
    beside = np.zeros_like(hit)
    beside[:, 1:] |= hit[:, :-1]
    beside[:, :-1] |= hit[:, 1:]
    hit &= beside
    if not hit.any():
        return 0, 0, 0
    row, col = np.nonzero(hit)
    places = np.asarray(diagonals)[row] + col
    return int(hit.any(axis=0).sum()), int(places.min()), int(places.max()) + 1


def verified(rows: DataFrame, found: DataFrame, templates: Templates, share: float) -> DataFrame:
    """``row, template, start, length, score`` of the spans that hold on the words themselves."""
    ids = [np.asarray(x) for x in templates.ids]
    exact = templates.exact

    def run(batches):
        for batch in batches:
            out = []
            for row, parts, cands in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = {p["start"]: np.asarray(p["ids"]) for p in parts}
                for c in cands:
                    t = c["template"]
                    m, (same, first, last) = len(ids[t]), aligned(words, ids[t], c["diagonals"])
                    score = same / max(m, last - first, 1)
                    if same == m == last - first if exact[t] else score >= share:
                        out.append((row, t, first, last - first, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["row", "template", "start", "length", "score"])

    both = rows.join(found, "row").select("row", "parts", "found")
    return both.mapInArrow(run, "row long, template int, start long, length long, score double")


def scan(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, passages: list[tuple[str, str]] | None = None, *, drift: int = 8, share: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document.

    ``doc_id, n_words, n_base, first_word, last_word`` (places of phrases), ``base_labels, labels`` (of phrases; of
    all spans), ``score`` (of the best span) and ``spans`` (label, whether a phrase, first word, words, score).
    """
    templates = Templates(PHRASES if phrases is None else phrases, PASSAGES if passages is None else passages)
    rows = written(stretches(docs, templates, id_col=id_col, text_col=text_col).withColumn("row", F.monotonically_increasing_id()), "stretches")
    good = verified(rows, spans(hits(rows, templates), templates, drift), templates, share)
    label = F.element_at(F.array(*map(F.lit, templates.labels)), F.col("template") + 1)
    base = F.element_at(F.array(*map(F.lit, templates.exact)), F.col("template") + 1)
    good = good.select("row", label.alias("label"), base.alias("base"), "start", "length", "score")
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    told = good.groupBy("row").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        names(F.when(F.col("base"), F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"), F.max("score").alias("score"), F.sort_array(F.collect_list(F.struct("start", "length", "label", "base", "score"))).alias("spans"),
    )
    none = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return rows.select("row", "doc_id", "n_words").join(told, "row", "left").select("doc_id", "n_words", none("n_base", 0), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0), "spans")
