"""Toxicity by a counterfactual-regularised linear classifier.

A text's features are its distinct words (letters, lower-cased), those kept whose presence
differs between the labels of the training documents by ``LEAST_Z`` standard errors or more.
Logistic regression is fitted with a ridge and one more penalty: every training sentence
that holds identity terms is copied with each term swapped for the next of its group, and
the squared change of its score is charged. Identity terms are always features, so what the
labels alone would pin on a neutral mention is taken back.

Fitting uses at most ``max_rows`` labelled documents (the first by a hash of their id) outside the
held-out fold. Their words are counted by label in the engine; at most ``MAX_FEATURES`` features and what each
document holds of them reach the driver, however long the texts. Scoring reads whole texts and grows by
map tasks alone: no shuffle.

Edge cases: null and empty texts get the score of no feature; labels other than 0 and 1 are
ignored, for a document labelled twice the higher counts; without both labels in the sample every
score is their share (0.0 without labels); a null id counts as held out; rows may repeat; other
columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_or_empty, written
from .labelled import MAX_ROWS, sample

#: Identity terms by group; a swap takes the next one of the group (fixed values).
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"), ("mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("madre", "padre"), ("musulmanes", "cristianos", "judíos"), ("negro", "blanco"), ("inmigrantes", "ciudadanos"),
    ("femmes", "hommes"), ("femme", "homme"), ("mère", "père"), ("musulmans", "chrétiens", "juifs"), ("noir", "blanc"), ("immigrés", "citoyens"),
    ("frauen", "männer"), ("frau", "mann"), ("mutter", "vater"), ("muslime", "christen", "juden"), ("schwarze", "weiße"), ("einwanderer", "bürger"),
)
LEAST_Z, LEAST_ROWS, MAX_FEATURES, BITS = 5.0, 4, 2048, 22

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_SWAP = {w: g[(k + 1) % len(g)] for g in IDENTITY for k, w in enumerate(g)}
_ANY = re.compile(r"\b(?:" + "|".join(sorted(_SWAP, key=len, reverse=True)) + r")\b", re.I)


def place(word: str) -> int:
    return zlib.crc32(word.encode()) >> (32 - BITS)


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def scorer(self):
        """text -> score, with the weights of words met so far."""
        known: dict[str, float] = {}

        def weight(word: str) -> float:
            got = known.get(word)
            if got is None:
                if len(known) > 500_000:
                    known.clear()
                got = known[word] = self.weights.get(place(word), 0.0)
            return got

        def score(text: str) -> float:
            s = self.bias + sum(map(weight, set(_WORD.findall(text.lower()))))
            return float(1 / (1 + np.exp(-np.clip(s, -40, 40))))

        return score


def _training_rows(texts: DataFrame) -> DataFrame:
    """Each document's distinct word hashes and its swapped sentences' changes: no text leaves the executors."""

    def run(batches):
        for batch in batches:
            words, before, after = [], [], []
            for text in batch.column(1).to_pylist():
                low = text.lower()
                words.append(sorted({place(w) for w in _WORD.findall(low)}))
                old, new = set(), set()
                if _ANY.search(low):
                    for s in _SENTENCE.split(low):
                        if _ANY.search(s):
                            old |= {place(w) for w in _WORD.findall(s)}
                            new |= {place(w) for w in _WORD.findall(_ANY.sub(lambda m: _SWAP[m[0].lower()], s))}
                before.append(sorted(old - new))
                after.append(sorted(new - old))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(x, pa.list_(pa.int32())) for x in (words, before, after))], names=["doc_id", "label", "key", "words", "before", "after"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "label", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, label int, key long, words array<int>, before array<int>, after array<int>")


def features(rows: DataFrame) -> list[int]:
    """Places of the words whose presence differs most between the labels, and of all identity terms.

    A copied text counts once. One map-side combined count; at most ``MAX_FEATURES`` rows come back.
    """
    single = rows.select("label", "words", "key").dropDuplicates(["key"])
    n, share = single.agg(F.count("*"), F.avg("label")).first()
    always = {place(w) for w in _SWAP}
    if not n or share in (0.0, 1.0):
        return sorted(always)
    counts = single.select("label", F.explode("words").alias("place")).groupBy("place").agg(F.count("*").alias("count"), F.sum("label").alias("toxic"))
    aim = F.col("count") * share
    z = F.abs((F.col("toxic") - aim) / F.sqrt(aim * (1 - share)))
    best = counts.withColumn("z", z).where((F.col("z") >= LEAST_Z) & (F.col("count") >= LEAST_ROWS)).orderBy(F.col("z").desc(), "place").limit(MAX_FEATURES)
    return sorted(always | {r["place"] for r in best.select("place").collect()})


def _sparse(parts: list[list[int]], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of what is a feature."""
    flat = np.asarray([p for part in parts for p in part], np.int64)
    rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    cols = np.minimum(np.searchsorted(kept, flat), len(kept) - 1)
    known = kept[cols] == flat
    return rows[known], cols[known]


def fit_rows(y: np.ndarray, words: list[list[int]], before: list[list[int]], after: list[list[int]], kept: np.ndarray, *, ridge: float = 0.5, swap_penalty: float = 20.0, steps: int = 400) -> Model:
    n, n1 = len(y), int(y.sum())
    if not n or n1 in (0, n):
        share = n1 / n if n else 0.0
        return Model(40.0 if share == 1 else -40.0, {})
    rows, cols = _sparse(words, kept)
    out, into = _sparse(before, kept), _sparse(after, kept)
    d_rows = np.concatenate([out[0], into[0]])
    d_cols, d_sign = np.concatenate([out[1], into[1]]), np.concatenate([np.ones(len(out[1])), -np.ones(len(into[1]))])
    w, b, m, v = np.zeros(len(kept) + 1), 0.0, np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    b = float(np.log(y.mean() / (1 - y.mean())))
    w[-1] = b
    for t in range(1, steps + 1):
        s = np.bincount(rows, w[cols], n) + w[-1]
        r = 1 / (1 + np.exp(-np.clip(s, -40, 40))) - y
        g = np.append(np.bincount(cols, r[rows], len(kept)) + ridge * w[:-1], r.sum())
        if len(d_cols):
            change = np.bincount(d_rows, d_sign * w[d_cols], n)
            g[:-1] += swap_penalty * np.bincount(d_cols, d_sign * change[d_rows], len(kept))
        g /= n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(w[-1]), {int(p): float(x) for p, x in zip(kept, w[:-1], strict=True) if x})


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", max_rows: int = MAX_ROWS, swap_penalty: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = written(_training_rows(sample(docs, labels, label_col, max_rows=max_rows, only=fold("doc_id") != 0, id_col=id_col, text_col=text_col)), "toxicity-rows")
    kept = features(rows)
    known = F.array(*map(F.lit, kept))
    held = rows.select("doc_id", "label", *[F.array_intersect(c, known).alias(c) for c in ("words", "before", "after")]).collect()  # bounded by max_rows and the features
    held.sort(key=lambda r: (r["doc_id"], r["words"], r["label"]))
    return fit_rows(np.asarray([r["label"] for r in held], float), *([r[c] for r in held] for c in ("words", "before", "after")), np.asarray(kept, np.int64), swap_penalty=swap_penalty)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``."""

    def run(batches):
        one = model.scorer()
        for batch in batches:
            s = np.asarray([one(t) for t in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == 0).alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more."""
    at = docs.columns.index(text_col)

    def run(batches):
        one = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([one(t or "") < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_rows(docs, run)
