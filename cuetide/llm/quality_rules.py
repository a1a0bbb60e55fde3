"""Quality rules as learned decision lists.

Statistics of every text are counted in one pass; a decision list over them is learned by
sequential covering: a rule, a conjunction of thresholds, grows condition by condition by
its information gain on two thirds of the labelled documents, loses its last conditions
while the other third judges it better without, and is kept if it is precise there; what
it covers is set aside before the next one. The list is emitted as ordered ``CASE WHEN`` of Spark,
so judging runs in the engine.

Learning uses at most ``max_rows`` labelled documents (the first by a hash of their id); only
their statistics reach the driver.

Edge cases: null and empty texts have no words, so the base rule fails them; without labels of
both kinds the list is empty and the base rule alone decides; rows may repeat; other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .labelled import MAX_ROWS, sample

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_ends", "n_distinct", "n_shout")
#: What rules may test: each is a quotient of counts, so the driver and Spark compute the same.
RATIOS = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "n_letters"), "digits": ("n_digits", "word_chars"), "sentence_ends": ("n_ends", "n_words"),
    "distinct": ("n_distinct", "n_words"), "line_words": ("n_words", "n_lines"), "shouts": ("n_shout", "n_words"), "letters": ("n_letters", "word_chars"),
}
_SPACE, _SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"


def repeat_words(words: list[bytes], known: dict) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids = np.asarray([known.setdefault(w, len(known)) for w in words], np.int64)
    size = len(known)
    if size < 2_000_000:  # else three ids don't fit 63 bits
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        keys = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1] * size + ids[2:]
    order = np.sort(keys)
    if not (order[1:] == order[:-1]).any():
        return 0
    again = np.unique(order[1:][order[1:] == order[:-1]])
    hit = np.isin(keys, again)
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= hit
    return int(cover.sum())


def counts(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on the ASCII white space that WORD names
    lines = [x for x in raw.split(b"\n") if x.strip()]
    known: dict[bytes, int] = {}
    repeats = repeat_words(words, known)
    upper = sum(map(str.isupper, text)) if not text.isascii() else sum(raw.count(bytes([c])) for c in range(65, 91))
    letters = sum(map(str.isalpha, text)) if not text.isascii() else upper + sum(raw.count(bytes([c])) for c in range(97, 123))
    digits = sum(raw.count(bytes([c])) for c in range(48, 58))
    chars = len(text) - sum(map(text.count, _SPACE))
    distinct = len(known) or len(set(words))
    return (len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), upper, letters, digits, sum(map(text.count, ".!?")), distinct, text.count("!"))


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and the counts of :data:`COUNTS`, of every whole text."""

    def run(batches):
        for batch in batches:
            got = np.asarray([counts(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + k) for k in range(len(extra))), *(pa.array(got[:, k]) for k in range(len(COUNTS)))], names=["doc_id", *extra, *COUNTS])

    kinds = [f"doc_id {docs.schema[id_col].dataType.simpleString()}", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra), *(f"{c} long" for c in COUNTS)]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *extra)
    return rows.mapInArrow(run, ", ".join(kinds))


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    value: float

    def column(self) -> Column:
        a, b = RATIOS[self.ratio]
        x = F.col(a).cast("double") if b is None else F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
        return x > self.value if self.above else x <= self.value


def ratios(rows: np.ndarray) -> np.ndarray:
    """The columns of :data:`RATIOS` from those of :data:`COUNTS`."""
    at = {c: rows[:, k].astype(float) for k, c in enumerate(COUNTS)}
    return np.stack([at[a] if b is None else np.divide(at[a], at[b], out=np.zeros(len(rows)), where=at[b] > 0) for a, b in RATIOS.values()], 1)


def learn(rows: np.ndarray, bad: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.8) -> list[list[Condition]]:
    """Ordered rules, each for ``bad`` documents."""
    x, names, out = ratios(rows), list(RATIOS), []
    left = np.ones(len(bad), bool)
    grow = np.arange(len(bad)) % 3 != 2
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65))) for j in range(x.shape[1])] if len(bad) else []
    holds = lambda j, above, t: x[:, j] > t if above else x[:, j] <= t
    while len(out) < max_rules and (left & bad & grow).sum() >= 3:
        rule, cover = [], left.copy()
        while len(rule) < max_conditions:
            p0, n0 = (cover & grow & bad).sum(), (cover & grow & ~bad).sum()
            if not n0:
                break
            best = None
            now = np.log2(p0 / (p0 + n0))
            for j, places in enumerate(cuts):
                for t in places:
                    for above in (True, False):
                        m = cover & grow & holds(j, above, t)
                        p = (m & bad).sum()
                        if p and (gain := p * (np.log2(p / m.sum()) - now)) > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, j, above, t)
            if best is None:
                break
            rule.append(best[1:])
            cover &= holds(*best[1:])
        worth = []
        for k in range(1, len(rule) + 1):
            m = left & ~grow
            for c in rule[:k]:
                m &= holds(*c)
            p, n = (m & bad).sum(), (m & ~bad).sum()
            worth.append(((p - n) / (p + n) if p + n else -1.0, k, p / (p + n) if p + n else 0.0))
        if not worth:
            break
        _, size, right = max(worth, key=lambda v: (v[0], -v[1]))
        if right < precision:
            break
        out.append([Condition(names[j], above, float(t)) for j, above, t in rule[:size]])
        gone = np.ones(len(bad), bool)
        for c in rule[:size]:
            gone &= holds(*c)
        left &= ~gone
    return out


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[list[Condition]]:
    rows = written(statistics(sample(docs, labels, label_col, max_rows=max_rows, id_col=id_col, text_col=text_col), extra=("label",)), "quality-rows")
    held = sorted(tuple(r) for r in rows.collect())  # bounded by max_rows
    if not held:
        return []
    order = np.random.default_rng(11).permutation(len(held))
    table = np.asarray([r[2:] for r in held], np.int64)[order]
    return learn(table, np.asarray([r[1] == 0 for r in held])[order])


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one conditional expression: the first rule that holds rejects, none keeps."""
    out = F.lit(True)
    for rule in reversed(rules):
        every = F.lit(True)
        for c in rule:
            every &= c.column()
        out = F.when(every, F.lit(False)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge(docs: DataFrame, rules: list[list[Condition]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All counts, ``base_failed`` and ``kept``."""
    return statistics(docs, id_col=id_col, text_col=text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
