"""Personal data: candidates from high-recall generators, judged by boosted trees.

Base spans (email, ip, card, phone of fixed formats) are always redacted. Beyond them
generators propose looser, overlapping spans: emails written with ``at`` and ``dot``, phone
numbers without ``+``, card numbers with other separators, IPv6 and bracketed addresses. For each kind
boosted trees over format and context features give a calibrated probability; candidates that
reach the kind's threshold are selected, the most probable first, where they overlap no other span.

What the trees learn from: the corpus itself, where a candidate that is a base span counts as right and one
that only fails a base rule (checksum, range, number of digits) as wrong. All of them count: Spark counts equal
rows of features, and what the driver gets are the different ones with their numbers. Together those of a kind
and label weigh ``MASS`` at most, lest a large corpus silence the sentences. And sentences generated here, ``EXAMPLES`` per kind and label,
for the looser formats, of which the corpus has no labels: right and wrong ones share formats and
contexts with different odds, so the classes overlap. Documents and sentences of a held-out fold set the
thresholds, for ``PRECISION``, and give each kind's precision and recall (:class:`Judge`).

Places are code points, ends exclusive. All scans are linear in the text, whatever it holds, selection is
a search in a sorted list. Generators know that a local part has at most 64 and a label at most 63
characters. Edge cases: null and empty texts have no span; a null id stays; rows may repeat; an empty table
gives no row; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_or_empty, written
from .trees import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
EXAMPLES, PRECISION, SEED, MASS = 1200, 0.95, 7, 4000
#: Different rows of features on the driver; with more, features keep fewer binary digits, and still every candidate counts.
MOST, DIGITS = 50_000, 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# digits before a match's start can't be part of another match, so the look-behinds only spare work
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping spans per kind, as (start, end, kind), in order."""
    out, before, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > before and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            before = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((*m.span(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


_AT = re.compile(r"[\x20]?[\[({<]\x20?at\x20?[\])}>][\x20]?|\x20at\x20|\x20?@\x20?", re.I)
_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DOT = re.compile(r"\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20|\x20?\.\x20?", re.I)
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+-])[+(]?[0-9](?:[\x20().0-9/-]{0,3}[0-9]){6,18}(?![0-9A-Za-z])")
_LONG = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}(?![0-9A-Za-z])")
_SIX = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_QUAD = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\.|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])", re.I)
#: A spelt-out host is proposed with its first so many labels, and whole, however many it has.
_LABELS = 8


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping (start, end, kind): one local part may go with several ends."""
    out, locals_ = [], None
    for m in _AT.finditer(text):
        if locals_ is None:
            locals_ = {x.end(): x.start() for x in _LOCAL_PART.finditer(text)}
        head = locals_.get(m.start())
        at, ends, last = m.end(), [], None
        while head is not None and (label := _LABEL.match(text, at)):
            last = label.end()
            if len(ends) < _LABELS:
                ends.append(last)
            dot = _DOT.match(text, last)
            if not dot:
                break
            at = dot.end()
        out += [(head, end, 0) for end in ends[1:] + [last] * (last is not None and last != ends[-1])]
    if _DIGIT.search(text):
        if ":" in text:
            out += [(*m.span(), 1) for m in _SIX.finditer(text) if len(m[0]) > 4]
        out += [(*m.span(), 1) for m in _QUAD.finditer(text)]
        out += [(*m.span(), 2) for m in _LONG.finditer(text)]
        out += [(*m.span(), 3) for m in _NUMBER.finditer(text)]
    return out


#: Words near a candidate, by what they speak for (fixed values).
_HINTS = (("phone", "call", "tel", "mobile", "cell", "fax", "whatsapp", "dial"), ("mail", "contact", "write", "reach"), ("card", "visa", "mastercard", "amex", "payment", "credit"), ("ip", "host", "server", "address", "login"), ("order", "invoice", "version", "isbn", "id", "ref", "ticket", "serial", "page", "total", "sku", "v"))


def features(text: str, start: int, end: int) -> list[float]:
    got = text[start:end]
    near = re.findall(r"[a-z]+", text[max(0, start - 40) : start].lower())[-4:]
    digits = re.sub("[^0-9]", "", got)
    groups = [len(x) for x in re.findall("[0-9]+", got)]
    prev, nxt = text[start - 1 : start], text[end : end + 1]
    date = re.fullmatch(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}.*|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}.*", got)
    row = [len(got), len(digits), len(groups), max(groups, default=0), min(groups, default=0), len(digits) / len(got)]
    row += [float(got.count(c)) for c in " .-/():+@["] + [float(luhn(digits)) if digits else 0.0, float(date is not None)]
    row += [float(prev.isalnum() or prev in "$#€£"), float(nxt.isalnum() or nxt in "%€$")]
    row += [float(any(w in hints for w in near)) for hints in _HINTS]
    tail = re.split(r"[^A-Za-z]+", got.rstrip("])}"))[-1].lower()
    row += [float(tail in ("com", "org", "net", "edu", "io", "gov", "de", "fr", "es", "uk", "eu")), float(bool(re.search(r"[\[({]", got))), float(got.lower().count("dot")), float(bool(re.search("[a-f]", got.lower())))]
    return row + [float(digits[:1] in ("3", "4", "5", "6")), float(groups[-2:] in ([3, 4], [4, 4], [2, 2]))]


#: How often a right and a wrong example stand near words of the own kind, near words against it, near neither.
_NEAR = {1: (0.6, 0.03, 0.37), 0: (0.05, 0.55, 0.4)}


def _examples(rng: random.Random) -> list[tuple[int, str, str, str, int]]:
    """(kind, text before, candidate, text after, label)."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefghijklmnoprstuw") for _ in range(rng.randint(2, 8)))
    h = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    byte = lambda: str(rng.randint(0, 255))

    def card(ok: bool, size: int = 16) -> str:
        body = rng.choice("3456") + n(size - 2)
        return body + next(str(d) for d in range(10) if luhn(body + str(d)) == ok)

    def email(right: bool) -> str:
        at = rng.choice([" [at] ", "(at)", " at ", "[at]", " {at} "] if right or rng.random() < 0.1 else [" at ", " at ", " (at) "])
        dot = rng.choice([" [dot] ", "(dot)", " dot ", ".", " {dot} "] if right or rng.random() < 0.1 else [". ", ".", " . "])
        tld = rng.choice(["com", "org", "net", "de", "fr", "io"]) if rng.random() < (0.85 if right else 0.15) else w()
        return f"{w()}{rng.choice(['', '.' + w(), n(2)])}{at}{w()}{dot}{tld}"

    def ip(right: bool) -> str:
        if not right and rng.random() < 0.9:
            return rng.choice([":".join(n(2) for _ in range(rng.randint(3, 6))), ":".join(h(2) for _ in range(6)), ".".join(str(rng.randint(200, 999)) for _ in range(4)), ". ".join(n(rng.randint(1, 3)) for _ in range(4))])
        long = ":".join(h(rng.randint(1, 4)) for _ in range(8))
        return rng.choice([long, f"fe80::{h(4)}:{h(4)}:{h(3)}", f"2001:db8::{h(2)}", rng.choice(["[.]", "(.)", " . ", "[dot]"]).join(byte() for _ in range(4))])

    def plastic(right: bool) -> str:
        digits = card(rng.random() < (0.97 if right else 0.1), rng.choice([16, 16, 16, 15, 19] if right else [16, 13, 14, 12, 18]))
        sep = rng.choice([".", "/", "_", "  ", "-", ""])
        return sep.join(re.findall(".{1,4}", digits)) if right or rng.random() < 0.5 else rng.choice([digits, f"20{n(2)}.{n(2)}.{n(2)} {n(2)}.{n(2)}.{n(2)}", f"{n(4)}/{n(5)}-{n(4)}"])

    def phone(right: bool) -> str:
        if rng.random() < (0.9 if right else 0.2):
            return rng.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"0{n(3)} {n(3)} {n(4)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{n(4)}/{n(6)}"])
        return rng.choice([n(rng.randint(7, 16)), f"20{n(2)}-0{n(1)}-1{n(1)}", f"1{n(1)}.0{n(1)}.19{n(2)}", f"{n(2)}.{n(2)}.{n(2)}.{n(3)}", f"{n(1)} {n(3)} {n(3)} {n(3)}", f"{n(3)} {n(3)} {n(3)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}"])

    out, own = [], (1, 3, 2, 0)  # the words of _HINTS that speak for each kind
    for _ in range(EXAMPLES):
        for kind, make in enumerate((email, ip, plastic, phone)):
            for label in (1, 0):
                pad = " ".join(w() for _ in range(rng.randint(0, 4)))
                near = rng.choices([rng.choice(_HINTS[own[kind]]), rng.choice(_HINTS[4]), w()], _NEAR[label])[0]
                after = rng.choice([" ", ".", ",", "\n", ") "]) + w()
                out.append((kind, f"{pad} {near}{rng.choice([' ', ': ', ' is '])}", make(label == 1), after, label))
    return out


@dataclass
class Judge:
    """The trees and threshold of a kind, and how they do on the held-out fold (of weight ``held``) at that threshold."""

    trees: BoostedTrees
    threshold: float
    held: float
    precision: float
    recall: float


def _coarse(x: Column, digits: int) -> Column:
    """Features cut to so many binary digits after their first; flags and zeros stay as they are."""

    def cut(v):
        step = F.pow(F.lit(2.0), F.floor(F.log2(v)) - digits)
        return F.when(v > 0, F.floor(v / step) * step).otherwise(v)

    return F.transform(x, cut)


def corpus_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """``kind, label, held, tune, x, n``: every labelled candidate of the corpus, equal ones counted as one row.

    ``held`` and ``tune`` are fixed by the document: the fold of the thresholds, and of the others that of the
    calibration. If more than ``most`` rows differ, features are cut digit by digit until fewer do.
    """

    def run(batches):
        for batch in batches:
            rows = Counter()
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                proposed = candidates(text)
                if not proposed:
                    continue
                base = {(a, b): KINDS.index(k) for a, b, k in base_spans(text)}
                fold = int.from_bytes(hashlib.blake2b(str(i).encode(), digest_size=4).digest(), "big") % 20
                for a, b, k in proposed:
                    fixed = (_PHONE, _CARD, _QUAD)[(3, 2, 1).index(k)].fullmatch(text, a, b) if k else None
                    label = 1 if base.get((a, b)) == k else 0 if fixed or (a, b) in base else None
                    if label is not None:
                        rows[k, label, fold % 5 == 0, fold % 4 == 3, tuple(features(text, a, b))] += 1
            if rows:
                columns = [*zip(*rows, strict=True), list(rows.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.float64()), pa.int64()), strict=True)], names=["kind", "label", "held", "tune", "x", "n"])

    found = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "kind int, label int, held boolean, tune boolean, x array<double>, n long")
    of = ["kind", "label", "held", "tune"]
    counted = written(found.groupBy(*of, "x").agg(F.sum("n").alias("n")), "pii-rows")
    for digits in range(DIGITS, -1, -1):
        if counted.count() <= most:
            break
        counted = counted.groupBy(*of, _coarse(F.col("x"), digits).alias("x")).agg(F.sum("n").alias("n"))
    return counted


def fit(docs: DataFrame | None = None, *, precision: float = PRECISION, mass: int = MASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[Judge, ...]:
    """A judge of each kind, from the corpus ``docs`` (if given) and the generated sentences."""
    rows = []
    if docs is not None:
        got = sorted(tuple(r) for r in corpus_rows(docs, id_col=id_col, text_col=text_col).collect())
        total = Counter()
        for k, y, _, _, _, n in got:
            total[k, y] += n
        rows = [(k, y, held, tune, x, n * min(1.0, mass / total[k, y])) for k, y, held, tune, x, n in got]
    for seed, held in ((SEED, False), (SEED + 1, True)):
        some = ((k, y, features(a + c + b, len(a), len(a) + len(c))) for k, a, c, b, y in _examples(random.Random(seed)))
        rows += [(k, y, held, j // 8 % 4 == 3, x, 1.0) for j, (k, y, x) in enumerate(some)]  # eight sentences, one of each kind and label
    kind, y, held, tune, weight = (np.asarray([r[c] for r in rows]) for c in (0, 1, 2, 3, 5))
    x = np.asarray([r[4] for r in rows])
    out = []
    for k in range(len(KINDS)):
        learn, test = (kind == k) & ~held, (kind == k) & held
        model = BoostedTrees(rounds=30).fit(x[learn], y[learn], weight[learn], tune[learn])
        least = model.threshold(x[test], y[test], weight[test], precision)
        chosen = weight[test] * (model.probability(x[test]) >= least)
        right = float((chosen * y[test]).sum())
        out.append(Judge(model, least, float(weight[test].sum()), right / max(1.0, float(chosen.sum())), right / max(1.0, float((weight * y)[test].sum()))))
    return tuple(out)


def all_spans(text: str, judges) -> tuple[list, list]:
    """(base spans, those and the selected candidates), each as (start, end, kind) in order."""
    base = base_spans(text)
    proposed = candidates(text)
    if proposed and base:
        taken = sorted((a, b) for a, b, _ in base)
        starts, top = np.asarray([a for a, _ in taken]), np.maximum.accumulate(np.asarray([b for _, b in taken]))
        proposed = [p for p in proposed if (k := int(np.searchsorted(starts, p[1]))) == 0 or top[k - 1] <= p[0]]
    if not proposed:
        return base, base
    scored = []
    x = np.asarray([features(text, a, b) for a, b, _ in proposed])
    kinds = np.asarray([k for _, _, k in proposed])
    for k in np.unique(kinds):
        p = judges[k].trees.probability(x[kinds == k])
        scored += [(-q, *proposed[j]) for j, q in zip(np.flatnonzero(kinds == k), p, strict=True) if q >= judges[k].threshold]
    chosen: list = []  # in order; none overlaps another
    for _, a, b, k in sorted(scored):
        at = bisect_left(chosen, (a,))
        if (at == len(chosen) or b <= chosen[at][0]) and (not at or chosen[at - 1][1] <= a):
            insort(chosen, (a, b, KINDS[k]))
    return base, sorted(base + chosen, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def digest(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list) -> str:
    """Each run of overlapping spans becomes the mark of its first kind, such as ``<EMAIL>``."""
    out, at, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < b:
            k += 1
            b = max(b, spans[k][1])
        out += [text[at:a], f"<{kind.upper()}>"]
        at, k = b, k + 1
    return "".join(out) + text[at:]


def find(docs: DataFrame, judges: tuple[Judge, ...], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` (counts: base spans)."""

    def run(batches):
        for batch in batches:
            counts, sums, joined = [], [], []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text, judges)
                kinds = [k for _, _, k in base]
                counts.append([kinds.count(k) for k in KINDS])
                sums.append(hashlib.sha256(digest(base).encode()).hexdigest())
                joined.append(digest(every))
            c = np.asarray(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[:, k]) for k in range(4)), pa.array(sums, pa.string()), pa.array(joined, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, judges: tuple[Judge, ...], *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind's mark; null stays null."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            new = [None if t is None else redact(t, all_spans(t, judges)[1]) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.names[place], pa.array(new, pa.string()))

    return map_rows(docs, run)
