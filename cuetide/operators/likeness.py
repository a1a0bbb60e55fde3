"""How alike two short texts are, for folds that compare the lines of one source again and again.

Lines, counts and scores depend on the texts alone, so a worker keeps the latest of them over the sources that it
folds, each kind up to ``KEPT``. Bounds by character counts come before the sequence matcher, which is quadratic.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

#: How many lines, texts and pairs of them a worker keeps; a text beyond ``LONG`` characters is not kept.
KEPT, LONG = 1 << 17, 300
#: How many texts' characters stay counted; other lines of a source beyond which those that a line has met are not kept.
FEW = MANY = 1 << 12

_SPACE, _OUT = re.compile(r"\s+"), re.compile(r"[\W_]")
_HAN, _LATIN = re.compile("[一-鿿]"), re.compile("[a-z]")


def normalized(text: str) -> str:
    """NFKC, lower case, long dashes as hyphens, runs of white space as one space."""
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", text).lower().strip().translate({0x2014: "-", 0x2013: "-"}))


def compacted(text: str) -> str:
    return "".join(filter(str.isalnum, normalized(text)))


@dataclass(frozen=True)
class Line:
    shown: str
    key: str = field(compare=False)
    compact: str = field(compare=False)
    han: bool = field(compare=False)
    latin: bool = field(compare=False)

    @property
    def script(self) -> tuple[bool, bool]:
        return self.han, self.latin


def _line(shown: str) -> Line:
    compact = compacted(shown)
    return Line(shown, normalized(shown), compact, bool(_HAN.search(compact)), bool(_LATIN.search(compact)))


def _lines(text: str) -> tuple[Line, ...]:
    return tuple(kept_line(x) for raw in text.splitlines() if (x := raw.strip()))


_counts = lru_cache(FEW)(Counter)


def _shared(a: str, b: str) -> int:
    """Characters that both hold, with multiplicity."""
    x, y = (_counts(s) if len(s) <= LONG else Counter(s) for s in (a, b))
    return sum(n if n < (m := y[c]) else m for c, n in x.items() if c in y)


def _alike(a: str, b: str) -> float:
    got = SequenceMatcher(None, a, b, autojunk=False).ratio()
    if len(a) > 1 and len(b) > 1:
        x, y = (Counter(map("".join, zip(s, s[1:], strict=False))) for s in (a, b))
        got = max(got, 0.99 * 2 * (x & y).total() / (len(a) + len(b) - 2))
    return got


def _reaches(a: str, b: str, least: float) -> bool:
    if len(a) > 1 and len(b) > 1 and 2 * kept_shared(a, b) < least * (len(a) + len(b) - 2):
        return False
    return Likeness.alike(a, b) >= least


def alikes(some: tuple[Line, ...], into: tuple[Line, ...]) -> list[list[float]]:
    return [[Likeness.alike(s.compact, t.compact) for t in into] for s in some]


def _by_lines(mine: tuple[Line, ...], others: tuple[Line, ...], there: list[list[float]], back: list[list[float]], whole: float) -> float:
    def one_way(some, rows):
        weights = [max(1, min(40, len(s.compact))) for s in some]
        return sum(w * max(row) for w, row in zip(weights, rows, strict=True)) / sum(weights)

    return (one_way(mine, there) + one_way(others, back)) / 2 if mine and others else whole


def _states(a: str, b: str) -> float:
    x, y, mine, others = kept_compact(a), kept_compact(b), kept_lines(a), kept_lines(b)
    whole = Likeness.alike(x, y)
    return max(whole, 0.55 * whole + 0.45 * _by_lines(mine, others, alikes(mine, others), alikes(others, mine), whole), 0.98 * Likeness.holds(x, y))


def states_bound(a: str, b: str, there: list[list[float]], back: list[list[float]]) -> float:
    """At least :func:`_states`: by lines and by character counts, without the matcher on the whole texts."""
    x, y = kept_compact(a), kept_compact(b)
    if x == y or len(x) < 2 or len(y) < 2:
        return 1.0
    whole = 2 * _shared(x, y) / (len(x) + len(y) - 2)
    return 1e-9 + max(whole, 0.55 * whole + 0.45 * _by_lines(kept_lines(a), kept_lines(b), there, back, whole), 0.98 * Likeness.holds(x, y))


def _states_reach(a: str, b: str, least: float) -> bool:
    mine, others = kept_lines(a), kept_lines(b)
    return states_bound(a, b, alikes(mine, others), alikes(others, mine)) >= least and kept_states(a, b) >= least


def remembered(f):
    """``f`` of one or two texts, the latest results kept; long texts, which would hold much memory, are worked out anew."""
    held = lru_cache(KEPT)(f)

    def of_one(a):
        return held(a) if len(a) <= LONG else f(a)

    def of_two(a, b, *more):
        return held(a, b, *more) if len(a) <= LONG and len(b) <= LONG else f(a, b, *more)

    return of_one if f.__code__.co_argcount == 1 else of_two


kept_line, kept_lines, kept_compact, kept_shared, kept_alike, kept_reaches, kept_states, kept_states_reach = map(remembered, (_line, _lines, compacted, _shared, _alike, _reaches, _states, _states_reach))


class Kin:
    """Which of many short texts reach ``least`` with one; a worker keeps whom each has met, up to ``KEPT`` pairs."""

    def __init__(self, least: float):
        self.least, self.met, self.size = least, {}, 0

    def of(self, text: str, others: set[str]) -> set[str]:
        if len(text) > LONG or len(others) > MANY:
            return {y for y in others if Likeness.reaches(text, y, self.least)}
        seen, kin = self.met.setdefault(text, (set(), set()))
        new = others - seen
        if new:
            if self.size + len(new) > KEPT:
                self.met.clear()
                self.size, seen, kin = 0, *self.met.setdefault(text, (set(), set()))
                new = others
            kin.update(y for y in new if Likeness.reaches(text, y, self.least))
            seen |= new
            self.size += len(new)
        return kin & others


class Likeness:
    """Lines and scores."""

    line, lines = staticmethod(kept_line), staticmethod(kept_lines)

    @staticmethod
    def letters(a: str, b: str) -> float:
        """Shared characters with multiplicity, twice over all."""
        if not a or not b:
            return float(a == b)
        return 2 * kept_shared(a, b) / (len(a) + len(b))

    @staticmethod
    def alike(a: str, b: str) -> float:
        """The matcher's ratio of two compact texts, or 0.99 of their bigrams' Dice coefficient if that is more."""
        if not a or not b or a == b:
            return float(a == b)
        return kept_alike(a, b)

    @staticmethod
    def reaches(a: str, b: str, least: float) -> bool:
        """Whether :meth:`alike` is ``least`` or more; character counts decide most pairs."""
        return kept_reaches(a, b, least)

    @staticmethod
    def holds(a: str, b: str) -> float:
        """Shorter over longer length if one holds the other, else 0."""
        short, long = sorted((a, b), key=len)
        return len(short) / len(long) if short and short in long else 0.0

    @staticmethod
    def states(a: str, b: str) -> float:
        """How alike two cues' texts are as a whole, by lines, or by one holding the other."""
        return 1.0 if a == b else kept_states(a, b)

    @staticmethod
    def states_reach(a: str, b: str, least: float) -> bool:
        """Whether :meth:`states` is ``least`` or more."""
        return 1.0 >= least if a == b else kept_states_reach(a, b, least)

    def same_family(self, a: Line, b: Line) -> bool:
        """Two lines are variants of one: alike, or one holds the other and is long enough to mean something."""
        if not a.compact or not b.compact:
            return False
        if self.reaches(a.compact, b.compact, 0.88):
            return True
        short, share = min((a, b), key=lambda x: len(x.compact)), self.holds(a.compact, b.compact)
        return share > 0 and (short.han and len(short.compact) >= 4 or short.latin and len(short.compact) >= 6 or share >= 0.45)
