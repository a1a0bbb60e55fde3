"""Which expected language each region of a frame belongs to, from its script, its neighbours and its place."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folds
from .grouped import folded

#: The languages that a script may stand for.
LANGUAGES_OF = {"kana": {"ja"}, "han": {"zh", "ja"}, "latin": {"en"}}
_KANA, _HAN, _LATIN = re.compile("[぀-ヿ]"), re.compile("[一-鿿]"), re.compile("[A-Za-z]")


def script(text: str) -> str | None:
    found = [name for name, p in (("kana", _KANA), ("han", _HAN), ("latin", _LATIN)) if p.search(text)]
    return "kana" if "kana" in found else found[0] if len(found) == 1 else None


def possible(text: str, expected: list[str]) -> set[str]:
    return LANGUAGES_OF.get(script(text), set()) & set(expected)


def _reading_place(r: dict) -> tuple[float, float]:
    return (0.0, 0.0) if r["top"] is None else (r["top"], r["left"])


def visual_lines(regions: list[dict], expected: list[str]) -> list[list[dict]]:
    """Regions whose heights overlap are one line, unless their scripts tell them apart."""
    lines: list[list[dict]] = []
    reach: tuple | None = None  # top, bottom, the language it surely is, whether scripts mix in it
    for r in sorted(regions, key=_reading_place):
        fits = possible(r["text"], expected)
        sure = next(iter(fits)) if len(fits) == 1 else None
        mix = bool(_HAN.search(r["text"]) and _LATIN.search(r["text"]) and not _KANA.search(r["text"]))
        if reach and reach[0] is not None and r["top"] is not None and min(reach[1], r["bottom"]) > max(reach[0], r["top"]):
            top, bottom, was, mixed = reach
            if not (sure and was and sure != was or was and mix or sure and mixed):
                lines[-1].append(r)
                reach = (min(top, r["top"]), max(bottom, r["bottom"]), was or sure, mixed or mix)
                continue
        lines.append([r])
        reach = (r["top"], r["bottom"], sure, mix)
    return lines


def assign(regions: list[dict], expected: list[str]) -> tuple[dict[str, list[list[dict]]], set[str]]:
    """(lines of each expected language from top to bottom, languages whose lines are a guess).

    A line takes its script's only language; else what other lines have not taken; else the hint that strictly
    leads. This repeats until nothing changes. A line that several languages could own is placed nowhere and makes
    them all ambiguous. One without script fills a language that has no line, or joins the nearest line's.
    """
    lines = visual_lines(regions, expected)
    fits = []
    for line in lines:
        each = [possible(r["text"], expected) for r in line]
        fits.append(next((x for x in each if len(x) == 1), set().union(*each)))
    home: dict[int, str] = {}
    order: list[int] = []
    while True:
        taken, step = set(home.values()), {}
        for k, own in enumerate(fits):
            left = own if len(own) == 1 else own - taken
            if k in home or not left:
                continue
            if len(left) > 1:
                votes = Counter(r["language"] for r in line_hints(lines[k], left)).most_common(2)
                left = {votes[0][0]} if votes and (len(votes) == 1 or votes[0][1] > votes[1][1]) else set()
            if left:
                step[k] = next(iter(left))
        if not step:
            break
        home |= step
        order += step
    guess = set().union(*(fits[k] for k in range(len(lines)) if k not in home))
    place = [_reading_place(line[0]) for line in lines]
    blank = sorted((k for k in range(len(lines)) if not fits[k]), key=lambda k: place[k])
    free = [x for x in expected if x not in home.values()]
    for language, k in zip(free, blank, strict=False):
        home[k] = language
        guess.add(language)
        order.append(k)
    settled = [k for x in expected for k in order if home[k] == x]
    for k in blank[len(free) :] if settled else []:
        near = min(settled, key=lambda j: abs(place[j][0] - place[k][0]))
        home[k] = home[near]
        guess.add(home[near])
        order.append(k)
    return {x: [lines[k] for k in sorted((k for k in order if home[k] == x), key=lambda k: place[k])] for x in expected}, guess


def line_hints(line: list[dict], among: set[str]) -> list[dict]:
    return [r for r in line if r["language"] in among]


def assigned(regions: DataFrame, expected: list[str], key: str = "source_id") -> DataFrame:
    """One row per frame and expected language: ``text`` (empty if missing), ``n_lines``, ``ambiguous``, ``ids``.

    ``frame, id, seq, text, language, top, bottom, left``; a frame is one task's unit, as small as a picture.
    """
    kind, id_kind = (regions.schema[c].dataType.simpleString() for c in (key, "id"))

    def run(held: list[dict]) -> list[tuple]:
        by, guess = assign(held, expected)
        return [(held[0][key], held[0]["frame"], x, "\n".join("".join(r["text"] for r in line) for line in by[x]), len(by[x]), x in guess, [r["id"] for line in by[x] for r in line]) for x in expected]

    need = regions.select(key, "frame", "id", "seq", "text", "language", "top", "bottom", "left")
    return folded(need, [key, "frame"], ["seq"], run, f"{key} {kind}, frame string, language string, text string, n_lines int, ambiguous boolean, ids array<{id_kind}>")


def _frames(regions: list[dict]) -> list[list[dict]]:
    """Regions by frame, in the order of first sight; one without a frame stands alone."""
    out: dict = {}
    for r in regions:
        out.setdefault(("frame", r["frame"]) if r["frame"] else ("alone", r["id"]), []).append(r)
    return list(out.values())


def canonical(regions: list[dict], expected: list[str]) -> list[dict]:
    """A frame's regions in the order of their languages, so that layers that swap places look the same; the rest after them."""
    if len(regions) == 1:
        return regions
    by, _ = assign(regions, expected)
    placed = [r for x in expected for line in by[x] for r in line]
    ids = {r["id"] for r in placed}
    return placed + [r for r in regions if r["id"] not in ids]


def merged_lines(members: list[dict], expected: list[str]) -> tuple[dict[str, list[list[dict]]], set[str]]:
    """Lines of each language over several frames: each frame is assigned by itself, then equal places meet."""
    lines: dict[str, list[list[dict]]] = {x: [] for x in expected}
    guess: set[str] = set()
    for frame in _frames(members):
        by, open_ = assign(frame, expected)
        guess |= open_
        for x in expected:
            for k, line in enumerate(by[x]):
                if k == len(lines[x]):
                    lines[x].append([])
                lines[x][k] += line
    return lines, guess


_LAYER_DDL = "array<struct<language:string,text:string,observation_ids:array<string>>>"


def reconstructed(regions: DataFrame, expected: list[str], threshold: float = 0.5, key: str = "source_id", processing_end: float | None = None) -> DataFrame:
    """Cues with a layer for each expected language: ``id, start_time, end_time, layers, missing, ambiguous``.

    States come from whole frames, their regions joined in the languages' order; then each line of each language gets a
    vote of its own over the state's frames. A language without a line has an empty layer and is named ``missing``.
    One language alone goes by :func:`folds.reconstructed`. A source is a task's unit, as long as one recording.
    """
    if len(expected) == 1:
        cues = folds.reconstructed(regions, threshold, key, processing_end)
        layer = F.struct(F.lit(expected[0]).alias("language"), "text", "observation_ids")
        none = F.array().cast("array<string>")
        return cues.select(key, "id", "start_time", "end_time", F.array(layer).alias("layers"), none.alias("missing"), none.alias("ambiguous"))
    kind = regions.schema[key].dataType.simpleString()

    def run(held: list[dict]) -> Iterator[tuple]:
        readings = []
        for frame in _frames(held):
            ordered = canonical(frame, expected)
            parts, last = [], None
            for r in ordered:
                apart = last is not None and last["top"] is not None and r["top"] is not None and min(last["bottom"], r["bottom"]) <= max(last["top"], r["top"])
                parts += ["\n", r["text"]] if apart else [r["text"]]
                last = r
            first = ordered[0]
            readings.append({"id": first["id"], "text": "".join(parts), "start_time": first["start_time"], "end_time": first["end_time"], "trigger": first["trigger"], "members": ordered})
        readings.sort(key=lambda r: r["start_time"])
        for members, boundary, mute in folds.state_runs(readings, threshold):
            said = [r for m in members if m["text"] and m["id"] not in mute for r in m["members"] if r["text"]]
            by, guess = merged_lines(said, expected)
            layers = [{"language": x, "text": "\n".join(folds.voted(line, "text")[0] for line in by[x]), "observation_ids": [str(r["id"]) for line in by[x] for r in line]} for x in expected]
            last = members[-1]["end_time"] if processing_end is None else processing_end
            yield held[0][key], f"cue-{members[0]['id']}", members[0]["start_time"], float(last if boundary is None else boundary), layers, [x for x in expected if not by[x]], [x for x in expected if x in guess]

    need = regions.select(key, "frame", "id", "seq", "text", "language", "confidence", "trigger", "start_time", "end_time", "top", "bottom", "left")
    return folded(need, [key], ["start_time", "seq"], run, f"{key} {kind}, id string, start_time double, end_time double, layers {_LAYER_DDL}, missing array<string>, ambiguous array<string>")
