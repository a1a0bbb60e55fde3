"""Ordered folds that no window can express, one source at a time in Arrow-fed Python.

A source is the unit of order, so it is also the unit of work; sources are many and each is
as long as one recording.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, windows
from .grouped import folded
from .likeness import remembered

SWITCHES = ("first_frame", "change_detected")


def distance(a: str, b: str) -> int:
    """Edit distance; equal ends and equal texts cost nothing."""
    if a == b:
        return 0
    start = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    a, b = sorted((a, b), key=len)
    at: dict[str, int] = {}
    for k, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << k
    # a row at once, as bits: where its cells are one more or one less than the cell before (Myers, Hyyrö)
    whole, last, far = (1 << len(b)) - 1, 1 << len(b) - 1, len(b)
    more, less = whole, 0
    for x in a:
        same = at.get(x, 0)
        down = same | less
        along = ((same & more) + more ^ more) | same
        up, back = less | whole ^ (along | more) & whole, more & along
        far += bool(up & last) - bool(back & last)
        up, back = up << 1 | 1, back << 1
        more, less = (back | ~(down | up)) & whole, up & down & whole
    return far


@remembered
def similarity(a: str, b: str) -> float:
    """1 - edit distance / longer length; readings repeat within and across sources, so a worker keeps the latest."""
    return 1 - distance(a, b) / longest if (longest := max(len(a), len(b))) else 1.0


def reaches(a: str, b: str, threshold: float) -> bool:
    """Whether :func:`similarity` is ``threshold`` or more; lengths and letters in common decide many pairs of long texts."""
    longest = max(len(a), len(b))
    for most in (lambda: min(len(a), len(b)), lambda: (Counter(a) & Counter(b)).total()):
        if longest and 1 - (longest - most()) / longest < threshold:
            return False
    return similarity(a, b) >= threshold


def state_runs(readings: list[dict], threshold: float = 0.5) -> Iterator[tuple[list[dict], float | None, set]]:
    """(members, where the next state begins, members without a vote) of each visual state.

    Readings compare with the run's first text. Blanks wait: the next text either continues the run,
    and they join it, or closes it where they began; two or more at the end close it too. A
    reading that a switch triggered opens a new run if the next text confirms it; a contradicted one joins with,
    an unconfirmed one without a vote.
    """
    following: list[str | None] = [None] * len(readings)
    ahead = None
    for k in range(len(readings) - 1, -1, -1):
        following[k] = ahead
        ahead = readings[k]["text"] or ahead
    run: list[dict] = []
    mute: set = set()
    blanks: list[dict] = []
    for k, r in enumerate(readings):
        text = r["text"]
        if not text:
            if run:
                blanks.append(r)
            continue
        if not run:
            run, mute = [r], set()
            continue
        anchor = run[0]["text"]
        if blanks:
            if reaches(anchor, text, threshold):
                run += blanks
                blanks = []
            else:
                yield run, blanks[0]["start_time"], mute
                run, mute, blanks = [r], set(), []
                continue
        if r["trigger"] in SWITCHES and text != anchor:
            if following[k] is None:
                run.append(r)
                mute.add(r["id"])
            elif reaches(text, following[k], threshold):
                yield run, r["start_time"], mute
                run, mute = [r], set()
            else:
                run.append(r)
        elif reaches(anchor, text, threshold):
            run.append(r)
        else:
            yield run, r["start_time"], mute
            run, mute = [r], set()
    if run:
        if len(blanks) >= 2:
            yield run, blanks[0]["start_time"], mute
        else:
            yield run + blanks, None, mute


def overlap(before: str, text: str) -> int:
    """The most characters that end ``before`` and start ``text``, by the prefix function in linear time."""
    if not text:
        return 0
    border, k = [0], 0
    for c in text[1:]:
        while k and text[k] != c:
            k = border[k - 1]
        k += text[k] == c
        border.append(k)
    k = 0
    # no more than text's length can meet it, so k is len(text) at the end only
    for c in before[-len(text) :]:
        while k and text[k] != c:
            k = border[k - 1]
        k += text[k] == c
    return k


def transition(said: str, end: float, text: str, start: float, pause: float = 1.0) -> tuple[str, int]:
    """(continue, ambiguous, collision or separate; shared characters) of a caption after the text so far.

    ``end`` is the end of the caption before it, which need not be the latest so far.
    """
    k, gap = overlap(said, text), start - end
    if k == 0:
        return ("collision" if gap < 0 else "separate"), 0
    if gap < 0:
        return ("continue" if k >= 2 or k == len(said) else "ambiguous"), k
    return ("continue" if gap <= pause and k == len(text) else "separate"), k


def captions(rows: list[dict]) -> list[dict]:
    """Rolling captions as whole cues with what was done to them."""
    out: list[dict] = []
    now: dict | None = None
    for r in rows:
        kind, k = ("first", 0) if now is None else transition(now["text"], now["last_end"], r["text"], r["start_time"])
        if kind == "continue":
            how = "repetition" if k == len(r["text"]) else "growth" if k == len(now["text"]) and len(r["text"]) > k else "sliding"
            now["text"] += r["text"][k:]
            now["end_time"], now["last_end"] = max(now["end_time"], r["end_time"]), r["end_time"]
            now["flags"].add(how)
            now["ids"].append(r["id"])
            now["seqs"].append(r["seq"])
        else:
            now = {"id": f"cue-{r['id']}", "start_time": r["start_time"], "end_time": r["end_time"], "last_end": r["end_time"], "text": r["text"], "ids": [r["id"]], "seqs": [r["seq"]], "flags": {kind} & {"collision", "ambiguous"}}
            out.append(now)
    high = None
    for cue in out:
        if cue["seqs"] != sorted(cue["seqs"]) or high is not None and min(cue["seqs"]) < high:
            cue["flags"].add("source_order")
        high = max([*cue["seqs"], *([high] if high is not None else [])])
    return out


def voted(members: list[dict], field: str) -> tuple[str | None, int, int]:
    """(the value that most members have, how many, how many values); ties: the highest confidence, then the earliest."""
    votes: dict = {}
    for k, r in enumerate(members):
        sure = -1.0 if pd.isna(r["confidence"]) else r["confidence"]
        n, best, first = votes.get(r[field], (0, -2.0, k))
        votes[r[field]] = (n + 1, max(best, sure), first)
    if not votes:
        return None, 0, 0
    value = max(votes, key=lambda t: (votes[t][0], votes[t][1], -votes[t][2]))
    return value, votes[value][0], len(votes)


_CUE_DDL = "id string, start_time double, end_time double, text string, language string, observation_ids array<string>, n_members int, n_votes int, n_distinct int, confidence double"


def consensus(rows: DataFrame, threshold: float = 0.5, key: str = "source_id", processing_end: float | None = None) -> DataFrame:
    """Cues of the visual states of ``rows`` (``id, start_time, end_time, text, confidence, trigger, language, member_ids``).

    A state ends where the next begins, else at ``processing_end``, else with its last member. All members are kept as
    observations, also blanks; only those with a vote count for text and language.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(held: list[dict]) -> Iterator[tuple]:
        for members, boundary, mute in state_runs(held, threshold):
            counted = [r for r in members if r["text"] and r["id"] not in mute]
            text, votes, n_distinct = voted(counted, "text")
            language = voted([r for r in counted if isinstance(r["language"], str) and r["language"]], "language")[0] or "und"
            last = members[-1]["end_time"] if processing_end is None else processing_end
            sure = [r["confidence"] for r in members if r["text"] and not pd.isna(r["confidence"])]
            ids = [str(i) for r in members for i in r["member_ids"]]
            yield held[0][key], f"cue-{members[0]['id']}", members[0]["start_time"], float(last if boundary is None else boundary), text, language, ids, len(members), votes, n_distinct, sum(sure) / len(sure) if sure else None

    held = F.col("member_ids") if "member_ids" in rows.columns else F.array("id")
    need = rows.select(key, "id", "start_time", "end_time", "text", "confidence", "trigger", "language", F.transform(held, lambda x: x.cast("string")).alias("member_ids"))
    return folded(need, [key], ["start_time", "id"], run, f"{key} {kind}, {_CUE_DDL}")


def reconstructed(rows: DataFrame, threshold: float = 0.5, key: str = "source_id", processing_end: float | None = None) -> DataFrame:
    """Whole consensus reconstruction: readings of one frame as one (if there is a ``frame``), states, votes, and
    neighbours of equal text as one cue.
    """
    if "frame" in rows.columns:
        firsts = rows.select(key, "id", "start_time", "end_time", "trigger", "language")
        joined = frames.same_frame(rows, key).withColumn("first", F.col("member_ids")[0])
        rows = joined.join(firsts.withColumnRenamed("id", "first"), [key, "first"]).drop("first", "frame")
    return windows.consolidate(consensus(rows, threshold, key, processing_end), key=key)


def rolling(rows: DataFrame, key: str = "source_id") -> DataFrame:
    """Whole cues of rolling captions (``id, seq, start_time, end_time, text``); ``seq`` is the place in the file."""
    kind = rows.schema[key].dataType.simpleString()

    def run(held: list[dict]) -> list[tuple]:
        return [(held[0][key], c["id"], c["start_time"], c["end_time"], c["text"], [str(i) for i in c["ids"]], sorted(c["flags"])) for c in captions(held)]

    need = rows.select(key, "id", "seq", "start_time", "end_time", "text")
    return folded(need, [key], ["start_time", "seq"], run, f"{key} {kind}, id string, start_time double, end_time double, text string, observation_ids array<string>, flags array<string>")
