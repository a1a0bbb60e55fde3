"""Cleaning of machine-made cues: overlays, bursts of near copies, fragments, to a fixed point.

Cues are cleaned by source and by the exact languages of their layers, each such group in one task, as long as
one recording; cues that a person has decided on are never touched. Text is chosen and cut by whole lines
(and overlays' edges), never made up.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bursts
from .cues import eligible, protected
from .grouped import folded
from .likeness import Kin, Likeness, Line, alikes, kept_compact, remembered, states_bound

#: Likeness, gap and span of a cluster; rounds; how far shorter steps reach.
ALIKE, GAP, SPAN, PASSES, CYCLES = 0.88, 0.35, 8.0, 6, 6
MICRO, MICRO_GAP, COVER = 0.50, 0.10, 4


#: Near copies of overlays; a worker keeps them over its sources.
COPIES = Kin(0.82)


@dataclass(frozen=True)
class Piece:
    """A cue under way: its ``origins`` are places in the group's input, ``donor`` the one whose text it shows."""

    start: float
    end: float
    text: str
    origins: tuple[int, ...]
    donor: int

    @property
    def length(self) -> float:
        return self.end - self.start


def shows(p: Piece, text: str) -> Piece:
    return p if text == p.text else replace(p, text=text)


def _once(text: str) -> tuple[str, bool]:
    """A text with each line once, as first shown, and whether any came again."""
    lines = Likeness.lines(text)
    first = {x.key: x.shown for x in reversed(lines)}
    return "\n".join(dict.fromkeys(first[x.key] for x in lines)), len(first) < len(lines)


def _shares_anchor(a: str, b: str) -> bool:
    """A long line stands, nearly unchanged, in both."""
    x, y = ([s.compact for s in Likeness.lines(t) if len(s.compact) >= 6] for t in (a, b))
    return any(Likeness.reaches(s, t, 0.97) for s in x for t in y)


def _scrambled(a: str, b: str) -> bool:
    """About the same letters in another order."""
    x, y = kept_compact(a), kept_compact(b)
    n, m = sorted((len(x), len(y)))
    return n >= 20 and n >= 0.82 * m and Likeness.letters(x, y) >= 0.94


def _facts(a: str, b: str, alike: float) -> tuple[bool, ...]:
    """What links two texts: alike as a whole, lines covered, one a part of the other, scrambled, a long line shared."""
    mine, others = Likeness.lines(a), Likeness.lines(b)
    there, back = alikes(mine, others), alikes(others, mine)

    def covered(some, rows):
        """The share of characters in lines that the other text has too."""
        weights = [max(1, len(s.compact)) for s in some]
        return sum(w for w, row in zip(weights, rows, strict=True) if max(row) >= 0.90) / sum(weights)

    whole = 1.0 >= alike if a == b else states_bound(a, b, there, back) >= alike and Likeness.states(a, b) >= alike
    shared = bool(mine and others) and max(covered(mine, there), covered(others, back)) >= 0.72
    part = Likeness.holds(kept_compact(a), kept_compact(b)) >= 0.45
    anchor = any(v >= 0.97 and len(s.compact) >= 6 and len(t.compact) >= 6 for s, row in zip(mine, there, strict=True) for t, v in zip(others, row, strict=True))
    return whole, shared, part, _scrambled(a, b), anchor


def _explained(fragment: str, text: str) -> bool:
    """Every line of the fragment stands in the text, whole or as a meaningful part."""
    parts, lines = Likeness.lines(fragment), Likeness.lines(text)

    def met(x: Line, y: Line) -> bool:
        if Likeness.reaches(x.compact, y.compact, 0.88):
            return True
        if not x.compact or not y.compact:
            return False
        if x.compact in y.compact and (x.han and len(x.compact) >= 2 or x.latin and len(x.compact) >= 4):
            return True
        return y.compact in x.compact and len(y.compact) >= 0.45 * len(x.compact)

    return bool(parts and lines) and all(any(met(x, y) for y in lines) for x in parts)


def _pruned(text: str) -> str:
    return bursts.without_short_extras(text)


kept_once, kept_anchor, kept_scrambled, kept_facts, kept_explained, kept_pruned = map(remembered, (_once, _shares_anchor, _scrambled, _facts, _explained, _pruned))


class Family:
    """Variants of one line within a cluster; its support is the number of cues that have one."""

    def __init__(self, line: Line, cue: int):
        self.head, self.cues, self.longest = line, {cue}, len(line.compact)

    def add(self, line: Line, cue: int) -> None:
        self.cues.add(cue)
        self.longest = max(self.longest, len(line.compact))
        if len(line.compact) > len(self.head.compact):
            self.head = line


class Cleaner:
    def __init__(self, alike: float = ALIKE, gap: float = GAP, span: float = SPAN):
        self.alike, self.gap, self.span = alike, gap, span
        self.like = Likeness()
        self.actions: list[dict] = []
        self.last: tuple | None = None

    def note(self, action: str, piece_origins, **more) -> None:
        self.actions.append({"action": action, "origins": list(piece_origins), "reasons": [], "size": 1, "loses": False, "selected": []} | more)

    # ---- overlays

    def overlays(self, pieces: list[Piece]) -> list[dict]:
        """Lines, and their near copies, that stand on 4 cues or more over 12 seconds or more."""
        if len(pieces) < 4 or max(p.end for p in pieces) - min(p.start for p in pieces) < 12:
            return []
        shown: dict[str, Line] = {}
        where: dict[str, set[int]] = {}
        for k, p in enumerate(pieces):
            for line in self.like.lines(p.text):
                if line.key in shown:
                    where[line.key].add(k)
                elif line.key:
                    shown[line.key], where[line.key] = line, {k}
        keys = list(shown)
        home = {key: key for key in keys}

        def root(key: str) -> str:
            while home[key] != key:
                home[key] = key = home[home[key]]
            return key

        # only lines of one script and about one length can be near copies
        blocks: dict[tuple, list[str]] = {}
        for key in keys:
            if len(shown[key].compact) >= 5:
                blocks.setdefault(shown[key].script, []).append(key)
        for block in blocks.values():
            block.sort(key=lambda key: len(shown[key].compact))
            texts = [shown[key].compact for key in block]
            sizes = list(map(len, texts))
            named: dict[str, list[str]] = {}
            for key, x in zip(block, texts, strict=True):
                named.setdefault(x, []).append(key)
            for i, (a, x) in enumerate(zip(block, texts, strict=True)):
                end = bisect_right(sizes, sizes[i], i, key=lambda n: 0.82 * n)
                for y in COPIES.of(x, set(texts[i + 1 : end])):
                    for b in named[y]:
                        if root(a) != root(b):
                            home[root(b)] = root(a)
        groups: dict[str, list[str]] = {}
        for key in keys:
            groups.setdefault(root(key), []).append(key)
        out = []
        for members in groups.values():
            cues = set().union(*(where[m] for m in members))
            if len(cues) >= 4 and (lasts := max(pieces[k].end for k in cues) - min(pieces[k].start for k in cues)) >= 12:
                out.append({"members": members, "cues": len(cues), "seconds": lasts})
        taken = {m for f in out for m in f["members"]}
        for key in keys:
            if key not in taken and len(shown[key].compact) >= 4:
                kin = next((f for f in out if any(shown[m].script == shown[key].script and self.like.reaches(shown[key].compact, shown[m].compact, 0.78) for m in f["members"])), None)
                if kin is not None:
                    kin["members"].append(key)
        return out

    def without_overlays(self, pieces: list[Piece], families: list[dict]) -> list[Piece]:
        gone, out = {m for f in families for m in f["members"]}, []
        for p in pieces:
            lines = self.like.lines(p.text)
            kept = [x.shown for x in lines if x.key not in gone] if gone else [x.shown for x in lines]
            if len(kept) < len(lines):
                self.note("remove_persistent_overlay_line", p.origins)
            if kept:
                out.append(shows(p, "\n".join(kept)))
        return out

    def without_repeats(self, p: Piece) -> Piece:
        text, repeats = kept_once(p.text)
        if repeats:
            self.note("dedupe_exact_lines", p.origins)
        return shows(p, text)

    def without_edges(self, pieces: list[Piece], families: list[dict]) -> list[Piece]:
        """Long, often seen overlays go where they start or end a longer line."""
        names = [m.strip() for f in families if f["cues"] >= 6 and f["seconds"] >= 15 for m in f["members"] if len(kept_compact(m)) >= 10]
        cuts = [re.compile(form.format(re.escape(m)), re.I) for m in names for form in (r"^\s*{}\s*[:\-–—|]*\s+", r"\s+[:\-–—|]*\s*{}\s*$")]
        out = []
        for p in pieces if cuts else ():
            lines = []
            for line in self.like.lines(p.text):
                text, k = line.shown, 0
                while k < len(cuts):
                    rest = cuts[k].sub("", text).strip()
                    if rest and rest != text:
                        text = rest
                        k += 1 + (k % 2 == 0)  # a name is cut on one side only
                    else:
                        k += 1
                lines.append(text)
            new = "\n".join(lines)
            if new != "\n".join(x.shown for x in self.like.lines(p.text)):
                self.note("strip_persistent_overlay_edge", p.origins)
                p = replace(p, text=new)
            out.append(p)
        return out if cuts else pieces

    # ---- clusters

    def link(self, a: Piece, b: Piece) -> str | None:
        """Why ``b`` goes on what ``a`` shows."""
        gap = b.start - a.end
        if gap > max(self.gap, 0.35):
            return None
        alike, covered, part, scramble, anchor = kept_facts(a.text, b.text, self.alike)
        if alike and gap <= self.gap:
            return "robust_similarity"
        if gap <= 0.15 and (covered or part and min(a.length, b.length) <= 0.8):
            return "fragment_or_line_coverage"
        if scramble and gap <= 0.35:
            return "character_order_scramble"
        return "shared_stable_line" if anchor and gap <= 0.20 else None

    def clusters(self, pieces: list[Piece]) -> list[tuple[list[Piece], set[str]]]:
        out: list[tuple[list[Piece], set[str]]] = []
        for p in pieces:
            reason = None
            if out:
                held, reasons = out[-1]
                reason = self.link(held[-1], p)
                if reason and p.end - held[0].start > self.span:
                    reason = None
                if reason and len(held) >= 3 and not self.like.states_reach(held[-1].text, p.text, self.alike + 0.04):
                    shown = self.representative(held).text
                    if not self.like.states_reach(shown, p.text, self.alike - 0.08) and not kept_anchor(shown, p.text) and not kept_scrambled(shown, p.text):
                        reason = None
            if reason:
                held.append(p)
                reasons.add(reason)
            else:
                out.append(([p], set()))
        return out

    def families(self, cluster: list[Piece]) -> list[Family]:
        """Families of lines by first appearance: each line joins the one it is most like, or opens one."""
        out: list[Family] = []
        for k, p in enumerate(cluster):
            for line in self.like.lines(p.text):
                kin = [f for f in out if self.like.same_family(line, f.head)]
                if kin:
                    max(kin, key=lambda f: self.like.alike(line.compact, f.head.compact)).add(line, k)
                else:
                    out.append(Family(line, k))
        return out

    def recurring(self, cluster: list[Piece]) -> list[Family]:
        """Families on two cues and a fifth of them or more, but those inside a longer one of their script."""
        held = [f for f in self.families(cluster) if len(f.cues) >= max(2, 0.20 * len(cluster))]
        inside = lambda f, g: f is not g and f.head.script == g.head.script and f.head.compact and len(f.head.compact) < len(g.head.compact) and f.head.compact in g.head.compact
        return [f for f in held if not any(inside(f, g) for g in held)]

    def covers(self, p: Piece, f: Family) -> bool:
        return any(self.like.same_family(line, f.head) for line in self.like.lines(p.text))

    def weigh(self, p: Piece, families: list[Family], n: int) -> tuple[float, float]:
        """(weight, characters) of the families that a cue shows."""
        met = [f for f in families if self.covers(p, f)]
        sizes = [min(f.longest, 60) for f in met]
        return sum(max(0.20, len(f.cues) / n) * s for f, s in zip(met, sizes, strict=True)), float(sum(sizes))

    def stray(self, p: Piece, families: list[Family]) -> int:
        """Characters of a cue's lines outside every family."""
        return sum(min(len(x.compact), 40) for x in self.like.lines(p.text) if not any(self.like.same_family(x, f.head) for f in families))

    def central(self, p: Piece, cluster: list[Piece]) -> float:
        return sum(self.like.states(p.text, q.text) for q in cluster) / len(cluster)

    def representative(self, cluster: list[Piece]) -> Piece:
        """The cue that shows the most recurring evidence, the least else, and is most like the others."""
        if len(cluster) == 1:
            return cluster[0]
        found = self.recurring(cluster)
        value = lambda k: (*self.weigh(cluster[k], found, len(cluster)), -self.stray(cluster[k], found), self.central(cluster[k], cluster) + 0.01 * min(cluster[k].length, 2.0), -k)
        return cluster[max(range(len(cluster)), key=value)]

    def evidence_cover(self, cluster: list[Piece], first: Piece, found: list[Family]) -> list[Piece]:
        """A few observed cues that show every recurring family together, at most ``COVER``."""
        chosen, open_ = [cluster.index(first)], [f for f in found if not self.covers(first, f)]
        while open_ and len(chosen) < min(COVER, len(cluster)):
            rest = [k for k in range(len(cluster)) if k not in chosen]
            gain = lambda k: sum(min(f.longest, 60) * max(0.20, len(f.cues) / len(cluster)) for f in open_ if self.covers(cluster[k], f))
            if not rest:
                break
            best = max(rest, key=lambda k: (gain(k), -self.stray(cluster[k], found), self.central(cluster[k], cluster), -k))
            left = [f for f in open_ if not self.covers(cluster[best], f)]
            if len(left) == len(open_):
                break
            chosen.append(best)
            open_ = left
        return sorted((cluster[k] for k in chosen), key=lambda p: (p.start, p.end))

    def without_transients(self, shown: Piece, cluster: list[Piece], found: list[Family]) -> str:
        """In a cluster of 4 or more, lines outside every family that few cues repeat go."""
        if len(cluster) < 4 or not found:
            return shown.text
        lines = self.like.lines(shown.text)
        support = lambda x: sum(any(self.like.reaches(x.compact, y.compact, 0.88) for y in self.like.lines(q.text)) for q in cluster) / len(cluster)
        kept = [x.shown for x in lines if any(self.like.same_family(x, f.head) for f in found) or support(x) >= 0.30]
        if kept and len(kept) < len(lines):
            self.note("prune_transient_lines", [o for q in cluster for o in q.origins])
        return "\n".join(kept) if kept else shown.text

    def one_pass(self, pieces: list[Piece]) -> tuple[list[Piece], list[dict]]:
        """A pass over the pieces of the last one repeats its result and its notes."""
        if self.last and self.last[0] == pieces:
            _, out, families, notes = self.last
            self.actions += notes
            return out, families
        n = len(self.actions)
        out, families = self.passed(pieces)
        self.last = pieces, out, families, self.actions[n:]
        return out, families

    def passed(self, pieces: list[Piece]) -> tuple[list[Piece], list[dict]]:
        families = self.overlays(pieces)
        ready = [self.without_repeats(p) for p in self.without_overlays(pieces, families)]
        out = []
        for cluster, reasons in self.clusters(ready):
            if len(cluster) == 1:
                out.append(cluster[0])
                continue
            shown, found = self.representative(cluster), self.recurring(cluster)
            origins = tuple(o for p in cluster for o in p.origins)
            loses = any(not self.covers(shown, f) for f in found)
            if loses:  # no single cue shows it all
                cover = self.evidence_cover(cluster, shown, found)
                out += cover
                self.note("preserve_complementary_evidence_cluster", origins, reasons=sorted(reasons), size=len(origins), loses=True, selected=[p.donor for p in cover])
                continue
            text = self.without_transients(shown, cluster, found)
            out.append(Piece(cluster[0].start, max(p.end for p in cluster), text, origins, shown.donor))
            self.note("merge_state_cluster", origins, reasons=sorted(reasons), size=len(origins), selected=[shown.donor])
        return out, families

    # ---- after the passes

    def absorbed(self, pieces: list[Piece]) -> list[Piece]:
        """Very short cues that a neighbour explains become part of its span; until none is left."""
        todo, changed = list(pieces), True
        while changed:
            changed, out = False, []
            for k, p in enumerate(todo):
                sides = []
                if p.end - p.start <= MICRO:
                    for side, q in (("previous", out[-1] if out else None), ("next", todo[k + 1] if k + 1 < len(todo) else None)):
                        if q is None:
                            continue
                        gap = p.start - q.end if side == "previous" else q.start - p.end
                        if gap <= MICRO_GAP and kept_explained(p.text, q.text):
                            sides.append((self.like.states(p.text, q.text) - max(0.0, gap), side))
                if not sides:
                    out.append(p)
                    continue
                side = max(sides, key=lambda s: s[0])[1]
                if side == "previous":
                    q = out[-1]
                    out[-1] = replace(q, end=max(q.end, p.end), origins=q.origins + p.origins)
                else:
                    q = todo[k + 1]
                    todo[k + 1] = replace(q, start=min(p.start, q.start), origins=p.origins + q.origins)
                self.note("absorb_redundant_micro_fragment", p.origins)
                changed = True
            todo = out
        return todo

    def without_tokens(self, pieces: list[Piece]) -> list[Piece]:
        out = []
        for p in pieces:
            c = kept_compact(p.text)
            if p.length <= bursts.TOKEN and 2 <= len(c) <= 4 and any(map(str.isalpha, c)) and any(map(str.isdigit, c)) and len(self.like.lines(p.text)) == 1:
                self.note("drop_high_confidence_machine_token", p.origins)
            else:
                out.append(p)
        return out

    def without_extras(self, pieces: list[Piece]) -> list[Piece]:
        out = []
        for p in pieces:
            text = kept_pruned(p.text)
            if text != p.text:
                self.note("prune_short_latin_extra_line", p.origins)
            out.append(shows(p, text))
        return out

    @staticmethod
    def signature(pieces: list[Piece]) -> list[tuple]:
        return [(round(p.start, 6), round(p.end, 6), p.text) for p in pieces]

    def settled(self, pieces: list[Piece], step, most: int) -> list[Piece]:
        """``step`` again and again until nothing changes, ``most`` times at most."""
        for _ in range(most):
            before, pieces = pieces, step(pieces)
            if pieces == before or len(pieces) == len(before) and self.signature(pieces) == self.signature(before):
                break
        return pieces

    def cycle(self, pieces: list[Piece]) -> list[Piece]:
        families: list[list[dict]] = []

        def one_pass(some):
            some, found = self.one_pass(some)
            families.append(found)
            return some

        pieces = self.settled(pieces, one_pass, PASSES)
        return self.settled(pieces, lambda some: self.without_tokens(self.absorbed(self.without_extras(self.without_edges(some, families[0])))), PASSES)

    def clean(self, pieces: list[Piece]) -> list[Piece]:
        return self.settled(pieces, self.cycle, CYCLES)


# ---- layers


def tagged_lines(like: Likeness, layers: list[dict]) -> list[tuple[str, int]]:
    """Every line of a cue with the layer that it stands in."""
    return [(x.shown, k) for k, layer in enumerate(layers) for x in like.lines(layer["text"])]


def attributed(like: Likeness, text: str, tagged: list[tuple[str, int]], n: int) -> list[list[str]] | None:
    """The lines of each layer in a cleaned text, found in order among the donor's; null where that is not certain."""
    shared = {line for line, c in Counter(line for line, _ in set(tagged)).items() if c > 1}
    out: list[list[str]] = [[] for _ in range(n)]
    rest = iter(tagged)
    for x in like.lines(text):
        at = None if x.shown in shared else next((k for line, k in rest if line == x.shown), None)
        if at is None:
            return None
        out[at].append(x.shown)
    return out


def _ids(cues: list[dict], layer: int) -> list[str]:
    return list(dict.fromkeys(i for c in cues for i in c["layers"][layer]["observation_ids"]))


def clean_group(cues: list[dict]) -> tuple[list[dict], list[dict]]:
    """(cleaned cues, actions) of pending cues whose layers have the same languages.

    ``id, start_time, end_time, layers (language, text, observation_ids)``; a cue that stays as it was keeps its id,
    another gets one made from those it came from. ``review_state`` is set where a person should look.
    """
    cues = sorted(cues, key=lambda c: (c["start_time"], c["end_time"], c["id"]))
    run = Cleaner()
    tags = [tagged_lines(run.like, c["layers"]) for c in cues]
    texts = ["\n".join(line for line, _ in t) for t in tags]
    got = run.clean([Piece(c["start_time"], c["end_time"], t, (k,), k) for k, (c, t) in enumerate(zip(cues, texts, strict=True))])
    doubtful = {k for a in run.actions if a["action"] == "preserve_complementary_evidence_cluster" for k in a["selected"]}
    out = []
    for p in got:
        some, donor = [cues[k] for k in p.origins], cues[p.donor]
        review = "needs_review" if p.donor in doubtful else "pending"
        if len(some) == 1 and (p.start, p.end, p.text) == (donor["start_time"], donor["end_time"], texts[p.donor]):
            out.append(donor | {"review_state": review, "origins": list(p.origins)})
            continue
        n = len(donor["layers"])
        lines = [[p.text]] if n == 1 else attributed(run.like, p.text, tags[p.donor], n)
        if lines is None:  # whose lines they are is not certain: all stay as they were
            out += [c | {"review_state": review if c is donor else "pending", "origins": [k]} for k, c in zip(p.origins, some, strict=True)]
            continue
        layers = [{"language": layer["language"], "text": "\n".join(x), "observation_ids": _ids(some, k)} for k, (layer, x) in enumerate(zip(donor["layers"], lines, strict=True))]
        if any(old["text"].strip() and not new["text"].strip() for old, new in zip(donor["layers"], layers, strict=True)):
            review = "needs_review"
        name = hashlib.sha256("\x1f".join(c["id"] for c in some).encode()).hexdigest()[:32]
        out.append({"id": name, "start_time": p.start, "end_time": p.end, "layers": layers, "review_state": review, "origins": list(p.origins)})
    return sorted(out, key=lambda c: (c["start_time"], c["end_time"], c["id"])), run.actions


_LAYERS = "array<struct<language:string,text:string,observation_ids:array<string>>>"


def _grouped(cues: DataFrame, fold, schema: str, key: str) -> DataFrame:
    kind = cues.schema[key].dataType.simpleString()

    def run(rows: list[dict]) -> list[tuple]:
        for r in rows:
            r["start_time"], r["end_time"] = (math.nan if r[c] is None else r[c] for c in ("start_time", "end_time"))
        return [(rows[0][key], *x) for x in fold(rows)]

    signature = F.concat_ws("\x1f", F.transform("layers", lambda x: x["language"]))
    layers = F.transform("layers", lambda x: F.struct(x["language"].alias("language"), x["text"].alias("text"), x["observation_ids"].alias("observation_ids")))
    need = eligible(cues).select(key, signature.alias("signature"), "id", "start_time", "end_time", layers.alias("layers"))
    # few bytes make much work here, so tasks aren't put together by their bytes
    tasks = int(cues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return folded(need, [key, "signature"], [], run, f"{key} {kind}, {schema}", tasks)


def cleaned(cues: DataFrame, key: str = "source_id") -> DataFrame:
    """All cues of their sources after cleaning: ``id, start_time, end_time, review_state, layers``; protected ones as they were."""

    def fold(rows):
        return [(c["id"], c["start_time"], c["end_time"], c["review_state"], c["layers"], c["origins"]) for c in clean_group(rows)[0]]

    made = _grouped(cues, fold, f"id string, start_time double, end_time double, review_state string, layers {_LAYERS}, origins array<int>", key)
    text = F.concat_ws("\n", F.transform("layers", lambda x: x["text"]))
    languages = F.concat_ws("\x1f", F.transform("layers", lambda x: x["language"]))
    made = bursts.collapse_bursts(made.withColumn("text", text).withColumn("signature", languages), [key, "signature"]).drop("text", "signature", "origins")
    return made.unionByName(cues.where(protected()).select(key, "id", "start_time", "end_time", "review_state", "layers"))


def actions(cues: DataFrame, key: str = "source_id") -> DataFrame:
    """What the cleaning did: ``action, origins, reasons, size, loses, selected``, for the risk report."""

    def fold(rows):
        return [(a["action"], a["origins"], a["reasons"], a["size"], a["loses"], a["selected"]) for a in clean_group(rows)[1]]

    return _grouped(cues, fold, "action string, origins array<int>, reasons array<string>, size int, loses boolean, selected array<int>", key)


def report(cues: DataFrame, made: DataFrame, key: str = "source_id") -> DataFrame:
    """``before, after, reduction`` of each source."""
    n = cues.groupBy(key).agg(F.count("*").alias("before"))
    m = made.groupBy(key).agg(F.count("*").alias("after"))
    out = n.join(m, key, "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return out.withColumn("reduction", F.round((1 - F.col("after") / F.col("before")) * 100, 2))

