"""The similarity join of lines and its families against the fold over one source, and components against a search."""

import random

from pyspark.sql import functions as F

from cuetide.operators import cleaner, overlays
from cuetide.operators.components import components
from cuetide.operators.likeness import Likeness


def lines(seed, n=60):
    """Cues of one to three lines, many of them near copies of a few, of several scripts and lengths."""
    rng = random.Random(seed)
    base = ["breaking news tonight", "channel five live", "新闻联播晚间报道", "abcde", "ok", "subscribe 现在 now", "weather at nine", "weather at nino"]

    def said():
        x = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice("abcdefgh xyz") for _ in range(rng.randint(3, 18))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            k = rng.randrange(len(x))
            x[k : k + rng.randint(0, 1)] = rng.choice("abxyz ")
        return "".join(x)

    return [(s, k, k * 0.7, k * 0.7 + 0.6, "\n".join(said() for _ in range(rng.randint(1, 3)))) for s in (1, 2) for k in range(n)]


def test_families_and_kin(spark):
    for seed in range(2):
        rows = lines(seed) + [(3, 0, 0.0, 1.0, None), (3, 1, 2.0, 3.0, ""), (3, 2, 4.0, 5.0, " \n ")]
        df = spark.createDataFrame(rows, "source_id int, id int, start_time double, end_time double, text string")
        members, pairs = overlays.families(overlays.line_places(df, "source_id", F.col("text")), "source_id")
        got = {}
        for r in overlays.with_kin(members, pairs, overlays.line_places(df, "source_id", F.col("text")), "source_id").collect():
            got.setdefault((r["source_id"], r["family"]), set()).add(r["key"])
        want, sure = {}, set()
        for s in (1, 2):
            fold = cleaner.Cleaner()
            pieces = [cleaner.Piece(**{**dict.fromkeys(cleaner.Piece.__dataclass_fields__), "start": a, "end": b, "text": t, "origins": (k,)}) for x, k, a, b, t in rows if x == s]
            for family in fold.overlays(pieces):
                want[s, min(family["members"])] = set(family["members"])
            like = Likeness()
            sure |= {(s, r["a"], r["b"]) for r in pairs.where(F.col("source_id") == s).collect() if like.alike(like.line(r["a"]).compact, like.line(r["b"]).compact) >= overlays.KIN}
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        keys = {s: sorted({like.line(x.strip()).key for y, *_, t in rows if y == s for x in (t or "").split("\n") if x.strip()}) for s in (1, 2)}
        every = {(s, a, b) for s in keys for a in keys[s] for b in keys[s] if a < b and like.line(a).script == like.line(b).script and min(len(like.line(a).compact), len(like.line(b).compact)) >= 4 and like.alike(like.line(a).compact, like.line(b).compact) >= overlays.KIN}
        assert sure == every and {(r["source_id"], r["a"], r["b"]) for r in pairs.collect()} == every


def test_components(spark):
    rng = random.Random(4)
    links = [(g, *(f"n{rng.randrange(60):02d}" for _ in "ab")) for g in (1, 2) for _ in range(35)] + [(3, f"p{k:02d}", f"p{k + 1:02d}") for k in range(40)] + [(4, "x", "x")]
    got = {(r["g"], r["id"]): r["component"] for r in components(spark.createDataFrame(links, "g int, a string, b string"), "g").collect()}
    home = {(g, x): x for g, a, b in links if a != b for x in (a, b)}
    for _ in home:
        for g, a, b in links:
            if a != b:
                home[g, a] = home[g, b] = min(home[g, a], home[g, b])
    assert got == home
    assert components(spark.createDataFrame([], "g int, a string, b string"), "g").count() == 0
