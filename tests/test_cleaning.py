"""The cleaner, identity evidence and layers by cases and invariants."""

import random

import pytest
from cuetide.operators import bursts, cleaner, identity, layers
from cuetide.operators.likeness import Likeness


def piece(k, text, start=None, end=None):
    start = k * 0.3 if start is None else start
    return cleaner.Piece(start, start + 0.28 if end is None else end, text, (k,), k)


def clean(*texts, **spans):
    run = cleaner.Cleaner()
    return [p.text for p in run.clean([piece(k, t, **spans) for k, t in enumerate(texts)])], run


def test_scores():
    like = Likeness()
    assert like.alike("", "") == 1 and like.alike("a", "") == 0 and like.alike("night", "nacht") >= 0.6
    assert like.states("one\ntwo", "two\none") > like.alike("onetwo", "twoone") and like.states("abcd", "abcd ef") > 0.6
    assert like.holds("abcd", "ab") == 0.5 and like.holds("abcd", "x") == 0
    rng = random.Random(1)
    for _ in range(300):  # the bound never hides a pair
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert like.reaches(a, b, 0.7) == (like.alike(a, b) >= 0.7)
    line = like.line("Now — THEN")
    assert line.key == "now - then" and line.compact == "nowthen"


def test_near_copies_merge():
    got, run = clean("hello wide world", "hello wide worlt", "hello wide world", "hello wide world")
    assert got == ["hello wide world"] and run.actions[0]["action"] == "merge_state_cluster" and run.actions[0]["size"] == 4


def test_unlike_and_distant_cues_stay():
    assert clean("hello wide world", "quite another thing")[0] == ["hello wide world", "quite another thing"]
    run = cleaner.Cleaner()
    apart = [piece(0, "same words here"), piece(1, "same words here", start=9.0)]
    assert len(run.clean(apart)) == 2


def test_repeated_lines_go():
    assert clean("one line\nOne  line\nother")[0] == ["one line\nother"]


def test_overlays_go():
    texts = [f"{w} {'and so on'}\nEvening News Live" for w in ("apples", "bridges", "candles", "donkeys", "engines", "flowers")]
    run = cleaner.Cleaner()
    got = run.clean([piece(k, t, start=k * 4.0, end=k * 4.0 + 3) for k, t in enumerate(texts)])
    assert [p.text.splitlines()[-1] for p in got].count("Evening News Live") == 0 and len(got) == 6
    assert any(a["action"] == "remove_persistent_overlay_line" for a in run.actions)


def test_overlay_edges_go():
    run = cleaner.Cleaner()
    families = [{"members": ["evening news live"], "cues": 6, "seconds": 20.0}]
    assert [p.text for p in run.without_edges([piece(0, "Evening News Live: the weather"), piece(1, "the evening news live show")], families)] == ["the weather", "the evening news live show"]


def test_fragments_are_absorbed():
    run = cleaner.Cleaner()
    got = run.absorbed([piece(0, "you have a potential issue here", 0.0, 1.0), piece(1, "potential issue", 1.05, 1.3), piece(2, "next", 5.0, 6.0)])
    assert [(p.text, p.end, p.origins) for p in got] == [("you have a potential issue here", 1.3, (0, 1)), ("next", 6.0, (2,))]


def test_complementary_evidence_is_kept():
    # two families that recur, no cue with both: a cover of observed cues, for review
    texts = ["alpha beta gamma delta", "omega sigma kappa lambda", "alpha beta gamma delta", "omega sigma kappa lambda"]
    run = cleaner.Cleaner()
    cluster = [piece(k, t) for k, t in enumerate(texts)]
    found = run.recurring(cluster)
    first = run.representative(cluster)
    assert len(found) == 2 and {p.text for p in run.evidence_cover(cluster, first, found)} == set(texts)


def cue(k, *texts, state="pending", languages=("en", "zh")):
    return {"id": f"c{k}", "start_time": k * 0.3, "end_time": k * 0.3 + 0.28, "layers": [{"language": x, "text": t, "observation_ids": [f"o{k}{x}"]} for x, t in zip(languages, texts, strict=False)]}


def test_layers_stay_apart():
    got, _ = cleaner.clean_group([cue(0, "hello wide world", "你好世界大家好"), cue(1, "hello wide world", "你好世界大家好")])
    assert len(got) == 1 and [x["text"] for x in got[0]["layers"]] == ["hello wide world", "你好世界大家好"]
    assert got[0]["layers"][0]["observation_ids"] == ["o0en", "o1en"] and got[0]["origins"] == [0, 1]
    alone, _ = cleaner.clean_group([cue(0, "hello wide world", "你好")])
    assert alone[0]["id"] == "c0" and alone[0]["review_state"] == "pending"


def test_cleaning_is_idempotent():
    rng = random.Random(2)
    words = ["stone", "river", "cloud", "house", "tree", "light"]
    for _ in range(20):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + rng.choice(["", "\nEvening News Live"]) for _ in range(12)]
        cues = [cue(k, t, languages=("en",)) for k, t in enumerate(texts)]
        once, _ = cleaner.clean_group(cues)
        again, _ = cleaner.clean_group(once)
        assert [c["layers"] for c in again] == [c["layers"] for c in once] and [c["id"] for c in again] == [c["id"] for c in once]
        assert {line for c in once for line in c["layers"][0]["text"].splitlines()} <= {line for t in texts for line in t.splitlines()}


def test_cleaned_table(spark):
    schema = "source_id long, id string, start_time double, end_time double, review_state string, layers array<struct<language:string,text:string,observation_ids:array<string>>>"
    rows = [(1, f"c{k}", k * 0.3, k * 0.3 + 0.28, "approved" if k == 3 else "pending", [("en", "hello wide world", [f"o{k}"])]) for k in range(4)]
    df = spark.createDataFrame(rows, schema)
    got = cleaner.cleaned(df).orderBy("start_time").collect()
    assert [(r["review_state"], r["end_time"]) for r in got] == [("pending", pytest.approx(0.88)), ("approved", pytest.approx(1.18))]
    assert got[0]["layers"][0]["observation_ids"] == ["o0", "o1", "o2"]
    assert cleaner.report(df, cleaner.cleaned(df)).first()["reduction"] == 50.0
    assert cleaner.actions(df).select("action").collect()[0][0] == "merge_state_cluster"
    assert cleaner.cleaned(df.limit(0)).count() == 0


def test_pruned_extras(spark):
    df = spark.createDataFrame([(1, "a long english line\n一二三四五六七\nFuent"), (2, None)], "id long, text string")
    assert {r["id"]: r["text"] for r in bursts.pruned_extras(df).collect()} == {1: "a long english line\n一二三四五六七", 2: None}


def region(k, text, box):
    return identity.Region(str(k), text, box)


def test_blocks():
    blocks, open_ = identity.blocks_of([region(0, "a", (0, 0, 9, 1)), region(1, "b", (0, 2, 9, 3))])
    assert open_ and blocks[0].text == "a\nb" and {b.text for b in blocks} == {"a\nb", "a", "b"}
    blocks, open_ = identity.blocks_of([region(0, "a", (0, 0, 4, 1)), region(1, "b", (5, 0, 9, 1))])
    assert not open_ and [b.text for b in blocks] == ["a", "b"]
    assert identity.blocks_of([]) == ([], False)


def test_verification():
    said = ["x"] * 4 + ["y"] * 6
    calls = []

    def read(k, reason):
        calls.append(k)
        return [region(k, said[k], (0, 0, 9, 1))]

    v = identity.verify([float(k) for k in range(10)], 5, read, 5)
    assert len(calls) == 5 and calls[:3] == [0, 5, 9] and v.stopped == "budget_exhausted" and not v.ambiguous
    assert [p.text for p in v.probes] == [said[int(p.at)] for p in v.probes] and len(v.changes) == 1
    assert v.open_spans and all(b - a > 1 for a, b in v.open_spans)
    whole = identity.verify([0.0, 1.0], 1, lambda k, _: [], 3)
    assert whole.stopped == "all_observations_probed" and [p.text for p in whole.probes] == ["", ""] and not whole.open_spans

    def broken(k, reason):
        raise OSError

    failed = identity.verify([0.0, 1.0], 1, broken, 3)
    assert failed.stopped == "ocr_failed" and failed.open_spans == [(0.0, 1.0)]
    with pytest.raises(ValueError):
        identity.verify([0.0], 0, read, 2)


def test_identity_cues(spark):
    rows = spark.createDataFrame([(1, float(k), k, "said" if k < 3 else "else") for k in range(5)], "source_id long, start_time double, id long, text string")
    found = identity.verified(rows, budget=3)
    got = identity.reconstructed(found).orderBy("start_time").collect()
    assert [(r["start_time"], r["text"], r["reason"]) for r in got if r["text"]] == [(0.0, "said", None), (2.0, "said", None), (4.0, "else", None)]
    assert [r["reason"] for r in got if not r["text"]] == [identity.UNVERIFIED] * 2


def test_multilingual(spark):
    def row(k, frame, text, top, language, at):
        return (1, str(k), k, frame, text, language, 0.9, "periodic_confirmation", at, at + 0.001, float(top), float(top) + 1, 0.0)

    kind = "source_id long, id string, seq int, frame string, text string, language string, confidence double, trigger string, start_time double, end_time double, top double, bottom double, left double"
    # the layers swap places between the frames
    rows = spark.createDataFrame([row(0, "f0", "你好", 0, "zh", 0.0), row(1, "f0", "hello", 2, "en", 0.0), row(2, "f1", "hello", 0, "en", 1.0), row(3, "f1", "你好", 2, "zh", 1.0)], kind)
    (got,) = layers.reconstructed(rows, ["zh", "en"]).collect()
    assert [(x["language"], x["text"], sorted(x["observation_ids"])) for x in got["layers"]] == [("zh", "你好", ["0", "3"]), ("en", "hello", ["1", "2"])]
    (one,) = layers.reconstructed(rows.where("language = 'en'"), ["zh", "en"]).collect()
    assert one["missing"] == ["zh"] and one["layers"][0]["text"] == ""
    (single,) = layers.reconstructed(rows.where("language = 'en'"), ["en"]).collect()
    assert single["layers"][0]["text"] == "hello"
