"""Values at a bound, and work that grows with its input only."""

import itertools
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cuetide.functions import text
from cuetide.operators import cleaner, evaluation, folds, grouped, identity, intervals, layers, likeness, overlays
from cuetide.operators.likeness import Likeness
from cuetide.plans import queries


def same_as_sql(spark, name, **tables):
    """A query's rows on the given folder of tables equal DuckDB's, with repeats."""
    con, d = duckdb.connect(), tables["folder"]
    for path in d.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, str(d)).select(*want.columns).collect()
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_float_at_the_bound(spark, tmp_path):
    at = np.float32(0.15)
    rows = [[float(v)] * 64 for v in (at, np.nextafter(at, np.float32(1)), np.nextafter(at, np.float32(0)), 0.5, at)]
    rows[3][7] = float(at)
    table = pa.table({"vec_id": pa.array(range(5), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([1] * 5, pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    assert same_as_sql(spark, "im5_signature_distances", folder=tmp_path)


def test_texts_are_compared_once_a_worker(monkeypatch):
    calls, matcher = [], likeness.SequenceMatcher
    monkeypatch.setattr(likeness, "SequenceMatcher", lambda *a, **k: calls.append(a) or matcher(*a, **k))

    def group(source):
        texts = ["a wide river bend", "a wide river band", "stones of the hill", "stones of the hall", "x" * 400, "x" * 399 + "y"]
        return [{"id": f"{source}-{k}", "start_time": k * 0.3, "end_time": k * 0.3 + 0.28, "layers": [{"language": "en", "text": t, "observation_ids": [f"{source}-{k}"]}]} for k, t in enumerate(texts)]

    first = cleaner.clean_group(group("a"))[0]
    assert any(len(a[1]) < likeness.LONG for a in calls)
    calls.clear()
    again = cleaner.clean_group(group("b"))[0]
    assert all(max(map(len, a[1:])) > likeness.LONG for a in calls)
    assert [c["layers"][0]["text"] for c in again] == [c["layers"][0]["text"] for c in first]


def test_small_groups_get_tasks_of_their_own(spark):
    rows = spark.createDataFrame([(k, f"{k}-{j}", j * 0.3, j * 0.3 + 0.28, "pending", [("en", f"words {j // 2} of {k}", [f"{k}-{j}"])]) for k in range(40) for j in range(3)], "source_id long, id string, start_time double, end_time double, review_state string, layers array<struct<language:string,text:string,observation_ids:array<string>>>")
    made = cleaner.actions(rows)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def near(lines, bound, least):
    like = Likeness()
    keys = sorted({x for x in lines if len(like.line(x).compact) >= least})
    said = [(x, like.line(x)) for x in keys]
    return {(a, b) for (a, x), (b, y) in itertools.combinations(said, 2) if x.script == y.script and like.alike(x.compact, y.compact) >= bound}


def worded(n, seed):
    rng = random.Random(seed)
    words = ["hot", "cold", "large", "ring", "gear", "plate", "standard", "中文", "economy", "é", "x" * 300]
    return [" ".join(rng.choice(words[: 9 + (k % 40 == 0) * 2]) for _ in range(rng.randint(1, 4))) + rng.choice(["", f" {rng.randint(1, 50)}"]) for k in range(n)]


def test_array_bounds_lose_no_pair():
    texts = sorted({Likeness.line(x).compact for x in worded(300, 3)})
    for bound in (0.5, 0.78, 0.9):
        got = {(texts[i], texts[j]) for i, j in zip(*overlays._may_reach(texts, texts, bound), strict=True)}
        every = {(x, y) for x in texts for y in texts if min(len(x), len(y)) > 1 and Likeness.alike(x, y) >= bound}
        assert every <= got and len(got) < 0.6 * len(texts) ** 2


def test_cells_split_frequent_bigrams(spark, monkeypatch):
    monkeypatch.setattr(overlays, "CELL", 12)
    rows = [(s, x) for s in (1, 2) for x in worded(150, 5)]
    found = overlays.near_copies(spark.createDataFrame(rows, "source_id int, key string"), "source_id", 0.78, 4).collect()
    want = near([x for _, x in rows], 0.78, 4)
    assert len(found) == 2 * len(want) and {(r["source_id"], r["a"], r["b"]) for r in found} == {(s, *p) for s in (1, 2) for p in want}
    assert all(abs(r["similarity"] - Likeness.alike(Likeness.line(r["a"]).compact, Likeness.line(r["b"]).compact)) < 1e-12 for r in found)


def test_repeated_lines_of_a_long_text(spark):
    rng = random.Random(6)
    said = [rng.choice(["A line", "a  LINE", "other — one", "other - one", ""]) if rng.random() < 0.1 else f"line {rng.randrange(20000)}" for _ in range(40000)]
    first = {}
    for x in said:
        if x:
            first.setdefault(" ".join(x.lower().replace("—", "-").split()), x)
    rows = spark.createDataFrame([(1, "\n".join(said)), (2, ""), (3, None), (4, "b\na\nB")], "id int, text string")
    began = time.monotonic()
    got = {r["id"]: r["t"] for r in rows.select("id", text.without_repeated_lines(F.col("text")).alias("t")).collect()}
    assert got == {1: "\n".join(first.values()), 2: "", 3: "", 4: "b\na"} and time.monotonic() - began < 20


def test_readings_are_compared_once_a_worker(monkeypatch):
    calls, distance = [], folds.distance
    monkeypatch.setattr(folds, "distance", lambda a, b: calls.append((a, b)) or distance(a, b))
    rows = [{"id": k, "text": f"reading {k % 3} of a sign", "trigger": "first_frame", "start_time": float(k)} for k in range(300)]
    first = list(folds.state_runs(rows))
    assert 0 < len(calls) == len(set(calls)) <= 9 and list(folds.state_runs(rows)) == first and len(calls) <= 9


def test_interval_joins_move_points_once(spark, capsys):
    """Ends in one bin, in several and on its edge; no shuffle of points or of spans in one bin after the join."""
    truth = spark.createDataFrame([(1, 1, 0.0, 30.0), (1, 2, 30.0, 40.0), (1, 3, 50.0, 130.0), (2, 4, 59.0, 61.0), (3, 5, 0.0, 1.0)], "source_id long, truth_id long, start_time double, end_time double")
    found = spark.createDataFrame([(1, "a", 10.0, 55.0), (1, "b", 29.0, 125.0), (1, "c", 60.0, 60.5), (2, "d", 58.0, 62.0), (4, "e", 0.0, 1.0), (3, "f", 1.0, 2.0)], "source_id long, found_id string, start_time double, end_time double")
    points = found.select("source_id", "found_id", F.col("start_time").alias("at"))
    figures = evaluation.precision_recall(truth, found, truth_id="truth_id", found_id="found_id").first()
    assert (figures["precision"], figures["recall"]) == (4 / 6, 4 / 5)
    assert tuple(evaluation.precision_recall(truth.limit(0), found, truth_id="truth_id", found_id="found_id").first()) == (0.0, 0.0)
    assert {tuple(r) for r in evaluation.merge_violations(found, truth, group_id="found_id", state_id="truth_id", tolerance=2.0).collect()} == {("a", 1, 3), ("b", 1, 3)}
    near = truth.select("source_id", "truth_id", (F.col("end_time") - 1).alias("start_time"), (F.col("end_time") + 1).alias("end_time"))
    labels = evaluation.interval_label(points, truth, near, point_id="found_id", state_id="truth_id")
    assert dict(map(tuple, labels.collect())) == {"a": 1, "b": None, "c": 3, "d": None, "e": None, "f": None}
    assert evaluation.interval_label(points.unionAll(points), truth, near, point_id="found_id", state_id="truth_id").count() == 12  # repeats stay
    twice = evaluation.precision_recall(truth, found.unionAll(found), truth_id="truth_id", found_id="found_id").first()
    assert (twice["precision"], twice["recall"]) == (4 / 6, 4 / 5)
    recall = evaluation.point_recall(points, truth, point_id="found_id", cue_id="truth_id")
    assert {tuple(r)[:3] for r in recall.collect()} == {(1, 3, 3), (2, 1, 0), (4, 1, 0), (3, 1, 1)}
    assert {tuple(r) for r in intervals.covering(points, truth, point_id="found_id", span_id="truth_id").select("p_found_id", "s_truth_id").collect()} == {("a", 1), ("b", 1), ("c", 3), ("f", 5)}
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (labels, intervals.covering(points, truth, point_id="found_id", span_id="truth_id")):
            rows.select("*").explain()
            assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_small_groups_share_batches(spark, capsys):
    """Folds of small groups walk over batches: no frame of pandas a group; missing keys and values count as before."""
    n = 3000
    kind = "source_id long, id string, seq int, frame string, text string, language string, confidence double, trigger string, start_time double, end_time double, top double, bottom double, left double"
    rows = [(k if k else None, f"{k}-{j}", j, f"{k}/{j // 2}" if k > 1 else None, ("你好", "hello", "same words", "")[(k + j) % 4], "en", None if j else float("nan"), "periodic_confirmation", float(j), j + 0.5, float("nan") if j == 2 else float(j % 2), j % 2 + 0.5, 0.0) for k in range(n) for j in range(4)]
    df = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), kind)
    of = {}
    for r in rows:
        of.setdefault((r[0], r[3]), []).append(dict(zip(df.columns, r, strict=True)) | ({"top": None} if r[10] != r[10] else {}))
    want = {}
    for (key, frame), held in of.items():
        by, guess = layers.assign(held, ["zh", "en"])
        want |= {(key, frame, x): ("\n".join("".join(r["text"] for r in line) for line in by[x]), x in guess, [r["id"] for line in by[x] for r in line]) for x in by}
    found = layers.assigned(df, ["zh", "en"])
    assert {(r["source_id"], r["frame"], r["language"]): (r["text"], r["ambiguous"], r["ids"]) for r in found.collect()} == want
    calls = spark.sparkContext.accumulator(0)

    def recogniser():
        calls.add(1)
        return lambda r: [identity.Region(r["id"], r["text"], (0.0, 0.0, 1.0, 1.0))]

    cues = layers.reconstructed(df, ["zh", "en"])
    probes = identity.verified(df.select("source_id", "start_time", "id", "text").unionAll(df.select("source_id", "start_time", F.concat("id", F.lit("x")), "text")), recogniser=recogniser)
    told = {r["source_id"]: [p["ids"] for p in r["probes"]] for r in probes.collect()}
    assert told == {k or None: [[f"{k}-{j}"] for j in (0, 2, 3)] for k in range(n)}
    assert 0 < calls.value <= 8  # once a task
    assert {r["source_id"] for r in cues.collect()} == {k or None for k in range(n)}
    for each in (found, cues, probes, folds.consensus(df), folds.rolling(df)):
        each.explain()
    assert "InPandas" not in capsys.readouterr().out


def test_long_texts_that_share_no_letters_are_not_aligned(monkeypatch):
    monkeypatch.setattr(folds, "distance", lambda a, b: pytest.fail("compared"))
    assert not folds.reaches("ab" * 500, "cd" * 500, 0.5) and not folds.reaches("a" * 900, "a" * 300, 0.5)
    monkeypatch.undo()
    draw = random.Random(7)
    for _ in range(300):
        a, b = ("".join(draw.choices("abc你", k=draw.randrange(40))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            was, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                was, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, was + (x != y))
        assert folds.distance(a, b) == row[-1]
        assert all(folds.reaches(a, b, t) == (folds.similarity(a, b) >= t) for t in (0.0, 0.3, 0.5, 1.0))


CUE_KIND = "source_id long, id string, start_time double, end_time double, review_state string, layers array<struct<language:string,text:string,observation_ids:array<string>>>"


def test_small_sources_are_cleaned_in_batches(spark):
    rows = [(k // 5 if k < 35 else None, f"{k}", (k % 5) * 0.3, (k % 5) * 0.3 + 0.28, "pending", [("en", f"a wide river {k // 10}", [f"o{k}"])]) for k in range(40)]
    df = spark.createDataFrame(rows, CUE_KIND)
    assert "InPandas" not in cleaner.actions(df)._jdf.queryExecution().executedPlan().toString()
    got = {r["source_id"]: r for r in cleaner.cleaned(df).collect()}
    assert len(got) == 8 and got[None]["layers"][0]["observation_ids"] == [f"o{k}" for k in range(35, 40)] and got[0]["end_time"] == 4 * 0.3 + 0.28


def test_unlike_texts_are_not_matched_whole(monkeypatch):
    calls, matcher = [], likeness.SequenceMatcher
    monkeypatch.setattr(likeness, "SequenceMatcher", lambda *a, **k: calls.append(a[1:]) or matcher(*a, **k))
    texts = ["old violet lamps\nSHUTTER", "seven quick horns\nGRAVEL", "my brown folder\nPICKET"]
    cues = [{"id": str(k), "start_time": k * 0.3, "end_time": k * 0.3 + 0.28, "layers": [{"language": "en", "text": t, "observation_ids": []}]} for k, t in enumerate(texts)]
    assert [c["id"] for c in cleaner.clean_group(cues)[0]] == ["0", "1", "2"]
    assert not {x for pair in calls for x in pair} & {likeness.compacted(t) for t in texts}


def test_bounds_and_facts_hide_no_link():
    rng, said = random.Random(7), worded(200, 5)
    for _ in range(1500):
        a, b = ("\n".join(rng.choice(said) for _ in range(rng.randint(0, 3))) for _ in "ab")
        least = rng.choice([0.5, 0.8, 0.88, 0.92])
        assert Likeness.states_reach(a, b, least) == (Likeness.states(a, b) >= least)
        x, y = Likeness.lines(a), Likeness.lines(b)
        assert likeness.states_bound(a, b, likeness.alikes(x, y), likeness.alikes(y, x)) >= likeness._states(a, b) or not (a and b)
        assert cleaner._facts(a, b, least)[0] == (Likeness.states(a, b) >= least)
        texts = {Likeness.line(t).compact for t in rng.sample(said, 9)}
        assert all(likeness.Kin(0.82).of(t, texts) == {u for u in texts if Likeness.reaches(t, u, 0.82)} for t in texts)


def test_a_worker_keeps_so_many_pairs_of_kin(monkeypatch):
    monkeypatch.setattr(likeness, "KEPT", 50)
    kin, texts = likeness.Kin(0.82), {Likeness.line(t).compact for t in worded(40, 6)}
    for t in sorted(texts):
        assert kin.of(t, texts) == {u for u in texts if Likeness.reaches(t, u, 0.82)}
        assert kin.size == sum(len(seen) for seen, _ in kin.met.values()) <= max(50, len(texts))


def test_nested_columns_as_values():
    kind = pa.list_(pa.struct([("a", pa.string()), ("b", pa.list_(pa.float64()))]))
    column = pa.array([[{"a": "x", "b": [1.0, None]}, None], None, [], [{"a": None, "b": None}], [{"a": "y", "b": []}]], kind)
    for part in (column, column.slice(1), column.slice(1, 3), column.slice(5), column.flatten()):
        assert grouped.values(part) == part.to_pylist()
