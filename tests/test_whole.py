"""Queries take their whole input: texts aren't cut before the operator sees them."""

import itertools
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from cuetide.operators import bursts, folds, windows
from cuetide.plans import evidence, queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def asked(sql):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    return con.sql(sql)


def test_consolidate_merges_equal_texts(spark):
    rows = [("a", 0.0, 2.5, "same text"), ("b", 2.0, 3.0, " same text "), ("c", 3.2, 4.0, "same text"), ("d", 4.0, 5.0, "some text"), ("e", 5.0, 6.0, ""), ("f", 6.0, 7.0, "")]
    cues = spark.createDataFrame([(1, *r) for r in rows], "source_id long, id string, start_time double, end_time double, text string")
    got = [(r["id"], r["end_time"], r["text"], r["n"]) for r in windows.consolidate(cues).orderBy("start_time").collect()]
    assert got == [("a", 3.0, "same text", 2), ("c", 4.0, "same text", 1), ("d", 5.0, "some text", 1), ("e", 6.0, "", 1), ("f", 7.0, "", 1)]


def test_overlap():
    words = ["".join(w) for n in range(6) for w in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(words, words):
        want = max(k for k in range(min(len(a), len(b)) + 1) if a.endswith(b[:k]))
        assert folds.overlap(a, b) == want
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choice("aaab") for _ in range(rng.randint(0, 150))) for _ in "ab")
        b = a[rng.randint(0, len(a)) :] + b if rng.random() < 0.5 else b
        assert folds.overlap(a, b) == max(k for k in range(min(len(a), len(b)) + 1) if a.endswith(b[:k]))


def test_overlap_is_linear():
    began = time.process_time()
    assert folds.overlap("a" * 500_000, "a" * 499_999 + "b") == 499_999
    assert folds.overlap("b" + "a" * 500_000, "a" * 250_000 + "b" + "a" * 250_000) == 250_000
    assert time.process_time() - began < 10


@needs_tables
def test_rolling_takes_whole_texts(spark):
    got = {r["id"]: r for r in queries.queries()["wn6_rolling_captions"](spark, SF).collect()}
    rows = asked("SELECT conv_id || '-' || turn AS id, text FROM conversations").fetchall()
    texts = dict(rows)
    assert sorted(i for r in got.values() for i in r["observation_ids"].split(",")) == sorted(texts)
    for r in got.values():
        want = ""
        for i in r["observation_ids"].split(","):
            k = max(k for k in range(min(len(want), len(texts[i])) + 1) if want.endswith(texts[i][:k]))
            want += texts[i][k:]
        assert r["text"] == want


def test_rolling_joins_long_texts(spark):
    a, b = "x" * 50 + "y" * 50, "y" * 50 + "z" * 50
    rows = spark.createDataFrame([(1, "a", 0, 0.0, 2.5, a), (1, "b", 1, 2.0, 4.5, b)], "source_id long, id string, seq int, start_time double, end_time double, text string")
    assert [(r["text"], r["flags"]) for r in folds.rolling(rows).collect()] == [("x" * 50 + "y" * 50 + "z" * 50, ["sliding"])]


def test_layers_see_scripts_after_a_prefix(spark, tmp_path):
    rows = [(1, 0, "user", "0123456789 12 かな"), (1, 1, "user", "0123456789 12 hello")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["language"]: (r["text"], r["ambiguous"]) for r in evidence.lg4_layers(spark, str(tmp_path)).collect()}
    assert got == {"zh": ("", False), "ja": (rows[0][3], False), "en": (rows[1][3], False)}


def test_machine_tokens(spark):
    rows = [("R90", 0.2), ("r 9-0", 0.1), ("R90", 0.25), ("R90\nx1", 0.1), ("a1 x and a long caption", 0.1), ("R", 0.1), ("90", 0.1), ("ab", 0.1), ("a1b2", 0.1), ("a1b2c", 0.1)]
    found = spark.createDataFrame(rows, "text string, seconds double").where(bursts.machine_token(F.col("text"), F.col("seconds")))
    assert sorted(map(tuple, found.collect())) == [("R90", 0.2), ("a1b2", 0.1), ("r 9-0", 0.1)]


def test_machine_tokens_by_whole_text_and_duration(spark, monkeypatch):
    kind = "source_id long, id string, start_time double, end_time double, layers array<struct<language:string,text:string>>"
    rows = [(2, "long", 0.0, 0.1, [("en", "a1 x and a long caption")]), (2, "slow", 1.0, 3.5, [("en", "R90")]), (1, "token", 5.0, 5.125, [("en", "R90")]), (2, "word", 6.0, 6.125, [("en", "ab")])]
    monkeypatch.setattr(evidence, "_cues", lambda spark, d: spark.createDataFrame(rows, kind))
    assert sorted(r["id"] for r in evidence.flt10_machine_tokens(spark, "").collect()) == ["long", "slow", "word"]
