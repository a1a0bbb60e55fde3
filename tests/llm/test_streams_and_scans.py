"""Click windows, licence scans and periodic runs against brute force, on null, empty, repeated and clashing input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuetide.llm import click_dedup, license_scan, periodic_runs
from cuetide.llm.license_texts import PASSAGES, PHRASES


def slow_windows(batches, horizon=72, lateness=48):
    out, held, newest = [], {}, None
    for b, rows in enumerate(batches):
        for i, hour, h in sorted(r for r in rows if newest is None or r[1] >= newest - lateness):
            w = held.get(i)
            if w and hour <= w[0] + horizon:
                w[2] += 1
                if h != w[1]:
                    w[3], w[4] = w[3] + 1, w[4] + zlib.crc32(h.hex().encode())
            else:
                if w:
                    out.append((i, w[0], b, *w[2:], w[1]))
                held[i] = [hour, h, 0, 0, 0]
        newest = max([r[1] for r in rows] + ([newest] if newest is not None else []), default=None)
        for i in list(held):
            if b == len(batches) - 1 or newest is not None and held[i][0] + horizon < newest - lateness:
                w = held.pop(i)
                out.append((i, w[0], b, *w[2:], w[1]))
    return sorted(out)


def clicks(seed, batches, n, ids):
    rng = random.Random(seed)
    hashes = [hashlib.sha256(b"%d" % k).digest() for k in range(4)]
    return [[(rng.choice(ids), b * 120 + rng.randint(-150, 130), rng.choice(hashes)) for _ in range(n)] for b in range(batches)]


def as_rows(rows):
    raw = np.frombuffer(b"".join(h for _, _, h in rows), ">u8").reshape(-1, 4)
    return {"id": np.array([i for i, _, _ in rows]), "hour": np.array([t for _, t, _ in rows]), "n": np.ones(len(rows), np.int64)} | {k: raw[:, c].astype("<u8") for c, k in enumerate(click_dedup.HASH)}


@pytest.mark.parametrize("seed", range(12))
def test_windows_fold(seed):
    """The vectorised fold alone, in several batches without late rows."""
    batches = clicks(seed, 4, 60, list(range(-2, 9)))
    held, got = click_dedup.unpack(None, click_dedup.OPEN), []
    for rows in batches:
        held, closed = click_dedup.fold(held, click_dedup.summed(as_rows(rows)), 72)
        held = click_dedup.unpack(click_dedup.pack(held), click_dedup.OPEN)
        got += closed
    got.append(held)
    found = [(int(w["id"][k]), int(w["start"][k]), *(int(w[c][k]) for c in ("repeats", "conflicts", "crc"))) for w in got for k in range(len(w["id"]))]
    want = [(i, s, r, c, x) for i, s, _, r, c, x, _ in slow_windows(batches, lateness=10**6)]
    assert sorted(found) == sorted(want)


def test_windows_stream(spark):
    """The stream: late rows, windows closed by rows and by time, an empty batch, hot and null ids, repeated rows."""
    batches = clicks(5, 4, 80, list(range(6)) + [3] * 6)
    batches[2] = []
    rows = [(i, t, bytearray(h), b) for b, part in enumerate(batches) for i, t, h in part]
    rows += [(None, 5, bytearray(32), 0), (1, None, bytearray(32), 1), (1, 7, bytearray(32), None)]
    df = spark.createDataFrame(rows, "click_id long, hour long, hash binary, batch int").withColumn("shard", F.lit("x")).withColumn("at", F.lit(1))
    got = click_dedup.windows(df, 4, shards=5).collect()
    assert sorted((r["click_id"], r["start_hour"], r["closed_batch"], r["n_repeats"], r["n_conflicts"], r["conflict_crc"], bytes(r["hash"])) for r in got) == slow_windows(batches)
    assert click_dedup.windows(df.limit(0), 4).count() == 0
    assert click_dedup.shards_for(10**9) == 20_000 and click_dedup.shards_for(0) == 64


def test_copies(spark):
    data = [(4, "2024-01-01 10:59:59.5", "2024-01-02 23:59:59", 7, "a|b", 1.005, None), (5, None, "1969-12-31 23:30:00", None, None, None, "{}"), (None, None, "2024-01-01 00:00:00", 1, "k", 1.0, "p"), (6, None, None, 1, "k", 1.0, "p")]
    df = spark.createDataFrame(data, "click_id long, ts string, arrived_at string, client_id long, kind string, value double, props string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("arrived_at", F.col("arrived_at").cast("timestamp_ntz")).withColumn("j", F.lit(9))
    got = sorted((r["click_id"], r["hour"], bytes(r["hash"]).hex()) for r in click_dedup.copies(df, 12).collect())
    want = []
    for i, hour, said in ((4, 473399, "7|a|b|100|1704106799500000||"), (5, -1, "|||" + "|{}|")):
        for j in range(i % 3 + 1):
            c = zlib.crc32(f"{i}:{j}".encode())
            want.append((i, hour + 6 * j * (c % 10), hashlib.sha256(f"{said}{c % 3}".encode()).hexdigest()))
    assert got == sorted(want)


def test_licenses(spark):
    mit = PASSAGES[0][1]
    changed = mit.replace("free of charge", "at no cost at all").replace("merge, ", "").replace("publish", "print")
    filler = "walk along the river and look at all the boats there "
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (4, "the GNU  General-Public\nLICENSE, gnu general public"), (5, filler * 30 + changed + filler * 30), (5, filler * 30 + changed + filler * 30), (6, "mit é license; cc by, cc-by-nc 4.0 CC BY"), (None, "apache license"), (7, mit[:80]), (8, filler * 2000), (9, (PASSAGES[2][1] + " ") * 3), (10, "of the software the of of the software use " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("labels", F.lit("gpl")).withColumn("row", F.lit(1)).withColumn("parts", F.lit(2))
    got = license_scan.scan(df).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text[r["doc_id"]] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted((k, label) for label, phrase in PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places})) and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}
    by = {r["doc_id"]: r for r in got}
    assert by[5]["labels"] == "mit" and 0.7 <= by[5]["score"] < 1 and by[3]["score"] == 1 and by[9]["labels"] == "bsd"
    assert [s["start"] for s in by[9]["spans"]] == [k * len(re.findall(r"\w+", PASSAGES[2][1])) for k in range(3)]
    assert all(by[k]["labels"] == "" and by[k]["score"] == 0 for k in (1, 2, 7, 8, 10))
    assert license_scan.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.Templates([("x", "one")], [])


def slow_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def patterned(rng):
    n = rng.choice([0, 5, 12, 13, 20, 40, 80, 150])
    w = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, p = rng.randrange(n + 1), rng.randint(1, max(1, n // 3))
        for i in range(a, min(n, a + rng.randint(2, 5) * p)):
            w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("least", [2, 7, 12])
def test_runs(least):
    rng = random.Random(least)
    for _ in range(250):
        w = patterned(rng)
        assert periodic_runs.runs(periodic_runs.numbered([b"%d" % x for x in w]), least) == slow_runs(w, least), w


def test_runs_of_long_texts():
    """Highly periodic texts of many words take seconds."""
    assert periodic_runs.runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert periodic_runs.runs(np.arange(100_000) % 7) == [(0, 100_000, 7)]
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert periodic_runs.runs(np.array(b[:700])) == slow_runs(b[:700]) and len(periodic_runs.runs(np.array(b))) > 100


def test_runs_of_documents(spark):
    rng = random.Random(3)
    rows = [(k, " \t".join(f"w{x}" for x in patterned(rng))) for k in range(60)] + [(None, "a b " * 20), (61, None), (62, ""), (63, "x y " * 30), (63, "x y " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("runs", F.lit(1)).withColumn("start", F.lit("s"))
    got = periodic_runs.find(df, fold=True, with_runs=True).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if r["doc_id"] is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want = slow_runs(words)
        gone = {k for s, m, q in want for k in range(s + q, s + m)}
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert periodic_runs.find(df.limit(0)).count() == 0


def test_stores_of_earlier_starts_close_soon():
    from cuetide.llm.click_dedup import STATE

    kept = {k.removeprefix("spark.sql.streaming.stateStore."): v for k, v in STATE.items()}
    assert int(kept["maintenanceInterval"].removesuffix("s")) <= 10 and kept["rocksdb.boundedMemoryUsage"] == "true"
