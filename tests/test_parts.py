"""Images, files, stores, jobs and review parts by cases."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuetide.functions import text
from cuetide.operators import evaluation, folds, frames, fuzzy, identity, images, regions, review
from cuetide.sources import captions, media, store
from cuetide.streaming import jobs


def test_edit_distance():
    plain = lambda a, b: folds.distance(a, b)
    assert [plain("kitten", "sitting"), plain("", "abc"), plain("abc", "abc"), plain("abcd", "acbd"), plain("xaby", "xbay")] == [3, 3, 0, 2, 2]


def test_rolling_gap_is_the_last_members():
    cap = lambda k, t, a, b: {"id": f"c{k}", "seq": k, "text": t, "start_time": a, "end_time": b}
    got = folds.captions([cap(0, "ABCD", 0, 10), cap(1, "CD", 1, 2), cap(2, "CDEF", 5, 6)])
    assert [c["text"] for c in got] == ["ABCD", "CDEF"] and got[0]["end_time"] == 10


def test_text_columns(spark):
    rows = spark.createDataFrame([("Ａｂ — c　 D", "ﬁ"), ("", "x")], "a string, b string")
    got = rows.select(text.normalized(F.col("a")).alias("n"), text.compact(F.col("a")).alias("c"), text.compact(F.col("b")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("ab - c d", "abcd", "fi"), ("", "", "x")]
    lines = spark.createDataFrame([("a\x1cb  a \r\nA",)], "t string").select(text.lines(F.col("t")).alias("l"), text.without_repeated_lines(F.col("t")).alias("w")).first()
    assert lines["l"] == ["a", "b", "a", "A"] and lines["w"] == "a\nb"


def test_fuzzy_columns(spark):
    rows = spark.createDataFrame([("1", "night", "nacht"), ("2", "aaaa", "aaa"), ("3", "", " "), ("4", "one\ntwo", "two\none"), ("5", "a", "")], "id string, a string, b string")
    got = {r["id"]: r for r in fuzzy.state_scores(rows, "id", "a", "b").collect()}
    assert got["1"]["dice"] == 0.25 and got["2"]["dice"] == 0.8 and got["3"]["sequence"] == 1 and got["4"]["lines"] == 1 and got["5"]["robust"] == 0
    words = rows.select("id", fuzzy.word_error_rate(F.lit("a b c"), F.lit("a x c d")).alias("w"), fuzzy.word_error_rate(F.lit(""), F.col("a")).alias("e")).collect()
    assert words[0]["w"] == pytest.approx(2 / 3) and [r["e"] for r in words] == [1.0, 1.0, 0.0, 1.0, 1.0]


def test_fuzzy_scores_stay_in_their_rows(spark, capsys):
    rows = spark.createDataFrame([("1", "One two\u2028ﬁve\n\nOne two", "five\x85two one"), ("2", None, "b"), ("3", "\n", "x"), ("4", "— \nab", "ab")], "id string, a string, b string")
    for found in (fuzzy.state_scores(rows, "id", "a", "b"), fuzzy.dice(rows, "id")):
        found.explain()
        assert "Exchange" not in capsys.readouterr().out
    got = {r["id"]: r for r in fuzzy.state_scores(rows, "id", "a", "b").collect()}
    assert got["1"]["lines"] == pytest.approx((12 * 0.99 * 0.8 + 4) / 16 / 2 + (6 * 0.99 * 0.8 + 4) / 10 / 2)
    assert got["2"]["sequence"] is None and got["2"]["lines"] is None and got["2"]["state"] == 0
    assert got["3"]["lines"] == 0 and got["4"]["lines"] == pytest.approx((2 / 3 + 1) / 2)
    rng = np.random.default_rng(3)
    for _ in range(2000):
        a, b = ("".join(rng.choice(list("abé𝒳"[: rng.integers(1, 5)]), rng.integers(1, 30))) for _ in range(2))
        assert fuzzy.matched(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()
    long = "ab" * 40_000
    assert fuzzy.matched(long, "b") == 2 / 80_001


def ink(text_rows):
    return np.asarray([[255 if c == "#" else 0 for c in r] for r in text_rows], np.uint8)


def test_images():
    flat, word = np.zeros((32, 32), np.uint8), np.zeros((32, 32), np.uint8)
    word[10:14, 4:28:3] = 255
    assert images.structural_difference(flat, flat) == 0 and images.structural_difference(flat, word) > 0.02
    assert images.structural_difference(flat, flat[:16]) == 1 and images.structural_difference(flat, flat + np.uint8(200)) > 0.7
    mask = ink(["##..#", "#...#", "..#.."]).astype(bool)
    assert images.component_sizes(mask).tolist() == [[3, 3, 0, 0, 2], [3, 0, 0, 0, 2], [0, 0, 1, 0, 0]]
    spiral = ink(["#####", "....#", "###.#", "#...#", "#####"]).astype(bool)
    assert set(images.component_sizes(spiral)[spiral].tolist()) == {int(spiral.sum())}
    assert not images.without_large_components(np.ones((4, 4), bool)).any()
    assert images.text_lines([[(0, 0), (9, 10)], [(12, 2), (20, 11)], [(0, 30), (9, 40)]]) == [(0, 0, 20, 11), (0, 30, 9, 40)]
    for kind in (images.dynamic_ink, images.stroke_ink, images.contrast_ink):
        a = images.signature(word, [[(2, 8), (30, 16)]], kind)
        assert a.shape == (96, 192) and a.any() and not images.signature(word, [], kind).any()
        assert (images.signature(255 - word, [[(2, 8), (30, 16)]], kind) == a).mean() > 0.9  # either polarity
    soft = images.box_resampled(ink(["##..", "##.."]).astype(bool), 1, 4)
    assert soft.tolist() == [[1, 1, 0, 0]] and images.box_resampled(np.ones((3, 3), bool), 2, 2).min() == 1
    assert abs(images.box_resampled(ink(["#..", "...", "..."]).astype(bool), 2, 2).sum() * 9 / 4 - 1) < 1e-9
    mask = images.RegionMask()
    cells = np.ones((30, 30), bool)
    assert mask.apply(cells).all()
    mask.update([[(2, 8), (30, 16)]], (32, 32))
    assert 0 < mask.apply(cells).sum() < cells.sum()
    mask.update([], (32, 32))
    assert mask.apply(cells).all()
    assert images.crop(word, (0.25, 0.25, 0.5, 0.5)).shape == (16, 16)


def test_image_tables(spark):
    frame = np.zeros((12, 12), np.uint8)
    frame[4:8, 2:10:2] = 255
    df = spark.createDataFrame([(bytearray(frame.tobytes()), 12, 12)], "pixels binary, height int, width int")
    made = images.with_signature(images.cropped(df, (0.0, 0.25, 1.0, 0.5)), images.edge_mask).first()
    assert (made["height"], made["width"], len(made["signature"])) == (6, 12, 40)
    pair = spark.createDataFrame([(bytearray(frame.tobytes()), bytearray(bytes(144)), 12, 12)], "a binary, b binary, height int, width int")
    assert images.difference_scores(pair).first()["difference"] > 0.02
    shift = spark.createDataFrame([([0.0, 1.0, 0.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    got = shift.select(frames.mass_distance(F.col("a"), F.col("b")).alias("m"), frames.shift_tolerant_distance(F.col("a"), F.col("b"), 2, 3).alias("s")).first()
    assert (got["m"], got["s"]) == (1.0, 0.0)


def test_pushed_states():
    grouper = frames.StateGrouper(0.4)
    on, off = [True] * 4, [False] * 4
    out = [grouper.push(float(k), c) for k, c in enumerate([off, off, on, on, off])] + [grouper.flush(), grouper.flush()]
    assert [x for x in out if x] == [("blank", 0.0, 1.0, 2, 0.0), ("subtitle", 2.0, 3.0, 2, 2.0), ("blank", 4.0, 4.0, 1, 4.0)]
    assert frames.medoid([[True, True], [True, False], [False, False]]) == 1 and frames.medoid([[True], [True, False]]) == 0
    assert list(frames.schedule([0.0, 0.1], lambda a, b: 0.0, tail=True)) == [(0, "bootstrap"), (1, "boundary")]


def test_caption_files(spark, tmp_path):
    body = "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i>\n\nafter a blank {\\an8}line\n\n2\n00:00:05,000 --> 00:00:04,000\nbad\n\n3\n01:00:06,000 --> 01:00:07,000\nlast 7\n"
    good, bad = captions.parsed(spark.createDataFrame([("s", "a.srt", body)], "source_id string, name string, body string"))
    assert [tuple(r)[1:] for r in good.orderBy("source_index").collect()] == [(0, "a.srt:0", 1.0, 2.5, "Hello\n\nafter a blank line"), (2, "a.srt:2", 3606.0, 3607.0, "last 7")]
    assert [r["source_index"] for r in bad.collect()] == [1]
    cues = spark.createDataFrame([(1, "a", 1.0, 2.0, "pending", [("en", "x")]), (1, "b", 0.0, 0.5, "rejected", [("en", "no")])], "source_id long, id string, start_time double, end_time double, review_state string, layers array<struct<language:string,text:string>>")
    paths = captions.write_files(captions.caption_files(cues, "vtt"), str(tmp_path / "out"), "vtt").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in paths] == ["1.vtt"] and (tmp_path / "out" / "1.vtt").read_text() == "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nx\n"
    assert captions.target_path("/a/b.srt") == "/a/b.reconstructed.srt"
    with pytest.raises(ValueError):
        captions.target_path("/a/b.srt", "/a/./b.srt")
    cues, kept, rejects = captions.reconstructed(spark.createDataFrame([("s", "a.srt", "1\n00:00:00,000 --> 00:00:02,000\nA\n\n2\n00:00:01,000 --> 00:00:03,000\nAB\n")], "source_id string, name string, body string"))
    assert cues.first()["text"] == "AB" and kept.count() == 2 and rejects.count() == 0


def test_store_checks(spark, tmp_path):
    from pyspark.errors import PySparkException

    entry = '{"id": "a", "video_path": "v", "segment_start_seconds": 0, "segment_end_seconds": 1, "languages": ["en"], "visibility": "public", "ground_truth_cues": []}'
    doc = lambda *e: spark.createDataFrame([('{"entries": [' + ", ".join(e) + "]}",)], "doc string")
    assert store.manifest(doc(entry)).first()["id"] == "a"
    for wrong in (doc(entry, entry), doc(entry.replace('"segment_end_seconds": 1', '"segment_end_seconds": 0')), doc(entry.replace('"visibility": "public", ', ""))):
        with pytest.raises(PySparkException):
            store.manifest(wrong).collect()
    cues = spark.createDataFrame([("a", [("en", "x")], "pending")], "id string, layers array<struct<language:string,text:string>>, review_state string")
    assert store.with_layer_text(cues, F.lit(True), "en", "y").first()["layers"][0]["text"] == "y"
    with pytest.raises(PySparkException):
        store.with_layer_text(cues, F.lit(True), "zh", "y").collect()
    assert review.required(cues, ["a"]).count() == 1
    with pytest.raises(Exception, match="unknown cue ids: b"):  # raised in a subquery, so by the JVM's own wrapper
        review.required(cues, ["a", "b"]).collect()
    with pytest.raises(PySparkException):
        spark.range(1).select(review.processing_range(F.lit(2.0), F.lit(1.0), F.lit(9.0))[0]).collect()
    detail = spark.createDataFrame([({"caption_identity_contract": "other"},)], "detail map<string,string>")
    with pytest.raises(PySparkException):
        detail.select(store.identity_evidence(F.col("detail"))).collect()
    steps = [lambda s: s.createDataFrame([(1,)], "id long"), lambda t: t.withColumn("more", F.lit("x"))]
    path = str(tmp_path / "t")
    assert store.migrated(spark, path, steps[:1]).columns == ["id"] and store.migrated(spark, path, steps).columns == ["id", "more"]
    assert store.migrated(spark, path, steps).first()["more"] == "x"
    with pytest.raises(ValueError):
        store.migrated(spark, path, steps[:1])
    codec = spark.createDataFrame([("a=1=2\x1fb=", None, "")], "d string, g string, h string").select(store.decoded_detail(F.col("d")).alias("d"), store.decoded_geometry(F.col("g")).alias("g"), store.decoded_geometry(F.col("h")).alias("h"), store.decoded_detail(F.col("h")).alias("e")).first()
    assert codec["d"] == {"a": "1=2", "b": ""} and codec["g"] is None and codec["h"] == [] and codec["e"] == {}


def test_jobs(spark, tmp_path):
    class Echo:
        name = "echo"

        def read(self, frame):
            return [jobs.Region(t, 0.5, "en", [(float(k), 0.0)]) for k, t in enumerate(frame.split())][::-1]

    rows = spark.createDataFrame([(1, k / 10, float(k // 4 % 2), "a b" if k % 2 else "") for k in range(20)], "source_id long, start_time double, signal double, frame string")
    found = jobs.evidence(rows, Echo).cache()
    assert found.where("text = ''").count() + found.where("text <> ''").select("start_time").distinct().count() == jobs.triggered(rows).count() > 0
    assert {(r["text"], r["place"]) for r in found.where("text <> ''").collect()} <= {("a", 0), ("b", 1)}
    assert jobs.metrics(rows, found).first()["frames"] == 20
    assert jobs.triggered(rows, "dense").count() == 20 and jobs.triggered(rows, "experimental_hybrid", detector=object).count() >= 2
    with pytest.raises(ValueError):
        jobs.triggered(rows, "experimental_hybrid")

    def broken():
        raise OSError("no card")

    assert isinstance(jobs.chosen([broken, Echo]), Echo)
    with pytest.raises(jobs.EngineError):
        jobs.chosen([broken])
    rows.select("source_id", "start_time").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id long, start_time double").parquet(str(tmp_path / "in"))
    job = jobs.Job(lambda: jobs.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "run1"))
    assert job.state == "queued" and job.run(120) == "succeeded"
    assert spark.read.parquet(str(tmp_path / "out")).where("evidence_run_id = 'run1'").count() == 20
    gone = jobs.Job(lambda: None)
    gone.cancel()
    assert gone.run() == "cancelled"


def test_evaluation_edges(spark):
    empty = spark.createDataFrame([], "source_id long, id long, start_time double, end_time double")
    got = evaluation.precision_recall(empty.withColumnRenamed("id", "t"), empty.withColumnRenamed("id", "f"), truth_id="t", found_id="f").first()
    assert tuple(got) == (0.0, 0.0)
    state = spark.createDataFrame([("succeeded", 0.1), ("cancelled", 0.99), ("cancelled", 0.5), ("failed", 1.0)], "s string, c double")
    assert [r[0] for r in state.select(evaluation.completion(F.col("s"), F.col("c"))).collect()] == ["completed", "completed_via_timeout_cancel", "partial_timeout", "failed"]
    assert regions.reading_order([[50.0, 0.0], [0.0, 5.0], [0.0, 40.0]]) == [1, 0, 2]
    one = spark.createDataFrame([(1,)], "x int")
    assert evaluation.recorded(one).count() == 1


def test_video_frames(spark, tmp_path):
    """12 frames at 30000/1001 a second: 6 flat, then 6 with a word."""
    path = tmp_path / "v.y4m"
    word = np.zeros((16, 24), np.uint8)
    word[6:10, 4:20:3] = 255
    flat = np.zeros((16, 24), np.uint8)
    with open(path, "wb") as f:
        f.write(b"YUV4MPEG2 W24 H16 F30000:1001 Ip C420jpeg\n")
        for k in range(12):
            f.write(b"FRAME\n" + (flat if k < 6 else word).tobytes() + bytes(192))
    (m,) = media.probe(spark, [str(path)]).collect()
    assert (m["width"], m["height"], m["codec"]) == (24, 16, "yuv4mpeg2/420jpeg") and m["duration_seconds"] == pytest.approx(0.4004)
    rows = media.read_frames(spark, [str(path)]).orderBy("place").collect()
    assert len(rows) == 12 and rows[11]["start_time"] == 11 * 1001 / 30000 and bytes(rows[7]["pixels"]) == word.tobytes()
    some = media.read_frames(spark, [str(path)], rows[3]["start_time"], rows[8]["start_time"]).collect()
    assert sorted(r["place"] for r in some) == [3, 4, 5, 6, 7]
    assert media.read_frames(spark, [str(path)], 5.0, 6.0).count() == 0
    states = images.dry_run(media.read_frames(spark, [str(path)]), 1000.0).orderBy("start_time").collect()
    assert [(r["kind"], r["n"]) for r in states] == [("blank", 6), ("subtitle", 6)]
    (tmp_path / "x.bin").write_bytes(b"other")
    with pytest.raises(ValueError):
        media.probed(str(tmp_path / "x.bin"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "x.bin"))
    assert media.decoded(files, lambda: lambda raw: [(0.0, 1, len(raw), raw)]).first()["width"] == 5


def test_straightened():
    x = np.arange(64, dtype=np.uint8).reshape(8, 8)
    assert (images.straightened(x, [(1, 2), (5, 2), (5, 5), (1, 5)]) == x[2:5, 1:5]).all()
    assert images.straightened(x, [(0, 0), (2, 0), (2, 6), (0, 6)]).shape == (2, 6)
    assert images.straightened(np.stack([x] * 3, -1), [(0, 0), (4, 0), (4, 4), (0, 4)]).shape == (4, 4, 3)


def test_runs_go_back(spark, tmp_path):
    path = str(tmp_path / "runs")
    one = lambda x: spark.createDataFrame([(x,)], "x int")
    assert store.latest_run(spark, path) is None and store.discard_latest_run(spark, path) is None
    store.save_run(one(1), path, 1)
    store.save_run(one(2), path, 2)
    assert store.latest_run(spark, path).first()["x"] == 2 and store.discard_latest_run(spark, path).first()["x"] == 1


def test_identity_summary(spark):
    payload = '{"version": "caption-identity-v1", "envelope": {"id": "e", "observed_start": 1, "observed_end": 2, "representative_pts": 1.5, "observations": []}, "stop_reason": "all_observations_probed", "selection_rationale": "r", "probes": [{"pts": 1.5, "selected_text": "x"}]}'
    row = spark.createDataFrame([({store.CONTRACT: store.IDENTITY_VERSION, store.ROLE: "envelope", store.PAYLOAD: payload},), ({},)], "detail map<string,string>")
    said = [r[0] for r in row.select(identity.summary(store.identity_evidence(F.col("detail")))).collect()]
    assert said[0].startswith("CoarseEnvelope 1.000–2.000s; representative 1.500s\nVerification: all_observations_probed; r") and said[0].endswith("1.500s selected: x") and said[1] is None
