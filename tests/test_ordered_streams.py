"""State machines over streams out of order: the same as the batch, after a restart too."""

import random

from pyspark.sql import functions as F

from cuetide.operators import frames
from cuetide.streaming import frame_gate, ordered


def run(spark, tmp_path, rows, schema, parts, start):
    """Feeds ``parts`` of rows, a start of the query each, on one checkpoint."""
    with ordered.state_store(spark):
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
            stream = start(spark.readStream.schema(schema).parquet(str(tmp_path / "in/part=*")))
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(repr, spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()))


def shuffled(rng, rows, n, late):
    """``n`` parts in time, rows up to ``late`` seconds late."""
    came = sorted(rows, key=lambda r: r[1] + rng.random() * late)
    size = -(-len(came) // n)
    return [came[k * size : (k + 1) * size] for k in range(n)]


def test_frame_triggers_stream_as_in_batch(spark, tmp_path):
    rng = random.Random(2)
    schema = "source_id long, start_time double, id long, height int, width int, pixels binary, ended boolean"
    rows = []
    for s in range(3):
        level = 0
        for k in range(120):
            level = rng.choice([level, level, level, (level + 7) % 200, rng.randrange(200)])
            shown = rng.randrange(200) if k % 17 == 5 else level  # a flash
            noise = [(shown + rng.choice([0, 0, 60]) * (k // 30 % 2)) % 256 for _ in range(64)]
            h, w = (4, 16) if k // 25 % 4 == 2 else (8, 8)
            rows.append((s, k * 0.25, k, h, w, bytearray(noise), False))
    want = sorted(map(repr, frame_gate.decisions(spark.createDataFrame(rows, schema)).collect()))
    assert {"first_frame", "change_detected", "below_structural_threshold", "reverted_to_baseline"} <= {w.split("decision='")[1].split("'")[0] for w in want}
    ends = [(s, 30.0, None, None, None, None, True) for s in range(3)]
    parts = shuffled(rng, rows, 3, 1.5)
    got = run(spark, tmp_path, rows, schema, parts[:-1] + [parts[-1] + ends], lambda df: ordered.stream_frame_triggers(df, "2 seconds"))
    assert got == want


def test_visual_states_wait_for_the_end(spark, tmp_path):
    rng = random.Random(3)
    schema = "source_id long, start_time double, id long, signature array<boolean>, ended boolean"
    rows = [(s, float(k), k, [rng.random() < (0.0 if k // 9 % 3 == 1 else 0.5) and (k // 9 + j) % 2 == 0 for j in range(16)], False) for s in range(2) for k in range(60)]
    batch = spark.createDataFrame(rows, schema)
    want = sorted(map(repr, frames.grouped_states(batch, 0.4).collect()))
    parts = shuffled(rng, rows, 2, 6)
    early = run(spark, tmp_path, rows, schema, parts, lambda df: ordered.stream_states(df, 0.4, "8 seconds"))
    assert set(early) < set(want)  # what is open is not given out
    ends = [(s, 60.0, None, None, True) for s in range(2)]
    spark.createDataFrame(ends, schema).coalesce(1).write.parquet(str(tmp_path / "in/part=9"))
    with ordered.state_store(spark):
        stream = ordered.stream_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in/part=*")), 0.4, "8 seconds")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(repr, spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())) == want


def test_gate_refuses_a_drift():
    gate = frame_gate.FrameGate()
    flat = lambda v: bytes([v]) * 64
    assert gate.see(0.0, 8, 8, flat(10))[0] == "first_frame"
    assert gate.see(1.0, 8, 8, flat(20)) is None
    assert gate.see(1.1, 8, 8, flat(20))[0] == "below_structural_threshold"
    assert gate.see(1.2, 4, 16, flat(20))[0] == "change_detected"
    again = frame_gate.FrameGate.restored(gate.state())
    assert again.see(3.3, 4, 16, flat(20))[0] == gate.see(3.3, 4, 16, flat(20))[0] == "periodic_confirmation"
