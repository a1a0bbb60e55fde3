"""Expiring deduplication of clicks: a keyed state machine over Structured Streaming.

A click id has at most one open window. A row of that id whose hour lies at most ``horizon`` hours behind the
window's start is a repeat; any other closes the window and opens the next. Rows more than ``lateness`` hours
behind the newest hour of earlier batches are late and dropped; windows that no timely row can reach close.

State: ``transformWithStateInPandas`` keyed by **shard** (a hash of the id), with one value a shard: an Arrow stream
of parallel arrays, sorted by id, one entry an open window. A batch is sorted once, merged with the state by binary
search, and folded in rounds (all ids take their next window at once). What the watermark has passed is masked out
when the shard's timer fires; the rest is written back as one blob.

Time: the event time of a row is its hour. The engine's watermark (newest hour less ``lateness``) is the bound of
late rows in the next batch, and closes windows at the start of that batch: by a shard's rows or, without rows, by its
timer. So a start needs one micro-batch, not a second one without data. A row of a far hour in the last batch, which
belongs to no id, moves the watermark past all windows; a batch without data follows that one only.

Recovery: batches lie in the shared folder before the stream starts; state, offsets and the sink's log lie in its
checkpoint there, so a start that fails is started again and repeats only what isn't committed.

Bounds: a shard's state and rows of one batch are in one task; ``shards`` grows with the rows, see
:func:`shards_for`. Equal (id, hour, hash) rows are summed before the shuffle. What one id has besides (different
rows of one id in one batch) is folded in one task, as its windows follow from each other.

Edge cases: rows without id or hour take no part; repeated rows are repeats of each other; a null hash counts as the
empty one; an empty batch changes nothing; without rows there is no window; further columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .common import new_folder

HOUR = 3_600_000
OUT = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"
#: The window's fields in a shard's blob, in the order of the arrays.
OPEN = {"id": "<i8", "start": "<i8", "repeats": "<i8", "conflicts": "<i8", "crc": "<i8", "h0": "<u8", "h1": "<u8", "h2": "<u8", "h3": "<u8"}
#: A row's fields in a packed part of a batch; ``n`` equal rows are one.
ROW = {"id": "<i8", "hour": "<i8", "n": "<i8", "h0": "<u8", "h1": "<u8", "h2": "<u8", "h3": "<u8"}
HASH = ("h0", "h1", "h2", "h3")
#: How state is kept: changes are uploaded, not whole stores; small stores, of which an executor may hold many, neither
#: reserve disk ahead nor hold large buffers, and share one bound of memory. Each start opens stores of its own, and
#: those of the start before stay open till the next maintenance, so that comes often (an executor keeps the interval of
#: its first stateful query).
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
#: Whether a start ends with a micro-batch without data; only the last one needs it.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Rows that a task packs at once before it deals them to shards.
PACK_ROWS = 100_000
#: Copies that a shard is meant to hold over the whole input.
SHARD_ROWS = 50_000


def shards_for(rows: int, least: int = 64) -> int:
    return max(least, math.ceil(rows / SHARD_ROWS))


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Parallel arrays as one compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in arrays.values()], names=list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes | None, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    if blob is None:
        return {k: np.empty(0, t) for k, t in kinds.items()}
    held = pa.ipc.open_stream(blob).read_all()
    return {k: held.column(k).to_numpy() for k in kinds}


def take(arrays: dict[str, np.ndarray], at) -> dict[str, np.ndarray]:
    return {k: a[at] for k, a in arrays.items()}


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _same(a: dict, b: dict, names) -> np.ndarray:
    return np.logical_and.reduce([a[k] == b[k] for k in names])


def summed(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows sorted by id, hour and hash, equal ones as one with their number."""
    rows = take(rows, np.lexsort([rows[k] for k in ("h3", "h2", "h1", "h0", "hour", "id")]))
    if len(rows["id"]) < 2:
        return rows
    first = np.flatnonzero(np.concatenate([[True], ~_same(take(rows, slice(1, None)), take(rows, slice(None, -1)), ("id", "hour", *HASH))]))
    return take(rows, first) | {"n": np.add.reduceat(rows["n"], first)}


def crc_of_hash(rows: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """crc32 of each hash's lowercase hexadecimal text."""
    raw = np.stack([rows[k][at] for k in HASH], axis=1).astype(">u8").tobytes().hex().encode()
    return np.fromiter((zlib.crc32(raw[k : k + 64]) for k in range(0, len(raw), 64)), np.int64, len(at))


def fold(held: dict[str, np.ndarray], rows: dict[str, np.ndarray], horizon: int) -> tuple[dict[str, np.ndarray], list[dict[str, np.ndarray]]]:
    """Open windows after ``rows`` (as :func:`summed` gives them), and the windows that they closed.

    Each round gives every id that still has rows all repeats of its open window by one binary search, then opens
    its next window; so the rounds are as many as the windows of the busiest id, whatever the number of ids.
    """
    ids, first = np.unique(rows["id"], return_index=True)
    end = np.append(first[1:], len(rows["id"]))
    at = first.copy()  # each id's next row
    where = np.searchsorted(held["id"], ids)
    known = np.zeros(len(ids), bool)
    inside = where < len(held["id"])
    known[inside] = held["id"][where[inside]] == ids[inside]
    rest = take(held, np.setdiff1d(np.arange(len(held["id"])), where[known], assume_unique=True))
    now = {k: np.zeros(len(ids), t) for k, t in OPEN.items()} | {"id": ids}
    for k in OPEN:
        now[k][known] = held[k][where[known]]
    closed, todo = [], np.arange(len(ids))
    opened = known.copy()
    group = np.repeat(np.arange(len(ids)), end - first)
    low = rows["hour"].min() if len(ids) else 0
    span = int(rows["hour"].max() - low) + 2 if len(ids) else 1
    key = group * span + (rows["hour"] - low)  # ascending, as rows go by id and hour
    while len(todo):
        new = todo[~opened[todo]]
        for k in HASH:
            now[k][new] = rows[k][at[new]]
        now["start"][new] = rows["hour"][at[new]]
        for k in ("conflicts", "crc"):
            now[k][new] = 0
        now["repeats"][new] = -1  # the opener itself is counted below
        last = np.clip(now["start"][todo] + horizon - low, -1, span - 2)
        upto = np.maximum(np.searchsorted(key, todo * span + last, side="right"), at[todo])
        size = upto - at[todo]
        owner = np.repeat(todo, size)
        row = np.repeat(at[todo] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        np.add.at(now["repeats"], owner, rows["n"][row])
        unlike = ~np.logical_and.reduce([rows[k][row] == now[k][owner] for k in HASH])
        if unlike.any():
            np.add.at(now["conflicts"], owner[unlike], rows["n"][row[unlike]])
            np.add.at(now["crc"], owner[unlike], rows["n"][row[unlike]] * crc_of_hash(rows, row[unlike]))
        at[todo] = upto
        todo = todo[upto < end[todo]]
        closed.append(take(now, todo))
        opened[todo] = False
    both = joined([rest, now])
    return take(both, np.argsort(both["id"], kind="stable")), closed


class ExpiringWindows(StatefulProcessor):
    """One start of the stream: the batch's number, that of the batch fed before it, the hour at which event time
    begins, and the far hour that ends the stream."""

    def __init__(self, batch: int, before: int, origin: int, far: int, horizon: int, lateness: int):
        self.batch, self.before, self.origin, self.far, self.horizon, self.lateness = batch, before, origin, far, horizon, lateness

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getValueState("windows", "blob binary")

    def _newest(self, timer_values) -> int | None:
        """The newest hour of earlier batches; none before the second."""
        at = timer_values.getCurrentWatermarkInMs()
        return at // HOUR - 1 + self.origin if at > 0 else None

    def _keep(self, held: dict[str, np.ndarray]) -> None:
        if not len(held["id"]):
            self.windows.clear()
            return
        self.windows.update((pack(held),))
        due = int(held["start"].min()) + self.horizon + self.lateness + 1  # the least newest hour that closes a window
        self.handle.registerTimer((due - self.origin + 1) * HOUR - 1)

    def _out(self, windows: dict[str, np.ndarray], batch: int) -> pd.DataFrame:
        n = len(windows["id"])
        raw = np.stack([windows[k] for k in HASH], axis=1).astype(">u8").tobytes()
        return pd.DataFrame({"click_id": windows["id"], "start_hour": windows["start"], "closed_batch": np.full(n, batch, np.int64), "n_repeats": windows["repeats"], "n_conflicts": windows["conflicts"], "conflict_crc": windows["crc"], "hash": [raw[k : k + 32] for k in range(0, 32 * n, 32)]})

    def _state(self) -> dict[str, np.ndarray]:
        return unpack(bytes(self.windows.get()[0]) if self.windows.exists() else None, OPEN)

    def _over(self, held: dict[str, np.ndarray], newest: int | None) -> np.ndarray:
        """Windows that no row can reach after the newest hour of earlier batches."""
        return np.zeros(len(held["id"]), bool) if newest is None else held["start"] + self.horizon < newest - self.lateness

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [unpack(bytes(blob), ROW) for frame in rows for blob in frame["blob"] if blob is not None]
        newest = self._newest(timerValues)
        if not parts:
            return
        got = joined(parts)
        if newest is not None:
            got = take(got, got["hour"] >= newest - self.lateness)
        if not len(got["id"]):
            return
        held = self._state()
        over = self._over(held, newest)
        if over.any():
            yield self._out(take(held, over), self.before)
        held, closed = fold(take(held, ~over), summed(got), self.horizon)
        self._keep(held)
        for windows in closed:
            if len(windows["id"]):
                yield self._out(windows, self.batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, newest = self._state(), self._newest(timerValues)
        if newest is None or not len(held["id"]):
            return
        over = self._over(held, newest)
        if over.any():
            yield self._out(take(held, over), self.batch if newest >= self.far else self.before)
            self._keep(take(held, ~over))

    def close(self) -> None:
        pass


def _packed(rows: DataFrame, shards: int) -> DataFrame:
    """``shard, blob``: what a task has of each shard, equal rows summed, as one blob."""

    def deal(parts):
        got = summed(joined(parts))
        shard = (got["id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % shards
        order = np.argsort(shard, kind="stable")
        got, shard = take(got, order), shard[order]
        names, first = np.unique(shard, return_index=True)
        ends = np.append(first[1:], len(shard))
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([pack(take(got, slice(a, b))) for a, b in zip(first, ends, strict=True)], pa.binary())], names=["shard", "blob"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            far = batch.filter(batch.column(0).is_null())
            if far.num_rows:  # moves the watermark only
                batch = batch.filter(batch.column(0).is_valid())
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([None], pa.binary())], names=["shard", "blob"])
            raw = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in batch.column(2)), ">u8").reshape(-1, 4)
            parts.append({"id": batch.column(0).to_numpy(), "hour": batch.column(1).to_numpy(), "n": np.ones(batch.num_rows, np.int64)} | {k: raw[:, c].astype("<u8") for c, k in enumerate(HASH)})
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield deal(parts)
                parts, n = [], 0
        if n:
            yield deal(parts)

    return rows.select("click_id", "hour", "hash").mapInArrow(run, "shard long, blob binary")


def _move(spark: SparkSession, source: str, target: str) -> bool:
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(old) and fs.rename(old, new))


def windows(rows: DataFrame, batches: int, *, horizon: int = 72, lateness: int = 48, shards: int | None = None) -> DataFrame:
    """All closed windows of ``rows`` (``click_id long, hour long, hash binary of 32 bytes, batch int``).

    The rows are written by batch, and each batch is a start of the streaming query of its own on one checkpoint.
    Returns ``click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash``.
    """
    spark = rows.sparkSession
    base = new_folder(spark, "clicks")
    rows.where("click_id IS NOT NULL AND hour IS NOT NULL AND batch IS NOT NULL").select("click_id", "hour", F.coalesce("hash", F.lit(bytes(32))).alias("hash"), "batch").write.option("compression", "zstd").partitionBy("batch").parquet(f"{base}/cut")
    cut = spark.read.schema("click_id long, hour long, hash binary, batch int").parquet(f"{base}/cut")
    told = cut.agg(F.min("hour").alias("low"), F.max("hour").alias("high"), F.count("*").alias("n")).first()
    if not told["n"]:
        return spark.createDataFrame([], OUT)
    origin, shards = told["low"] - lateness, shards or shards_for(told["n"])  # event time starts so late that every watermark is positive
    far = told["high"] + horizon + lateness + 1
    spark.range(1).select(F.lit(None).cast("long").alias("click_id"), F.lit(far).cast("long").alias("hour"), F.lit(bytes(32)).alias("hash")).write.mode("append").parquet(f"{base}/cut/batch={batches - 1}")
    before = {k: spark.conf.get(k, None) for k in (*STATE, NO_DATA)}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    fed = 0
    try:
        for batch in range(batches):
            if not _move(spark, f"{base}/cut/batch={batch}", f"{base}/fed/batch={batch}"):
                continue
            spark.conf.set(NO_DATA, str(batch == batches - 1).lower())
            stream = spark.readStream.schema("click_id long, hour long, hash binary").parquet(f"{base}/fed/batch=*")
            timed = stream.withColumn("at", F.timestamp_seconds((F.col("hour") - origin + 1) * 3600)).withWatermark("at", f"{lateness} hours")
            out = _packed(timed, shards).groupBy("shard").transformWithStateInPandas(ExpiringWindows(batch, fed, told["low"], far, horizon, lateness), OUT, "Append", "eventTime")
            query = out.writeStream.format("parquet").option("path", f"{base}/closed").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            fed = batch
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(OUT).parquet(f"{base}/closed")


def epoch_micros(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970 in UTC; a time without a zone is UTC, whatever the session's zone."""
    at = F.col(name)
    if rows.schema[name].dataType.simpleString() != "timestamp_ntz":
        return F.unix_micros(at)
    day = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return (day * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60) * 1_000_000 + (F.expr(f"extract(SECONDS FROM `{name}`)") * 1_000_000).cast("long")


def copies(clicks: DataFrame, batches: int) -> DataFrame:
    """The copies of the rows of ``clicks`` with hour, hash and batch, as the contract of the query fixes them."""
    micros = epoch_micros(clicks, "arrived_at")
    hour = F.floor(micros / F.lit(3_600_000_000)).cast("long") if clicks.schema["arrived_at"].dataType.simpleString() != "timestamp_ntz" else (F.datediff(F.col("arrived_at").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("arrived_at"))
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cents = F.floor(F.col("value") * 100 + 0.5)
    row = clicks.where("click_id IS NOT NULL AND arrived_at IS NOT NULL").select(
        "click_id", hour.alias("came"), F.concat_ws("|", empty(F.col("client_id")), empty(F.col("kind")), empty(cents), empty(epoch_micros(clicks, "ts")), empty(F.col("props"))).alias("said"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("click_id") % 3, F.lit(0)).cast("int"))).alias("j")
    )
    row = row.withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string"))))
    row = row.withColumn("hour", F.col("came") + 6 * F.col("j") * (F.col("c") % 10))
    row = row.withColumn("place", F.col("hour") + F.floor(F.col("c") / 10) % 200)
    low, high = row.agg(F.min("place"), F.max("place")).first()
    batch = F.floor((F.col("place") - F.lit(low)) * batches / F.lit((high or 0) - (low or 0) + 1)).cast("int") if low is not None else F.lit(0)
    return row.select("click_id", "hour", F.unhex(F.sha2(F.concat_ws("|", "said", (F.col("c") % 3).cast("string")), 256)).alias("hash"), batch.alias("batch"))
