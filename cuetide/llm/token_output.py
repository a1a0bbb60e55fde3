"""Token ids as binary shards of byte planes.

Documents are range-partitioned by id, so shard after shard holds them in ascending order.
Each task encodes its documents and writes one shard; a manifest (one row per shard) keeps
the paths that committed attempts wrote, so a file left by a lost or speculative attempt is
never read. A prefix sum over the manifest's totals gives each shard's global start.

A shard: ``CTBP1\\0\\0\\0``; blocks of ``block`` ids, each transposed into 4 byte planes (or 32
bit planes) that are compressed one by one with zstandard, so the empty high planes vanish;
the index, zstandard-compressed JSON and arrays: each block's place, its planes' sizes and
ids, then the documents' ids and lengths; last 16 bytes: the index's place and size. Any block
can be read alone. Files go through ``pyarrow.fs``: a local shared folder, HDFS or an object store.

Edge cases: a null or empty text is its end id alone; null ids come first; rows of equal ids
stand in the order of a hash of their text, so many of them are spread over shards; an empty table gives no shard and no row; other columns don't matter.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, text_or_empty, written
from .tokens import encoder

MAGIC = b"CTBP1\0\0\0"
BLOCK = 1 << 16


def file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The block's bits in order of their place in the id: 4 byte planes or 32 bit planes."""
    table = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [table[:, k].tobytes() for k in range(4)]
    return [np.packbits(table[:, k // 8] >> (k % 8) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if len(planes) == 4:
        for k, x in enumerate(planes):
            out[:, k] = np.frombuffer(x, np.uint8)
    else:
        for k, x in enumerate(planes):
            out[:, k // 8] |= np.unpackbits(np.frombuffer(x, np.uint8), count=n) << (k % 8)
    return out.reshape(-1).view("<u4")


class ShardWriter:
    """Holds one block of ids at most, besides the documents' ids and lengths."""

    def __init__(self, stream, block: int = BLOCK, planes: str = "byte", level: int = 3):
        import zstandard

        self.out, self.block, self.planes, self.packer = stream, block, planes, zstandard.ZstdCompressor(level=level)
        self.out.write(MAGIC)
        self.at, self.held, self.n_held, self.blocks, self.docs, self.sizes = len(MAGIC), [], 0, [], [], []

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.block:
            rows = np.frombuffer(b"".join(self.held), "<u4")
            whole = len(rows) // self.block * self.block
            for a in range(0, whole, self.block):
                self._put(rows[a : a + self.block])
            self.held, self.n_held = [rows[whole:].tobytes()], len(rows) - whole

    def _put(self, ids: np.ndarray) -> None:
        packed = [self.packer.compress(x) for x in to_planes(ids, self.planes)]
        self.blocks.append([self.at, len(ids), [len(x) for x in packed]])
        for x in packed:
            self.out.write(x)
            self.at += len(x)

    def close(self) -> None:
        if self.n_held:
            self._put(np.frombuffer(b"".join(self.held), "<u4"))
        none = [k for k, x in enumerate(self.docs) if x is None]
        arrays = [np.asarray([0 if x is None else x for x in self.docs], "<i8").tobytes(), np.asarray(self.sizes, "<i8").tobytes()]
        head = json.dumps({"blocks": self.blocks, "docs": len(self.docs), "null_ids": none}).encode()
        index = self.packer.compress(struct.pack("<q", len(head)) + head + b"".join(arrays))
        self.out.write(index + struct.pack("<qq", self.at, len(index)))


class ShardReader:
    def __init__(self, file, size: int):
        import zstandard

        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token shard")
        raw = self.unpacker.decompress(self._read(*struct.unpack("<qq", self._read(size - 16, 16))))
        n = struct.unpack("<q", raw[:8])[0]
        head = json.loads(raw[8 : 8 + n])
        ids, sizes = np.frombuffer(raw[8 + n :], "<i8").reshape(2, head["docs"])
        none = set(head["null_ids"])
        self.blocks, self.sizes = head["blocks"], sizes
        self.docs = [None if k in none else int(x) for k, x in enumerate(ids)]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.blocks[k]
        raw, planes = self._read(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.unpacker.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(planes, n)

    def documents(self):
        """(document id, its ids), holding a block and a document at most."""
        held, k, at = np.zeros(0, "<u4"), 0, 0
        for doc, size in zip(self.docs, self.sizes.tolist(), strict=True):
            if len(held) - at < size:
                parts, n = [held[at:]], len(held) - at
                while n < size:
                    parts.append(self.block(k))
                    n += len(parts[-1])
                    k += 1
                held, at = np.concatenate(parts), 0
            yield doc, held[at : at + size]
            at += size


def write_ids(docs: DataFrame, tokenizer: str, *, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, block: int = BLOCK, planes: str = "byte") -> DataFrame:
    """Writes the shards and returns their manifest: ``shard, path, n_docs, n_tokens, start``."""
    if planes not in ("byte", "bit"):
        raise ValueError("planes is byte or bit")
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-shards")

    def run(batches):
        encode, part, writer, path, n = encoder(tokenizer, end_id).encode, TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.ctbp"
                    fs, place = file_system(path)
                    writer = ShardWriter(fs.open_output_stream(place), block, planes)
                ids = encode(text.as_py())
                n += len(ids) // 4
                writer.add(doc, ids)
        if writer is not None:
            writer.close()
            writer.out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [path], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    place = [F.col("doc_id").asc_nulls_first(), F.col("key")]  # an id that many rows share is spread too
    ordered = rows.withColumn("key", F.xxhash64("text")).repartitionByRange(*place).sortWithinPartitions(*place, "text")
    found = written(ordered.select("doc_id", "text").mapInArrow(run, "shard int, path string, n_docs long, n_tokens long"), "token-manifest")
    out, at = [], 0
    for r in sorted(found.collect()):  # one short row per shard
        out.append((*r, at))
        at += r["n_tokens"]
    return spark.createDataFrame(out, "shard int, path string, n_docs long, n_tokens long, start long")


def read_ids(spark: SparkSession, manifest: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """Every document of the shards, from the files: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``).

    ``start`` counts the ids of all documents before it. One task reads one shard, block by block.
    """
    shards = [(r["path"], r["start"]) for r in manifest.orderBy("shard").collect()]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def batch(rows):
        doc, start, n, crc, ids = zip(*rows, strict=True)
        cols = {"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        return pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    def run(batches):
        for got in batches:
            for k in got.column(0).to_pylist():
                path, at = shards[k]
                fs, place = file_system(path)
                with fs.open_input_file(place) as file:
                    rows, held = [], 0
                    for doc, ids in ShardReader(file, file.size()).documents():
                        raw = ids.tobytes()
                        rows.append((doc, at, len(ids), zlib.crc32(raw), raw if with_ids else None))
                        at, held = at + len(ids), held + len(raw) * with_ids + 64
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, schema)
