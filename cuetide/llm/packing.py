"""Packing of token ids into fixed windows: concatenate and cut.

Pass 1 encodes every text once and writes the ids with their offset inside the partition.
The partition totals (one row per partition) give each partition's global offset by a
prefix sum. Pass 2 cuts the endless row of ids at every multiple of ``length``: window
``k`` holds the ids from ``k * length``; a document over a boundary becomes several pieces,
the boundary records, that name their windows. Only the last window needs padding.

Recovery: offsets are read from the written table of pass 1, never recomputed, so a task
that runs again places its ids where the first attempt did.

Edge cases: a null or empty text is its end id alone (nothing without an end id); a null
document id stays null; repeated rows are packed as often as they occur; an empty table gives
no piece. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .tokens import encoder

#: Bytes of ids after which a batch goes to Spark.
BATCH_BYTES = 8 << 20


def encoded(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> DataFrame:
    """Pass 1, lazily: ``doc_id, ids (binary <u4), n_tokens, part, part_start``."""

    def run(batches):
        encode, part, at = encoder(tokenizer, end_id).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, ids, starts, first, held = batch.column(0), [], [], 0, 0
            for k, text in enumerate(batch.column(1)):
                got = encode(text.as_py())
                ids.append(got)
                starts.append(at)
                at += len(got) // 4
                held += len(got)
                if held > BATCH_BYTES or k == batch.num_rows - 1:
                    n = pa.array([len(x) // 4 for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([keys.slice(first, k + 1 - first), pa.array(ids, pa.binary()), n, pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64())], names=["doc_id", "ids", "n_tokens", "part", "part_start"])
                    ids, starts, first, held = [], [], k + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, part int, part_start long")


def cut(ids: DataFrame, length: int, *, with_ids: bool = True) -> DataFrame:
    """Pass 2 over the written rows of :func:`encoded`."""
    totals = ids.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one short row per partition
    base, at = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        base[part], at = at, at + n

    def run(batches):
        for batch in batches:
            rows, first, crcs, cuts = [], [], [], []
            doc, n, part, offset = (batch.column(k) for k in (0, 2, 3, 4))
            for k, (raw, size, p, o) in enumerate(zip(batch.column(1), n.to_pylist(), part.to_pylist(), offset.to_pylist(), strict=True)):
                begin = base[p] + o
                edges = [begin, *range((begin // length + 1) * length, begin + size, length), begin + size]
                view = memoryview(raw.as_buffer())
                for a, b in zip(edges, edges[1:], strict=False):
                    if b > a:
                        piece = view[4 * (a - begin) : 4 * (b - begin)]
                        rows.append(k)
                        first.append((a - begin, b - a, a // length, a % length))
                        crcs.append(zlib.crc32(piece))
                        if with_ids:
                            cuts.append(bytes(piece))
            if rows:
                at = pa.array(rows, pa.int64())
                start, size, seq, off = np.asarray(first, np.int64).T
                cols = [doc.take(at), pa.array(start), pa.array(size), pa.array(crcs, pa.int64()), n.take(at), pa.array(seq), pa.array(off)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(cuts, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    kind = ids.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ids.mapInArrow(run, schema + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, *, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: one row for each piece and the window it lies in.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``with_ids``, the piece's ``ids`` as little-endian unsigned 32-bit integers.
    """
    if length < 1:
        raise ValueError("length must be positive")
    return cut(written(encoded(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id), "packing"), length, with_ids=with_ids)


def sequences(pieces: DataFrame, *, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """Whole windows ready for training: ``sequence_id, n_tokens, ids`` padded to ``length``.

    A window has at most ``length`` pieces, so no group can grow with the corpus.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    pad = F.lit(bytearray(np.full(length, pad_id, "<u4").tobytes()))
    held = F.aggregate(F.col("parts"), F.lit(bytearray()), lambda a, x: F.concat(a, x["ids"]))
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
        .select("sequence_id", "n_tokens", F.substring(F.concat(held, pad), 1, 4 * length).alias("ids"))
    )
