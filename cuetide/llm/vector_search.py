"""Exact top-k inner products by vector-approximation files.

Components are ``floor(256 * x)``. Two files are written: the exact vectors, one row each, and the
approximation file, blocks of the vectors' cells: the components' leading bits, one byte a component.

1. Scan: each block of queries meets each block of cells in one task. The cells bound every score from both
   sides; what can't reach the block's k-th lower bound goes, the rest are rows of (query, candidate, bounds).
   No exact vector is read.
2. The k-th lower bound over all blocks leaves each query its candidates, in the order of their upper bounds.
3. Exact vectors are fetched for each query's first ``FIRST`` of them; then, for queries whose k-th exact score an
   unread upper bound could still reach, for those. The result is certain then.

No join broadcasts a side, whatever the files' size lets Spark expect: a block of queries goes to every block of
cells, so a broadcast would hold the queries many times. Blocks of cells hold ``BLOCK_ROWS`` vectors, or fewer where
that would leave tasks idle and a task would score over ``PAIRS`` pairs; each block has the queries shuffled and
bounds kept once more. Inside a task they are scanned ``TILE`` at a time.

Edge cases: a null vector, or one with a null or non-finite component, takes no part; vectors of
unlike lengths are compared as if padded with zeros; repeated rows are candidates each; a
query's own id is never its neighbour; a null id is no query but a candidate, after the others in ties; fewer
than ``k`` candidates: all of them; ties go to the smaller id; components beyond the long range count as its
ends, and so do scores; empty tables give no row; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS, QUERY_ROWS, TILE, FIRST, PAIRS = 65_536, 4096, 4096, 16, 1 << 27


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def cells_of(v: np.ndarray, shift: int) -> np.ndarray:
    """The leading bits, as signed bytes."""
    return (v >> shift).astype(np.int8)


def _dense(vectors: list, dim: int) -> np.ndarray:
    flat = np.zeros((len(vectors), dim), np.int64)
    for k, v in enumerate(vectors):
        flat[k, : len(v)] = v
    return flat


def _blocks(rows: DataFrame, n_blocks: int, name: str, as_cells: bool, shift: int, dim: int, small: bool) -> DataFrame:
    """``row, id, v`` packed to one row a block: cells in bytes, or whole queries in the least width that holds them."""
    kind = np.int16 if small else np.int64

    def run(table: pa.Table) -> pa.Table:
        flat = _dense(table["v"].to_pylist(), dim)
        ids = table["id"].to_pylist()
        out = {
            "block": table["block"].slice(0, 1).combine_chunks(),
            "rows": [table["row"].to_numpy().astype(np.int64).tobytes()],
            "ids": [np.asarray([0 if x is None else x for x in ids], np.int64).tobytes()],
            "known": [np.asarray([x is not None for x in ids]).tobytes()],
            "v": [(cells_of(flat, shift) if as_cells else flat.astype(kind)).tobytes()],
        }
        return pa.Table.from_pydict(out)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    return written(dealt.groupBy("block").applyInArrow(run, "block int, rows binary, ids binary, known binary, v binary"), name)


def scan(q: np.ndarray, q_ids: np.ndarray, cells: np.ndarray, c_ids: np.ndarray, c_known: np.ndarray, k: int, shift: int):
    """(query's place, candidate's place, lower, upper bound) of all that may be among a query's ``k`` best here.

    Bounds are doubles widened by their rounding error, so they hold for components of any size.
    """
    wide = float((1 << shift) - 1)
    whole = q.astype(np.float64)
    up, down = np.maximum(whole, 0).sum(1) * wide, np.minimum(whole, 0).sum(1) * wide
    most = np.abs(whole).sum(1)
    slack = most * float(1 << shift) * 128 * 2.0**-45  # rounding of the products, with room to spare
    kind = np.float32 if most.max(initial=0) * 128 < 1 << 24 else np.float64
    if most.max(initial=0) * 128 * float(1 << shift) < 2.0**52:
        slack = np.zeros(len(q))  # every sum is exact
    parts = []
    for a in range(0, len(cells), TILE):
        near = (q.astype(kind) @ cells[a : a + TILE].T.astype(kind)).astype(np.float64) * float(1 << shift)
        near[c_known[None, a : a + TILE] & (q_ids[:, None] == c_ids[None, a : a + TILE])] = -np.inf
        low = near + (down - slack)[:, None]
        n = low.shape[1]
        floor = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
        high = near + (up + slack)[:, None]
        i, j = np.nonzero((high >= floor[:, None]) & (near > -np.inf))
        parts.append((i, j + a, low[i, j], high[i, j]))
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None


def _best_bounds(i: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Which rows reach their query's k-th lower bound."""
    order = np.lexsort((-low, i))
    start = np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1]]))
    size = np.diff([*start, len(order)])
    floor = np.where(size >= k, low[order][np.minimum(start + k - 1, len(order) - 1)], -np.inf)
    keep = np.zeros(len(i), bool)
    keep[order] = high[order] >= np.repeat(floor, size)
    return keep


def _scores(pairs: DataFrame, big: bool) -> DataFrame:
    """``own, query_id, vec_id, score`` of ``own, query_id, vec_id, q, v``."""
    if not big:
        return pairs.select("own", "query_id", "vec_id", F.aggregate(F.zip_with(F.col("q"), F.col("v"), lambda x, y: F.coalesce(x.cast("long") * y, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))

    def run(batches):  # sums may leave the long range: exact integers, then its ends
        for batch in batches:
            got = [max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=False)))) for q, v in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(got, pa.int64())], names=["own", "query_id", "vec_id", "score"])

    return pairs.select("own", "query_id", "vec_id", "q", "v").mapInArrow(run, "own long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, bits: int = 8, block_rows: int = BLOCK_ROWS, first: int = FIRST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best among all other rows."""
    if not 1 <= bits <= 8:
        raise ValueError("a cell has 1 to 8 bits")
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col))).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col)).alias("v"), (F.coalesce(is_query, F.lit(False)) & F.col(id_col).isNotNull()).alias("asks"))
    rows = written(rows, "exact-vectors")
    top = F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))
    n, asks, most, dim = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)), F.max(top), F.max(F.size("v"))).first()
    most, dim = int(most or 0), int(dim or 0)
    shift = max(0, most.bit_length() + 1 - bits)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c_blocks = max(1, -(-n // block_rows), min(tasks, -(-n // TILE), -(-n * asks // PAIRS)))
    small, big = most < 1 << 15, most * most * max(1, dim) >= 1 << 62
    cells = _blocks(rows.drop("asks"), c_blocks, "cells", True, shift, dim, small)
    queries = _blocks(rows.where("asks").drop("asks"), max(1, -(-asks // QUERY_ROWS)), "queries", False, shift, dim, small)
    queries = queries.select(F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("v").alias("q_v"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("block"))
    met = queries.repartition(max(2, c_blocks), "block").join(cells.hint("merge"), "block")

    def run(batches):
        kind = np.int16 if small else np.int64
        for batch in batches:
            for p in range(batch.num_rows):
                r = {name: batch.column(x)[p].as_py() for x, name in enumerate(batch.schema.names)}
                q_ids, q_rows, c_ids, c_rows = (np.frombuffer(r[x], np.int64) for x in ("q_ids", "q_rows", "ids", "rows"))
                found = scan(np.frombuffer(r["q_v"], kind).reshape(len(q_ids), -1).astype(np.int64), q_ids, np.frombuffer(r["v"], np.int8).reshape(len(c_ids), -1), c_ids, np.frombuffer(r["known"], bool), k, shift)
                if found is not None and len(found[0]):
                    keep = _best_bounds(found[0], found[2], found[3], k)
                    i, j, low, high = (x[keep] for x in found)
                    yield pa.RecordBatch.from_pydict({"own": q_rows[i], "row": c_rows[j], "low": low, "high": high})

    bounds = written(met.mapInArrow(run, "own long, row long, low double, high double"), "bounds")
    by_low, by_high = W.partitionBy("own").orderBy(F.col("low").desc()), W.partitionBy("own").orderBy(F.col("high").desc(), "row")
    floor = bounds.withColumn("place", F.row_number().over(by_low)).where(F.col("place") <= k).groupBy("own").agg(F.when(F.count("*") == k, F.min("low")).otherwise(float("-inf")).alias("floor"))
    left = bounds.join(floor.hint("merge"), "own").where("high >= floor").withColumn("place", F.row_number().over(by_high)).select("own", "row", "high", "place")
    left = written(left, "candidates")
    v = F.col("v").cast("array<short>" if small else "array<long>")  # these are shuffled
    exact = rows.select("row", F.col("id").alias("vec_id"), v.alias("v"))
    asked = rows.where("asks").select(F.col("row").alias("own"), F.col("id").alias("query_id"), v.alias("q"))
    fetch = lambda some: _scores(some.select("own", "row").join(exact.hint("merge"), "row").join(asked.hint("merge"), "own"), big)
    by_score = W.partitionBy("own").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    best = lambda scored: scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    got = written(best(fetch(left.where(F.col("place") <= max(first, k)))), "first-scores")
    reached = got.groupBy("own").agg(F.min("score").cast("double").alias("kth"))  # of k, as k were read
    rest = left.where(F.col("place") > max(first, k)).join(reached.hint("merge"), "own").where(F.col("high") >= F.col("kth") - F.abs("kth") * 2.0**-50)
    every = got.drop("rank").unionAll(fetch(rest))
    return best(every).select("query_id", "rank", "vec_id", "score")
