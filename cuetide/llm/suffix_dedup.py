"""Repeated passages by a depth-limited radix sort of suffixes.

A byte is removed if a window of ``WINDOW`` bytes that covers it also starts in a document with a
smaller id. Suffixes are ordered only through a window's depth, by most-significant-digit passes over their
bytes (:func:`radix`): each pass splits every group by the next digit and drops the groups of one document.
Groups that are left at full depth are exactly the repeated windows; no hash decides equality.

1. Which suffixes are sorted (sampling). Of every window only the ``GRAM``-byte string with the smallest hash, its
   anchor, is looked for; equal windows have equal anchors at the same place, so no repeat is lost, and about 1
   of 14 places is one. Each chunk of documents sends its distinct anchors, as 32 bits of a hash and a bucket,
   and learns which of them other documents may have too. Wrong hits only cost work.
2. The surviving anchors are sent with their contexts: all bytes that a window over the anchor can hold. A bucket
   sorts them by the anchor's bytes, then by the others; equal contexts share their first document. Where an
   anchor has several contexts, the suffixes that start at each place before it are sorted through ``WINDOW`` bytes,
   which gives, bit by bit, the windows that start earlier elsewhere.
3. Each chunk marks its windows, byte for byte equal to those sent, and removes what they cover.

Skew: every key is aggregated inside a chunk (``CHUNK_DOCS`` documents) before it is shuffled, so
a text or passage of a third of all rows costs a row a chunk. An anchor that more than
``HOT_CHUNKS`` chunks hold, such as a common line amid ever other text, is dealt by its windows
instead of by itself, so no group of contexts is unbounded. Chunks are compressed and written once, into
a table bucketed by chunk that later joins read in place; its buckets hold about ``PART_BYTES`` of text.

Edge cases: null and empty texts have no byte and keep none; texts shorter than a window stay whole; rows
that share an id never remove each other's bytes; a null id neither removes nor loses bytes;
an empty table gives no row; other columns don't matter. A text is never split: it needs several times
its size in the memory of one worker.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, text_or_empty

WINDOW, GRAM = 50, 24
CHUNK_DOCS, CHUNK_BYTES, HOT_CHUNKS = 4096, 16 << 20, 1024
#: Entries of a bucket and bytes of text in a part of the chunk table, about.
BUCKET, PART_BYTES = 400_000, 64 << 20
_SEGMENT, _PLACE_BITS = 1 << 20, 21


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: Odd multipliers without linear relations between them.
ODD = mixed(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _loads(raw: np.ndarray, n: int, offset: int, stride: int = 1) -> np.ndarray:
    """``n`` little-endian 64-bit words, ``stride`` bytes apart."""
    return np.ndarray((n,), "<u8", raw, offset, (stride,))


def _hash_at(raw: np.ndarray, n: int, offset: int, size: int, stride: int = 1) -> np.ndarray:
    """Hashes of the ``size``-byte strings (8 or more) at ``offset``, ``offset + stride``, ..."""
    places = [*range(0, size - 7, 8)] + ([size - 8] if size % 8 else [])
    total = np.zeros(n, np.uint64)
    for k, at in enumerate(places):
        total += (x := _loads(raw, n, offset + at, stride)) * ODD[k] ^ (x >> np.uint64(32))
        total ^= total << np.uint64(7)
    return mixed(total)


class Shape:
    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        if not (8 <= gram < window and window - gram <= 31):
            raise ValueError("a window is 1 to 31 bytes longer than an anchor of 8 bytes or more")
        self.window, self.gram, self.side = window, gram, window - gram
        self.whole = gram + 2 * self.side
        self.row = (self.whole + 2 + 7) // 8 * 8  # a context, its sides' lengths, padding

    def anchors(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of all anchors of the documents that end at ``ends`` in ``raw``."""
        n, step, places, hashes = int(ends[-1]) if len(ends) else 0, _SEGMENT, [], []
        data = np.concatenate([raw[:n], np.zeros(8, np.uint8)])
        steps = []
        width = 1
        while width * 2 <= self.side + 1:
            steps.append(width)
            width *= 2
        for a in range(0, n - self.window + 1, step):
            b = min(n, a + step + self.window - 1)
            h = _hash_at(data, b - a - self.gram + 1, a, self.gram)
            low = h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
            for s in steps:
                low = np.minimum(low[:-s], low[s:])
            if width < self.side + 1:
                low = np.minimum(low[: len(low) - (self.side + 1 - width)], low[self.side + 1 - width :])
            fine = np.zeros(len(low) + 1, np.int32)
            cross = ends[(ends > a) & (ends < b)] - a  # windows over a document's end
            np.add.at(fine, np.maximum(cross - self.window + 1, 0), 1)
            np.add.at(fine, np.minimum(cross, len(low)), -1)
            got = (low[np.cumsum(fine[:-1]) == 0] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
            if len(got):
                got = got[np.concatenate([[True], got[1:] != got[:-1]])]
                places.append(got + a)
                hashes.append(h[got])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        p, h = np.concatenate(places), np.concatenate(hashes)
        first = np.concatenate([[True], p[1:] != p[:-1]])
        return p[first], h[first]

    def contexts(self, raw: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A row of bytes for each anchor: what windows over it hold (0 outside the document), the sides' lengths."""
        rows = np.zeros((len(place), self.row), np.uint8)
        padded = np.concatenate([np.zeros(self.side, np.uint8), raw, np.zeros(self.side, np.uint8)])
        wide = np.lib.stride_tricks.sliding_window_view(padded, self.whole)
        rows[:, : self.whole] = wide[place]
        left, right = np.minimum(self.side, place - start), np.minimum(self.side, end - place - self.gram)
        for k in np.flatnonzero((left < self.side) | (right < self.side)):
            rows[k, : self.side - left[k]] = 0
            rows[k, self.side + self.gram + right[k] : self.whole] = 0
        rows[:, self.whole], rows[:, self.whole + 1] = left, right
        return rows

    def row_hash(self, rows: np.ndarray) -> np.ndarray:
        return _hash_at(np.ascontiguousarray(rows).reshape(-1), len(rows), 0, self.row, self.row) if len(rows) else np.zeros(0, np.uint64)

    def windows(self, rows: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        """(which rows have a window at ``offset``, its hash)."""
        left, right = rows[:, self.whole], rows[:, self.whole + 1]
        fine = (offset >= self.side - left.astype(int)) & (offset <= right)
        return fine, _hash_at(np.ascontiguousarray(rows).reshape(-1), len(rows), offset, self.window, self.row)


def _digits(start: int, end: int) -> list[int]:
    """Where 8-byte digits that cover the bytes from ``start`` to ``end`` stand; the last may overlap."""
    return [*range(start, end - 7, 8)] + ([end - 8] if (end - start) % 8 else [])


def radix(rows: np.ndarray, places: list[int], members: np.ndarray, group: np.ndarray, alive) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the digits at ``places`` of the ``members`` among ``rows`` (bytes).

    Each pass splits the groups by one digit; ``alive(members, starts)`` says which groups go on. Returns the
    members left, by group, and their groups: equal in all digits.
    """
    for at in places:
        if not len(members):
            break
        key = np.ndarray((len(rows),), ">u8", rows, at, (rows.shape[1],))[members]
        order = np.lexsort((key, group))
        members, key, group = members[order], key[order], group[order]
        edge = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        group = np.cumsum(edge) - 1
        on = alive(members, np.flatnonzero(edge))[group]
        members, group = members[on], group[on]
    return members, group


def _codec(level: int = 2):
    import zstandard

    return zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()


def _sorted_planes(x: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as byte planes of their differences."""
    return np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _first_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunks of documents: ``chunk, n_bytes, ids, sizes, texts`` (zstandard)."""

    def run(batches):
        pack, _ = _codec()
        chunk, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def row():
            body = b"".join(texts)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "n_bytes": pa.array([len(body)], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "texts": pa.array([pack.compress(body)], pa.binary())})

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = t.as_buffer().to_pybytes()
                if ids and (len(ids) >= CHUNK_DOCS or held + len(raw) > CHUNK_BYTES):
                    yield row()
                    chunk, ids, texts, held = chunk + 1, [], [], 0
                ids.append(i)
                texts.append(raw)
                held += len(raw)
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long"), text_or_empty(text_col))
    return rows.mapInArrow(run, "chunk long, n_bytes long, ids array<long>, sizes array<long>, texts binary")


def _chunks(batches, undo):
    """(row, ids, ends, bytes) of each chunk of :func:`packed`."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = {name: batch.column(j)[k] for j, name in enumerate(batch.schema.names)}
            sizes = np.asarray(r["sizes"].values.to_numpy(zero_copy_only=False), np.int64)
            raw = np.frombuffer(undo.decompress(r["texts"].as_py()), np.uint8) if sizes.sum() else np.zeros(0, np.uint8)
            yield r, r["ids"].as_py(), np.cumsum(sizes), raw


def _by_bucket(batches):
    """(bucket, its rows) of a partition sorted by bucket, one bucket at a time."""
    now, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["bucket"] != now:
                yield now, held
                held = []
            now = r["bucket"]
            held.append(r)
    if held:
        yield now, held


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("payload", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())])
_SENT_DDL = "bucket int, kind int, chunk long, n int, payload binary"
_REPLY_DDL = "chunk long, bucket int, kind int, n int, payload binary"


def send_anchors(chunks: DataFrame, shape: Shape, bits: int) -> DataFrame:
    """First digit: each chunk's distinct anchors by bucket, and which of them it has in two documents."""

    def run(batches):
        pack, undo = _codec()
        for r, _, ends, raw in _chunks(batches, undo):
            place, h = shape.anchors(raw, ends)
            if not len(place):
                continue
            key = h >> np.uint64(32 - bits)
            doc = np.searchsorted(ends, place, "right")
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = _first_of(key)
            twice = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
            key = key[first]
            bucket, rest = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            starts = _first_of(bucket)
            rows = [(int(bucket[a]), 0, r["chunk"].as_py(), int(b - a), pack.compress(np.packbits(twice[a:b]).tobytes() + _sorted_planes(rest[a:b]))) for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True)]
            yield _batch(_SENT, rows)

    return chunks.mapInArrow(run, _SENT_DDL)


def repeated_anchors(sent: DataFrame, hot_chunks: int) -> DataFrame:
    """For each chunk: its anchors that two documents have, and whether they are hot."""

    def run(batches):
        pack, undo = _codec()
        for bucket, held in _by_bucket(batches):
            parts, flags = [], []
            for r in held:
                raw, n = undo.decompress(r["payload"]), r["n"]
                flags.append(np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8), count=n).astype(bool))
                parts.append(_from_planes(raw[(n + 7) // 8 :]))
            rest, twice = np.concatenate(parts), np.concatenate(flags)
            order = np.argsort(rest, kind="stable")
            first = _first_of(rest[order])
            count = np.diff([*first, len(order)])
            state = np.where(count > hot_chunks, 2, np.where((count > 1) | np.logical_or.reduceat(twice[order], first), 1, 0)).astype(np.uint8)
            back = np.empty(len(order), np.uint8)
            back[order] = np.repeat(state, count)
            at, rows = 0, []
            for r, x in zip(held, parts, strict=True):
                s = back[at : at + len(x)]
                at += len(x)
                if (keep := s > 0).any():
                    rows.append((r["chunk"], bucket, 0, int(keep.sum()), pack.compress(s[keep].tobytes() + _sorted_planes(x[keep]))))
            if rows:
                yield _batch(_REPLY, rows)

    return sent.mapInArrow(run, _REPLY_DDL)


def _sent_rows(keys: np.ndarray, own: np.ndarray, place: np.ndarray, body: np.ndarray, bits: int, bucket_of: np.ndarray, chunk: int, kind: int, pack) -> list[tuple]:
    """A chunk's distinct ``body`` rows by bucket: first owner, whether it has more, first place, bytes."""
    order = np.lexsort((own, keys, bucket_of))
    keys, own, place, body, bucket_of = keys[order], own[order], place[order], body[order], bucket_of[order]
    if not len(keys):
        return []
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (body[1:] != body[:-1]).any(1)]))
    many = np.maximum.reduceat(own, first) != own[first]
    own, place, body = own[first], place[first].astype("<u4"), body[first]
    bucket = (bucket_of[first] >> np.uint64(64 - bits)).astype(np.int64)
    cuts = _first_of(bucket)
    return [(int(bucket[a]), kind, chunk, int(b - a), pack.compress(own[a:b].tobytes() + many[a:b].tobytes() + place[a:b].tobytes() + body[a:b].tobytes())) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]


def send_contexts(joined: DataFrame, shape: Shape, bits: int, own_bits: int) -> DataFrame:
    """Distinct contexts of the surviving anchors, or distinct windows of hot ones, with their first document."""

    def run(batches):
        pack, undo = _codec(5)
        for r, ids, ends, raw in _chunks(batches, undo):
            keys, states = [], []
            for x in sorted(r["replies"].as_py(), key=lambda x: x["bucket"]):
                body, n = undo.decompress(x["payload"]), x["n"]
                states.append(np.frombuffer(body, np.uint8, n))
                keys.append(_from_planes(body[n:]).astype(np.uint64) | np.uint64(x["bucket"] << 32))
            keys, states = np.concatenate(keys), np.concatenate(states)
            order = np.argsort(keys, kind="stable")
            keys, states = keys[order], states[order]
            place, h = shape.anchors(raw, ends)
            key = h >> np.uint64(32 - own_bits)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            doc = np.searchsorted(ends, place, "right")
            known = np.asarray([x is not None for x in ids])[doc] & (keys[at] == key)
            place, h, doc, hot = place[known], h[known], doc[known], states[at[known]] == 2
            owner = np.asarray([0 if x is None else x for x in ids], np.int64)[doc]
            starts = np.concatenate([[0], ends[:-1]])
            rows = shape.contexts(raw, place, starts[doc], ends[doc])
            chunk, cold = r["chunk"].as_py(), ~hot
            out = _sent_rows(shape.row_hash(rows[cold]), owner[cold], place[cold], rows[cold], bits, h[cold], chunk, 0, pack)
            if hot.any():
                seen, whose, where, bodies = [], [], [], []
                for o in range(shape.side + 1):
                    fine, w = shape.windows(rows[hot], o)
                    seen.append(w[fine])
                    whose.append(owner[hot][fine])
                    where.append(place[hot][fine] - shape.side + o)
                    bodies.append(rows[hot][fine, o : o + shape.window])
                w = np.concatenate(seen)
                out += _sent_rows(w, np.concatenate(whose), np.concatenate(where), np.concatenate(bodies), bits, w, chunk, 1, pack)
            if out:
                yield _batch(_SENT, out)

    return joined.mapInArrow(run, _SENT_DDL)


_FOUND = np.dtype([("place", "<u4"), ("first", "<i8"), ("mask", "<u4")])


def _several(members: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff([*starts, len(members)]) > 1


def first_and_mask(shape: Shape, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first document of each context, which of that one's windows start earlier elsewhere)."""
    n = len(rows)
    first, mask, of = own.copy(), np.zeros(n, np.uint32), np.arange(n)
    anchored, anchor = radix(rows, _digits(shape.side, shape.side + shape.gram), np.arange(n), np.zeros(n, np.int64), _several)
    if not len(anchored):
        return first, mask
    end = shape.whole + 2  # with the sides' lengths
    equal, group = radix(rows, _digits(0, shape.side) + _digits(shape.side + shape.gram, end), anchored, anchor, _several)
    if len(equal):
        starts = _first_of(group)
        sizes = np.diff([*starts, len(equal)])
        first[equal] = np.repeat(np.minimum.reduceat(own[equal], starts), sizes)
        of[equal] = np.repeat(np.minimum.reduceat(equal, starts), sizes)
    lead = of[anchored] == anchored  # one of each context
    reps, anchor = anchored[lead], anchor[lead]
    other = lambda members, starts: np.minimum.reduceat(first[members], starts) != np.maximum.reduceat(first[members], starts)
    for o in range(shape.side + 1):
        left, right = rows[reps, shape.whole].astype(int), rows[reps, shape.whole + 1].astype(int)
        fine = (o >= shape.side - left) & (o <= right)
        same, group = radix(rows, _digits(o, o + shape.window), reps[fine], anchor[fine], other)
        if len(same):
            starts = _first_of(group)
            low = np.repeat(np.minimum.reduceat(first[same], starts), np.diff([*starts, len(same)]))
            mask[same[low < first[same]]] |= np.uint32(1 << o)
    return first, mask[of]


def earlier_windows(sent: DataFrame, shape: Shape) -> DataFrame:
    """For each chunk and context: its first document and which of that one's windows start earlier elsewhere."""

    def run(batches):
        pack, undo = _codec()
        for bucket, held in _by_bucket(batches):
            out = []
            for kind, width in ((0, shape.row), (1, shape.window)):
                mine = [r for r in held if r["kind"] == kind]
                if not mine:
                    continue
                own, many, place, rows = [], [], [], []
                for r in mine:
                    body, n = undo.decompress(r["payload"]), r["n"]
                    own.append(np.frombuffer(body, "<i8", n))
                    many.append(np.frombuffer(body, bool, n, 8 * n))
                    place.append(np.frombuffer(body, "<u4", n, 9 * n))
                    rows.append(np.frombuffer(body, np.uint8, n * width, 13 * n).reshape(n, width))
                own, many, place, rows = np.concatenate(own), np.concatenate(many), np.concatenate(place), np.concatenate(rows)
                if kind == 0:
                    first, mask = first_and_mask(shape, rows, own)
                else:
                    first, mask = own.copy(), np.zeros(len(own), np.uint32)
                    same, group = radix(rows, _digits(0, width), np.arange(len(rows)), np.zeros(len(rows), np.int64), _several)
                    if len(same):
                        starts = _first_of(group)
                        first[same] = np.repeat(np.minimum.reduceat(own[same], starts), np.diff([*starts, len(same)]))
                useful = (first < own) | many | (mask > 0)
                at = 0
                for r in mine:
                    s = np.flatnonzero(useful[at : at + r["n"]]) + at
                    at += r["n"]
                    if len(s):
                        found = np.empty(len(s), _FOUND)
                        found["place"], found["first"], found["mask"] = place[s], first[s], mask[s]
                        out.append((r["chunk"], bucket, kind, len(s), pack.compress(found.tobytes())))
            if out:
                yield _batch(_REPLY, out)

    return sent.mapInArrow(run, _REPLY_DDL)


def _lookup(keys: np.ndarray, rows: np.ndarray, key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each ``row`` the place of its equal among ``rows``, or -1; ``key`` and ``keys`` are their hashes, ``keys`` ascending."""
    out, at = np.full(len(key), -1), np.searchsorted(keys, key)
    todo = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == key))
    while len(todo):
        same = (rows[at[todo]] == row[todo]).all(1)
        out[todo[same]] = at[todo[same]]
        todo = todo[~same]
        at[todo] += 1  # another row of the same hash
        todo = todo[at[todo] < len(keys)]
        todo = todo[keys[at[todo]] == key[todo]]
    return out


def covered(shape: Shape, ids: list, ends: np.ndarray, raw: np.ndarray, found: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which bytes of a chunk are removed."""
    change = np.zeros(len(raw) + 1, np.int32)
    if len(found) or len(hot):
        place, h = shape.anchors(raw, ends)
        doc = np.searchsorted(ends, place, "right")
        known = np.asarray([x is not None for x in ids], bool)[doc]
        if not len(hot):
            known &= np.isin(h, h[np.searchsorted(place, found["place"])])
        place, doc = place[known], doc[known]
        owner = np.asarray([0 if x is None else x for x in ids], np.int64)[doc]
        starts = np.concatenate([[0], ends[:-1]])
        rows = shape.contexts(raw, place, starts[doc], ends[doc])
        if len(found):
            key, mine = shape.row_hash(rows), np.searchsorted(place, found["place"])
            order = np.argsort(key[mine], kind="stable")
            found, mine = found[order], mine[order]
            at = _lookup(key[mine], rows[mine], key, rows)
            hit = at >= 0
            left, right = rows[:, shape.whole].astype(np.int64), rows[:, shape.whole + 1].astype(np.int64)
            late = hit & (owner > found["first"][at]) & (right >= shape.side - left)
            np.add.at(change, (place - left)[late], 1)
            np.add.at(change, (place + shape.gram + right)[late], -1)
            mask = np.where(hit & (owner == found["first"][at]), found["mask"][at], 0)
            for o in range(shape.side + 1):
                s = place[(mask >> o & 1) > 0] - shape.side + o
                np.add.at(change, s, 1)
                np.add.at(change, s + shape.window, -1)
        if len(hot):
            bodies = np.lib.stride_tricks.sliding_window_view(raw, shape.window)[hot["place"].astype(np.int64)]
            keys = _hash_at(np.ascontiguousarray(bodies).reshape(-1), len(bodies), 0, shape.window, shape.window)
            order = np.argsort(keys, kind="stable")
            keys, bodies, hot = keys[order], bodies[order], hot[order]
            for o in range(shape.side + 1):
                fine, w = shape.windows(rows, o)
                some = np.flatnonzero(fine)
                at = _lookup(keys, bodies, w[some], rows[some, o : o + shape.window])
                s = place[some[(at >= 0) & (owner[some] > hot["first"][at])]] - shape.side + o
                np.add.at(change, s, 1)
                np.add.at(change, s + shape.window, -1)
    return np.cumsum(change[:-1]) > 0


def cut_out(joined: DataFrame, shape: Shape, with_kept: bool) -> DataFrame:
    def run(batches):
        _, undo = _codec()
        for r, ids, ends, raw in _chunks(batches, undo):
            parts = {0: [], 1: []}
            for x in r["replies"].as_py() or []:
                parts[x["kind"]].append(np.frombuffer(undo.decompress(x["payload"]), _FOUND))
            found, hot = (np.concatenate(parts[k]) if parts[k] else np.zeros(0, _FOUND) for k in (0, 1))
            gone = covered(shape, ids, ends, raw, found, hot)
            rows, a = [], 0
            for i, b in zip(ids, ends.tolist(), strict=True):
                g = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                kept = raw[a:b][~g].tobytes() if len(edges) else raw[a:b].tobytes()
                rows.append((i, b - a, int(g.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges.tolist(), *([kept] if with_kept else [])))
                a = b
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64())] + [pa.binary()] * with_kept
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_edges"] + ["kept"] * with_kept
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_edges array<long>" + ", kept binary" * with_kept)


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, hot_chunks: int = HOT_CHUNKS, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_edges`` and, if asked, the ``kept`` bytes.

    ``span_edges`` alternates starts and ends of the removed byte runs.
    """
    shape, spark = Shape(window, gram), docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(20, max(6, int(np.ceil(np.log2(max(1, total * 2 / (shape.side + 2) / BUCKET))))))
    n = max(parts, min(1 << bits, 4000))
    chunks, _ = bucketed(packed(docs, id_col, text_col), "chunk", "chunks", max(parts, -(-total // PART_BYTES)))

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "chunk")

    def by_chunk(rows: DataFrame) -> DataFrame:
        return rows.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "kind", "n", "payload")).alias("replies"))  # a chunk's own anchors at most

    found = by_chunk(repeated_anchors(by_bucket(send_anchors(chunks, shape, bits)), hot_chunks))
    sent = send_contexts(chunks.join(found.hint("shuffle_hash"), "chunk"), shape, bits, bits)
    replies = by_chunk(earlier_windows(by_bucket(sent), shape))
    return cut_out(chunks.join(replies.hint("shuffle_hash"), "chunk", "left"), shape, with_kept)
