"""Similarity self-join on word n-grams by adaptive multi-match prefixes.

A document is the set of its distinct ``size``-word shingles, as 64-bit hashes. Two link when
their Jaccard similarity is ``percent`` per cent or more.

1. Equal texts are one text, told by 128 bits of hashes and dropped before the shuffle where a task meets them
   again. Texts are shuffled once, into a table bucketed by a part of the hash that starts a text's number, so
   every later join by that number reads them in place. Equal sets are one class, found by a digest of the
   set; a class's smallest text number is its node from here on.
2. Seeds: classes that share one of their ``SEEDS`` smallest shingles, at about the same size, are
   compared with the first class that has it (a star, not all pairs). Verified links are
   merged into components, so large groups of near copies collapse at linear cost.
3. Counts: every shingle of the corpus is counted, by as many bits of its hash as the corpus needs
   for about one shingle a value. Those with ``LEAST`` or more are frequent.
4. Adaptive prefixes find every link between different components. All shingles have one
   order: rare before frequent by their counts, then by hash. If x and y
   are similar, their prefixes of ``|x| - ceil(t |x|) + l`` shingles share at least ``l``. Each
   document picks its own ``l`` by its candidates' estimated number, the counts of the frequent
   shingles in its prefix, and a pair must share as many as the smaller ``l`` of the two; size and
   place filters go before. Fewer than ``LEAST`` documents share a rare shingle, so its pairs
   are rows. Few documents have a frequent one where a similar set must meet them; those meet with whole
   prefixes: once with a few of their like, so that what is alike becomes few components, then with all of other
   components, dealt over pairs of groups of about ``CELL`` members. Only pairs that share enough leave a task.
   Candidates are verified on whole texts.
5. Components of all verified links; rows that share an id are linked too.

Nothing is capped: a group of documents with a common shingle is only skipped where they
are in one component already. The table of frequent shingles is broadcast; it holds at most
``MAX_FREQUENT``, for ``LEAST`` doubles until they fit. A hub's comparisons are dealt over salted groups
of about ``GROUP`` members, each of which streams past the hub's set.

Edge cases: null and empty texts have no set and link with nothing; fewer words than ``size``: the whole
sequence is the one shingle; rows that share an id are one document with several sets, linked if any
of them is; a null id links with nothing and its component is null; an empty table gives no row;
other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bucketed, named, quoted, text_or_empty, written
from .components import components
from .suffix_dedup import ODD, _from_planes, _sorted_planes, mixed

SIZE, PERCENT, SEEDS, GROUP, CELL = 5, 80, 6, 256, 512
#: Postings of a bucket and counted shingles of a bucket, about.
BUCKET, COUNT_BUCKET = 300_000, 4_000_000
#: Bytes of text in a part of the text table, about.
PART_BYTES = 64 << 20
#: A shingle of so many documents is frequent; the broadcast table of them has at most so many rows.
LEAST, MAX_FREQUENT = 16, 1 << 20

class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


class Shingler:
    """Text -> its distinct shingles' hashes, ascending."""

    def __init__(self, size: int = SIZE):
        self.size, self.words = size, _Words()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: A-Z and ASCII white space
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        size = min(n, self.size)
        total = np.full(n - size + 1, size * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for k in range(size):
            total += w[k : n - size + 1 + k] * ODD[k]
        return np.unique(mixed(total))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def least_shared(n, percent: int):
    """Shingles that a set of ``n`` shares with any similar one at least."""
    return -(-n * percent // 100)


def counted(hashes: list[np.ndarray], bits: int, bucket_bits: int):
    """(bucket, its distinct leading ``bits`` and their counts, packed) of some shingles."""
    import zstandard

    pack, low = zstandard.ZstdCompressor(level=1), bits - bucket_bits
    keys = np.sort(np.concatenate(hashes) >> np.uint64(64 - bits))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff([*first, len(keys)]).astype("<u4")
    keys = keys[first]
    cuts = np.searchsorted(keys, np.arange(0, (1 << bucket_bits) + 1, dtype=np.uint64) << np.uint64(low))
    for bucket, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a:
            rest = (keys[a:b] & np.uint64((1 << low) - 1)).astype(np.uint32)
            more = np.flatnonzero(counts[a:b] > 1).astype("<u4")  # most occur once
            yield bucket, pack.compress(len(more).to_bytes(4, "little") + more.tobytes() + counts[a:b][more].tobytes() + _sorted_planes(rest))


def uncounted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    more, several = np.frombuffer(raw, "<u4", 2 * n, 4).reshape(2, n)
    keys = _from_planes(raw[4 + 8 * n :])
    counts = np.ones(len(keys), np.int64)
    counts[more] = several
    return keys, counts


def distinct_texts(rows: DataFrame, n: int) -> DataFrame:
    """``node, b, h1, h2, text`` of every different text of ``h1, h2, text``, in ``n`` parts by ``b``.

    ``b`` is 47 bits of ``h1``, ``node`` ``b`` and a running number among the texts that share it.
    """

    def once(batches):
        met = set()
        for batch in batches:
            keep = []
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key not in met:
                    if len(met) > 200_000:
                        met.clear()
                    met.add(key)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    def number(batches):
        now, last, k = None, None, 0
        for batch in batches:
            nodes, keep = [], []
            for place, (part, *key) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if part != now:
                    now, k = part, 0
                elif key == last:
                    continue
                else:
                    k += 1
                    if k >> 16:
                        raise ValueError("too many texts share 47 bits of their hash")
                last = key
                nodes.append(part << 16 | k)
                keep.append(place)
            got = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *got.columns], names=["node", *got.schema.names])

    rows = rows.select("h1", "h2", "text").mapInArrow(once, "h1 long, h2 long, text string").withColumn("b", F.shiftrightunsigned("h1", 17))
    dealt = rows.select("b", "h1", "h2", "text").repartition(n, "b").sortWithinPartitions("b", "h1", "h2")
    return dealt.mapInArrow(number, "node long, b long, h1 long, h2 long, text string")


def with_texts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (with ``node``) and each node's ``text``: a join by ``b``, by which the texts lie in buckets already."""
    asked = asked.withColumnRenamed("node", "asked_node").withColumn("asked_b", F.shiftrightunsigned("asked_node", 16))
    # were the nodes' equality a key too, the texts would be shuffled by both
    same = (F.col("b") == F.col("asked_b")) & (F.col("node") - F.col("asked_node") == 0)
    return texts.select("b", "node", "text").join(asked.hint("shuffle_hash"), same).drop("b", "asked_b", "asked_node")


def with_texts_of(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with ``h1``, ``h2``) and the ``text`` of these hashes, by ``b`` as :func:`with_texts`."""
    asked = rows.withColumnsRenamed({"h1": "asked_h1", "h2": "asked_h2"}).withColumn("asked_b", F.shiftrightunsigned("asked_h1", 17))
    same = (F.col("b") == F.col("asked_b")) & (F.col("h1").bitwiseXOR(F.col("asked_h1")) == 0) & (F.col("h2").bitwiseXOR(F.col("asked_h2")) == 0)
    return texts.select("b", "h1", "h2", "text").join(asked.hint("shuffle_hash"), same).drop("b", "h1", "h2", "asked_b", "asked_h1", "asked_h2")


def described(texts: DataFrame, size: int, bits: int, bucket_bits: int) -> DataFrame:
    """``node, n, digest, seeds`` of each of ``node, text``; also rows with ``block`` and ``counts``: shingles counted."""
    names = ["node", "n", "digest", "seeds", "block", "counts"]

    def run(batches):
        sets, held, n_held = Shingler(size), [], 0

        def rows():
            got = list(counted(held, bits, bucket_bits))
            k = len(got)
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], names=names)

        for batch in batches:
            ns, digests, seeds = [], [], []
            for text in batch.column(1):
                s = sets(text.as_buffer().to_pybytes())
                ns.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                seeds.append(s[:SEEDS].view(np.int64).tolist())
                if len(s):
                    held.append(s)
                    n_held += len(s)
                    if n_held > 4_000_000:
                        yield rows()
                        held, n_held = [], 0
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(seeds, pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if held:
            yield rows()

    return texts.select("node", "text").mapInArrow(run, "node long, n long, digest binary, seeds array<long>, block int, counts binary")


class Frequent:
    """Classes of frequent shingles by their leading bits: 0 is rare, each one more is twice as frequent."""

    def __init__(self, keys: np.ndarray, classes: np.ndarray, bits: int):
        order = np.argsort(keys)
        self.keys, self.classes, self.bits = keys[order], classes[order], bits

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(s), np.uint8)
        k = s >> np.uint64(64 - self.bits)
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.classes[at], 0).astype(np.uint8)


def frequent(rows: DataFrame, bits: int, bucket_bits: int, least: int, most: int) -> Frequent:
    """The shingles that ``least`` documents or more have; ``least`` doubles until they are at most ``most``."""

    def run(batches):
        import zstandard

        undo, now, held = zstandard.ZstdDecompressor(), None, []

        def found():
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
            total = np.add.reduceat(counts[order], first)
            often = total >= least
            key = keys[order][first][often].astype(np.int64) | now << (bits - bucket_bits)
            kind = np.floor(np.log2(total[often] / least)).astype(np.int32) + 1
            return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "kind": pa.array(kind, pa.int32())})

        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and block != now:
                    yield found()
                    held = []
                now = block
                held.append(uncounted(undo.decompress(raw.as_py())))
        if held:
            yield found()

    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << bucket_bits)
    some = rows.where(F.col("block").isNotNull()).select("block", "counts").repartition(n, "block").sortWithinPartitions("block")
    table = written(some.mapInArrow(run, "key long, kind int"), "frequent")
    sizes, lowest = {r["kind"]: r["count"] for r in table.groupBy("kind").count().collect()}, 1
    while sum(c for k, c in sizes.items() if k >= lowest) > most:
        lowest += 1
    got = table.where(F.col("kind") >= lowest).toArrow()  # at most ``most`` rows
    kinds = got["kind"].to_numpy() - (lowest - 1)
    return Frequent(got["key"].to_numpy().astype(np.uint64), kinds.astype(np.uint8), bits)


def prefix(s: np.ndarray, classes: Frequent, percent: int) -> tuple[np.ndarray, int, int, int]:
    """(the adaptive prefix, rare shingles first; how many of it are rare; the length that any similar set's meets; ``l``) of a set."""
    n = len(s)
    kind = classes(s)
    order = np.argsort(kind, kind="stable") if kind.any() else np.arange(n)
    least = int(least_shared(n, percent))
    base = n - least + 1
    first = kind[order[:base]]
    cost = float(np.exp2(first[first > 0].astype(float)).sum())  # frequent shingles bring candidates
    matches = min(max(1, least), 1 + int(np.sqrt(cost)))
    size = base + matches - 1
    return s[order[:size]], int((kind[order[:size]] == 0).sum()), base, matches


_SENT = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
_POSTING = np.dtype([("token", "<u4"), ("doc", "<i8"), ("component", "<i8"), ("n", "<u4"), ("place", "<u4"), ("matches", "<u4"), ("often", "<u4")])


def send_prefixes(docs: DataFrame, classes, bits: int, size: int, percent: int) -> DataFrame:
    """Postings of the rare prefix shingles of ``node, component, text``, packed by bucket of the shingle.

    A document with frequent ones in its prefix also sends itself: a row of a negative bucket.
    """
    flush = 1_000_000

    def run(batches):
        import zstandard

        known, sets, pack, held, n_held = classes.value, Shingler(size), zstandard.ZstdCompressor(level=2), [], 0

        def rows():
            key = np.concatenate([h[0] for h in held])
            counts = np.asarray([len(h[0]) for h in held])
            table = np.empty(len(key), _POSTING)
            table["token"] = (key >> np.uint64(bits)) & np.uint64(0xFFFFFFFF)
            table["place"] = np.concatenate([np.arange(c) for c in counts])
            for k, name in enumerate(("doc", "component", "n", "matches", "often"), 1):
                table[name] = np.repeat(np.asarray([h[k] for h in held]), counts)
            bucket = (key & np.uint64((1 << bits) - 1)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, table = bucket[order], table[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                t = table[a:b].copy()
                t["component"] -= t["doc"]
                body = b"".join(np.ascontiguousarray(t[name]).view(np.uint8).reshape(b - a, -1).T.tobytes() for name in _POSTING.names)
                out.append((int(bucket[a]), pack.compress(body)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], schema=_SENT)

        for batch in batches:
            whole = []
            for node, component, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not len(s := sets(text.as_buffer().to_pybytes())):
                    continue
                tokens, rare, base, matches = prefix(s, known, percent)
                if rare < base:  # a similar set may share frequent shingles only
                    dealt = tokens[rare:base]
                    head = np.asarray([node, component, len(s), matches, len(dealt)], "<i8").tobytes()
                    whole.append((-1 - node % (1 << bits), head + dealt.astype("<u8").tobytes() + tokens.astype("<u4").tobytes()))
                if rare:
                    held.append((tokens[:rare], node, component, len(s), matches, len(tokens) - rare))
                    n_held += rare
                if n_held >= flush:
                    yield rows()
                    held, n_held = [], 0
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in whole], pa.int32()), pa.array([r[1] for r in whole], pa.binary())], schema=_SENT)
        if held:
            yield rows()

    return docs.select("node", "component", "text").mapInArrow(run, "bucket int, payload binary")


def _postings(raw: bytes) -> np.ndarray:
    width = _POSTING.itemsize
    n, at = len(raw) // width, 0
    out = np.empty(n, _POSTING)
    for name in _POSTING.names:
        kind = _POSTING[name]
        part = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out[name] = np.ascontiguousarray(part.T).view(kind).ravel()
        at += n * kind.itemsize
    out["component"] += out["doc"]
    return out


def runs_of(p: np.ndarray):
    """(postings by shingle, starts and sizes of the runs with several components)."""
    p = p[np.argsort(p["token"], kind="stable")]
    starts = np.flatnonzero(np.concatenate([[True], p["token"][1:] != p["token"][:-1]]))
    sizes = np.diff([*starts, len(p)])
    mixed_up = np.minimum.reduceat(p["component"], starts) != np.maximum.reduceat(p["component"], starts)
    return p, starts[mixed_up], sizes[mixed_up]


def pairs_of(p: np.ndarray, starts: np.ndarray, sizes: np.ndarray, percent: int, most: int = 2_000_000):
    """(a, b, shared, needed) arrays of pairs in different components with a shared prefix shingle, from runs of one bucket."""
    # every posting of a run meets the later ones: (first, how many follow)
    firsts = np.concatenate([[0], np.cumsum(sizes)]) if len(sizes) else np.zeros(1, np.int64)
    member = np.repeat(starts - firsts[:-1], sizes) + np.arange(firsts[-1]) if len(sizes) else np.zeros(0, np.int64)
    follow = np.repeat(starts + sizes, sizes) - member - 1
    total = np.cumsum(follow)
    a = 0
    while a < len(member):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        x = np.repeat(member[a:b], follow[a:b])
        back = np.cumsum(follow[a:b]) - follow[a:b]
        y = x + 1 + np.arange(len(x)) - np.repeat(back, follow[a:b])
        u, v = p[x], p[y]
        nu, nv = u["n"].astype(np.int64), v["n"].astype(np.int64)
        need = -(-percent * (nu + nv) // (100 + percent))
        reach = 1 + np.minimum(u["place"], v["place"]) + np.minimum(nu - u["place"], nv - v["place"]) - 1
        fine = (u["component"] != v["component"]) & (np.minimum(nu, nv) * 100 >= percent * np.maximum(nu, nv)) & (reach >= need)
        u, v = u[fine], v[fine]
        if len(u):
            lo, hi = np.minimum(u["doc"], v["doc"]), np.maximum(u["doc"], v["doc"])
            least = needed(nu[fine], u["matches"].astype(np.int64), nv[fine], v["matches"].astype(np.int64), percent)
            least = np.maximum(1, least - np.minimum(u["often"], v["often"]).astype(np.int64))  # the others may be frequent ones
            order = np.lexsort((hi, lo))
            lo, hi, least = lo[order], hi[order], least[order]
            cut = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            yield lo[cut], hi[cut], np.diff([*cut, len(lo)]), np.minimum.reduceat(least, cut)
        a = b


def needed(nu, lu, nv, lv, percent: int):
    """Prefix shingles that a similar pair shares at least, from its sizes and numbers of matches.

    Beyond the common part of the two prefixes there are at most the shingles that follow the
    prefix that ends first; the rest of the overlap lies in both prefixes.
    """
    overlap = -(-percent * (nu + nv) // (100 + percent))
    follow = np.maximum(least_shared(nu, percent) - lu, least_shared(nv, percent) - lv)
    return np.maximum(np.minimum(lu, lv), overlap - follow - 1)


_PAIR = "a long, b long, shared long, needed long, component long, n long, matches long, tokens array<long>, prefix binary"


def pair_rows(sent: DataFrame, bits: int, percent: int) -> DataFrame:
    """Pairs of each rare shingle, counted by bucket: ``a, b, shared, needed``.

    Documents with frequent shingles in their prefix pass: ``a, component, n, matches, tokens, prefix``.
    """
    spark = sent.sparkSession
    kinds = {"a": pa.int64(), "b": pa.int64(), "shared": pa.int64(), "needed": pa.int64(), "component": pa.int64(), "n": pa.int64(), "matches": pa.int64(), "tokens": pa.list_(pa.int64()), "prefix": pa.binary()}

    def batch_of(rows: int, **columns):
        return pa.RecordBatch.from_pydict({k: pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in kinds.items()})

    def run(batches):
        import zstandard

        undo, now, held = zstandard.ZstdDecompressor(), None, []

        def found():
            p, starts, sizes = runs_of(np.concatenate(held))
            for a, b, shared, need in pairs_of(p, starts, sizes, percent):
                yield batch_of(len(a), a=a, b=b, shared=shared.astype(np.int64), needed=need)

        for batch in batches:
            whole = []
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket < 0:
                    body = raw.as_py()
                    head = np.frombuffer(body, "<i8", 5).tolist()
                    whole.append((*head[:4], np.frombuffer(body, "<i8", head[4], 40), body[40 + 8 * head[4] :]))
                    continue
                if held and bucket != now:
                    yield from found()
                    held = []
                now = bucket
                held.append(_postings(undo.decompress(raw.as_py())))
            if whole:
                yield batch_of(len(whole), **dict(zip(("a", "component", "n", "matches", "tokens", "prefix"), zip(*whole, strict=True), strict=True)))
        if held:
            yield from found()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << bits, 4000))
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _PAIR)


def shared_counts(lists: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """How many values each of the lists at ``rows`` shares with every list: a matrix product, some columns at a time."""
    values = np.unique(np.concatenate([lists[k] for k in rows]))
    counts = np.zeros((len(rows), len(lists)), np.float32)
    if not len(values):
        return counts
    flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
    known = values[at] == flat
    at, owner = at[known], owner[known]
    for c in range(0, len(values), 4096):
        some = (at >= c) & (at < c + 4096)
        table = np.zeros((len(lists), min(4096, len(values) - c)), np.float32)
        table[owner[some], at[some] - c] = 1
        counts += table[rows] @ table.T
    return counts


def frequent_candidates(whole: DataFrame, percent: int, cell: int) -> DataFrame:
    """Candidates among the documents of frequent shingles (``a, component, n, matches, tokens, prefix``).

    A shingle's documents are dealt over groups by a hash; each pair of groups is a cell that one task compares.
    A pair is counted by whole prefixes, under its first common frequent shingle, and only those that share
    enough become rows.
    """
    # one row for each frequent shingle at most, so the table fits a broadcast
    several = whole.select(F.explode("tokens").alias("token"), "component").groupBy("token").agg(F.count("*").alias("m"), F.min("component").alias("x"), F.max("component").alias("y"))
    several = several.where("x < y").select("token", F.ceil(F.col("m") / cell).cast("int").alias("groups"))
    rows = whole.withColumn("token", F.explode("tokens")).join(F.broadcast(several), "token")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    rows = rows.select("token", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", F.col("a").alias("doc"), "component", "n", "matches", "prefix", F.filter("tokens", lambda t: t < F.col("token")).alias("earlier"))

    def meet(batches):
        now, held = None, []

        def found():
            doc, component, n, matches, mine = (np.asarray([r[k] for r in held], np.int64) for k in ("doc", "component", "n", "matches", "mine"))
            _, of, sizes = np.unique(component, return_inverse=True, return_counts=True)
            if len(sizes) == 1:
                return
            most = of == sizes.argmax()  # its members need no comparison with each other
            rows = np.flatnonzero(~most)
            k = rows[:, None]
            fine = shared_counts([np.frombuffer(r["prefix"], "<u4") for r in held], rows) >= needed(n[k], matches[k], n[None], matches[None], percent)
            fine &= (component[k] != component[None]) & (most[None] | (doc[k] < doc[None]))
            fine &= np.minimum(n[k], n[None]) * 100 >= percent * np.maximum(n[k], n[None])
            if now[1] != now[2]:
                fine &= mine[k] != mine[None]
            x, y = np.nonzero(fine)
            if len(x):
                earlier = [np.asarray(r["earlier"], np.int64) for r in held]
                some = np.unique(x)
                first = shared_counts(earlier, rows[some])[np.searchsorted(some, x), y] == 0
                x, y = rows[x[first]], y[first]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(doc[x], doc[y]), "b": np.maximum(doc[x], doc[y])})

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["token"], r["i"], r["j"])
                if held and key != now:
                    yield from found()
                    held = []
                now = key
                held.append(r)
        if held:
            yield from found()

    return rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(meet, "a long, b long")


def nearest_candidates(whole: DataFrame, percent: int, cell: int, each: int = 4) -> DataFrame:
    """Some candidates of each document of frequent shingles: its best ones by whole prefixes, and others at random.

    They meet once, under their smallest frequent shingle, in groups of about ``cell``. Verified, they merge what is alike
    into few components before every remaining pair of different components is looked at.
    """
    rows = whole.withColumn("token", F.array_min("tokens")).drop("tokens")
    groups = rows.groupBy("token").agg(F.ceil(F.count("*") / cell).cast("int").alias("groups"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").drop("x", "y")
    # one row for each frequent shingle at most, so the table fits a broadcast
    rows = rows.join(F.broadcast(groups), "token").withColumn("mine", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int"))

    def meet(batches):
        now, held = None, []

        def found():
            doc, component, n, matches = (np.asarray([r[k] for r in held], np.int64) for k in ("a", "component", "n", "matches"))
            every = np.arange(len(held))
            k = every[:, None]
            margin = shared_counts([np.frombuffer(r["prefix"], "<u4") for r in held], every) - needed(n[k], matches[k], n[None], matches[None], percent)
            fine = (margin >= 0) & (component[k] != component[None]) & (np.minimum(n[k], n[None]) * 100 >= percent * np.maximum(n[k], n[None]))
            some = np.random.default_rng(len(held)).random(fine.shape)
            chosen = np.zeros_like(fine)
            for score in (margin, some):
                best = np.argsort(np.where(fine, -score, np.inf), axis=1, kind="stable")[:, :each]
                np.put_along_axis(chosen, best, True, axis=1)
            x, y = np.nonzero(chosen & fine)
            if len(x):
                yield pa.RecordBatch.from_pydict({"a": np.minimum(doc[x], doc[y]), "b": np.maximum(doc[x], doc[y])})

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["token"], r["mine"]) != now:
                    yield from found()
                    held = []
                now = (r["token"], r["mine"])
                held.append(r)
        if held:
            yield from found()

    return rows.repartition("token", "mine").sortWithinPartitions("token", "mine", "a").mapInArrow(meet, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole texts (``node, text``; one row a node) are similar.

    Members of a hub ``a`` are dealt over groups of about ``GROUP``; a group streams past the hub's set.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    dealt = pairs.join(groups, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    hubs = groups.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("member"))
    asked = hubs.unionAll(dealt.select("b", "a", "salt", F.lit(1)))
    sent = with_texts(texts, asked).select("a", "salt", "member", "node", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "node")

    def run(batches):
        sets, now, hub = Shingler(size), None, None
        for batch in batches:
            a, b = [], []
            keys = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for (x, salt, member, doc), text in zip(keys, batch.column(4), strict=True):
                if not member:
                    now, hub = (x, salt), sets(text.as_buffer().to_pybytes())
                elif now == (x, salt) and similar(hub, sets(text.as_buffer().to_pybytes()), percent):
                    a.append(x)
                    b.append(doc)
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sent.mapInArrow(run, "a long, b long")


def join_components(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT, least: int = LEAST, max_frequent: int = MAX_FREQUENT, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id that links reach, itself included.

    A hot text costs a row a task: copies go before the texts are shuffled. Only ids and hashes of all documents are
    shuffled besides.
    """
    out, _, table = _joined(docs, size, percent, least, max_frequent, cell, id_col, text_col)
    docs.sparkSession.sql(f"DROP TABLE {table}")
    return out


def keep_first(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT, least: int = LEAST, max_frequent: int = MAX_FREQUENT, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the document of the smallest id of each component.

    Rows that share an id are one document: the one whose text comes first stays. Rows without an id stay.
    Texts are not shuffled again: of a row with words all but the text goes to its text's bucket and takes it from
    there. By then a text has one row at most (or one for each id that it shares with others). The text table stays in
    the catalog, as the result reads it.
    """
    found, texts, _ = _joined(docs, size, percent, least, max_frequent, cell, id_col, text_col)
    ids = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("component_id").alias("low"), (F.count("*") > 1).alias("repeated"))
    ids = written(ids.where("low = doc_id").drop("low"), "kept-ids")

    text, names, others = text_or_empty(quoted(text_col)), docs.columns, [c for c in docs.columns if c != text_col]
    known, worded, doc_id = F.col(quoted(id_col)).isNotNull(), text.rlike(WORD), F.col(quoted(id_col)).cast("long").alias("doc_id")
    # inner joins: a semi or anti join would be moved below the hashes, and the texts shuffled
    plain = docs.where(known & ~worded).select(doc_id, F.struct(*named(names)).alias("row")).join(ids, "doc_id")
    rows = docs.where(known & worded).select(doc_id, *_hashes(text), F.struct(*named(others)).alias("rest")).join(ids, "doc_id")

    def row_of(text):
        return F.struct(*[text.cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col(f"rest.{quoted(c)}").alias(c) for c in names])

    def whole(rows: DataFrame) -> DataFrame:
        return with_texts_of(texts, rows.select("doc_id", "h1", "h2", "rest")).select("doc_id", row_of(F.col("text")).alias("row"))

    if not ids.where("repeated").limit(1).count():
        kept = plain.select("doc_id", "row").unionAll(whole(rows))
    else:
        # a row's text, then all of it as text: any column type has an order there
        once = rows.where("repeated").groupBy("doc_id", "h1", "h2").agg(F.min_by("rest", F.to_json(row_of(F.lit("")))).alias("rest"))
        one = plain.where("repeated").select("doc_id", "row").unionAll(whole(once))
        one = one.groupBy("doc_id").agg(F.min_by("row", F.struct(F.col(f"row.{quoted(text_col)}"), F.to_json("row"))).alias("row"))
        kept = plain.where("not repeated").select("doc_id", "row").unionAll(whole(rows.where("not repeated"))).unionAll(one)
    no_id = docs.where(~known)
    return no_id.unionAll(kept.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns]))


def _hashes(text):
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def _joined(docs: DataFrame, size: int, percent: int, least: int, max_frequent: int, cell: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """The components, the text table that they come from (:func:`distinct_texts`) and its name."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("*", *_hashes(F.col("text")))
    known = rows.where(F.col("doc_id").isNotNull())
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    about = max(1, n_bytes // 6)  # shingles in the corpus
    count_bits = min(40, max(16, int(np.ceil(np.log2(about)))))
    bucket_bits = min(12, max(4, count_bits - 32, int(np.ceil(np.log2(about / COUNT_BUCKET)))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))
    texts, table = bucketed(distinct_texts(known, parts), "b", "texts", parts, dealt=True)
    shingles = written(described(texts, size, count_bits, bucket_bits), "shingles")
    every = shingles.where(F.col("block").isNull()).select("node", "n", "digest", "seeds")
    real = every.where(F.col("n") > 0)
    classes = written(real.groupBy("digest").agg(F.min("node").alias("node"), F.max("n").alias("n"), F.max("seeds").alias("seeds")), "classes")

    band = F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int")
    seeds = classes.select("node", band.alias("band"), F.explode("seeds").alias("seed"))
    hubs = seeds.groupBy("seed", "band").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").drop("last")
    stars = seeds.join(hubs, ["seed", "band"]).where("a < node").select("a", F.col("node").alias("b")).distinct()
    near = written(verified(written(stars, "stars"), texts, size, percent), "links")
    found = components(near)

    nodes = classes.select("node").join(found.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(20, max(4, int(np.ceil(np.log2(max(1, total * (100 - percent) / 100 / BUCKET))))))
    order = spark.sparkContext.broadcast(frequent(shingles, count_bits, bucket_bits, least, max_frequent))
    pairs = written(pair_rows(send_prefixes(with_texts(texts, written(nodes, "nodes")), order, bits, size, percent), bits, percent), "pairs")
    star = lambda components: components.select(F.col("component").alias("a"), F.col("id").alias("b"))
    whole = pairs.where(F.col("b").isNull()).select("a", "component", "n", "matches", "tokens", "prefix")
    merged = verified(written(nearest_candidates(whole, percent, cell), "nearest"), texts, size, percent)
    found = components(merged.unionAll(star(found)))
    whole = whole.drop("component").join(found.withColumnRenamed("id", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    rare = pairs.where(F.col("b").isNotNull()).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed"))
    rare = rare.where(F.col("shared") >= F.col("needed")).select("a", "b")
    asked = rare.unionAll(frequent_candidates(written(whole, "frequent-documents"), percent, cell)).distinct()
    links = verified(written(asked, "candidates"), texts, size, percent).unionAll(star(found))

    # each text's class, then the documents of each text
    of = every.join(classes.select("digest", F.col("node").alias("class")), "digest", "left").select("node", "n", "class")
    of = written(texts.select("node", "h1", "h2").join(of, "node").drop("node"), "text-classes")
    ids = known.select("doc_id", "h1", "h2")
    several = ids.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x < y").select("doc_id")
    held = ids.join(several, "doc_id").join(of.where("class is not null"), ["h1", "h2"]).select("doc_id", "class").distinct()
    hub = held.groupBy("doc_id").agg(F.min("class").alias("a"))
    links = links.unionAll(held.join(hub, "doc_id").where("a < class").select("a", F.col("class").alias("b")))
    last = components(links).select(F.col("id").alias("class"), "component")
    order.unpersist()
    of = of.join(last, "class", "left").select("h1", "h2", "n", F.coalesce("component", "class").alias("component"))
    least_ids = ids.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"))
    low = of.join(least_ids, ["h1", "h2"]).groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(low.where("component is not null"), "component", "left").select("h1", "h2", F.col("n").alias("n_shingles"), "component_id")
    out = ids.join(of, ["h1", "h2"]).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

    def count(batches):
        sets = Shingler(size)
        for batch in batches:
            n = [len(sets(t.as_buffer().to_pybytes())) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(len(n), pa.int64()), "n_shingles": pa.array(n, pa.int64()), "component_id": pa.nulls(len(n), pa.int64())})

    out = out.unionAll(rows.where(F.col("doc_id").isNull()).select("text").mapInArrow(count, "doc_id long, n_shingles long, component_id long"))
    return out, texts, table
