"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles, 64-bit hashes of the words
joined by one blank (fewer words: one shingle of all; no words: the empty set, linked
with nothing).  Two documents link when ``den * |x & y| >= num * |x | y|``.

If the shingles of all sets are put in any one order, two sets that link share at
least ``l`` shingles within their first ``|x| - ceil(t |x|) + l`` ones.  The join uses
this twice, each time over all documents that are left:

1. In hash order, with ``l`` in proportion to the size: a document stays if enough of
   its prefix occurs in other documents as well.  Most documents end here.
2. Among those that stay, frequencies are counted exactly and shingles are ordered
   from rare to common.  Each document takes the ``l`` that its posting lists make
   cheapest (longer prefixes cost postings, more matches save verifications), and a
   pair is a candidate if it shares ``min(l_x, l_y)`` prefix shingles, its sizes are
   near, and the places of the matches leave room for the overlap.

Documents of equal sets are one class from the start.  Pairs of a posting list are
never made as rows: every document belongs to the cluster of the most central document
that most of its lists name, and visits other clusters with which it shares enough
prefix shingles, sizes and places allowing.  Members and visitors of a cluster are
compared on their whole sets by blocked products of incidence matrices; every link is
counted, and those that join components of a block are passed on.  Large clusters are
cut by distance from their leader, and only pairs of blocks whose links the triangle
inequality leaves open are compared.  So a group of near copies around one text takes
rows in proportion to its size.  A large cluster whose members are far from its leader
takes a copy of each set per block of ``MEMBERS`` that it may be linked with: counting
the links of unlike sets exactly needs these comparisons.

Shingles travel in packed arrays, one per block of documents and bucket of hashes,
already merged within the block, so that a shingle of all documents costs one entry
per block.  Nothing is collected; sets of ids are broadcast up to ``BROADCAST_IDS``
rows and joined by a shuffle beyond.

Defined results: null texts are empty; a null id is returned with a null component and
takes no part (its number of links too is null); rows of one id are one document with several
texts, linked if any is, and the links of its texts are added up;
other columns take no part, whatever they are called; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, released, small_batches

#: Shingles of one block of documents; text bytes for one bucket of hashes.
BLOCK_SHINGLES, BUCKET_BYTES = 1 << 19, 32 << 20
BROADCAST_IDS = 1_000_000
#: In the first filter, a match is asked for every so many shingles.
FILTER_STEP = 16
MOST_MATCHES = 8
#: What the verification of a candidate costs, in postings.
VERIFY_COST = 16.0
#: Members and shingles of one block of a cluster, and visitors compared at a time.
MEMBERS, MEMBER_SHINGLES, VISITORS = 1024, 1 << 19, 64
#: Parts of the greatest distance of a link, by which the blocks of a large cluster are told apart.
BANDS = 8
#: Shingles that so many members of a block have are compared by a dense product.
DENSE = 64

_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; A-Z count as a-z.

    Every word is hashed by itself, and the hashes of k words in a row are then mixed one
    after the other, so that no repetitive form of a word makes two shingles alike.
    """
    words = (text or "").encode().lower().split()  # bytes: ASCII case and blanks alone
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    many = len(words) - k + 1
    h = np.full(many, k, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * _STEP + hashes[j : j + many]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _least(n: np.ndarray | int, num: int, den: int):
    """Shingles of a set of n that a linked one must have at least."""
    return (num * n + den - 1) // den


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """``id, n, sig`` of every row; equal sets have equal signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for i, text in _texts(batches):
            s = shingle_set(text, k)
            rows.append((i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()))
            if len(rows) == 8192:
                yield _batch(["id", "n", "sig"], [pa.int64(), pa.int64(), pa.binary()], rows)
                rows = []
        yield _batch(["id", "n", "sig"], [pa.int64(), pa.int64(), pa.binary()], rows)

    return docs.mapInArrow(released(run), "id long, n long, sig binary")


def keep_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose id is (or is not) among ``ids``: by broadcast if they are few."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "id", how)


def _by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes: buckets are equal ranges."""
    width = np.uint64((1 << 64) // buckets)
    edges = np.arange(1, buckets, dtype=np.uint64) * width
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


_PACKED = "key long, block long, kind int, a binary, b binary, c binary"
_PACKED_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_PACKED_NAMES = ["key", "block", "kind", "a", "b", "c"]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(_PACKED_NAMES, _PACKED_KINDS, rows)


def _runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows that agree in one column; they come sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                if held and held[0][name] != row[name]:
                    yield held[0][name], held
                    held = []
                held.append(row)
    if held:
        yield held[0][name], held


def _u64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


MANY = 0xFFFF


def shared_enough(docs: DataFrame, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """Ids of documents whose prefix in hash order occurs often enough in others."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        ids: list[int] = []
        prefixes: list[np.ndarray] = []
        wants: list[int] = []

        def flush() -> pa.RecordBatch:
            h = np.concatenate(prefixes)
            owner = np.repeat(np.arange(len(ids), dtype=np.uint16), [len(p) for p in prefixes])
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(first, len(h)))
            again = np.repeat(count > 1, count)  # in several documents of the block: known to be shared
            local = np.bincount(owner[again], minlength=len(ids)).astype(np.uint32)
            h, owner = h[first], np.where(count > 1, np.uint16(MANY), owner[first])
            cut = _by_bucket(h, buckets)
            rows = [
                (b, block, 0, h[s:e].tobytes(), owner[s:e].tobytes(), b"") for b, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s
            ]
            told = (np.array(ids, np.int64).tobytes(), np.array(wants, np.uint32).tobytes(), local.tobytes())
            return _packed([*rows, (-1 - block, block, 1, *told)])

        size = 0
        for i, text in _texts(batches):
            s = shingle_set(text, k)
            n = len(s)
            if not n:
                continue
            least = _least(n, num, den)
            matches = min(1 + n // FILTER_STEP, least)
            ids.append(i)
            prefixes.append(s[: n - least + matches].copy())
            # A partner may be smaller, and then asks for fewer matches.
            wants.append(min(1 + least // FILTER_STEP, _least(least, num, den), matches))
            size += len(prefixes[-1])
            if size >= BLOCK_SHINGLES or len(ids) == MANY - 1:
                yield flush()
                ids, prefixes, wants, size, block = [], [], [], 0, block + 1
        if ids:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _runs(batches, "key"):
            if key < 0:
                yield _packed([tuple(r.values()) for r in rows])
                continue
            h = np.concatenate([_u64(r["a"]) for r in rows])
            owner = np.concatenate([np.frombuffer(r["b"], np.uint16) for r in rows])
            block = np.repeat(np.arange(len(rows)), [len(r["a"]) // 8 for r in rows])
            order = np.argsort(h, kind="stable")
            h, owner, block = h[order], owner[order], block[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(first, len(h)))
            shared = np.repeat((size > 1) | np.logical_or.reduceat(owner == MANY, first), size) & (owner != MANY)
            block, owner = block[shared], owner[shared]
            order = np.argsort(block, kind="stable")
            block, owner = block[order], owner[order]
            cut = np.searchsorted(block, np.arange(len(rows) + 1))
            yield _packed([(0, rows[j]["block"], 2, owner[s:e].tobytes(), b"", b"") for j, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, "block"):
            told = rows[0]  # kind 1 comes first
            ids, wants = np.frombuffer(told["a"], np.int64), np.frombuffer(told["b"], np.uint32)
            have = np.frombuffer(told["c"], np.uint32).astype(np.int64)
            for r in rows[1:]:
                have += np.bincount(np.frombuffer(r["a"], np.uint16), minlength=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[have >= wants], pa.int64())], names=["id"])

    packed = docs.mapInArrow(released(pack), _PACKED)
    counted = packed.repartition("key").sortWithinPartitions("key").mapInArrow(released(count), _PACKED)
    return counted.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(released(choose), "id long").distinct()


def block_sets(docs: DataFrame, k: int) -> DataFrame:
    """Blocks of whole sets: ``block, a (ids), b (sizes), c (sorted hashes, one set after the other)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        ids: list[int] = []
        sets: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.uint32)
            return _packed([(0, block, 0, np.array(ids, np.int64).tobytes(), sizes.tobytes(), np.concatenate(sets).tobytes())])

        size = 0
        for i, text in _texts(batches):
            s = shingle_set(text, k)
            if not len(s):
                continue
            ids.append(i)
            sets.append(s)
            size += len(s)
            if size >= BLOCK_SHINGLES:
                yield flush()
                ids, sets, size, block = [], [], 0, block + 1
        if ids:
            yield flush()

    return docs.mapInArrow(released(run), _PACKED)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, sizes, h = np.frombuffer(row["a"], np.int64), np.frombuffer(row["b"], np.uint32).astype(np.int64), _u64(row["c"])
    return ids, sizes, h, np.repeat(np.arange(len(ids)), sizes)


def matches_wanted(df: np.ndarray, n: int, least: int) -> int:
    """The number of matches to ask for that makes a document's candidates cheapest.

    ``df``: frequencies of its shingles from rare to common.  Every match list in the
    prefix is read; about one in l of what is read is left to verify.
    """
    base = n - least
    most = min(MOST_MATCHES, least)
    reads = np.cumsum(df[: base + most].astype(float) - 1)
    l = np.arange(1, most + 1)  # noqa: E741
    cost = reads[base : base + most] * (1 + VERIFY_COST / l)
    return int(l[cost.argmin()])


def postings(sets: DataFrame, num: int, den: int, buckets: int) -> DataFrame:
    """Prefix entries ``h, id, n, place, l, first`` of shingles that are in two sets at least;
    ``first`` is the number of shingles before the first such one."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                h, count = np.unique(_u64(row["c"]), return_counts=True)
                cut = _by_bucket(h, buckets)
                yield _packed([
                    (b, row["block"], 0, h[s:e].tobytes(), count[s:e].astype(np.uint32).tobytes(), b"")
                    for b, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s
                ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, "key"):
            own = [_u64(r["a"]) for r in rows]
            h, where = np.unique(np.concatenate(own), return_inverse=True)
            many = np.concatenate([np.frombuffer(r["b"], np.uint32) for r in rows])
            df = np.bincount(where, weights=many, minlength=len(h)).astype(np.uint32)
            for r, mine in zip(rows, own):
                d = df[np.searchsorted(h, mine)]
                if (d > 1).any():
                    yield _packed([(0, r["block"], 1, mine[d > 1].tobytes(), d[d > 1].tobytes(), b"")])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["h", "id", "n", "place", "l", "first"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        for _, rows in _runs(batches, "block"):
            if len(rows) < 2:
                continue
            ids, sizes, h, owner = _unpack(rows[0])
            shared = np.concatenate([_u64(r["a"]) for r in rows[1:]])
            counts = np.concatenate([np.frombuffer(r["b"], np.uint32) for r in rows[1:]])
            order = np.argsort(shared)
            shared, counts = shared[order], counts[order]
            at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
            df = np.where(shared[at] == h, counts[at], 1)
            order = np.lexsort((h, df, owner))
            h, df = h[order], df[order]
            ends = np.cumsum(sizes)
            out: list[list[np.ndarray]] = [[] for _ in names]
            for i, (n, stop) in enumerate(zip(sizes.tolist(), ends.tolist())):
                mine, start = df[stop - n : stop], stop - n
                least = _least(n, num, den)
                if mine[min(n - least + min(MOST_MATCHES, least), n) - 1] < 2:
                    continue  # nothing in the longest prefix is shared
                wanted = matches_wanted(mine, n, least)
                length = n - least + wanted
                place = np.flatnonzero(mine[:length] > 1)
                if not len(place):
                    continue
                for column, values in zip(out, (h[start + place].view(np.int64), ids[i], n, place, wanted, place[0])):
                    column.append(np.broadcast_to(values, len(place)))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds)], names=names)

    counted = sets.mapInArrow(released(distinct), _PACKED).repartition("key").sortWithinPartitions("key").mapInArrow(released(count), _PACKED)
    return (
        sets.unionByName(counted).repartition("block").sortWithinPartitions("block", "kind")
        .mapInArrow(released(prefixes), "h long, id long, n int, place int, l int, first int")
    )


def clusters(p: DataFrame) -> DataFrame:
    """``id, cluster``: the most central document that most of the id's posting lists name."""
    lead = p.groupBy("h").agg(F.min(F.struct("first", "id")).alias("y"), F.count("*").alias("many")).filter("many > 1").select("h", "y")
    named = p.select("h", "id").join(lead, "h").groupBy("id", "y").agg(F.count("*").alias("many"))
    return named.groupBy("id").agg(F.max_by("y.id", F.struct("many", (-F.col("y.first")).alias("c"), (-F.col("y.id")).alias("i"))).alias("cluster"))


def visits(p: DataFrame, homes: DataFrame, num: int, den: int) -> DataFrame:
    """``id, cluster``: clusters of smaller ids that an id has to be compared with.

    Of two documents that link, the first l shared shingles have places that leave room for
    the rest of the overlap; l is the smaller of the document's and of the cluster's least.
    """
    # A cluster's least l is found from ids, so that entries of a large cluster stay dealt by id.
    per_id = p.groupBy("id").agg(F.min("l").alias("l")).join(homes, "id")
    told = p.join(homes.join(per_id.groupBy("cluster").agg(F.min("l").alias("cluster_l")), "cluster"), "id")
    lists = told.groupBy("h", "cluster", "cluster_l").agg(
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("place")).alias("room")
    )
    wanted = F.least("x.l", "y.cluster_l")
    n = F.col("x.n")
    near = (F.lit(den) * F.col("y.most_n") >= F.lit(num) * n) & (F.lit(den) * n >= F.lit(num) * F.col("y.least_n"))
    overlap = F.lit(num) * (n + F.col("y.least_n"))
    left = F.lit(num + den) * (F.least(n - F.col("x.place"), F.col("y.room")) + wanted - 1)
    met = (
        told.select("h", F.struct("id", "n", "place", "l", "cluster").alias("x"))
        .join(lists.select("h", F.struct("cluster", "cluster_l", "least_n", "most_n", "room").alias("y")), "h")
        .filter((F.col("y.cluster") < F.col("x.cluster")) & near & (left >= overlap))
    )
    return (
        met.groupBy(F.col("x.id").alias("id"), F.col("y.cluster").alias("cluster")).agg(F.count("*").alias("shared"), F.min(wanted).alias("wanted"))
        .filter("shared >= wanted").select("id", "cluster")
    )


class _Members:
    """An index of one block's sets that counts intersections with other sets."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], weights: np.ndarray) -> None:
        self.ids, self.weights = np.array(ids, np.int64), weights
        self.met = np.zeros(len(ids), np.int64)  # rows among visitors that a member is linked with
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.label = np.arange(len(ids))
        h = np.concatenate(sets)
        owner = np.repeat(np.arange(len(ids)), self.sizes)
        order = np.argsort(h, kind="stable")
        self.owner = owner[order]
        self.h, self.start, self.count = np.unique(h[order], return_index=True, return_counts=True)
        column = np.full(len(self.h), -1)
        dense = np.flatnonzero(self.count >= DENSE)
        column[dense] = np.arange(len(dense))
        self.column = column
        self.matrix = np.zeros((len(dense), len(ids)), np.float32)
        row = np.repeat(column, self.count)
        self.matrix[row[row >= 0], self.owner[row >= 0]] = 1

    def intersections(self, sets: list[np.ndarray]) -> np.ndarray:
        sizes = [len(s) for s in sets]
        h, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        held = self.h[at] == h
        at, who = at[held], who[held]
        column = self.column[at]
        dense = np.zeros((len(sets), len(self.matrix)), np.float32)
        dense[who[column >= 0], column[column >= 0]] = 1
        out = (dense @ self.matrix).astype(np.int64)
        at, who = at[column < 0], who[column < 0]
        many = self.count[at]
        ends = np.cumsum(many)
        flat = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(self.start[at], many)
        width = len(self.ids)
        out += np.bincount(np.repeat(who, many) * width + self.owner[flat], minlength=len(sets) * width).reshape(len(sets), width)
        return out

    def links(self, ids: list[int], sets: list[np.ndarray], weights: np.ndarray, num: int, den: int, own: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Links of these documents that join what was apart, and how many rows each is linked
        with here; ``own``: their places, if they are members."""
        both = self.intersections(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        linked = den * both >= num * (sizes[:, None] + self.sizes[None, :] - both)
        if own is not None:
            linked[np.arange(len(own)), own] = False
        else:
            self.met += weights @ linked
        out = []
        for i in np.flatnonzero(linked.any(axis=1)):
            to = np.flatnonzero(linked[i])
            labels, first = np.unique(self.label[to], return_index=True)
            mine = self.label[own[i]] if own is not None else -1
            out += [(int(ids[i]), int(self.ids[to[f]])) for label, f in zip(labels, first) if label != mine]
            low = labels[0] if own is None else min(mine, labels[0])
            joined = np.isin(self.label, labels if own is None else np.append(labels, mine))
            self.label[joined] = low
        return [(a, b) for a, b in out if a != b], linked @ self.weights


def single_sets(sets: DataFrame) -> DataFrame:
    """``id, set`` of every document in blocks of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, sizes, h, _ = _unpack(batch.slice(at, 1).to_pylist()[0])
                ends = np.cumsum(sizes)
                for s in range(0, len(ids), 1024):
                    rows = [(int(i), h[e - n : e].tobytes()) for i, n, e in zip(ids[s : s + 1024], sizes[s : s + 1024], ends[s : s + 1024])]
                    yield _batch(["id", "set"], [pa.int64(), pa.binary()], rows)

    return sets.mapInArrow(released(run), "id long, set binary")


def _blocks(many, shingles):
    return F.ceil(F.greatest(many / MEMBERS, shingles / MEMBER_SHINGLES))


def _with_few(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    few = other.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(other) if few else other, on)


def banded(members: DataFrame, shape: DataFrame, each: DataFrame, num: int, den: int) -> DataFrame:
    """Members and visitors of large clusters with their sets and the band of their distance from
    the cluster's leader: band b holds distances of more than b and of at most b + 1 of the
    ``BANDS`` equal parts of the greatest distance of a link, told apart in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "cluster", "kind", "n", "weight", "band", "set"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        part, leader, leads, last = None, b"", np.zeros(0, np.uint64), None
        for batch in batches:
            out = []
            for row in (r for at in range(0, batch.num_rows, 128) for r in batch.slice(at, 128).to_pylist()):
                this = (row["cluster"], row["part"])
                if this != part:
                    part, leader, last = this, b"", None
                if row["kind"] < 0:
                    # A leader of several texts: the same one of them in all parts.
                    leader = min(leader, row["set"]) if leader else row["set"]
                    leads = _u64(leader)
                    continue
                if last == (last := (row["id"], row["set"])):
                    continue  # a repeated row
                mine = _u64(row["set"])
                at = np.minimum(np.searchsorted(leads, mine), len(leads) - 1)
                both = int((leads[at] == mine).sum())
                union = len(mine) + len(leads) - both
                apart, most = BANDS * (union - both) * den, union * (den - num)
                band = max(0, -(-apart // most) - 1) if most else (BANDS << 8 if apart else 0)
                out.append((row["id"], row["cluster"], row["kind"], len(mine), row["weight"], band, row["set"]))
            yield _batch(names, kinds, out)

    parts = shape.select("cluster", _blocks(F.col("many"), F.col("shingles")).alias("parts"))
    rows = members.join(parts, "cluster").select("cluster", F.pmod(F.xxhash64("id"), "parts").alias("part"), "kind", "id", "weight")
    leaders = parts.select(
        "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(-1).alias("kind"), F.col("cluster").alias("id"), F.lit(0).cast("long").alias("weight")
    )
    return (
        rows.unionByName(leaders).join(each, "id").repartition("cluster", "part").sortWithinPartitions("cluster", "part", "kind", "id", "set")
        .mapInArrow(released(run), "id long, cluster long, kind int, n long, weight long, band int, set binary")
    )


def compared(homes: DataFrame, away: DataFrame, sizes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows ``x, y, links``: links of x and y, enough to join what is linked (no number), and
    numbers of rows that x is linked with, to be added up (no y).

    ``sizes`` is ``id, n, weight``: shingles, and rows of that set.  A cluster of up to
    ``MEMBERS`` documents is one task.  A larger one is cut into blocks by distance from its
    leader.  The distance ``1 - |x & y| / |x | y|`` obeys the triangle inequality, so all pairs of
    two blocks are linked if their distances add up to no more than the greatest of a link, and
    none if they differ by as much; only pairs of other blocks are compared, each in its own task.
    A group of near copies, whose sets lie within half that distance of one of them, is so
    counted without comparing its members; each set is copied once for each block that it
    has to be compared with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, held, index, last = None, None, [], None, None
        names, kinds = ["x", "y", "links"], [pa.int64(), pa.int64(), pa.int64()]

        def settle(ends: bool) -> list[tuple]:
            """Deal with what is held: a whole block of members (roles 0 and 1), or some visitors."""
            nonlocal index, held
            out: list[tuple] = []
            ids, mine, weights = [h[0] for h in held], [h[1] for h in held], np.array([h[2] for h in held], np.int64)

            def told(start: int, stop: int, own: np.ndarray | None) -> None:
                pairs, many = index.links(ids[start:stop], mine[start:stop], weights[start:stop], num, den, own)
                out.extend((a, b, None) for a, b in pairs)
                out.extend((i, None, int(n)) for i, n in zip(ids[start:stop], many) if n)

            if held and role < 2:
                index = _Members(ids, mine, weights)
                for at in range(0, len(ids) if role == 0 else 0, VISITORS):
                    told(at, at + VISITORS, np.arange(at, min(at + VISITORS, len(ids))))
            elif held and index is not None:
                told(0, len(ids), None)
            if ends and index is not None:
                out += [(int(i), None, int(n)) for i, n in zip(index.ids, index.met) if n]
                index = None
            held = []
            return out

        for batch in batches:
            rows: list[tuple] = []
            for row in (r for at in range(0, batch.num_rows, 128) for r in batch.slice(at, 128).to_pylist()):
                this = (row["cluster"], row["task"])
                if this != key or row["role"] != role or (role == 2 and len(held) == VISITORS):
                    rows += settle(this != key)
                    key, role = this, row["role"]
                if last != (last := (this, role, row["id"], row["set"])):  # a repeated row counts once
                    held.append((row["id"], _u64(row["set"]), row["weight"]))
            yield _batch(names, kinds, rows)
        yield _batch(names, kinds, settle(True))

    met = homes.withColumn("kind", F.lit(0)).unionByName(away.withColumn("kind", F.lit(1)))
    members = checkpointed(met.join(sizes, "id").select("id", "cluster", "kind", "n", "weight"))
    shape = members.groupBy("cluster").agg(F.count("*").alias("many"), F.sum("n").alias("shingles")).filter("many > 1")
    large = (F.col("many") > MEMBERS) | (F.col("shingles") > MEMBER_SHINGLES)
    shape = checkpointed(shape.withColumn("large", large & (F.col("many") > 2)))
    each = single_sets(sets)
    small = members.join(shape.filter("NOT large"), "cluster").select("id", "cluster", "weight", F.lit("").alias("task"), (2 * F.col("kind")).alias("role")).join(each, "id")

    apart = checkpointed(banded(members, shape.filter("large"), each, num, den))
    place = ["cluster", "kind", "band"]
    bands = checkpointed(apart.groupBy(*place).agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"), F.sum("weight").alias("rows")))
    side = lambda name: [F.col(c).alias(f"{name}_{c}") for c in ("kind", "band", "blocks", "rows")]
    pairs = bands.filter("kind = 0").select("cluster", *side("a")).join(bands.select("cluster", *side("b")), "cluster")
    sure = F.expr(f"a_band + b_band + 2 <= {BANDS}")
    never = F.expr(f"abs(a_band - b_band) - 1 >= {BANDS}")
    numbered = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    todo = (
        pairs.filter(~sure & ~never & F.expr("b_kind = 1 OR a_band <= b_band"))
        .withColumn("a_block", numbered("a_blocks")).withColumn("b_block", numbered("b_blocks"))
        .withColumn("same", F.expr("b_kind = 0 AND a_band = b_band AND a_block = b_block"))
        .filter("same OR b_kind = 1 OR a_band < b_band OR a_block < b_block")
        .withColumn("task", F.concat_ws(" ", "a_band", "a_block", "b_kind", "b_band", "b_block"))
    )
    seat = lambda name, role: ["cluster", *[F.col(f"{name}_{c}").alias(c) for c in ("kind", "band", "block")], "task", role.alias("role")]
    seats = todo.select(seat("a", F.when(F.col("same"), 0).otherwise(1))).unionByName(todo.filter("NOT same").select(seat("b", F.lit(2))))
    placed = _with_few(apart, bands.select(*place, "blocks"), place).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks"))
    far = placed.join(seats, [*place, "block"]).select("id", "cluster", "weight", "task", "role", "set")
    found = (
        small.unionByName(far).repartition("cluster", "task").sortWithinPartitions("cluster", "task", "role", "id", "set")
        .mapInArrow(released(run), "x long, y long, links long")
    )

    # What needs no comparison: whole bands, and the leader with all that are near enough.
    own = F.expr(f"CASE WHEN kind = 0 AND 2 * band + 2 <= {BANDS} THEN weight ELSE 0 END")
    whole = pairs.filter(sure)
    whole = (
        whole.select("cluster", *[F.col(f"a_{c}").alias(c) for c in ("kind", "band")], F.col("b_rows").alias("sure"))
        .unionByName(whole.filter("b_kind = 1").select("cluster", *[F.col(f"b_{c}").alias(c) for c in ("kind", "band")], F.col("a_rows").alias("sure")))
        .groupBy(*place).agg(F.sum("sure").alias("sure"))
    )
    counted = _with_few(apart.drop("set"), checkpointed(whole), place).select(F.col("id").alias("x"), F.lit(None).cast("long").alias("y"), (F.col("sure") - own).alias("links"))
    led = apart.filter((F.col("band") < BANDS) & (F.col("id") != F.col("cluster"))).select(F.col("cluster").alias("x"), F.col("id").alias("y"), F.lit(None).cast("long").alias("links"))
    return found.unionByName(counted.filter("links > 0")).unionByName(led)


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that can be reached, for all nodes of links.

    Labels spread to neighbours and then jump to the label's own label, until none changes.
    """
    both = links.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(links.select(F.col("y").alias("u"), F.col("x").alias("v"))).distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        spread = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(spread, F.col("node") == F.col("u")).select("node", "label", F.least("label", "near").alias("lower"))
        lower = checkpointed(lower)
        jump = lower.select(F.col("node").alias("at"), F.col("lower").alias("to"))
        jumped = checkpointed(lower.join(jump, F.col("lower") == F.col("at")).select("node", "label", F.least("lower", "to").alias("new")))
        changed = jumped.filter("new < label").limit(1).count()
        labels = jumped.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``id, n_shingles, component_id, n_links`` per row: the smallest id that links reach, its own
    included, and the number of other rows that the row is linked with."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(8, -(-size // BUCKET_BYTES)))
    meta = checkpointed(document_sets(rows, k))
    full = meta.filter("id IS NOT NULL AND n > 0")
    classes = full.groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("many"))
    copies = checkpointed(classes.filter("many > 1"))
    heads = copies.select(F.col("rep").alias("id")).distinct()
    # Rows that only repeat another's set; ids that also stand for a set of their own stay.
    repeats = full.join(copies, "sig").filter("id <> rep").select("id").distinct().join(heads, "id", "left_anti")
    alone = full.groupBy("id").agg(F.count_distinct("sig").alias("sets")).filter("sets > 1").select("id")
    known = keep_ids(rows.filter("id IS NOT NULL"), checkpointed(repeats.join(alone, "id", "left_anti")), "left_anti")
    stays = checkpointed(shared_enough(known, k, num, den, buckets))
    sets = checkpointed(block_sets(keep_ids(known, stays), k))
    entries = checkpointed(postings(sets, num, den, buckets))
    homes = checkpointed(clusters(entries))
    away = checkpointed(visits(entries, homes, num, den))
    heavy = copies.groupBy(F.col("rep").alias("id")).agg(F.sum("many").alias("many"))
    sizes = entries.groupBy("id").agg(F.max("n").alias("n")).join(heavy, "id", "left")
    told = checkpointed(compared(homes, away, sizes.select("id", F.col("n").cast("long").alias("n"), F.coalesce("many", F.lit(1).cast("long")).alias("weight")), sets, num, den))
    links = told.filter("y IS NOT NULL").select("x", "y").distinct()
    counts = told.filter("links IS NOT NULL").groupBy(F.col("x").alias("counted")).agg(F.sum("links").alias("links"))
    # An id of several texts joins the classes of all of them; other copies hang on their class's smallest id.
    bridges = full.join(copies, "sig").filter("id <> rep").join(alone, "id", "left_semi").select(F.col("id").alias("x"), F.col("rep").alias("y"))
    between = checkpointed(links.unionByName(bridges))
    final = components(between).join(counts, F.col("node") == F.col("counted"), "left")
    shown = (
        meta.join(copies, "sig", "left")
        .withColumn("head", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).otherwise(F.col("id")))
    )
    others = F.when(F.col("id").isNotNull(), F.coalesce(F.col("many") - 1, F.lit(0)) + F.coalesce("links", F.lit(0)))
    return shown.join(final, F.col("head") == F.col("node"), "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("label", "head").alias("component_id"), others.alias("n_links")
    )
