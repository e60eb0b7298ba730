"""Document fingerprints from prefix polynomial hashes.

A text of code points ``c_0 c_1 ...`` has the prefix array ``H[i] = sum(c_j * B**j)``
for ``j < i``, modulo two primes.  Any span is hashed from two entries, so spans
of any two texts are compared in constant time, and the longest common extension
of two positions is found by binary search over span lengths.

A fingerprint keeps the hash of the whole text; at geometrically growing lengths, the
hashes of the leading and of the trailing span; and, of the spans of ``WINDOW`` code
points at every place of the text, the ``KEPT`` smallest distinct hashes.  All come from
the prefix arrays.  ``likeness`` of two fingerprints is the greater of two shares: what of
the longer text is a prefix and a suffix that both have (by binary search over the kept
lengths), and what both have of the windows of either (exact while all are kept,
estimated from the smallest hashes beyond).  The first suits a text whose end was
replaced, the second one that was changed in several places.  The first is at most
the true share, and at least 0.84 of it; an estimate of the second, from ``KEPT`` hashes, has a
standard error of 0.07 at most, and 0.25 is never passed in the tests.

Where the arrays of two texts are in hand, ``common_extension`` gives exact lengths;
each row has those of its text's and the next text's common prefix and suffix.

Defined results: a null text is an empty one; the fingerprint of an empty text is
that of length 0; two empty texts have likeness 1, an empty and another one 0.
Rows are ordered by doc_id (null first), ties by text; a row's next document is
the row after it, the last row's the first one (a single row is its own next).
Repeated rows count as rows of their own.  Columns other than the two named ones
take no part, whatever they are called.  A text takes about 50 bytes of memory per code
point while it is in hand.  Rows of one id are dealt to one task.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525011)
#: Spans are kept at lengths 2**(k / PER_OCTAVE).
PER_OCTAVE = 4
#: Code points of a window, and windows kept of a text.
WINDOW, KEPT = 32, 48
#: Rows of one ordered bucket, and the most buckets (the driver holds their bounds); a bucket is streamed, not held.
BUCKET_ROWS, MOST_BUCKETS = 128, 65536

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LENGTHS = np.unique(np.ceil(2 ** (np.arange(0, 32 * PER_OCTAVE) / PER_OCTAVE)).astype(np.int64))


class _Powers:
    """Powers of each base and of its inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if n >= self.n:
            self.n = max(1 << 12, 1 << int(n + 1).bit_length())
            self.tables = [(self._table(b, p), self._table(pow(b, -1, p), p)) for b, p in zip(BASES, PRIMES)]
        return self.tables

    def _table(self, base: int, prime: int) -> np.ndarray:
        out, size = np.ones(self.n, np.uint64), 1
        while size < self.n:  # double: out[size:2*size] = out[:size] * base**size
            step = min(size, self.n - size)
            out[size : size + step] = out[:step] * np.uint64(pow(base, size, prime)) % np.uint64(prime)
            size += step
        return out


_POWERS = _Powers()


class PrefixHashes:
    """The prefix arrays of one text; a joined text is described, not hashed again."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.arrays = []
        for (powers, _), prime in zip(_POWERS.upto(self.n), PRIMES):
            prefix = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * powers[: self.n] % np.uint64(prime), out=prefix[1:])
            self.arrays.append(prefix % np.uint64(prime))

    def at(self, which: int, ends: np.ndarray) -> np.ndarray:
        return self.arrays[which][ends]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans, the same for equal spans wherever they begin."""
        mixed = np.zeros(len(starts), np.uint64)
        for i, ((_, inverse), prime) in enumerate(zip(_POWERS.upto(self.n), PRIMES)):
            p = np.uint64(prime)
            h = (self.at(i, ends) + p - self.at(i, starts)) % p * inverse[starts] % p
            mixed ^= (h + np.uint64(1)) * _MIX[i]
        return mixed ^ (mixed >> np.uint64(29))

    def span_equal(self, start: int, other: PrefixHashes, other_start: int, length: int) -> bool:
        if start + length > self.n or other_start + length > other.n:
            return False
        powers = _POWERS.upto(max(self.n, other.n))
        for i, prime in enumerate(PRIMES):
            mine = int(self.arrays[i][start + length]) - int(self.arrays[i][start])
            theirs = int(other.arrays[i][other_start + length]) - int(other.arrays[i][other_start])
            if (mine * int(powers[i][0][other_start]) - theirs * int(powers[i][0][start])) % prime:
                return False
        return True

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Length of the longest common extension of two positions, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span_equal(start, other, other_start, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def common_suffix(self, other: PrefixHashes) -> int:
        """Length of the longest common suffix, by binary search."""
        low, high = 0, min(self.n, other.n)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span_equal(self.n - mid, other, other.n - mid, mid):
                low = mid
            else:
                high = mid - 1
        return low

    @functools.cached_property
    def windows(self) -> np.ndarray:
        """Hashes of the windows at all places."""
        many = max(0, self.n - WINDOW + 1)
        return self._windows(self.arrays[0][:many], self.arrays[0][WINDOW : WINDOW + many], slice(0, many))

    def _windows(self, before: np.ndarray, after: np.ndarray, starts: slice | np.ndarray) -> np.ndarray:
        """Of windows one prime's hash is enough, mixed so that their order is arbitrary."""
        p = np.uint64(PRIMES[0])
        h = (after + p - before) % p * _POWERS.upto(self.n)[0][1][starts] % p
        h = (h + np.uint64(1)) * _MIX[0]
        h = (h ^ (h >> np.uint64(33))) * _MIX[1]
        return h ^ (h >> np.uint64(31))


class Joined(PrefixHashes):
    """``head[:cut] + tail[:rest]`` seen through the arrays of both texts."""

    def __init__(self, head: PrefixHashes, cut: int, tail: PrefixHashes, rest: int) -> None:
        self.head, self.cut, self.tail, self.n = head, cut, tail, cut + rest

    def at(self, which: int, ends: np.ndarray) -> np.ndarray:
        powers, prime = _POWERS.upto(self.n)[which][0], np.uint64(PRIMES[which])
        inside = np.minimum(ends, self.cut)
        beyond = ends - inside
        return (self.head.at(which, inside) + powers[self.cut] * self.tail.at(which, beyond)) % prime

    @functools.cached_property
    def windows(self) -> np.ndarray:
        """Those within either text, which are known, and those across the joint."""
        starts = np.arange(max(0, self.cut - WINDOW + 1), min(self.cut - 1, self.n - WINDOW) + 1)
        across = self._windows(self.at(0, starts), self.at(0, starts + WINDOW), starts)
        head, tail = (text.windows[: max(0, size - WINDOW + 1)] for text, size in ((self.head, self.cut), (self.tail, self.n - self.cut)))
        return np.concatenate([head, across, tail])


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """The ``KEPT`` smallest distinct ones, in order."""
    if len(hashes) > 8 * KEPT:
        few = np.sort(hashes[hashes <= np.uint64((4 * KEPT << 64) // len(hashes))])
        few = few[np.append(True, few[1:] != few[:-1])[: len(few)]]
        if len(few) >= KEPT:
            return few[:KEPT]
    return np.unique(hashes)[:KEPT]


def fingerprint(hashes: PrefixHashes) -> str:
    """Length, hash of the whole, 24 bits for each leading and trailing span, 32 for each window kept."""
    n = hashes.n
    lengths = _LENGTHS[: np.searchsorted(_LENGTHS, n, side="right")]
    starts = np.concatenate([np.zeros(len(lengths) + 1, np.int64), n - lengths])
    ends = np.concatenate([[n], lengths, np.full(len(lengths), n)]).astype(np.int64)
    spans = hashes.spans(starts, ends)
    parts = (spans[1:] >> np.uint64(40)).astype(">u4").tobytes()
    packed = np.frombuffer(parts, np.uint8).reshape(-1, 4)[:, 1:].tobytes()
    windows = (_smallest(hashes.windows) >> np.uint64(32)).astype(">u4").tobytes()
    return base64.b64encode(struct.pack(">IQ", n, int(spans[0])) + packed + windows).decode()


def _resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of either that both have."""
    mine, theirs = set(a.tolist()), set(b.tolist())
    either, both = mine | theirs, mine & theirs
    if not both:
        return 0.0
    if len(a) < KEPT and len(b) < KEPT:
        return len(both) / len(either)
    smallest = sorted(either)[:KEPT]
    return sum(x in both for x in smallest) / len(smallest)


def _common(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> int:
    """Longest kept length at which both agree, never more than they share; agreement is monotone, so bisect."""
    low, high = 0, len(lengths)
    while low < high:
        mid = (low + high + 1) // 2
        if (a[mid - 1] == b[mid - 1]).all():
            low = mid
        else:
            high = mid - 1
    return int(lengths[low - 1]) if low else 0


def likeness(a: str, b: str) -> float:
    """Share of the longer text, or of all windows, that both texts have, 0 to 1."""
    if a == b:
        return 1.0
    raw = [base64.b64decode(x) for x in (a, b)]
    sizes = [struct.unpack(">I", r[:4])[0] for r in raw]
    if 0 in sizes:
        return 0.0
    many = [int(np.searchsorted(_LENGTHS, n, side="right")) for n in sizes]
    spans = [np.frombuffer(r[12 : 12 + 6 * m], np.uint8).reshape(2, -1, 3) for r, m in zip(raw, many)]
    windows = [np.frombuffer(r[12 + 6 * m :], ">u4") for r, m in zip(raw, many)]
    few = min(sizes)
    lengths = _LENGTHS[: np.searchsorted(_LENGTHS, few, side="right")]
    head, tail = (_common(spans[0][i], spans[1][i], lengths) for i in (0, 1))
    shared = min(head + tail, few)
    return min(max(shared / max(sizes), _resemblance(*windows)), 1 - 1 / max(max(sizes), 2))


def _edit_sizes(n: int, n_next: int) -> tuple[int, int]:
    return n - n // 2, min(n // 2, n_next)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long, common_suffix long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Consecutive rows of each bucket; a bucket ends with a guest, the first row after it."""
    before = None
    for batch in batches:
        for bucket, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            hashes = PrefixHashes(text)
            if before is not None and before[0] == bucket:
                yield before[1:], (doc_id, text, hashes)
            before = None if guest else (bucket, doc_id, text, hashes)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    kept: tuple[int, str] = (0, "")
    for (doc_id, text, hashes), (_, text_next, hashes_next) in _pairs(batches):
        cut, rest = _edit_sizes(hashes.n, hashes_next.n)
        own = kept[1] if kept[0] == id(hashes) else fingerprint(hashes)
        following = fingerprint(hashes_next)
        kept = (id(hashes_next), following)
        edited = fingerprint(Joined(hashes, cut, hashes_next, rest))
        digest = hashlib.sha256((text[:cut] + text_next[:rest]).encode()).hexdigest()
        rows.append((doc_id, hashes.n, digest, own, edited, likeness(own, edited), likeness(own, following), hashes.common_extension(0, hashes_next, 0), hashes.common_suffix(hashes_next)))
        if len(rows) >= 4096:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = [part.split()[0] for part in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``bucket, guest, id, text``: each bucket holds a run of ids in order and,
    as its guest, the first row after the run.  The text is shuffled once; the driver
    holds one bound and one first id per bucket, ``MOST_BUCKETS`` at most.
    """
    spark = docs.sparkSession
    ids = small_batches(docs).select(F.col(id_col).cast("long").alias("id"))
    count = ids.count()
    n = int(min(MOST_BUCKETS, max(1, count // BUCKET_ROWS)))
    shares = [i / n for i in range(1, n)]
    cuts = ids.agg(F.percentile_approx("id", shares, 10 * n).alias("c")).first()["c"] if shares else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def bucket_of(v):
        known = v.notna().to_numpy()
        found = np.zeros(len(v), np.int32)
        found[known] = np.searchsorted(shared.value, v[known].to_numpy(np.int64), side="right")
        import pandas as pd

        return pd.Series(found)

    # The first id of each bucket; null sorts before every number and lies in bucket 0.
    firsts = (
        ids.distinct().withColumn("bucket", bucket_of("id")).groupBy("bucket")
        .agg(F.min("id").alias("first"), F.max(F.col("id").isNull().cast("int")).alias("nulls")).collect()
    )
    first = {r["bucket"]: None if r["nulls"] else r["first"] for r in firsts}
    order = sorted(first)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first bucket's rows follow the last's
    heads = spark.sparkContext.broadcast({b: (first[b], before[b]) for b in order})

    @F.pandas_udf("array<int>")
    def places(v):
        import pandas as pd

        known = v.notna().to_numpy()
        found = np.zeros(len(v), np.int64)
        found[known] = np.searchsorted(shared.value, v[known].to_numpy(np.int64), side="right")
        out = []
        for b, x, k in zip(found.tolist(), v, known):
            head, to = heads.value[b]
            leads = (head is None) if not k else (head is not None and int(x) == head)
            out.append([b, to] if leads else [b])
        return pd.Series(out)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.withColumn("p", places("id")).select(F.posexplode("p").alias("guest", "bucket"), "id", "text")
    return (
        dealt.select("bucket", (F.col("guest") > 0).alias("guest"), "id", "text")
        .repartition("bucket").sortWithinPartitions("bucket", "guest", "id", "text")
    )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit by the next text, their likeness, and the
    lengths of the text's and the next one's common prefix and suffix.

    The edited text has its last ``floor(n / 2)`` code points replaced by as many of
    the next document's first ones (or all it has).
    """
    return with_next(docs, id_col, text_col).mapInArrow(_compare, _OUT)
