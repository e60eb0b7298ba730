"""Byte-level BPE encoding and decoding over overlapping chunks.

Texts of up to ``CHUNK`` characters are pre-tokenised and encoded where they lie.
Longer ones are cut, in one pass, into chunks of ``CHUNK`` characters and an overlap,
and the chunks of all texts are dealt out one by one:

1. Each chunk is pre-tokenised on its own, from its first character, right or wrong,
   and tells the boundaries it has in the overlaps with its neighbours.
2. Neighbours are stitched on boundaries alone.  The matches of the pattern depend only
   on where one starts, so at the first boundary that both chunks of an overlap have,
   the later one has come into step with the earlier; what follows is as true as the
   earlier chunk is.  So a text falls into runs, each from one such place to the next:
   mostly one chunk each; where an overlap holds no common boundary (one endless word,
   say) the run goes on through the next chunk.
3. Runs are encoded one by one, wherever they are dealt, and the ids of a text are put
   together in order.

A match must not be decided by more than ``LOOK_AHEAD`` characters beyond its start, nor
by what lies before it; this holds for the given pattern (a contraction has 3, and a run
of blanks that ends with the chunk is not used) and is asked of any other.

Every distinct piece is merged by rank once per worker and kept.  Decoding joins
the raw bytes of the ids.

Defined results: a null text is an empty one, of no tokens; repeated rows are
encoded each; other columns are kept if asked for and otherwise dropped.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, released, small_batches

CHUNK, OVERLAP = 32768, 1024
#: Bytes of long texts for each of the tasks that their chunks are dealt to.
TASK_BYTES = 2 << 20
#: Characters beyond a match's start that may decide what it is (a contraction has 3).
LOOK_AHEAD = 3
#: Most pieces that a worker remembers; others are merged anew.
REMEMBERED = 300_000
LONG_PIECE = 128


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64-token rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token_of = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Join the neighbouring pair of the lowest rank, leftmost first, while there is one."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > LONG_PIECE:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, rank in enumerate(pairs):
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list of parts."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # part at i is piece[i:end[i]]; 0 if merged away
        before = list(range(-1, n - 1))

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        heap: list[tuple[int, int, int]] = []
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        packed = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(self.known) < REMEMBERED and len(piece) <= LONG_PIECE:
            self.known[piece] = packed
        return packed

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        known, fresh = self.known.get, self.piece_ids
        return [known(p) or fresh(p) for p in pieces]

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_pieces(self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def pieces_from(self, text: str, start: int = 0) -> tuple[list[str], np.ndarray]:
        """Pieces and their boundaries: one more than pieces, the first at ``start``."""
        pieces = self.pattern.findall(text, start)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return pieces, np.concatenate([[start], start + np.cumsum(sizes)]).astype(np.int64)

    def zones(self, text: str, first: bool, last: bool, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """Boundaries of a chunk in its first characters, which the chunk before has too, and
        the certain ones in the overlap with the chunk after it; as offsets in the chunk."""
        _, ends = self.pieces_from(text)
        overlap = len(text) - chunk
        head = ends[:0] if first else ends
        if last:
            return head, ends[:0]
        sure = (ends[1:] < len(text)) & (ends[:-1] + LOOK_AHEAD <= len(text))
        certain = ends[: 1 + (len(sure) if sure.all() else int(np.argmin(sure)))]
        return head[head < overlap], certain[certain >= chunk]

    def encode_run(self, text: str, begin: int, end: int | None) -> bytes:
        """Ids of the pieces between two true boundaries of a text that goes on beyond the second."""
        pieces, ends = self.pieces_from(text, begin)
        return b"".join(self.encode_pieces(pieces if end is None else pieces[: int(np.searchsorted(ends, end))]))


_ENCODERS: dict[str, ByteBpe] = {}


def _encoder(sent: Broadcast) -> ByteBpe:
    """The encoder of what was sent; a worker keeps the last one, with the pieces it remembers."""
    key, ranks, pattern = sent.value
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ByteBpe(ranks, pattern)
    return _ENCODERS[key]


def encode_documents(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Rows ``id, ids`` (binary, little-endian 32-bit ids) ``, decoded`` (binary)."""
    return _encoded(docs, ranks, pattern, id_col, text_col, chunk, overlap, digest=False)


def encode_digests(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Rows ``id, n_tokens, ids_sha256, decoded_sha256`` of every text."""
    return _encoded(docs, ranks, pattern, id_col, text_col, chunk, overlap, digest=True)


def _encoded(docs, ranks, pattern, id_col, text_col, chunk, overlap, digest) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ranks, pattern))
    rows = small_batches(docs).select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema[id_col].dataType.simpleString()
    told = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"
    names = [part.split()[0] for part in told.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.binary(), pa.binary()]

    def shown(parts: Iterable[tuple[bytes, bytes]]) -> tuple:
        """What is returned of a text whose ids and bytes come in parts; digests never hold the whole."""
        if not digest:
            ids, decoded = zip(*parts)
            return b"".join(ids), b"".join(decoded)
        many, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for ids, decoded in parts:
            many += len(ids) // 4
            of_ids.update(ids)
            of_bytes.update(decoded)
        return many, of_ids.hexdigest(), of_bytes.hexdigest()

    def batch_of(keys: pa.Array, key_name: str, results: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[c] for r in results], kind) for c, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([keys, *columns], names=[key_name, *names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield batch_of(part.column(0), id_col, [shown([(i, bpe.decode(i))]) for i in ids])

    size = F.char_length("text")
    short = rows.filter(size <= chunk).mapInArrow(released(whole), f"`{id_col}` {id_type}, {told}")
    # Numbers of rows hold once the rows are written.
    long = checkpointed(rows.filter(size > chunk).withColumns({"row": F.monotonically_increasing_id(), "bytes": F.octet_length("text")}))
    tasks = int((long.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES) + 1
    texts = _long_texts(long.select("row", "text"), sent, chunk, overlap, tasks)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, runs in _groups(batches, ("row",)):
            yield batch_of(pa.array([row[0]], pa.int64()), "row", [shown((r["ids"], r["decoded"]) for r in runs)])

    results = texts.repartition("row").sortWithinPartitions("row", "run").mapInArrow(released(joined), f"row long, {told}")
    return short.unionByName(long.select(id_col, F.col("row").alias("key")).join(results, F.col("key") == F.col("row")).select(id_col, *names))


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows that agree in ``names``; the rows come sorted by them, and are handed on one by one."""
    rows = (row for batch in batches for at in range(0, batch.num_rows, 16) for row in batch.slice(at, 16).to_pylist())
    return itertools.groupby(rows, key=lambda row: tuple(row[n] for n in names))


def _long_texts(long: DataFrame, sent: Broadcast, chunk: int, overlap: int, tasks: int) -> DataFrame:
    """``row, run, ids, decoded``: the ids of each run of each text, and the bytes they stand for."""
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    pairs = F.arrays_zip(parts.alias("own"), F.slice(parts, F.lit(2), F.size(parts)).alias("after"))
    dealt = (
        long.select("row", F.posexplode(pairs).alias("k", "part"))
        .select("row", "k", F.concat("part.own", F.coalesce(F.substring("part.after", 1, overlap), F.lit(""))).alias("text"), F.col("part.after").isNull().alias("last"))
        .repartition(tasks, "row", "k")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(sent)
        for batch in batches:
            zones = []
            for k, text, last in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "last"))):
                zones.append([(z + k * chunk).tolist() for z in bpe.zones(text, k == 0, last, chunk)])
            heads, tails = (pa.array([z[i] for z in zones], pa.list_(pa.int64())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, heads, tails], names=[*batch.schema.names, "head", "tail"])

    chunks = checkpointed(dealt.mapInArrow(released(cut), "row long, k int, text string, last boolean, head array<long>, tail array<long>"))
    before = chunks.select("row", (F.col("k") + 1).alias("k"), "tail")
    met = chunks.select("row", "k", "head").join(before, ["row", "k"], "left").select("row", "k", F.array_min(F.array_intersect("head", "tail")).alias("meet"))
    # A run begins where a chunk has met the one before it, and ends where the next run begins.
    in_order = Window.partitionBy("row").orderBy("k")
    runs = met.withColumn("run", F.count_if(F.col("meet").isNotNull()).over(in_order))
    ends = runs.groupBy("row", "run").agg(F.coalesce(F.max("meet"), F.lit(0)).alias("begin"), F.min("k").alias("from_k"))
    ends = ends.withColumn("end", F.lead("begin").over(Window.partitionBy("row").orderBy("run")))
    placed = runs.select("row", "k", "run").join(ends, ["row", "run"])
    dealt = chunks.select("row", "k", "text", "last").join(placed, ["row", "k"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(sent)
        for (row, run), group in _groups(batches, ("row", "run")):
            held = list(group)
            offset, begin, end = held[0]["from_k"] * chunk, held[0]["begin"], held[0]["end"]
            text = "".join([*(c["text"][:chunk] for c in held[:-1]), held[-1]["text"]])
            ids = bpe.encode_run(text, begin - offset, None if end is None else end - offset)
            columns = [pa.array([row], pa.int64()), pa.array([run], pa.int64()), pa.array([ids], pa.binary()), pa.array([bpe.decode(ids)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "run", "ids", "decoded"])

    ordered = dealt.repartition(tasks, "row", "run").sortWithinPartitions("row", "run", "k")
    return ordered.select("row", "run", "k", "text", "from_k", "begin", "end").mapInArrow(released(encode), "row long, run long, ids binary, decoded binary")
