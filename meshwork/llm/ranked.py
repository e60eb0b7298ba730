"""Ranked lexical search, reversed: documents stream past an index of the items.

The items, the smaller side, are indexed: each of their terms leads to the items that
hold it.  The index is broadcast, and every task streams its documents' term counts
through it, keeping the ``k`` best documents of each item so far; these lists are merged.
No document is shuffled and none is indexed.

Two passes over the texts: the first counts documents, terms, and in how many documents
each term of an item occurs; the second scores.  Items are searched in blocks of at most
``BLOCK_ITEMS`` items and ``BLOCK_TERMS`` different terms of an item, counted with repeats
among items, so that an index has a bound of size whatever the number of items; only one
item that has more terms itself makes a larger block.  A block costs two scans.

Weights of terms are ``floor(1000 ln((2N + 2) / (2 df + 1)))``; all else is in integers.
Sums go through float64 while they are sure to stay below 2**53, else through int64.

Defined results: texts are cut at every byte that is no letter, digit or part of a
character beyond ASCII, and only A-Z are lower-cased; null and empty texts have no terms and count
nowhere; rows of one item id make one item, of all their terms, null being an id like
others; an item without terms has no results; every row of the documents is a document,
so that a repeated one is ranked again; ties go to the smaller id, a null id comes last;
fewer than ``k`` documents of a score above 0 give fewer rows; other columns take no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, released, small_batches

BLOCK_ITEMS, BLOCK_TERMS = 4096, 1 << 17
#: Scores of documents and items that a task holds at a time, and bytes of a text that it cuts into words at a time.
CELLS, PIECE = 1 << 21, 1 << 20
#: Lists of best documents that one task merges.
FAN_IN = 256
EXACT = 1 << 53

#: Bytes of terms stay, A-Z in lower case; all others become blanks.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in UTF-8, in order, a piece of it at a time."""
    raw = text.translate(_FOLD)
    at = 0
    while at < len(raw):
        stop = raw.find(b" ", at + PIECE)
        stop = len(raw) if stop < 0 else stop
        yield raw[at:stop].split()
        at = stop


def _term_counts(text: bytes | None, index: dict[bytes, int]) -> tuple[int, Counter]:
    """How many terms a text has, and how often each term of the index occurs, by its number."""
    n, found = 0, Counter()
    for piece in words(text) if text else ():
        n += len(piece)
        found.update(map(index.get, piece))
    found.pop(None, None)
    return n, found


def _item_blocks(items: DataFrame, item_col: str, text_col: str, most_items: int, most_terms: int) -> Iterator[list[Row]]:
    """``item, term, times``: the terms of each item, in blocks of bounded size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                times = Counter()
                for piece in words(text.as_py()) if text.is_valid else ():
                    times.update(piece)
                terms = list(times.items())
                for at in range(0, len(terms), 65536):
                    part = terms[at : at + 65536]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()] * len(part), pa.int64()), pa.array([t for t, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())],
                        names=["item", "term", "times"],
                    )

    plain = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("text"))
    terms = plain.mapInArrow(counted, "item long, term binary, times long")
    rows = terms.limit(most_terms + 1).collect()  # those of several rows of an item add up in the index as well
    if len(rows) <= most_terms and len({r["item"] for r in rows}) <= most_items:
        if rows:
            yield rows
        return
    terms = checkpointed(terms.groupBy("item", "term").agg(F.sum("times").alias("times")))
    sizes = checkpointed(terms.groupBy("item").agg(F.count("*").alias("n")))
    total = sizes.agg(F.count("*").alias("items"), F.sum("n").alias("terms")).first()
    parts = max(-(-2 * total["items"] // most_items), -(-2 * total["terms"] // most_terms))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, weight = 0, 0, 0
        for batch in batches:
            blocks = []
            for n in batch.column(1).to_pylist():
                if held and (held == most_items or weight + n > most_terms):
                    block, held, weight = block + 1, 0, 0
                held, weight = held + 1, weight + n
                blocks.append(f"{TaskContext.get().partitionId()}/{block}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.string())], names=["item", "block"])

    blocks = sizes.repartition(parts, F.xxhash64("item")).mapInArrow(dealt, "item long, block string")
    blocks = checkpointed(blocks).withColumnRenamed("item", "owner")
    told = checkpointed(terms.join(blocks, F.col("item").eqNullSafe(F.col("owner"))).select("block", "item", "term", "times"))
    for (block,) in told.select("block").distinct().orderBy("block").toLocalIterator():
        yield told.filter(F.col("block") == block).select("item", "term", "times").collect()


class _Index:
    """Numbers of terms, and for each the items that hold it and how often."""

    def __init__(self, rows: list) -> None:
        self.items = list(dict.fromkeys(r["item"] for r in rows))
        place = {item: i for i, item in enumerate(self.items)}
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(bytes(r["term"]) for r in rows))}
        term = np.array([self.terms[bytes(r["term"])] for r in rows], np.int64)
        by_term = np.argsort(term, kind="stable")
        self.item = np.array([place[r["item"]] for r in rows], np.int64)[by_term]
        self.times = np.array([r["times"] for r in rows], np.int64)[by_term]
        self.starts = np.searchsorted(term[by_term], np.arange(len(self.terms) + 1))
        self.most = int(np.bincount(self.item, self.times).max()) if rows else 0


def _statistics(docs: DataFrame, index: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents that have a term, their terms, and in how many of them each term of the index occurs."""
    told = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = told.value
        df, documents, length = np.zeros(len(index), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                n, found = _term_counts(text.as_py(), index)
                documents, length = documents + (n > 0), length + n
                df[list(found)] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, [-1, -2]), pa.int64()), pa.array(np.append(df[seen], [documents, length]), pa.int64())], names=["term", "n"]
        )

    rows = docs.select("text").mapInArrow(released(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(len(index), np.int64), {-1: 0, -2: 0}
    for term, n in rows:
        if term < 0:
            total[term] = n
        else:
            df[term] = n
    return total[-1], total[-2], df


class _Best:
    """The k best documents of each item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.scores = np.zeros((items, k), np.int64)
        self.ids = np.zeros((items, k), np.int64)
        self.absent = np.ones((items, k), bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        """Scores of documents (rows) for items (columns); those of 0 take no part."""
        reach = (scores > 0) & (scores >= self.scores[:, -1])
        for item in np.flatnonzero(reach.any(axis=0)):
            at = np.flatnonzero(reach[:, item])
            found = [np.append(old[item], new[at]) for old, new in ((self.scores, scores[:, item]), (self.ids, ids), (self.absent, absent))]
            best = np.lexsort((found[1], found[2], -found[0]))[: self.k]
            self.scores[item], self.ids[item], self.absent[item] = (f[best] for f in found)


def _scorer(index: _Index, weights: np.ndarray, documents: int, length: int, k: int):
    in_floats = index.most * 1_000_000 * int(weights.max(initial=0)) < EXACT

    def summed(cells: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
        if in_floats:
            return np.bincount(cells, values, n).astype(np.int64)
        out = np.zeros(n, np.int64)
        np.add.at(out, cells, values)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = len(index.items)
        best, most = _Best(items, k), max(1, CELLS // items)
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                n = part.num_rows
                row, term, tf, m = [], [], [], []
                for i, text in enumerate(part.column(1)):
                    size, found = _term_counts(text.as_py(), index.terms)
                    row += [i] * len(found)
                    term += found.keys()
                    tf += found.values()
                    m.append(75 + (25 * size * documents) // length if size else 0)
                row, term, tf = (np.array(x, np.int64) for x in (row, term, tf))
                gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.array(m, np.int64)[row]))
                scores = np.zeros(n * items, np.int64)
                # Postings of these terms, a bounded number at a time.
                many = index.starts[term + 1] - index.starts[term]
                ends = np.cumsum(many)
                at = 0
                while at < len(term):
                    stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
                    wide = many[at:stop]
                    of = np.repeat(np.arange(at, stop), wide)
                    post = np.arange(len(of)) - np.repeat(np.cumsum(wide) - wide, wide) + index.starts[term[of]]
                    scores += summed(row[of] * items + index.item[post], n * items, gain[of] * index.times[post])
                    at = stop
                ids = part.column(0)
                best.offer(scores.reshape(n, items), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False))
        item, place = np.nonzero(best.scores)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(item), TaskContext.get().partitionId()), pa.int64()), pa.array([index.items[i] for i in item], pa.int64()),
                pa.array(best.ids[item, place], pa.int64(), mask=best.absent[item, place]), pa.array(best.scores[item, place], pa.int64()),
            ],
            names=["part", "item_id", "doc_id", "score"],
        )

    return run


def _merged(lists: DataFrame, k: int, fan_in: int) -> DataFrame:
    """The k best of each item: at most ``fan_in`` lists of an item meet in one task, level by level."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    many = (lists.agg(F.max("part")).first()[0] or 0) + 1
    while many > fan_in:
        many = -(-many // fan_in)
        lists = lists.withColumn("part", F.col("part") % many)
        best = Window.partitionBy("item_id", "part").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")
    best = Window.partitionBy("item_id").orderBy(*order)
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS, fan_in: int = FAN_IN,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of greatest score for each item."""
    spark = docs.sparkSession
    texts = small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")))
    out = None
    for rows in _item_blocks(items, item_col, item_text, block_items, block_terms):
        index = _Index(rows)
        documents, length, df = _statistics(texts, index.terms)
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        told = spark.sparkContext.broadcast((index, weights))

        def score(batches: Iterator[pa.RecordBatch], told=told, documents=documents, length=length) -> Iterator[pa.RecordBatch]:
            yield from _scorer(*told.value, documents, length, k)(batches)

        lists = checkpointed(texts.mapInArrow(released(score), "part long, item_id long, doc_id long, score long"))
        found = _merged(lists, k, fan_in)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
