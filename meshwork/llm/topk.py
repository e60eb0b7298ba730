"""Exact top-k search by inner product with dual cover trees.

Vectors are dealt into cells around pivots, a bounded sample of the vectors; a cell of
more than ``SHARD`` rows is split by a hash of the id.  Every shard and every block of
queries is indexed by a cover tree of its own: each node covers its points within a
known radius of its centre, and children have smaller radii.  Query tree and data tree
are descended together.  A pair of nodes is pruned when

    <q, c> + |q| r_c + |c| r_q + r_q r_c

(centres q and c, radii r_q and r_c) is below the worst k-th score so far within the
query node.  Before that, whole cells are pruned the same way against every block of
queries, with k-th scores from the queries' own cells.

Shards hold ``SHARD`` rows, query blocks ``QUERY_BLOCK``; a task streams up to
``TASK_BLOCKS`` query blocks past one indexed shard, and a shard that more blocks ask is
indexed in several tasks.  The driver holds the pivots, ``MOST_PIVOTS`` at most, and
numbers of their cells; a length of vectors without a pivot is a cell around zero.

Scores are integer inner products, exact: in float64 while no sum can reach 2**53, in
Python integers beyond.  Defined results: null vectors, vectors with null or non-finite
components, and null ids take no part; vectors of different lengths are never compared;
ties go to the smaller id; a query is never its own answer (by id); repeated rows of a
query id are asked once each and answered together; equal answers count once, so a
repeated row takes one place, and an id of several vectors one for each score; fewer than
k such answers give fewer rows; other columns take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

SHARD, QUERY_BLOCK = 4096, 512
#: Points of a leaf of a data tree and of a query tree.
LEAF, QUERY_LEAF = 512, 64
FEWEST_PIVOTS, MOST_PIVOTS = 16, 1024
#: Query blocks that one task takes past a shard.
TASK_BLOCKS = 64
#: Float64 sums below this are exact.
EXACT = float(1 << 53)


def quantised(vector: str, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, x as double; null if any is null or not finite."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("double")))


class CoverTree:
    """Nested covers of points: a node's children cover its points with smaller radii."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points = points
        self.order = np.arange(len(points))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.norm: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if len(points):
            self._grow(0, len(points), points[0], leaf)

    def _grow(self, start: int, stop: int, centre: np.ndarray, leaf: int) -> int:
        rows = self.order[start:stop]
        away = np.sqrt(np.maximum(((self.points[rows] - centre) ** 2).sum(axis=1), 0))
        radius = float(away.max()) if len(rows) else 0.0
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(radius * (1 + 1e-9) + 1e-9)
        self.norm.append(float(np.sqrt((centre**2).sum())))
        self.span.append((start, stop))
        self.children.append([])
        if stop - start > leaf and radius > 0:
            # Cover with centres that are far from one another, until all lie within half the radius (at most 16).
            centres, nearest, owner = [rows[int(away.argmin())]], None, np.zeros(len(rows), np.int64)
            while True:
                d = np.sqrt(np.maximum(((self.points[rows] - self.points[centres[-1]]) ** 2).sum(axis=1), 0))
                if nearest is None:
                    nearest = d
                else:
                    closer = d < nearest
                    owner[closer] = len(centres) - 1
                    nearest = np.where(closer, d, nearest)
                if len(centres) == 16 or nearest.max() <= radius / 2:
                    break
                centres.append(rows[int(nearest.argmax())])
            by_owner = np.argsort(owner, kind="stable")
            self.order[start:stop] = rows[by_owner]
            sizes = np.bincount(owner, minlength=len(centres))
            at = start
            for c, n in zip(centres, sizes):
                if n:
                    self.children[node].append(self._grow(at, at + int(n), self.points[c], leaf))
                    at += int(n)
        return node


class Best:
    """The k best distinct (score, id) of each query so far: scores descending, ids ascending."""

    def __init__(self, n: int, k: int, floor: np.ndarray, unique: bool = False) -> None:
        self.k, self.floor, self.unique = k, floor, unique
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> float:
        return float(np.maximum(self.scores[rows, -1], self.floor[rows]).min())

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in what reaches a row's k-th score."""
        least = np.maximum(self.scores[rows, -1], self.floor[rows])
        reach = (scores >= least[:, None]) & (scores > -np.inf)
        for i in np.flatnonzero(reach.any(axis=1)):
            row, at = rows[i], np.flatnonzero(reach[i])
            if self.unique and len(at) > 4 * self.k:  # the k best and all that tie with the last of them
                values = scores[i, at]
                at = at[values >= np.partition(values, len(values) - self.k)[-self.k]]
            all_scores = np.append(self.scores[row], scores[i, at])
            all_ids = np.append(self.ids[row], ids[at])
            best = np.lexsort((all_ids, -all_scores))
            if not self.unique:
                s, i = all_scores[best], all_ids[best]
                # Empty places are kept, so that k are left.
                best = best[np.append(True, (s[1:] != s[:-1]) | (i[1:] != i[:-1])) | (s == -np.inf)]
            best = best[: self.k]
            self.scores[row], self.ids[row] = all_scores[best], all_ids[best]


def dual_search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """The k best data points of each query that reach the query's floor."""
    best = Best(len(query_ids), k, floor, len(np.unique(data_ids)) == len(data_ids))
    if not len(query_ids) or not len(data_ids):
        return best

    def bound(a: int, b: int) -> float:
        q, c = queries.radius[a], data.radius[b]
        return float(queries.centre[a] @ data.centre[b]) + queries.norm[a] * c + data.norm[b] * q + q * c + 1e-6

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        upper, a, b = heapq.heappop(heap)
        rows = queries.order[slice(*queries.span[a])]
        if -upper < best.worst(rows):
            continue
        if not queries.children[a] and not data.children[b]:
            columns = data.order[slice(*data.span[b])]
            scores = queries.points[rows] @ data.points[columns].T
            scores[query_ids[rows][:, None] == data_ids[columns][None, :]] = -np.inf
            best.offer(rows, scores, data_ids[columns])
        elif data.children[b] and (not queries.children[a] or data.radius[b] >= queries.radius[a]):
            for child in data.children[b]:
                heapq.heappush(heap, (-bound(a, child), a, child))
        else:
            for child in queries.children[a]:
                heapq.heappush(heap, (-bound(child, b), child, b))
    return best


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows that agree in ``names``; the rows come sorted by them."""
    held: list[pd.DataFrame] = []
    key = None
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        keys = frame[names]
        starts = np.flatnonzero(np.append(True, (keys.iloc[1:].to_numpy() != keys.iloc[:-1].to_numpy()).any(axis=1)))
        for start, stop in zip(starts, np.append(starts[1:], len(frame))):
            this = tuple(keys.iloc[start])
            if key is not None and this != key:
                yield key, pd.concat(held, ignore_index=True)
                held = []
            key = this
            held.append(frame.iloc[start:stop])
    if held:
        yield key, pd.concat(held, ignore_index=True)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def _exact_scores(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether float64 sums are exact."""
    if not q.size or not x.size:
        return True
    return float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < EXACT


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, ids = None, None, None
        for (name, part, kind, _), rows in _grouped(batches, ["shard", "part", "is_query", "block"]):
            points = _matrix(rows["v"])
            if not kind:
                shard, tree, ids = (name, part), CoverTree(points), rows["id"].to_numpy(np.int64)
                continue
            if (name, part) != shard:
                continue
            query_ids, floor = rows["id"].to_numpy(np.int64), rows["floor"].to_numpy(float)
            if _exact_scores(points, tree.points):
                best = dual_search(CoverTree(points, QUERY_LEAF), query_ids, tree, ids, k, floor)
                taken = np.isfinite(best.scores) & (best.scores >= floor[:, None])
                at, place = np.nonzero(taken)
                out = (query_ids[at], best.ids[at, place], best.scores[at, place].astype(np.int64))
            else:
                out = _wide_scores(points, query_ids, tree.points, ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return run


def _wide_scores(q: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """Components too large for float64 sums: exact integers, row by row.  A score beyond 64 bits raises."""
    wide = [[int(c) for c in row] for row in x]
    out: list[tuple[int, int, int]] = []
    for row, me in zip(q, query_ids.tolist()):
        mine = [int(c) for c in row]
        scored = {(sum(a * b for a, b in zip(mine, other)), -i) for other, i in zip(wide, ids.tolist()) if i != me}
        out += [(me, -i, s) for s, i in heapq.nlargest(k, scored)]
    return tuple(np.array([r[c] for r in out], np.int64) for c in range(3))


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
    shard: int = SHARD, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of greatest score for each query row."""
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v"), is_query.alias("asks"))
    plain = plain.filter("id IS NOT NULL AND v IS NOT NULL").withColumn("dim", F.size("v"))
    n = plain.count()
    # Pivots: the rows of smallest hash, a sample of a bounded size.
    wanted = int(min(MOST_PIVOTS, max(FEWEST_PIVOTS, -(-n // shard))))
    sample = plain.orderBy(F.xxhash64("id"), "id", "v").limit(wanted).select("dim", "v").collect()
    chosen = {}
    for dim in {r["dim"] for r in sample}:
        rows = [r["v"] for r in sample if r["dim"] == dim]
        chosen[dim] = np.unique(np.array(rows, float).reshape(len(rows), dim), axis=0)
    pivots = spark.sparkContext.broadcast(chosen)

    def pivots_of(dim: int) -> np.ndarray:
        return pivots.value.get(dim, np.zeros((1, dim)))

    @F.pandas_udf("struct<cell:int,away:double>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            cell, away = np.zeros(len(v), np.int32), np.zeros(len(v))
            sizes = np.array([len(x) for x in v])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x, p = _matrix(v.iloc[at]).reshape(len(at), dim), pivots_of(int(dim))
                d = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]
                best = d.argmin(axis=1)
                cell[at] = best
                away[at] = np.sqrt(((x - p[best]) ** 2).sum(axis=1))
            yield pd.DataFrame({"cell": cell, "away": away})

    placed = checkpointed(plain.withColumn("p", place("v")).select("id", "v", "asks", "dim", "p.cell", "p.away"))
    cells = checkpointed(placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max("away").alias("radius")))
    # Cells are as many as pivots, but for lengths that have none; those may be many.
    few = cells.limit(2 * MOST_PIVOTS + 1).count() <= 2 * MOST_PIVOTS
    near_cells = F.broadcast(cells) if few else cells
    salt = lambda many, per, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.greatest(many, F.lit(1)) / per))
    dealt = placed.join(near_cells, ["dim", "cell"]).withColumn("shard_salt", salt(F.col("n"), shard, 1)).withColumn("block_salt", salt(F.col("q"), query_block, 2))
    name = lambda last: F.concat_ws("/", "dim", "cell", last)
    data = dealt.select(name("shard_salt").alias("shard"), "id", "v")
    asked = checkpointed(dealt.filter("asks").select(name("block_salt").alias("block"), "block_salt", "id", "v", "dim", "cell", "away"))
    numbered = cells.withColumn("shards", F.ceil(F.col("n") / shard))

    def searched(queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """Partial answers of the queries ``block, id, v, floor`` for ``pairs`` of block and shard."""
        asks = pairs.groupBy("shard").agg(F.ceil(F.count("*") / TASK_BLOCKS).alias("parts"))
        told = checkpointed(pairs.join(asks, "shard").select("shard", "block", F.pmod(F.xxhash64("block"), "parts").alias("part")))
        needed = told.select("shard", "part").distinct()
        rows = data.join(needed, "shard").select("shard", "part", F.lit(False).alias("is_query"), F.lit("").alias("block"), "id", "v", F.lit(0.0).alias("floor")).unionByName(
            queries.join(told, "block").select("shard", "part", F.lit(True).alias("is_query"), "block", "id", "v", "floor")
        )
        return rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "is_query", "block").mapInArrow(
            _search(k), "query_id long, vec_id long, score long"
        )

    # Floors: the k-th score of every query within one shard of its own cell; blocks take turns at the shards.
    low = F.lit(float("-inf"))
    blocks = asked.select("block", "block_salt", "dim", "cell").distinct()
    home = blocks.join(numbered, ["dim", "cell"]).select("block", name(F.col("block_salt") % F.col("shards")).alias("shard"))
    near = searched(asked.withColumn("floor", low), home)
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.distinct().withColumn("r", F.row_number().over(by_rank)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    floored = checkpointed(asked.join(kth, "id", "left").withColumn("floor", F.coalesce("floor", low)))

    # Cells that may hold a better one than the block's worst k-th score; all shards of such a cell are asked.
    worst = floored.groupBy("block", "dim", "cell").agg(F.max("away").alias("q_radius"), F.min("floor").alias("worst"))
    others = cells.select("dim", F.col("cell").alias("other"), "radius", F.ceil(F.col("n") / shard).alias("shards"))

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in batch.to_pylist():
                p = pivots_of(row["dim"])
                q, c, r, radius = p[row["cell"]], p[row["other"]], row["q_radius"], row["radius"]
                upper = c @ q + np.sqrt(q @ q) * radius + np.sqrt(c @ c) * r + r * radius
                keep.append(bool(upper + abs(upper) * 1e-9 + 1e-6 >= row["worst"]))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["block", "dim", "other", "shards"])

    # One row for each block and cell of a length, and numbers alone: no vectors meet here.
    met = worst.join(F.broadcast(others) if few else others, "dim").mapInArrow(meets, "block string, dim int, other int, shards long")
    every = met.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    answers = searched(floored, every.select("block", F.concat_ws("/", "dim", "other", "salt").alias("shard")))
    ranked = answers.distinct().withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
