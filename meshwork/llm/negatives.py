"""Hard-negative mining: exact scores by matrix products in a residue number system.

Every anchor is scored against every row, in blocks.  Components are integers; their
matrices are reduced modulo several small primes, multiplied in float32, where no sum of
residues is rounded, and the exact signed scores are put together from the residues by
Chinese remaindering in mixed radix.  As many primes are taken as the largest product of
two vectors' lengths asks for.

Two rounds of products: the first finds each anchor's ``positives`` best rows of its own
label, the second, for each of these, the ``negatives`` best rows of other labels whose
score lies within ``low`` to ``high`` percent of the positive's.  Tasks give their own
best, windows over an anchor choose among them.

Rows are numbered and dealt into shards by a hash of the number, so that no label, vector
or id gathers in one.  A task holds one shard and streams at most ``TASK_BLOCKS`` blocks
of ``BLOCK`` anchors past it.  Shards grow with the table, up to ``SHARD`` rows, so that
anchors are sent to few of them while memory stays bounded.

Defined results: rows with a null id or label, a null vector, or any component that is
null or not finite take no part; rows equal in id, label and vector count once, other rows
of one id count each; a row is never a positive of its own id; vectors of different
lengths are never compared, and empty ones have scores of 0; ties go to the smaller id;
fewer rows give fewer results; an anchor without positives, or a positive whose window
holds no row, has none; other columns take no part; a score beyond 64 bits raises an
OverflowError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, released
from .topk import _grouped, quantised

FEWEST_ROWS, SHARD, BLOCK, TASK_BLOCKS = 2048, 65536, 256, 64
#: Scores that are held at a time.
CELLS = 1 << 20
#: Float32 holds integers up to this exactly.
EXACT = 1 << 24
#: Odd primes below 256, the largest first.
PRIMES = [p for p in range(255, 2, -2) if all(p % d for d in range(3, 16, 2) if d < p)]


def primes_for(bound: int) -> list[int]:
    """As many primes as tell apart all integers of at most this size, either sign.

    Their product is twice as large as that needs, so that the last digit in mixed radix is far
    from half its prime, where rounding might take the other sign.
    """
    chosen, product = [], 1
    for p in PRIMES:
        if product > 4 * bound + 4:
            break
        chosen.append(p)
        product *= p
    if product <= 4 * bound + 4:
        raise OverflowError("components are too large for exact scores")
    return chosen


def residues(points: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Residues of least size, one float32 matrix for each prime; the components are integers in float64."""
    out = []
    for p in primes:
        r = np.fmod(points, p)
        r -= p * np.rint(r / p)
        out.append(r.astype(np.float32))
    return out


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """A residue of least size, exact for integers of float32; near half of p it may have the other sign."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact integer products of the rows of ``a`` with those of ``b``, from their residues."""
    digits: list[np.ndarray] = []
    for p, x, y in zip(primes, a, b):
        step = max(1, EXACT // ((p // 2) ** 2 + 1) - 1)
        r = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, x.shape[1], step):
            r = _centred(r + x[:, at : at + step] @ y[:, at : at + step].T, p)
        # The next digit in mixed radix: what is left of the residue, divided by the primes before.
        for q, digit in zip(primes, digits):
            inverse = pow(q, -1, p)
            inverse -= p * (inverse > p // 2)
            r = _centred(_centred(r - digit, p) * np.float32(inverse), p)
        digits.append(r)
    total = np.zeros((len(a[0]), len(b[0])), np.int64)
    rough = np.zeros(total.shape) if math.prod(primes) >= 1 << 63 else None
    for p, digit in zip(reversed(primes), reversed(digits)):
        total = total * p + digit.astype(np.int64)
        if rough is not None:
            rough = rough * p + digit
    if rough is not None and rough.size and np.abs(rough).max() >= 2.0**63 * (1 - 1e-12):
        raise OverflowError("a score is beyond 64 bits")
    return total


def best_columns(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest allowed scores of each row; of equal ones, of those in earlier columns."""
    n, m = scores.shape
    least = np.iinfo(np.int64).min
    if m > k:
        masked = np.where(allowed, scores, least)
        kth = np.partition(masked, m - k, axis=1)[:, m - k]
        taken = allowed & (masked > kth[:, None])
        ties = allowed & (masked == kth[:, None])
        room = k - taken.sum(axis=1)
        few = ties.sum(axis=1) <= room
        taken[few] |= ties[few]
        for i in np.flatnonzero(~few):
            taken[i, np.flatnonzero(ties[i])[: room[i]]] = True
    else:
        taken = allowed
    return np.nonzero(taken)


def _search(k: int, primes: list[int], high: int, low: int):
    """Best rows of each anchor in one shard: of its own label where it has no windows, else of others within each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, data = None, None
        for (name, part, kind, _), rows in _grouped(batches, ["shard", "part", "is_anchor", "block"]):
            if not kind:
                # Columns in order of the ids, so that the first of equal scores is the one to take.
                rows = rows.sort_values(["id", "row"], kind="stable")
                shard = (name, part)
                data = residues(_matrix(rows["v"]), primes), rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
                continue
            if (name, part) != shard:
                continue
            points, ids, labels = data
            step = max(1, CELLS // max(1, len(ids)))
            for at in range(0, len(rows), step):
                asked = rows.iloc[at : at + step]
                scores = products(residues(_matrix(asked["v"]), primes), points, primes)
                me, own = asked["id"].to_numpy(np.int64), asked["label"].to_numpy(np.int64)
                anchor = asked["row"].to_numpy(np.int64)
                same = own[:, None] == labels[None, :]
                windows = asked["windows"].tolist()
                places = max((len(w) for w in windows if w is not None), default=0)
                if not places:
                    yield _found(anchor, 0, ids, scores, *best_columns(scores, same & (me[:, None] != ids[None, :]), k))
                    continue
                for place in range(places):
                    has = np.array([len(w) > place for w in windows])
                    mid = [int(w[place]) if len(w) > place else 0 for w in windows]
                    floor = np.array([-(-low * s // 100) for s in mid], np.int64)
                    ceiling = np.array([high * s // 100 for s in mid], np.int64)
                    allowed = ~same & (scores >= floor[:, None]) & (scores <= ceiling[:, None]) & has[:, None]
                    yield _found(anchor, place, ids, scores, *best_columns(scores, allowed, k))

    return run


def _found(anchor: np.ndarray, place: int, ids: np.ndarray, scores: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    columns = anchor[i], np.full(len(i), place), ids[j], scores[i, j]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "place", "found_id", "score"])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
    fewest_rows: int = FEWEST_ROWS, block: int = BLOCK, task_blocks: int = TASK_BLOCKS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    plain = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(vector_col, scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    )
    plain = plain.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("id", "label", "v").agg(F.max("asks").alias("asks"))
    # A component and its negative are one size; the number of a row holds once it is written.
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = checkpointed(plain.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("v"), "length": length}))
    sizes = checkpointed(rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("length").alias("longest"), F.max(F.when(F.col("asks"), F.col("length"))).alias("asked")))
    bound = sizes.agg(F.max(F.col("longest") * F.col("asked"))).first()[0] or 0.0
    primes = primes_for(int(bound * (1 + 1e-9)) + 1)
    # Shards: at least so many that cores have work, at most SHARD rows each; blocks of anchors by a hash as well.
    per_shard = F.greatest(F.lit(fewest_rows), F.least(F.lit(SHARD), F.ceil(F.col("n") / 64)))
    shards = sizes.select("dim", F.ceil(F.col("n") / per_shard).alias("shards"))
    name = lambda salt: F.concat_ws("/", "dim", salt)
    salted = lambda seed, many: F.pmod(F.xxhash64("row", F.lit(seed)), many)
    data = rows.join(shards, "dim").select(name(salted(1, F.col("shards"))).alias("shard"), "row", "id", "label", "v")
    anchors = rows.filter("asks").select("row", "id", "label", "v", "dim")
    blocks = anchors.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    asked = checkpointed(anchors.join(blocks, "dim").withColumn("block", name(salted(2, F.col("blocks")))))

    def searched(asks: DataFrame, k: int) -> DataFrame:
        met = asks.select("dim", "block").distinct().join(shards, "dim")
        parts = met.groupBy("dim").agg(F.ceil(F.count("*") / task_blocks).alias("parts"))
        met = met.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("block"), "parts"))
        met = checkpointed(met.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).select(name("salt").alias("shard"), "block", "part"))
        none = F.lit(None).cast("array<long>")
        held = data.join(met.select("shard", "part").distinct(), "shard").select("shard", "part", F.lit(False).alias("is_anchor"), F.lit("").alias("block"), "row", "id", "label", "v", none.alias("windows"))
        both = held.unionByName(asks.join(met, "block").select("shard", "part", F.lit(True).alias("is_anchor"), "block", "row", "id", "label", "v", "windows"))
        return both.repartition("shard", "part").sortWithinPartitions("shard", "part", "is_anchor", "block").mapInArrow(
            released(_search(k, primes, high, low)), "anchor long, place long, found_id long, score long"
        )

    by_rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id"))
    near = searched(asked.withColumn("windows", F.lit(None).cast("array<long>")), positives)
    best = near.withColumn("place", by_rank("anchor") - 1).filter(F.col("place") < positives)
    best = checkpointed(best.select("anchor", F.col("place").cast("long").alias("place"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    listed = best.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("windows"))
    hard = searched(asked.join(listed, asked["row"] == listed["anchor"]).drop("anchor"), negatives)
    ranked = hard.withColumn("rank", by_rank("anchor", "place")).filter(F.col("rank") <= negatives)
    told = ranked.join(best, ["anchor", "place"]).join(asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
