"""Mixing sources to target weights by the cube method of balanced sampling.

A source's target over its size is the number of copies each of its documents is to
have on average; the whole part is given to all, the fraction becomes an inclusion
probability.  The cube method then moves the probabilities of a few documents at a
time along the null space of the balancing constraints (token total and document
total of the source), until each is 0 or 1; a source's totals stay what they were
while it flies, and only the dozen documents that are left at the end are landed
by the rounding that keeps the totals nearest.

Flight is dealt out: documents of a source fall into blocks by a hash of their id,
each block flies alone and hands on two documents at most, which fly together on
the next level, until one block per source is left.  No task holds more than a
block of rows, however large a source is.

Defined results: null or blank texts have size 0; a null source is a source of its
own, ordered last; an empty table gives an empty result; rows that agree in id,
source and size are one unit (they are taken alike); with no words at all, every
target is 0 and nothing is taken.  Runs agree: the only randomness is a hash of
the ids.  Columns named like the outputs take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST_COPIES = 1.5, 2
#: Units that fly together, and how many of a source's last ones are landed together.
BLOCK, LANDED = 2048, 12
NEAR_0 = 1e-9
#: Tables of more sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than space, tab and line ends; null: 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    ``sizes`` has ``source, size``.  A target is the source's weight's share of
    ``share`` times all words, but ``most`` times its size at most; the excess goes to
    the others by weight until none is above.  That is filling to one level: with
    sources ordered by ``most * size / weight``, those below the level are full.
    Only the table of sources is ordered as a whole, one row for each.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("turn", (F.row_number().over(order) - 1) % len(weights)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") + 1).cast("int"))
    )
    full = F.lit(float(most)) * F.col("source_size")
    by_level = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    at_least = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.withColumn(
        "level",
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(below), F.lit(0.0)))
        / F.sum("weight").over(at_least),
    )
    # The level that holds is that of the first source that it does not fill.
    found = levels.withColumn(
        "held", F.min(F.when(F.col("level") * F.col("weight") <= full, F.struct((full / F.col("weight")).alias("at"), "level"))).over(everything)
    )
    target = F.when(F.col("held").isNull(), full).otherwise(F.least(full, F.col("held.level") * F.col("weight")))
    return found.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def fly(sizes: np.ndarray, probabilities: np.ndarray, draws: np.ndarray, leave: int = 2) -> np.ndarray:
    """Flight phase over one block: all but ``leave`` entries (two at least) become 0 or 1.

    Three undecided entries at a time move along the direction that keeps the sum of
    probabilities and of ``size * probability``; ``draws`` in [0, 1) choose the way.
    """
    p = probabilities.astype(float).copy()
    undecided = np.flatnonzero((p > NEAR_0) & (p < 1 - NEAR_0)).tolist()
    p = np.where(p <= NEAR_0, 0.0, np.where(p >= 1 - NEAR_0, 1.0, p))
    left, ids, following, at = len(undecided), [], 0, 0
    while left > max(2, leave):
        while len(ids) < 3:
            ids.append(undecided[following])
            following += 1
        x, y, z = (float(sizes[i]) for i in ids)
        way = (y - z, z - x, x - y)
        largest = max(map(abs, way))
        way = (1.0, -1.0, 0.0) if largest == 0 else tuple(w / largest for w in way)
        ahead = min((1 - p[i]) / w if w > 0 else p[i] / -w for i, w in zip(ids, way) if w)
        back = min(p[i] / w if w > 0 else (1 - p[i]) / -w for i, w in zip(ids, way) if w)
        step = ahead if draws[at] * (ahead + back) < back else -back
        at += 1
        moved = [min(1.0, max(0.0, p[i] + step * w)) for i, w in zip(ids, way)]
        if all(NEAR_0 < m < 1 - NEAR_0 for m in moved):  # rounding kept all inside: settle the nearest
            k = min(range(3), key=lambda k: min(moved[k], 1 - moved[k]))
            moved[k] = float(round(moved[k]))
        for i, m in zip(ids, moved):
            p[i] = 0.0 if m <= NEAR_0 else 1.0 if m >= 1 - NEAR_0 else m
        ids = [i for i in ids if 0 < p[i] < 1]
        left -= 3 - len(ids)
    return p


def land(sizes: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """Round the last ``LANDED`` so that the word total, then the document total, stays nearest."""
    p = probabilities.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        words = np.abs(choices @ sizes[open_] - (sizes[open_] * p[open_]).sum())
        count = np.abs(choices.sum(axis=1) - p[open_].sum())
        p[open_] = choices[np.lexsort((count, np.round(words, 6)))[0]]
    return p


def _fly_block(last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["h", "doc_key", "size"], kind="stable").reset_index(drop=True)
        draws = ((block["h"].to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / float(1 << 53)
        sizes = (block["size"] * block["n_rows"]).to_numpy(float)
        p = fly(sizes, block["p"].to_numpy(float), draws, LANDED if last else 2)
        block["p"] = land(sizes, p) if last else p
        return block

    return run


def mix_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, block: int = BLOCK,
) -> DataFrame:
    """Units ``doc_id, source, size, n_rows, source_size, target, copies`` with their copies."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    units = checkpointed(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows")))
    targets = source_targets(units.select("source", (F.col("size") * F.col("n_rows")).alias("size")))
    counts = units.groupBy("source").agg(F.count("*").alias("units"))
    per_source = checkpointed(
        targets.withColumnRenamed("source", "s")
        .join(counts.withColumnRenamed("source", "cs"), F.col("s").eqNullSafe(F.col("cs"))).drop("cs")
    )
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(mean + F.lit(NEAR_0))
    told = units.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    start = (
        told.withColumn("base", whole.cast("long"))
        .withColumn("p", F.greatest(mean - whole, F.lit(0.0)))
        .withColumn("doc_key", F.col("doc_id").cast("string"))
        .withColumn("h", F.xxhash64("doc_key", "size"))
        .drop("doc_id")
    )
    largest = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    schema = T.StructType([*start.schema.fields, T.StructField("block", T.LongType())])
    level, parts, done = start, max(1, -(-largest // block)), []
    while True:
        n_blocks = F.ceil(F.col("units") / block) if level is start else F.lit(parts)
        dealt = level.withColumn("block", F.pmod(F.xxhash64("h", F.lit(parts)), n_blocks))
        last = parts == 1
        flown = checkpointed(dealt.groupBy("source", "block").applyInPandas(_fly_block(last), schema)).drop("block")
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        if last:
            done.append(flown)
            break
        done.append(flown.filter(settled))
        level = flown.filter(~settled)
        parts = max(1, -(-2 * parts // block))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("doc_key").cast(docs.schema[id_col].dataType).alias("doc_id"), "source", "size", "n_rows", "source_size", "target",
        (F.col("base") + F.round("p").cast("long")).alias("copies"),
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, in the input's columns."""
    units = mix_units(docs, id_col, text_col, source_col, **options).filter("copies > 0").select(
        F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"), F.col("copies").alias("mix_copies")
    )
    sized = docs.withColumn("mix_words", word_count(text_col))
    same = (
        sized[id_col].eqNullSafe(units["mix_id"]) & sized[source_col].eqNullSafe(units["mix_source"])
        & (sized["mix_words"] == units["mix_size"])
    )
    repeats = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return sized.join(units.hint("shuffle_hash"), same).withColumn("mix_turn", repeats).select(*[sized[f"`{c}`"] for c in docs.columns])
