"""Order-dependent matching and free-form text: grouped Arrow functions, and the rules around them."""

from __future__ import annotations

import difflib
import functools
import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import text
from .common import checkpointed

#: Thresholds tuned to the block-matching ratio.
SAME_NAME, GREEDY = 0.5, 0.8
#: Rows that a grouped function gives back at once.
ROWS_OUT = 10_000


def by_sorted_groups(rows: DataFrame, keys: int, order: tuple[str, ...], rule: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What a rule makes of each group of rows that agree in their first ``keys`` columns, given the key and the other columns' values
    in order.

    Groups follow one another in sorted partitions and are read as a stream: a task holds one at a time, and small ones, of
    which there may be millions, cost no more than their rows.
    """
    names = rows.columns
    kinds = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(schema)])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for key, group in itertools.groupby(stream(batches), lambda r: r[:keys]):
            made.extend(rule(key, [r[keys:] for r in group]))
            if len(made) >= ROWS_OUT:
                yield _batch(made, kinds)
                made = []
        if made:
            yield _batch(made, kinds)

    # Dealt by a hash of the keys, as Spark drops an exchange by the keys themselves above a join by them, which it then may change
    # while it runs; and into as many partitions as are set: joined by size, a few tasks would get all of the rule's work.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, F.xxhash64(*names[:keys])).sortWithinPartitions(*names[:keys], *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Block-matching ratio of two normalised names."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def take_in_turn(ratios: np.ndarray, least: float) -> np.ndarray:
    """For each row in turn the free column of its greatest value (the first of equals), or -1 if that is below ``least``."""
    chosen, open_ = np.full(len(ratios), -1), np.array(ratios, float)
    for row in range(len(ratios) if ratios.size else 0):
        column = int(open_[row].argmax())
        if open_[row, column] >= least:
            chosen[row] = column
            open_[:, column] = -1.0
    return chosen


def match_editions(old: DataFrame, new: DataFrame, reuses_ids: bool) -> DataFrame:
    """``step, rkey, old_pos, new_pos, how`` for editions whose keys may repeat.

    Within a key, new records in print order take the most alike unused old one; where a plan
    reuses ids the names must agree.  A single leftover is a rename.  Keys never meet, so every
    (step, key) is a group of its own; a group holds one key's records of two editions.
    """
    key = F.ltrim(F.col("rkey"), F.lit("0")) if reuses_ids else F.col("rkey")
    named = lambda d, side: d.select("step", key.alias("k"), "rkey", F.col("pos").alias("pos"), text.norm_name(F.col("name")).alias("norm"), F.lit(side).alias("side"))

    least = SAME_NAME if reuses_ids else 0.0

    def match(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        olds, news = ([r for r in rows if r[0] == side] for side in ("old", "new"))
        alike = difflib.SequenceMatcher(None)
        ratios = np.zeros((len(news), len(olds)))
        for i, (_, _, norm, _) in enumerate(news):
            alike.set_seq2(norm or "")
            for j, (_, _, other, _) in enumerate(olds):
                if norm != other:
                    alike.set_seq1(other or "")
                ratios[i, j] = 1.0 if norm == other else alike.ratio()
        chosen = take_in_turn(ratios, least)
        free = set(range(len(olds))) - set(chosen.tolist())
        how = ["same" if c >= 0 else "added" for c in chosen]
        if reuses_ids and len(olds) == 1 and free and news:
            chosen[0], how[0] = 0, "renamed"  # the only one of its key, under another name
            free = set()
        for (_, pos, _, rkey), c, told in zip(news, chosen.tolist(), how):
            yield key[0], rkey, olds[c][1] if c >= 0 else None, pos, told
        for j in sorted(free):
            yield key[0], olds[j][3], olds[j][1], None, "removed"

    out = "step string, rkey string, old_pos long, new_pos long, how string"
    both = named(old, "old").unionByName(named(new, "new"))
    sides = both.groupBy("step", "k").agg(F.count_if(F.col("side") == "old").alias("n_old"), F.count_if(F.col("side") == "new").alias("n_new"))
    # Keys printed once on either side need no order: only the others go through Python, key by key.
    told = both.join(sides, ["step", "k"])
    many = (F.col("n_old") > 1) | (F.col("n_new") > 1)

    grouped = by_sorted_groups(told.filter(many).select("step", "k", "side", "pos", "norm", "rkey"), 2, ("pos",), match, out)
    once = told.filter(~many)
    o = once.filter("side = 'old'").select("step", "k", F.col("rkey").alias("o_key"), F.col("pos").alias("old_pos"), F.col("norm").alias("o_norm"))
    n = once.filter("side = 'new'").select("step", "k", F.col("rkey").alias("n_key"), F.col("pos").alias("new_pos"), F.col("norm").alias("n_norm"))
    met = o.join(n, ["step", "k"], "full_outer")
    if reuses_ids:  # only names on both sides that differ go through Python for their ratio
        met = checkpointed(met)
        unlike = F.col("old_pos").isNotNull() & F.col("new_pos").isNotNull() & ~F.col("o_norm").eqNullSafe(F.col("n_norm"))
        met = met.filter(~unlike).withColumn("alike", F.lit(True)).unionByName(met.filter(unlike).withColumn("alike", similarity("o_norm", "n_norm") >= SAME_NAME))
    else:
        met = met.withColumn("alike", F.lit(True))
    how = F.when(F.col("old_pos").isNull(), "added").when(F.col("new_pos").isNull(), "removed").when(F.col("alike"), "same").otherwise("renamed")
    single = met.select("step", F.coalesce("n_key", "o_key").alias("rkey"), F.col("old_pos").cast("long").alias("old_pos"), F.col("new_pos").cast("long").alias("new_pos"), how.alias("how"))
    return single.unionByName(grouped)


def lineage(records: DataFrame, rounds: list[dict[str, str | None]], reuses_ids: bool) -> DataFrame:
    """``filing, pos, lineage``: plans' editions in order; a match keeps its lineage.

    A new record is named by state, key and name; repeats take the next free ordinal in print order.
    A round holds one edition of each plan, with the one before it; the loop is over the few editions
    of a plan, and each round is one distributed match of all plans.
    """
    spark, done = records.sparkSession, []
    fresh = F.concat_ws(":", "state", "rkey", text.norm_name(F.col("name")))
    previous: DataFrame | None = None
    for filings in rounds:
        mine = records.filter(F.col("filing").isin(list(filings))).withColumn("fresh", fresh)
        if previous is None:
            told = mine.withColumn("kept", F.lit(None).cast("string"))
        else:
            follows = F.broadcast(spark.createDataFrame([(p, f) for f, p in filings.items() if p], "filing string, step string"))
            old = previous.join(follows, "filing").withColumnRenamed("pos", "old_pos")
            pairs = match_editions(old.withColumnRenamed("old_pos", "pos"), mine.withColumn("step", F.col("filing")), reuses_ids).filter("new_pos IS NOT NULL")
            kept = pairs.join(old.select("step", "old_pos", F.col("lineage").alias("kept")), ["step", "old_pos"])
            told = mine.join(kept.select(F.col("step").alias("filing"), F.col("new_pos").alias("pos"), "kept"), ["filing", "pos"], "left")
        previous = _with_free_ordinals(told.select("filing", "pos", "rkey", "name", "state", "fresh", "kept"))
        done.append(previous.select("filing", "pos", "lineage"))
    return functools.reduce(DataFrame.unionByName, done)


def _with_free_ordinals(records: DataFrame) -> DataFrame:
    """Adds ``lineage``: the one ``kept``, or else ``fresh`` itself, ``fresh:2``, ``fresh:3``, ...,
    the first of these that no record of the edition carries, in print order."""
    named = checkpointed(records)
    taken = named.filter("kept IS NOT NULL").select("filing", F.col("kept").alias("lineage")).distinct()
    news = named.filter("kept IS NULL").withColumn("nth", F.row_number().over(Window.partitionBy("filing", "fresh").orderBy("pos")))
    # As many candidates as could be needed: one for each new record and for each taken name that begins like it.
    base = F.regexp_replace("lineage", r":\d+$", "")
    used = taken.select("filing", F.explode(F.array_distinct(F.array("lineage", base))).alias("fresh")).groupBy("filing", "fresh").agg(F.count("*").alias("used"))
    wanted = news.groupBy("filing", "fresh").agg(F.count("*").alias("many")).join(used, ["filing", "fresh"], "left")
    ordinals = wanted.select("filing", "fresh", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many") + F.coalesce("used", F.lit(0)))).alias("ordinal"))
    names = ordinals.withColumn("lineage", F.when(F.col("ordinal") == 1, F.col("fresh")).otherwise(F.concat_ws(":", "fresh", "ordinal")))
    free = names.join(taken, ["filing", "lineage"], "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy("filing", "fresh").orderBy("ordinal")))
    told = news.join(free.select("filing", "fresh", "nth", "lineage"), ["filing", "fresh", "nth"]).drop("nth")
    return checkpointed(told.unionByName(named.filter("kept IS NOT NULL").withColumn("lineage", F.col("kept"))))


def greedy_matches(lefts: DataFrame, rights: DataFrame, group: str) -> DataFrame:
    """One-to-one pairs of a group, most alike first (ties by left, then right place), down to the threshold.

    ``lefts`` and ``rights`` have the group, pos and norm; a group is one document's entries.  Equal
    names are the most alike, so they are paired by a join, in order; only what is left of a group is
    compared, and only where lengths and letters allow the threshold.
    """
    nth = F.row_number().over(Window.partitionBy(group, "norm").orderBy("pos"))
    left, right = (d.select(group, "pos", "norm").withColumn("nth", nth) for d in (lefts, rights))
    keys = [group, "norm", "nth"]
    equal = left.withColumnRenamed("pos", "l").join(right.withColumnRenamed("pos", "r"), keys).select(group, "l", "r", F.lit(1.0).alias("ratio"))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        sides = [block[block.side == s].sort_values("pos") for s in ("l", "r")]
        alike = difflib.SequenceMatcher(None)
        scored = []
        for j, b in zip(sides[1].pos, sides[1].norm):
            alike.set_seq2(b)
            for i, a in zip(sides[0].pos, sides[0].norm):
                alike.set_seq1(a)
                if alike.real_quick_ratio() >= GREEDY and alike.quick_ratio() >= GREEDY and (ratio := alike.ratio()) >= GREEDY:
                    scored.append((-ratio, int(i), int(j)))
        taken: dict[str, set[int]] = {"l": set(), "r": set()}
        out = []
        for ratio, i, j in sorted(scored):
            if i not in taken["l"] and j not in taken["r"]:
                taken["l"].add(i)
                taken["r"].add(j)
                out.append((block[group].iloc[0], i, j, -ratio))
        return pd.DataFrame(out, columns=[group, "l", "r", "ratio"])

    kind = lefts.schema[group].dataType.simpleString()
    rest = left.join(right.select(keys), keys, "left_anti").withColumn("side", F.lit("l")).unionByName(right.join(left.select(keys), keys, "left_anti").withColumn("side", F.lit("r")))
    return equal.unionByName(rest.drop("nth").groupBy(group).applyInPandas(run, f"`{group}` {kind}, l long, r long, ratio double"))


def leader_clusters(points: DataFrame, group: str, within: float = 1.0) -> DataFrame:
    """``group, pos, leader``: each point joins the first leader within so many miles, in order."""

    def miles(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 3958.8 * math.asin(math.sqrt(x))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple[int, tuple[float, float]]] = []
        out = []
        for pos, lat, lon in block.sort_values("pos")[["pos", "lat", "lon"]].itertuples(index=False):
            here = next((p for p, at in leaders if miles(at, (lat, lon)) <= within), None)
            if here is None:
                leaders.append((int(pos), (lat, lon)))
                here = int(pos)
            out.append((block[group].iloc[0], int(pos), here))
        return pd.DataFrame(out, columns=[group, "pos", "leader"])

    kind = points.schema[group].dataType.simpleString()
    return points.select(group, "pos", "lat", "lon").groupBy(group).applyInPandas(run, f"`{group}` {kind}, pos long, leader long")


class _Phases:
    """A largest one-to-one matching by phases: all shortest ways to a free right node are counted
    off in layers, and as many as have no node in common are swapped before the next count."""

    def __init__(self, pairs: Iterable[tuple[int, int]]) -> None:
        self.near: dict[int, list[int]] = {}
        for left, right in sorted(set(pairs)):
            self.near.setdefault(left, []).append(right)
        self.right_of: dict[int, int] = {}
        self.left_of: dict[int, int] = {}
        while self._swap_all(self._layers()):
            pass

    def _layers(self) -> dict[int, int]:
        """Layer of each left node that a free one reaches; stops at the first layer next to a free right node."""
        depth = {left: 0 for left in self.near if left not in self.right_of}
        edge = list(depth)
        while edge:
            behind = {self.left_of.get(right) for left in edge for right in self.near[left]}
            if None in behind:
                return depth
            edge = sorted(behind - depth.keys())
            depth |= dict.fromkeys(edge, depth[max(depth, key=depth.get)] + 1)
        return {}

    def _swap_all(self, depth: dict[int, int]) -> bool:
        options = {left: iter(self.near[left]) for left in depth}
        return any([self._swap(left, depth, options) for left in depth if depth[left] == 0])

    def _swap(self, left: int, depth: dict[int, int], options: dict) -> bool:
        way = [left]  # the right node that each of these tries is the last one its options gave
        tried: list[int] = []
        while way:
            right = next(options[way[-1]], None)
            if right is None:
                way.pop()
                tried = tried[: len(way) - 1] if way else []
            elif right not in self.left_of:
                for a, b in zip(way, [*tried, right]):
                    self.right_of[a], self.left_of[b] = b, a
                return True
            elif depth.get(self.left_of[right]) == depth[way[-1]] + 1:
                way.append(self.left_of[right])
                tried.append(right)
        return False


def maximum_matching(edges: DataFrame, group: str) -> DataFrame:
    """``group, l, r`` of a largest one-to-one matching of each group's edges."""

    def match(key: tuple, edges: list[tuple]) -> Iterator[tuple]:
        return ((*key, a, b) for a, b in sorted(_Phases(edges).right_of.items()))

    kind = edges.schema[group].dataType.simpleString()
    return by_sorted_groups(edges.select(group, F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r")), 1, ("l", "r"), match, f"`{group}` {kind}, l long, r long")
