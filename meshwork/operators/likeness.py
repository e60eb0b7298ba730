"""Names that are nearly the same, by the block-matching ratio, without comparing all with all.

The ratio of two texts is twice the letters in matching blocks over the letters of both, so it is at
most twice the letters that both have, counted with repeats, over the same.  Letters are numbered by
their occurrence within a text, which makes sets of them.  Two texts whose sets share enough for a
ratio share one of the rarest few letters of each, and differ in length by a bounded factor.  So texts meet by
length and by these letters alone, then by what they share, and the ratio is taken of what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .common import by_distinct, checkpointed, few_or_merged
from .matching import similarity



#: Fixed value: a voltage in a title.
VOLTS = r"(?i)\b\d{2,3}(?:\s*[-/]\s*\d{1,3})?\s*kv\b"


def _letters(t: Column) -> Column:
    """The letters of a text, each with its number among equal ones: a set."""
    sorted_ = F.array_sort(F.split(t, ""))
    return F.transform(sorted_, lambda c, i: F.concat(c, (i - F.array_position(sorted_, c) + 1).cast("string")))


def _least_shared(n: Column, least: float) -> Column:
    """Letters that a text of n letters shares with any text that is so like it."""
    return F.ceil(F.lit(least) * n / (2 - least) - 1e-9)


def _prefixes(texts: DataFrame, rarity: DataFrame, least: float) -> DataFrame:
    """``id, text, block, n, letters, rare``: each of the rarest letters of which one must be shared."""
    spread = texts.select("id", "block", "n", F.explode("letters").alias("letter")).join(rarity, ["block", "letter"], "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "letter")))
    few = (F.col("n") - _least_shared(F.col("n"), least) + 1).cast("int")
    return spread.groupBy("id", "block", "n").agg(order.alias("o")).select("id", "block", "n", F.explode(F.transform(F.slice("o", F.lit(1), few), lambda x: x["letter"])).alias("rare"))


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``left, right, bound``: pairs of ids whose letters allow the ratio (``id, text, block``; only texts of one block meet), and its upper bound.

    Texts without letters, and null ones, are like nothing.
    """
    shape = lambda d: d.filter("text <> ''").select("id", "text", "block", F.length("text").alias("n")).withColumn("letters", _letters(F.col("text")))
    a, b = checkpointed(shape(left)), checkpointed(shape(right))
    rarity = b.select("block", F.explode("letters").alias("letter")).groupBy("block", "letter").agg(F.count("*").alias("many"))
    asks = _prefixes(a, rarity, least).withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * least / (2 - least) - 1e-9), F.floor(F.col("n") * (2 - least) / least + 1e-9))))
    asks = asks.select(F.col("id").alias("left"), "block", "rare", "m")
    held = _prefixes(b, rarity, least).select(F.col("id").alias("right"), "block", "rare", F.col("n").alias("m"))
    met = asks.hint("merge").join(held, ["block", "rare", "m"]).select("block", "left", "right").distinct()
    told = met.join(few_or_merged(a).select("block", F.col("id").alias("left"), F.col("letters").alias("x"), F.col("text").alias("a_text")), ["block", "left"])
    told = told.join(few_or_merged(b).select("block", F.col("id").alias("right"), F.col("letters").alias("y"), F.col("text").alias("b_text")), ["block", "right"])
    bound = 2 * F.size(F.array_intersect("x", "y")) / (F.size("x") + F.size("y"))
    return told.withColumn("bound", bound).filter(F.col("bound") >= least).select("left", "right", "a_text", "b_text", "bound")


def _texts(d: DataFrame, *first: Column) -> DataFrame:
    """Distinct texts of a block, each its own id."""
    named = F.struct("block", "text")
    told = d.filter("text <> ''").groupBy("block", "text")
    told = told.agg(*first) if first else told.agg(F.lit(1).alias("one")).drop("one")
    return told.withColumn("id", named)


def pairs_alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``left, right, ratio`` of all pairs whose ratio is at least so much.

    Equal texts of a block are compared once.
    """
    told = candidates(_texts(left), _texts(right), least).withColumn("ratio", similarity("a_text", "b_text"))
    told = told.filter(F.col("ratio") >= least).select(F.col("left").alias("__a"), F.col("right").alias("__b"), "ratio")
    side = lambda d, n, k: d.select(F.col("id").alias(n), F.struct("block", "text").alias(k)).distinct()
    return told.join(side(left, "left", "__a"), "__a").join(side(right, "right", "__b").hint("merge"), "__b").select("left", "right", "ratio")


def best_alike(left: DataFrame, right: DataFrame, least: float, order: str = "pos") -> DataFrame:
    """``left, right, ratio``: for each left text the right one of the greatest ratio, if that is at least so much; of equals the first
    by ``order``, a column of the right.

    Equal texts of a block are compared once, of the right ones the first stands for all.  The ratio of each text's
    most promising candidate comes first; of the others only those whose bound is not below it.
    """
    held = checkpointed(_texts(right, F.min(F.struct(F.col(order).alias("at"), F.col("id").alias("right"))).alias("first")))
    found = checkpointed(candidates(_texts(left), held.select("id", "text", "block"), least))
    top = found.groupBy("left").agg(F.max_by(F.struct("a_text", "b_text"), "bound").alias("t"), F.max("bound").alias("most"))
    floors = checkpointed(top.select("left", similarity("t.a_text", "t.b_text").alias("reached")))
    open_ = found.join(floors, "left").filter(F.col("bound") >= F.col("reached"))
    told = open_.withColumn("ratio", similarity("a_text", "b_text")).filter(F.col("ratio") >= least)
    ranked = told.join(held.select(F.col("id").alias("right"), "first"), "right")
    best = ranked.groupBy("left").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "first.at", "first.right")).alias("b"))
    asked = left.select(F.col("id").alias("__id"), F.struct("block", "text").alias("left")).join(few_or_merged(checkpointed(best)), "left")
    own = asked.groupBy("__id").agg(F.min("b").alias("b"))
    return own.select(F.col("__id").alias("left"), F.col("b.right").alias("right"), (-F.col("b.r")).alias("ratio"))


def title_alternatives(title: Column) -> Column:
    """A title and, where it names several works joined by "and", each of them."""
    parts = F.filter(F.split(title, r"\s+and\s+"), lambda p: p.rlike("[A-Za-z]{3}"))
    return F.when(F.size(parts) > 1, F.concat(F.array(title), parts)).otherwise(F.array(title))


#: The ratio at which a slide is of a list row, at which a project is still the one of a sample, and above which it is one on the list of dropped ones.
SAME_TITLE, SAME_PROJECT, DROPPED = 0.75, 0.8, 0.5


def own_slides(rows: DataFrame, slides: DataFrame) -> DataFrame:
    """``left, right, ratio``: the slide that describes each list row, by the title or one of its alternatives; one slide may describe
    several rows.  Both have ``id, title, block``, slides also ``pos``; titles are normalised without voltages and ordinals."""
    norm = lambda c: text.norm_name(F.regexp_replace(F.regexp_replace(c, VOLTS, " "), r"#\s*\d+", " "))
    every = lambda title: F.transform(title_alternatives(title), norm)
    told = by_distinct(slides, "title", "alts", every).select("id", "block", "pos", F.explode("alts").alias("text"))
    return best_alike(by_distinct(rows, "title", "text", norm).select("id", "block", "text"), told, SAME_TITLE)


def sample_status(sample: DataFrame, records: DataFrame, dropped: DataFrame) -> DataFrame:
    """``id, status, found``: what became of each project of a sample in its state's current list: still planned, dropped, or not listed.

    All have ``id, name, block``, records and dropped ones also ``pos``; a project is still planned if a record is as like as ``SAME_PROJECT``.
    """
    named = lambda d, *more: by_distinct(d, "name", "text", text.norm_name).select("id", "block", *more, "text")
    held = best_alike(named(sample), named(records, "pos"), SAME_PROJECT).select(F.col("left").alias("id"), F.col("right").alias("now"))
    gone = best_alike(named(sample), named(dropped, "pos"), DROPPED).filter(F.col("ratio") > DROPPED).select(F.col("left").alias("id"), F.col("right").alias("was"))
    told = sample.select("id").join(held, "id", "left").join(gone, "id", "left")
    status = F.when(F.col("now").isNotNull(), "still planned").when(F.col("was").isNotNull(), "dropped").otherwise("not listed")
    return told.select("id", status.alias("status"), F.coalesce("now", "was").alias("found"))
