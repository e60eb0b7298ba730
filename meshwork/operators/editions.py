"""Editions of plans: their order, the match of one edition with the next, and the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, text
from .common import checkpointed
from .matching import SAME_NAME, similarity
from .pairs import near_join


def edition_order(filings: DataFrame) -> DataFrame:
    """Adds ``seq``: filings oldest first.

    A plan's filings go by edition; plans are interleaved by date, and a late one delays its
    successors.  That merge orders by the latest date so far within the plan, ties by the
    plan's first place.  Filings are few; a plan's are ordered on their own first.
    """
    within = Window.partitionBy("plan").orderBy("edition", "fdate", "id")
    nth = filings.withColumn("nth", F.row_number().over(within)).withColumn("merge", F.max("fdate").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    first = Window.orderBy("edition", "fdate", "plan_ord")
    heads = nth.filter("nth = 1").withColumn("plan_at", F.row_number().over(first)).select("plan", "plan_at")
    merged = nth.join(F.broadcast(heads), "plan")
    return merged.withColumn("seq", F.row_number().over(Window.orderBy("merge", "plan_at", "nth")))


def edition_steps(ordered: DataFrame) -> DataFrame:
    """Each filing with the one before it in its plan, the closest one, and whether it is first or current."""
    w = Window.partitionBy("plan").orderBy("seq")
    return ordered.withColumn("previous", F.lag("id").over(w)).withColumn("closest", F.coalesce("previous", F.lead("id").over(w))).withColumn(
        "is_baseline", F.row_number().over(w) == 1
    ).withColumn("is_current", F.lead("id").over(w).isNull())


def snapshots(ordered: DataFrame) -> DataFrame:
    """For each filing, every plan's latest filing up to it: an as-of join by range of seq."""
    until = F.coalesce(F.lead("seq").over(Window.partitionBy("plan").orderBy("seq")), F.lit(1 << 40))
    spans = ordered.withColumn("until", until).select(F.col("plan").alias("other_plan"), F.col("id").alias("latest"), F.col("seq").alias("start"), "until")
    return ordered.select("id", "seq").join(F.broadcast(spans), (F.col("seq") >= F.col("start")) & (F.col("seq") < F.col("until"))).select("id", "other_plan", "latest")


def match_unique(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of one step and its predecessor, matched by a key that is unique within an edition."""
    names = ["name", "isd", "cost_cents", "lat", "lon", "state"]
    o = old.select("step", "rkey", F.struct(*names).alias("o"))
    n = new.select("step", "rkey", F.struct(*names).alias("n"))
    return o.join(n, ["step", "rkey"], "full_outer")


def project_changes(matched: DataFrame) -> DataFrame:
    """Added, removed and changed projects; what changed, days moved and cost."""
    differs = lambda c: ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    # Ids that are unique match on the id alone; a name only counts as changed if it is quite another.  Only
    # records on both sides whose normalised names differ go through Python for their ratio.
    names = checkpointed(matched.withColumns({"o_norm": text.norm_name(F.col("o.name")), "n_norm": text.norm_name(F.col("n.name"))}))
    unlike = both & ~F.col("o_norm").eqNullSafe(F.col("n_norm"))
    matched = names.filter(~unlike).withColumn("ratio", F.lit(1.0)).unionByName(names.filter(unlike).withColumn("ratio", similarity("o_norm", "n_norm")))
    renamed = differs("name") & (F.col("ratio") < SAME_NAME)
    cost = (F.coalesce(F.col("o.cost_cents"), F.lit(0)) != 0) & (F.coalesce(F.col("n.cost_cents"), F.lit(0)) != 0) & differs("cost_cents")
    what = F.array_compact(F.array(F.when(renamed, "name"), F.when(differs("isd"), "date"), F.when(cost, "cost")))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    told = matched.select(
        "step", "rkey", kind.alias("kind"), F.when(both, what).otherwise(F.array().cast("array<string>")).alias("what"),
        F.when(both, F.datediff("n.isd", "o.isd")).alias("days"), F.when(both & cost, F.col("o.cost_cents")).alias("old_cost"), F.when(both & cost, F.col("n.cost_cents")).alias("cost"),
    )
    return told.filter((F.col("kind") != "changed") | (F.size("what") > 0))


def change_counts(changes: DataFrame) -> DataFrame:
    """Counts of a step by kind; one change may count in several."""
    has = lambda w: F.count_if((F.col("kind") == "changed") & F.array_contains("what", w))
    return changes.groupBy("step").agg(
        F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"),
        has("date").alias("rescheduled"), has("name").alias("renamed"), has("cost").alias("recosted"),
    )


def qualifying_pairs(records: DataFrame, cutoff: float = 25.0) -> DataFrame:
    """Pairs of a snapshot's records of different plans and states within the cutoff.

    ``records`` has snap, plan_ord, state, rkey, isd, lat, lon; a snapshot meets only itself.
    """
    slim = records.filter("lat IS NOT NULL AND lon IS NOT NULL").select(F.struct("snap", "plan_ord", "state", "rkey", "isd", "lat", "lon").alias("p"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    met = near_join(slim.select(F.col("p").alias("a")), slim.select(F.col("p").alias("b")), cutoff, same=("snap",))
    ok = (a("plan_ord") < b("plan_ord")) & (a("state") != b("state"))
    found = met.filter(ok).withColumn("miles", geo.haversine(a("lat"), a("lon"), b("lat"), b("lon"))).filter(F.col("miles") < cutoff)
    return found.select(a("snap").alias("snap"), a("plan_ord").alias("a_plan"), a("rkey").alias("a_key"), b("plan_ord").alias("b_plan"), b("rkey").alias("b_key"), "miles", F.abs(F.datediff(a("isd"), b("isd"))).alias("gap"))


def pair_changes(before: DataFrame, after: DataFrame, moved: int = 30) -> DataFrame:
    """New and gone pairs, and those whose gap moved by at least so many days."""
    key = ["snap", "a_plan", "a_key", "b_plan", "b_key"]
    q = before.select(*key, F.struct("miles", "gap").alias("q"))
    p = after.select(*key, F.struct("miles", "gap").alias("p"))
    shift = F.abs(F.col("p.gap") - F.col("q.gap"))
    kind = F.when(F.col("q").isNull(), "new").when(F.col("p").isNull(), "gone").when(shift >= moved, "timing")
    joined = q.join(p, key, "full_outer").withColumn("kind", kind).filter("kind IS NOT NULL")
    return joined.select(*key, "kind", F.round(F.coalesce("p.miles", "q.miles"), 2).alias("miles"), F.coalesce("p.gap", "q.gap").alias("gap"), F.when(F.col("kind") == "timing", F.col("q.gap")).alias("old_gap"))


def edition_shape(records: DataFrame) -> DataFrame:
    """Records, dated ones, and the upper median length of names, per filing."""
    counts = records.groupBy("filing").agg(F.count("*").alias("records"), F.count("isd").alias("dated"), F.count_if(F.col("rkey") != "").alias("with_id"))
    # The median from how many names there are of each length: few rows a filing, however many records.
    lengths = records.groupBy("filing", F.length("name").alias("length")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("filing").orderBy(F.col("length").asc_nulls_first()))
    reached = lengths.withColumn("upto", upto).join(counts.select("filing", "records"), "filing").filter(F.col("upto") > F.floor(F.col("records") / 2))
    medians = reached.groupBy("filing").agg(F.min_by("length", "upto").alias("name_length"))
    return counts.join(medians, "filing").select("filing", "records", "dated", "with_id", "name_length")


def shape_drift(shapes: DataFrame, steps: DataFrame) -> DataFrame:
    """Rules that an edition breaks against the one before it."""
    now = shapes.select(*[F.col(c).alias(f"n_{c}") for c in shapes.columns])
    old = shapes.select(*[F.col(c).alias(f"o_{c}") for c in shapes.columns])
    both = steps.filter("previous IS NOT NULL").join(now, F.col("id") == F.col("n_filing")).join(old, F.col("previous") == F.col("o_filing"))
    count = (F.col("n_records") * 2 < F.col("o_records")) | (F.col("n_records") > 2 * F.col("o_records"))
    dated = F.col("n_dated") * F.col("o_records") * 2 < F.col("o_dated") * F.col("n_records")
    names = (F.col("n_name_length") > 2 * F.col("o_name_length")) & (F.col("n_name_length") > F.col("o_name_length") + 20)
    return both.select("id", count.alias("count_drift"), dated.alias("date_drift"), names.alias("name_drift"))
