"""Rules over records: ground flags, reasons, items of the change log, location cascade, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from .common import checkpointed
from .pairs import near_join

#: Radius in miles and confidence of a location by the method that found it.
METHODS = {"manual": (0.5, "high"), "reference": (0.5, "high"), "osm-exact": (0.5, "high"), "osm-partial": (1.5, "medium"), "town": (6.0, "low")}
#: Miles beyond which a reference or a peer is another place, and the most combinations looked at.
FAR, COMBINATIONS = 80.0, 5000
#: Share of dated records, of the checked count, and drop of the dated share that an edition may show.
MIN_DATED, MIN_COUNT, MAX_DROP = 0.5, 0.5, 0.25


def project_ground(checked: DataFrame, hits: DataFrame) -> DataFrame:
    """``key, ground``: whether a project was checked, lies in a flood area, and the labels of the
    habitats and protected areas it meets; ``hits`` has ``key, kind, label``."""
    labels = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("label"))))
    met = hits.groupBy("key").agg(F.max(F.col("kind") == "flood").alias("flood"), labels("habitat").alias("habitat"), labels("protected").alias("protected"))
    none = F.array().cast("array<string>")
    told = checked.join(met, "key", "left")
    held = lambda c, empty: F.when(F.col("checked"), F.coalesce(F.col(c), empty)).otherwise(empty).alias(c)
    return told.select("key", F.struct("checked", held("flood", F.lit(False)), held("habitat", none), held("protected", none)).alias("ground"))


def pair_ground(a: Column, b: Column) -> Column:
    """What either side of a pair shows."""
    union = lambda c: F.array_union(a[c], b[c]).alias(c)
    return F.struct((a["checked"] | b["checked"]).alias("checked"), (a["flood"] | b["flood"]).alias("flood"), union("habitat"), union("protected"))


def removal_reasons(removed: DataFrame, printed: DataFrame, filings: DataFrame) -> DataFrame:
    """``step, rkey, reason`` of removed records ``step, rkey, isd``: the new filing's own list of
    dropped projects (``printed``: step, rkey, status), else whether the date had passed."""
    lists = printed.select("step", F.lit(True).alias("prints")).distinct()
    told = removed.join(printed, ["step", "rkey"], "left").join(lists, "step", "left").join(F.broadcast(filings.select(F.col("id").alias("step"), "fdate")), "step")
    in_table = F.concat(F.initcap("status"), F.lit(": listed in Table "), F.when(F.col("status") == "cancelled", "3").otherwise("4"), F.lit(" of the new plan"))
    passed = F.concat(
        F.lit("No longer listed. Its in-service date ("), F.col("isd").cast("string"), F.lit(") was before the new list came out; the list doesn't say whether it was finished or dropped.")
    )
    reason = F.when(F.col("status").isNotNull(), in_table).when(F.col("prints").isNull() & (F.col("isd") < F.col("fdate")), passed)
    return told.select("step", "rkey", F.coalesce(reason, F.lit("No longer listed; the filing doesn't say why.")).alias("reason"))


def kept_locations(records: DataFrame, steps: DataFrame) -> DataFrame:
    """Each record with the place of the same one in the edition before, or none: it is located afresh."""
    before = records.select(F.col("filing").alias("previous"), "rkey", F.col("lat").alias("old_lat"), F.col("lon").alias("old_lon")).filter("old_lat IS NOT NULL")
    told = records.join(F.broadcast(steps.select(F.col("id").alias("filing"), "previous")), "filing").join(before, ["previous", "rkey"], "left")
    origin = F.when(F.col("old_lat").isNotNull(), "kept").otherwise("afresh")
    return told.select("filing", "rkey", F.col("old_lat").alias("lat"), F.col("old_lon").alias("lon"), origin.alias("origin"))


def items_of(changes: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Items of the change log of any of the kinds; all, if none are named."""
    item = F.when(F.size("what") > 0, F.col("what")).otherwise(F.array("kind"))
    told = changes.withColumn("kinds", item)
    return told if kinds is None else told.filter(F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in kinds])))


def filing_entries(filings: DataFrame) -> DataFrame:
    """Filings, the newest first: by date, then by id, both descending; no date counts as the empty text."""
    order = Window.orderBy(F.coalesce(F.col("fdate").cast("string"), F.lit("")).desc(), F.desc("id"))
    return filings.withColumn("entry", F.row_number().over(order).cast("long"))


def plan_dimension(declared: DataFrame, projects: DataFrame) -> DataFrame:
    """Declared plans in their order, then those seen on projects alone, by first project."""
    seen = projects.groupBy("plan").agg(F.min("ord").alias("first")).join(declared, "plan", "left_anti")
    both = declared.select("plan", F.lit(0).alias("late"), F.col("at").cast("long").alias("first")).unionByName(seen.select("plan", F.lit(1).alias("late"), F.col("first").cast("long").alias("first")))
    return both.select("plan", F.row_number().over(Window.orderBy("late", "first")).cast("long").alias("at"))


def current_editions(plans: DataFrame, filings: DataFrame) -> DataFrame:
    """``plan, edition``: of the filing at the plan's own address, else of the newest one (the later
    of equal dates), else the years in the plan's title."""
    ranked = filings.join(plans.select("plan", F.col("url").alias("own"), "title"), "plan", "right")
    at_url = F.max_by("edition", F.struct(F.when(F.col("url") == F.col("own"), 1).otherwise(0).alias("own"), F.col("fdate").alias("d"), F.col("pos").alias("p")))
    years = F.nullif(F.regexp_extract("title", r"\d{4}\s*[-–]\s*\d{4}", 0), F.lit(""))
    told = ranked.groupBy("plan", "title").agg(at_url.alias("edition"))
    return told.select("plan", F.regexp_replace(F.coalesce(F.col("edition").cast("string"), years), r"\s*[-–]\s*", "–").alias("edition"))


def located_endpoints(endpoints: DataFrame, overrides: DataFrame, references: DataFrame, places: DataFrame, towns: DataFrame) -> DataFrame:
    """The trust cascade: an override of the endpoint, else a reference point of its name that is not
    far from the project's own place, else a named place (its ``method`` says whether the whole
    name or a part matched), else the town.

    ``endpoints`` has ``id, pos, name, a_lat, a_lon, mismatch``; the others have ``lat, lon`` and their
    key, overrides may have ``confidence`` and ``radius_mi`` of their own.  Where the owner is
    another (``mismatch``), a reference or a named place is of medium confidence at most and of
    a wider radius; an override and a town are as they are.  An endpoint without any place has
    confidence "none" and no radius.
    """
    own = lambda d, c, kind: F.col(c).cast(kind) if c in d.columns else F.lit(None).cast(kind)
    at = lambda d, keys, name, method: d.select(
        *keys, F.struct(F.col("lat"), F.col("lon"), method.alias("method"), own(d, "confidence", "string").alias("confidence"), own(d, "radius_mi", "double").alias("radius")).alias(name)
    )
    told = (
        endpoints.join(at(overrides, ["id", "pos"], "manual", F.lit("manual")), ["id", "pos"], "left").join(at(references, ["name"], "reference", F.lit("reference")), "name", "left")
        .join(at(places, ["name"], "place", F.col("method") if "method" in places.columns else F.lit("osm-exact")), "name", "left").join(at(towns, ["id"], "town", F.lit("town")), "id", "left")
    )
    off = geo.haversine_asin(F.col("reference.lat"), F.col("reference.lon"), F.col("a_lat"), F.col("a_lon"))
    near = F.when(F.col("a_lat").isNull() | (off <= FAR), F.col("reference"))
    told = told.withColumn("at", F.coalesce("manual", near, "place", "town"))
    method = F.col("at.method")
    by = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for m, v in METHODS.items() for x in (m, v[i])]), method)
    confidence, radius = F.coalesce("at.confidence", by(1)), F.coalesce("at.radius", by(0))
    doubted = F.coalesce(F.col("mismatch") & method.isin("reference", "osm-exact", "osm-partial"), F.lit(False))
    return told.select(
        "id", "pos", method.alias("method"), F.when(method.isNull(), "none").when(doubted & (confidence == "high"), "medium").otherwise(confidence).alias("confidence"),
        F.when(doubted, F.greatest(radius, F.lit(METHODS["osm-partial"][0]))).otherwise(radius).alias("radius_mi"), F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"),
    )


def _joint_choice(candidates: DataFrame, anchors: DataFrame | None) -> DataFrame:
    """``id, b``: the best combination as a struct of ``c0, c1, c2`` (pos, choice, lat, lon; null where there is no such endpoint) and ``cost``.

    A combination's number follows from those of its parts, so only the first ``COMBINATIONS`` of a
    project are made, whatever the number of candidates: a part is joined only while a number in reach is left.
    """
    point = F.struct("pos", "choice", "lat", "lon")
    first = candidates.groupBy("id").agg(F.min("pos").alias("p0"), F.max("pos").alias("p2"), F.count_distinct("pos").alias("endpoints"))
    if wide := first.filter("endpoints > 3").first():
        raise ValueError(f"project {wide['id']} has {wide['endpoints']} endpoints, three are looked at")
    turn = F.when(F.col("pos") == F.col("p0"), 0).when(F.col("pos") == F.col("p2"), 2).otherwise(1)
    told = candidates.join(first, "id").withColumn("turn", turn)
    told = told.withColumn("i", F.row_number().over(Window.partitionBy("id", "turn").orderBy("choice")).cast("long") - 1)
    many = lambda t: F.greatest(F.count_if(F.col("turn") == t), F.lit(1))
    sizes = told.groupBy("id").agg(many(1).alias("n1"), many(2).alias("n2"))
    side = lambda t: told.filter(F.col("turn") == t).select(F.col("id").alias(f"id{t}"), point.alias(f"c{t}"), F.col("i").alias(f"i{t}"))
    combos = sizes.join(side(0), F.col("id") == F.col("id0")).withColumn("nth", F.col("i0") * F.col("n1") * F.col("n2")).filter(F.col("nth") < COMBINATIONS)
    for t, unit in ((1, F.col("n2")), (2, F.lit(1))):
        at = F.col("nth") + F.col(f"i{t}") * unit
        combos = combos.join(side(t), (F.col("id") == F.col(f"id{t}")) & (at < COMBINATIONS), "left").withColumn("nth", F.coalesce(at, F.col("nth")))
    if anchors is not None:
        combos = combos.join(anchors.select("id", F.struct("lat", "lon").alias("anchor")), "id", "left")
    between = lambda a, b: F.coalesce(geo.haversine_asin(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon")), F.lit(0.0))
    to_anchor = between("c0", "anchor") + between("c1", "anchor") + between("c2", "anchor") if anchors is not None else F.lit(0.0)
    cost = between("c0", "c1") + between("c0", "c2") + between("c1", "c2") + to_anchor
    numbered = combos.withColumn("cost", cost)
    return numbered.groupBy("id").agg(F.min_by(F.struct("c0", "c1", "c2", "cost"), F.struct(F.round("cost", 9).alias("cost"), "nth")).alias("b"))


def best_combination(candidates: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Joint choice among the candidate places of a project's endpoints (three at most, more raise an error): the
    combination of the least sum of miles between all, and from all to the project's anchor
    (``id, lat, lon``) where it has one; the first of equals.

    ``candidates`` has ``id, pos, choice, lat, lon``; combinations beyond ``COMBINATIONS``, in the
    order of the choices, are not looked at.
    """
    best = _joint_choice(candidates, anchors)
    return best.select("id", *[F.col(f"b.c{t}.choice").alias(f"choice{t}") for t in range(3)], F.round("b.cost", 6).alias("cost"))


def chosen_places(candidates: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """``id, pos, choice``: what ``best_combination`` takes for each endpoint that has candidates."""
    parts = F.explode(F.array_compact(F.array("b.c0", "b.c1", "b.c2"))).alias("c")
    return _joint_choice(candidates, anchors).select("id", parts).select("id", "c.pos", "c.choice")


def reference_points(points: DataFrame, order: str = "ord") -> DataFrame:
    """``key, lat, lon, issues``: the first point of each key; others far from it are issues."""
    w = Window.partitionBy("key").orderBy(order)
    told = points.withColumns({"lat0": F.first("lat").over(w), "lon0": F.first("lon").over(w)})
    off = geo.haversine_asin(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")) > 0.05
    return told.groupBy("key").agg(F.max("lat0").alias("lat"), F.max("lon0").alias("lon"), F.count_if(off).alias("issues"))


def cost_agreement(total: Column, printed: Column, unit: Column, own_unit: Column) -> Column:
    """The unit in which a total agrees with the amount as printed, within half a percent and a
    dollar; null if none does.  An amount with its own unit is in dollars once read."""
    used = F.when(own_unit, F.lit(1.0)).otherwise(unit)
    return F.when(F.abs(total - printed * used) <= 0.005 * printed * used + 1, used)


def amounts_agree(sum_of: Column, total: Column) -> Column:
    """Whether yearly amounts add up to the total, within half a percent and a dollar."""
    return F.abs(sum_of - total) <= 0.005 * F.abs(total) + 1


def accepted(shapes: DataFrame, checked: DataFrame) -> DataFrame:
    """Why an edition's records are not accepted, if they are not; ``checked`` has the numbers of the
    edition a plan's parser was checked on, which bind only later ones."""
    told = shapes.join(checked, "plan", "left")
    later = F.col("edition") > F.col("c_edition")
    why = F.array_compact(F.array(
        F.when(F.col("records") == 0, "no records"), F.when(F.col("dated") < MIN_DATED * F.col("records"), "few dates"),
        F.when(later & (F.col("records") < MIN_COUNT * F.col("c_records")), "few records"),
        F.when(later & (F.col("dated") / F.col("records") < F.col("c_dated") / F.col("c_records") - MAX_DROP), "fewer dates"),
    ))
    return told.select("filing", (F.size(why) == 0).alias("accepted"), F.array_join(why, "; ").alias("why"))


def nearest_of_places(a: DataFrame, b: DataFrame, reach: float, most: int = 10) -> DataFrame:
    """``a_id, b_id, miles`` below ``reach`` of rows ``id, lat, lon`` (an id lies at one place): those that may be among the first ``most`` by
    miles to one place, a_id and b_id.

    Places are met once, however many projects lie there.  Two places give no pair of a later id before ``most`` of earlier ones, and are
    themselves behind if the first pairs of so many other places are before theirs.
    """

    def places(rows: DataFrame, side: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("id"))
        kept = rows.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).withColumn("nth", nth).filter(F.col("nth") <= most)
        return checkpointed(kept.groupBy("lat", "lon").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.struct("lat", "lon", "ids").alias(side)))

    far = geo.haversine_asin(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    met = near_join(places(a, "a"), places(b, "b"), reach).select(F.col("a.ids").alias("a_ids"), F.col("b.ids").alias("b_ids"), far.alias("miles")).filter(F.col("miles") < reach)
    met = met.orderBy(F.round("miles", 1), F.col("a_ids")[0], F.col("b_ids")[0]).limit(most)
    return met.select(F.explode("a_ids").alias("a_id"), "b_ids", "miles").select("a_id", F.explode("b_ids").alias("b_id"), "miles")


def nearest_report(pairs: DataFrame, most: int = 10) -> DataFrame:
    """The nearest pairs ``a_id, b_id, miles`` by miles to one place, each once, at most so many."""
    return pairs.select("a_id", "b_id", F.round("miles", 1).alias("miles")).distinct().orderBy("miles", "a_id", "b_id").limit(most)


def ground_cell(zones: Column, ground: Column) -> Column:
    """One cell of the export: flood zones of the stations, and the habitats and protected land that a project meets."""
    named = lambda label, names: F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(F.array_sort(names), ", ")))
    told = F.concat_ws("; ", F.concat(F.lit("flood zones: "), zones), named("critical habitat: ", ground["habitat"]), named("protected land: ", ground["protected"]))
    return F.when(ground["checked"], told).otherwise("not checked")
