"""The uncertainty distance join of projects, its order, and what is derived from it."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, geo, intervals
from .common import checkpointed, numbered

#: Radii are joined class by class, so that one wide circle does not widen every cell.
RADIUS_CLASSES = (2.0, 12.0, float("inf"))
#: No two places are farther apart.
HALF_AROUND = 12_500.0
#: Projects of one place that are met as one; of more, each so many are.
TOGETHER = 256
LEGACY_PLANS = {"SC": "desc", "GA": "ga"}


def plan_of(plan: Column, state: Column) -> Column:
    """The plan, else that of the state's older data, else null (never pairs)."""
    known = F.create_map(*[F.lit(x) for kv in LEGACY_PLANS.items() for x in kv])
    return F.coalesce(plan, F.try_element_at(known, state))


def _cells(lat: Column, lon: Column, height: float, columns: int, spread: bool) -> Column:
    """The grid cell of a point, or with ``spread`` all cells next to it; longitudes wrap."""
    i = F.floor(lat / height).cast("long")
    j = F.floor((lon + 180.0) * columns / 360.0).cast("long")
    around = (-1, 0, 1) if spread else (0,)
    return F.array_distinct(F.array(*[F.struct((i + a).alias("i"), F.pmod(j + b, F.lit(columns)).alias("j")) for a in around for b in around]))


def _grid(reach: float, max_abs_lat: float) -> tuple[float, int]:
    """Height of a cell in degrees and cells around the globe: a cell is at least as high and as wide as the reach."""
    height = reach / 69.0
    width = 360.0 if max_abs_lat > 85 else min(360.0, 1.01 * height / math.cos(math.radians(max_abs_lat)))
    return height, max(1, int(360.0 // width))


def near_join(a: DataFrame, b: DataFrame, reach: float, same: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a and b (structs ``a`` and ``b`` with lat, lon) that share a neighbourhood of cells,
    and the fields named in ``same``.

    Lossless for distances below ``reach``: cells are as wide as the greatest latitude of either
    side asks for.  Each row of a lies in one cell only, so no pair is found twice.
    """
    tops = [d.agg(F.max(F.abs(F.col(f"{side}.lat")))).first()[0] for d, side in ((a, "a"), (b, "b"))]
    grid = _grid(reach, float(max(top or 0.0 for top in tops)))
    keyed = lambda d, side, spread: d.select(
        side, F.explode(_cells(F.col(f"{side}.lat"), F.col(f"{side}.lon"), *grid, spread)).alias("cell"), *[F.col(f"{side}.{c}").alias(f"__{c}") for c in same]
    )
    on = ["cell", *[f"__{c}" for c in same]]
    # Merged, not broadcast: Spark takes a row spread over cells for one row.
    return keyed(a, "a", False).hint("merge").join(keyed(b, "b", True), on).drop(*on)


def near_join_of_kinds(rows: DataFrame, reaches: dict[tuple[int, int], float], max_abs_lat: float, sides: tuple[Column, Column] | None = None) -> DataFrame:
    """``near_join`` of a table (``kind, lat, lon``, struct ``p``) with itself, where the reach depends on both
    rows' kinds: one join on the two kinds and the cell of their grid.  ``sides`` tell which rows may be a, and which b."""
    kinds = sorted({k for k, _ in reaches})
    lat, lon = F.col("lat"), F.col("lon")

    def cells(mine: int, spread: bool) -> Column:
        each = []
        for other in kinds:
            x, y = (other, mine) if spread else (mine, other)
            found = _cells(lat, lon, *_grid(reaches[x, y], max_abs_lat), spread)
            each.append(F.transform(found, lambda c: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), c["i"].alias("i"), c["j"].alias("j"))))  # noqa: B023
        return F.concat(*each)

    def keyed(side: str, spread: bool) -> DataFrame:
        all_cells = F.lit(None)
        for k in kinds:
            all_cells = F.when(F.col("kind") == k, cells(k, spread)).otherwise(all_cells)
        some = rows if sides is None else rows.filter(sides[side == "b"])
        return some.select(F.col("p").alias(side), F.explode(all_cells).alias("cell"))

    return keyed("a", False).hint("merge").join(keyed("b", True), "cell").drop("cell")


def _sides(rows: DataFrame) -> tuple[Column, Column]:
    """Which rows have any of a later plan and another state (``a``), and which of an earlier one (``b``): of the plans of each state
    only the two states that go furthest are asked."""
    ends = rows.groupBy("state").agg(F.max("plan_ord").alias("last"), F.min("plan_ord").alias("first"))
    last, first = (ends.orderBy(order).limit(2).collect() for order in (F.desc("last"), F.asc("first")))

    def of(found: list, end: str) -> Column:
        """The furthest plan of the states but the row's own, null if there is none."""
        second = F.lit(found[1][end]) if len(found) > 1 else F.lit(None)
        return F.when(F.col("state") == found[0]["state"], second).otherwise(F.lit(found[0][end])) if found else F.lit(None)

    return F.col("plan_ord") < of(last, "last"), F.col("plan_ord") > of(first, "first")


def distance_join(
    projects: DataFrame, cutoff: float = classify.CUTOFF, include_possible: bool = False, as_of: str | None = None, exact: bool = False,
) -> DataFrame:
    """Pairs of projects of different plans and states that may be within the cutoff.

    ``projects`` has id, plan_ord, state, lat, lon, radius_mi, isd, win_start, win_end.  With ``exact`` miles, and all
    that hangs on them, are those of the C library to the last bit, for pairs to be ordered.
    """
    placed = projects.filter("lat IS NOT NULL AND lon IS NOT NULL AND plan_ord IS NOT NULL AND state IS NOT NULL")
    radius = F.coalesce("radius_mi", F.lit(0.0)) if include_possible else F.lit(0.0)
    kind = F.lit(len(RADIUS_CLASSES) - 1)
    for i in reversed(range(len(RADIUS_CLASSES) - 1)):
        kind = F.when(radius <= RADIUS_CLASSES[i], i).otherwise(kind)
    # Projects of one place, plan and state are met once, however many they are, and told apart where places are near enough.
    place = ["kind", "lat", "lon", "plan_ord", "state"]
    each = placed.select(kind.alias("kind"), radius.alias("r"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "plan_ord", "state", F.struct(*placed.columns).alias("p"))
    nth = F.floor((F.row_number().over(Window.partitionBy(*place).orderBy("p.id")) - 1) / TOGETHER)
    grouped = each.withColumn("nth", nth).groupBy(*place, "nth").agg(F.max("r").alias("r"), F.collect_list("p").alias("all"))
    # Written once: both sides of the join, and the reach of each kind, are read from it.
    up, along = F.radians("lat"), F.radians("lon")
    on_globe = [(F.cos(up) * F.cos(along)).alias("x"), (F.cos(up) * F.sin(along)).alias("y"), F.sin(up).alias("z")]
    rows = checkpointed(grouped.select("kind", "r", "lat", "lon", "plan_ord", "state", F.struct("lat", "lon", "plan_ord", "state", "r", *on_globe, "all").alias("p")))
    found = rows.groupBy("kind").agg(F.max("r").alias("r"), F.max(F.abs("lat")).alias("lat")).collect()
    reaches = {(x["kind"], y["kind"]): cutoff + x["r"] + y["r"] for x in found for y in found} or {(0, 0): cutoff}
    joined = near_join_of_kinds(rows, reaches, max((r["lat"] for r in found), default=0.0), _sides(rows))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    day = F.lit(as_of).cast("date")
    # The way through the globe is shorter than the one over it, so that it leaves out no pair, and asks for no sines of those that are far.
    through = functools.reduce(lambda s, t: s + t, ((a(c) - b(c)) * (a(c) - b(c)) for c in "xyz"))
    reach = (a("r") + b("r") + cutoff * (1 + 1e-9) + 1e-6) / geo.RADIUS_PAIRS
    near = joined.filter((a("plan_ord") < b("plan_ord")) & (a("state") != b("state")) & (through < reach * reach))
    miles = geo.haversine_libm if exact else geo.haversine
    near = near.withColumn("miles", miles(a("lat"), a("lon"), b("lat"), b("lon"))).filter(F.col("miles") - (a("r") + b("r")) < cutoff)
    measured = near.select(F.explode("a.all").alias("a"), F.col("b.all").alias("all"), "miles").select("a", F.explode("all").alias("b"), "miles")
    told = measured.withColumn("certainty", classify.certainty(F.col("miles"), a("radius_mi"), b("radius_mi"), cutoff))
    told = told.filter(F.col("certainty").isin(["robust", "sensitive"] + ["possible"] * include_possible))
    windows = [a("win_start"), a("win_end"), b("win_start"), b("win_end")]
    told = (
        told.withColumn("qualifies", F.col("miles") < cutoff)
        .withColumn("gap_days", intervals.gap_days(a("isd"), b("isd")))
        .withColumn("overlap_days", intervals.overlap_days(*windows))
        .withColumn("remaining_days", intervals.remaining_days(*windows, day))
        .withColumn("both_past", F.coalesce((a("isd") < day) & (b("isd") < day), F.lit(False)))
        .withColumn("id", F.concat(a("id"), F.lit("__"), b("id")))
    )
    parts = classify.score(F.col("miles"), F.col("remaining_days"), F.col("overlap_days"), F.col("gap_days"), F.col("certainty"))
    return told.withColumns({f"score_{k}": v for k, v in parts.items()})


#: Orders of pairs; qualifying ones always come first, the pair's id decides at last.
def pair_order(key: str = "score", pair: Column | None = None) -> list[Column]:
    by = {
        "score": [F.desc("score_total"), F.asc("miles")],
        "distance": [F.asc("miles")],
        "time": [F.asc_nulls_last("gap_days"), F.asc("miles")],
        "overlap": [F.coalesce("remaining_days", F.lit(-1)).desc(), F.asc("miles")],
    }
    return [F.desc("qualifies"), *by.get(key, by["score"]), (F.col("id") if pair is None else pair).asc()]


def ranked(pairs: DataFrame, key: str = "score", pair: Column | None = None) -> DataFrame:
    """Every pair's rank over all in the order of the key; ``pair`` tells its id, where it has no column of it.  Pairs are shuffled and
    written with all columns that they have: select those needed."""
    return numbered(pairs, *pair_order(key, pair))


def ordered_by(key: str) -> list[str]:
    """The columns that ``ranked`` needs for a key, but for the pair's id."""
    return ["qualifies", *{"score": ["score_total"], "time": ["gap_days"], "overlap": ["remaining_days"]}.get(key, []), "miles"]


def shown_rank(pairs: DataFrame, key: str = "score", pair: Column | None = None) -> DataFrame:
    """Rank among qualifying pairs only, null for others: they always come first in every order."""
    return ranked(pairs, key, pair).withColumn("shown_rank", F.when(F.col("qualifies"), F.col("rank")))


def nearby_endpoints(projects: DataFrame, endpoints: DataFrame, within: float = 0.5, cutoff: float = classify.CUTOFF) -> DataFrame:
    """Endpoint pairs at most ``within`` miles apart, of pairs of projects within the cutoff.

    Endpoints meet in cells as wide as ``within``; those of one point and project's place are met once.  Whether
    their projects are a pair is asked of the few that are near, not the other way round.
    """
    home = projects.filter("lat IS NOT NULL AND lon IS NOT NULL AND plan_ord IS NOT NULL AND state IS NOT NULL").select("id", "plan_ord", "state", F.col("lat").alias("home_lat"), F.col("lon").alias("home_lon"))
    point = ["lat", "lon", "plan_ord", "state", "home_lat", "home_lon"]
    each = endpoints.filter("lat IS NOT NULL AND lon IS NOT NULL").select("id", "pos", "name", "lat", "lon").join(home, "id")
    nth = F.floor((F.row_number().over(Window.partitionBy(*point).orderBy("id", "pos")) - 1) / TOGETHER)
    rows = checkpointed(each.withColumn("nth", nth).groupBy(*point, "nth").agg(F.collect_list(F.struct("id", "pos", "name")).alias("all")).select(F.struct(*point, "all").alias("p")))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    met = near_join(rows.select(F.col("p").alias("a")), rows.select(F.col("p").alias("b")), within * 1.001)
    met = met.filter((a("plan_ord") < b("plan_ord")) & (a("state") != b("state"))).withColumn("miles", geo.haversine(a("lat"), a("lon"), b("lat"), b("lon"))).filter(F.col("miles") <= within)
    met = met.filter(geo.haversine(a("home_lat"), a("home_lon"), b("home_lat"), b("home_lon")) < cutoff)
    told = met.select(F.explode("a.all").alias("x"), F.col("b.all").alias("all"), "miles").select("x", F.explode("all").alias("y"), "miles")
    pair = F.concat("x.id", F.lit("__"), "y.id").alias("pair")
    return told.select(pair, F.col("x.name").alias("a_name"), F.col("y.name").alias("b_name"), F.col("x.pos").alias("a_pos"), F.col("y.pos").alias("b_pos"), "miles")


def nearest_partner(projects: DataFrame, reach: float = 5.0) -> DataFrame:
    """The nearest project of another plan and state; the first in input order wins ties.

    Looked for within ``reach`` miles first; what finds none there goes on with twice the reach,
    until all have one or the reach is half the way around the globe.  So a dense region is
    settled in small cells, and wide ones are left to projects that are far from all others.
    """
    placed = projects.filter("lat IS NOT NULL AND lon IS NOT NULL AND plan_ord IS NOT NULL")
    slim = checkpointed(placed.select(F.struct("id", "ord", "plan_ord", "state", "lat", "lon").alias("p")))

    def best(pairs: DataFrame) -> DataFrame:
        a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
        ok = (a("plan_ord") != b("plan_ord")) & (a("state") != b("state"))
        far = geo.haversine(a("lat"), a("lon"), b("lat"), b("lon"))
        return pairs.filter(ok).select(a("id").alias("id"), b("id").alias("partner"), far.alias("miles"), b("ord").alias("o")).groupBy("id").agg(
            F.min_by(F.struct("partner", "miles"), F.struct("miles", "o")).alias("m")
        ).select("id", "m.partner", "m.miles")

    right, missing, found = slim.select(F.col("p").alias("b")), slim.select(F.col("p").alias("a")), []
    while True:
        last = reach > HALF_AROUND
        near = checkpointed(best(near_join(missing, right, reach)).filter(F.lit(last) | (F.col("miles") < reach)))
        found.append(near)
        missing = checkpointed(missing.join(near, F.col("a.id") == F.col("id"), "left_anti"))
        if last or not missing.limit(1).count():
            break
        reach *= 2
    return functools.reduce(DataFrame.unionByName, found)


def partner_counts(pairs: DataFrame, projects: DataFrame) -> DataFrame:
    """Number of pairs of every located project; 0 for those without a partner."""
    sides = pairs.select(F.explode(F.array("a.id", "b.id")).alias("id")).groupBy("id").agg(F.count("*").alias("partners"))
    located = projects.filter("lat IS NOT NULL").select("id")
    return located.join(sides, "id", "left").select("id", F.coalesce("partners", F.lit(0)).alias("partners"))


def same_stations(projects: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Groups of one plan's projects with the same set of two or more endpoint names."""
    names = endpoints.groupBy("id", "plan").agg(F.array_sort(F.collect_set(F.upper("name"))).alias("names")).filter(F.size("names") >= 2)
    key = names.withColumn("key", F.concat_ws("|", "plan", F.array_join("names", "+")))
    many = key.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return key.join(many, "key").select("id", "key", (F.col("n") - 1).alias("others"))


def in_pairing_range(projects: DataFrame, reach: float = classify.CUTOFF, radius: float = geo.RADIUS_PLACES) -> DataFrame:
    """Projects with one of another plan and state within reach plus both radii."""
    placed = projects.filter("lat IS NOT NULL AND lon IS NOT NULL AND plan_ord IS NOT NULL AND state IS NOT NULL").withColumn("r", F.coalesce("radius_mi", F.lit(0.0)))
    # Projects of one place and radius are in range together, and of a place the widest circle decides: each is met once.
    place = ["plan_ord", "state", "lat", "lon"]
    own = checkpointed(placed.select(*place, "r").distinct())
    wide = checkpointed(own.groupBy(*place).agg(F.max("r").alias("r")))
    most = wide.agg(F.max("r")).first()[0] or 0.0
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    met = near_join(own.select(F.struct(*place, "r").alias("a")), wide.select(F.struct(*place, "r").alias("b")), reach + 2 * most)
    close = geo.haversine_asin(a("lat"), a("lon"), b("lat"), b("lon"), radius) < reach + a("r") + b("r")
    found = met.filter((a("plan_ord") != b("plan_ord")) & (a("state") != b("state")) & close).select("a.*").distinct()
    return placed.join(found, [*place, "r"], "left_semi").select("id").distinct()
