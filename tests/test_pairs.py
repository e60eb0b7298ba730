"""Golden values of the pair engine, its classes, windows, orders and filters."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from meshwork.functions import classify, geo, intervals
from meshwork.operators import filters, pairs, rules

# Ten starter projects (id, state, lat, lon, in service).
STARTERS = [
    ("DESC_1", "SC", 33.562599, -82.051362, "2024-12-31"), ("DESC_2", "SC", 33.660127, -82.195931, "2024-12-31"), ("DESC_3", "SC", 32.346439, -81.078547, "2025-12-31"),
    ("DESC_4", "SC", 32.722793, -79.967332, "2023-12-31"), ("DESC_5", "SC", 32.284393, -80.942939, "2025-06-01"), ("GPC_1", "GA", 33.602061, -82.182289, "2033-06-01"),
    ("GPC_2", "GA", 32.352116, -81.175112, "2026-06-01"), ("GPC_3", "GA", 32.300409, -81.195789, "2027-06-01"), ("GPC_4", "GA", 31.462605, -83.841487, "2025-05-01"),
    ("GPC_5", "GA", 31.662351, -81.834325, "2025-06-01"),
]
EXPECTED = {
    ("DESC_2", "GPC_1"): (4.09, 3074), ("DESC_3", "GPC_2"): (5.65, 152), ("DESC_3", "GPC_3"): (7.55, 517),
    ("DESC_1", "GPC_1"): (8.01, 3074), ("DESC_5", "GPC_2"): (14.34, 365), ("DESC_5", "GPC_3"): (14.81, 730),
}
SCHEMA = "id string, plan_ord int, state string, lat double, lon double, radius_mi double, isd date, win_start date, win_end date, ord int, name string, utility string"


def day(s):
    return dt.date.fromisoformat(s) if s else None


def frame(spark, rows):
    """Rows (id, plan, state, lat, lon, radius, isd, start, end)."""
    return spark.createDataFrame([(*r[:6], day(r[6]), day(r[7]), day(r[8]), i, r[0], r[2]) for i, r in enumerate(rows)], SCHEMA)


def test_starter_pairs(spark):
    rows = [(i, 0 if s == "SC" else 1, s, lat, lon, None, d, None, None) for i, s, lat, lon, d in STARTERS]
    got = {(r.a.id, r.b.id): (round(r.miles, 2), r.gap_days) for r in pairs.distance_join(frame(spark, rows)).collect()}
    assert got == EXPECTED


def test_three_plans_and_same_plan(spark):
    rows = [("D1", 0, "SC", 33.40, -81.90), ("D2", 0, "SC", 33.42, -81.92), ("G1", 1, "GA", 33.45, -82.00), ("X1", 2, "SC", 33.38, -81.95), ("G2", 0, "GA", None, None)]
    got = {r.id for r in pairs.distance_join(frame(spark, [(*r, None, None, None, None) for r in rows])).collect()}
    assert got == {"D1__G1", "D2__G1", "G1__X1"}
    assert pairs.distance_join(frame(spark, [("A", 0, "SC", 33.4, -81.9, 1.0, None, None, None), ("B", 0, "GA", 33.4, -81.9, 1.0, None, None, None)])).count() == 0


def test_cutoff_is_strict(spark):
    rows = frame(spark, [("A", 0, "SC", 32.08, -81.09, 0.0, None, None, None), ("B", 1, "GA", 32.30, -80.93, 0.0, None, None, None)])
    miles = 17.848941051469826
    assert pairs.distance_join(rows, cutoff=miles + 0.001).first().miles == pytest.approx(miles, abs=1e-9)
    assert pairs.distance_join(rows, cutoff=miles).count() == 0


def test_empty_and_antimeridian(spark):
    assert pairs.distance_join(frame(spark, [])).collect() == []
    rows = frame(spark, [("A", 0, "SC", 10.0, 179.99, 0.0, None, None, None), ("B", 1, "GA", 10.0, -179.99, 0.0, None, None, None)])
    assert pairs.distance_join(rows).count() == 1


@pytest.mark.parametrize("seed,possible", [(1, False), (2, True), (3, True)])
def test_grid_equals_nested_loop(spark, seed, possible):
    rng = random.Random(seed)
    rows = [(f"P{i}", rng.randrange(3), rng.choice(["SC", "GA"]), rng.uniform(30, 36), rng.uniform(-84, -79), rng.choice([None, 0.5, 3.0, 40.0]), None, None, None) for i in range(150)]
    df = frame(spark, rows)
    got = {r.id for r in pairs.distance_join(df, include_possible=possible).select("id").collect()}
    a, b = df.alias("a"), df.alias("b")
    m = geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    level = classify.certainty(m, F.col("a.radius_mi"), F.col("b.radius_mi"))
    wanted = ["robust", "sensitive"] + ["possible"] * possible
    every = a.join(b, (F.col("a.plan_ord") < F.col("b.plan_ord")) & (F.col("a.state") != F.col("b.state")) & level.isin(wanted))
    assert got == {f"{r[0]}__{r[1]}" for r in every.select("a.id", "b.id").collect()}


CASES = [
    ("2026-01-01", "2026-12-31", "2026-12-01", "2027-06-01", None, 30, 30), ("2026-01-01", "2026-02-01", "2026-12-01", "2027-06-01", None, 0, 0),
    (None, "2026-12-31", "2026-12-01", "2027-06-01", None, None, None), ("2025-01-01", "2026-12-31", "2025-06-01", "2027-06-01", "2026-09-26", 574 - 26, 96),
    ("2025-01-01", "2026-12-31", "2025-06-01", "2026-06-01", "2026-09-26", 365, 0), (None, "2026-06-01", "2025-06-01", "2027-06-01", "2026-09-26", None, 0),
    (None, "2027-06-01", "2025-06-01", "2027-06-01", "2026-09-26", None, None),
]


@pytest.mark.parametrize("s1,e1,s2,e2,as_of,overlap,remaining", CASES)
def test_windows(spark, s1, e1, s2, e2, as_of, overlap, remaining):
    w = [F.lit(x).cast("date") for x in (s1, e1, s2, e2)]
    got = spark.range(1).select(intervals.overlap_days(*w), intervals.remaining_days(*w, F.lit(as_of).cast("date"))).first()
    assert got[1] == remaining and (as_of or got[0] == overlap)


@pytest.mark.parametrize("miles,ra,rb,level", [(20, 1, 1, "robust"), (20, 4, 2, "sensitive"), (27, 4, 2, "possible"), (40, 4, 2, "none"), (24.9, None, None, "robust")])
def test_certainty(spark, miles, ra, rb, level):
    got = spark.range(1).select(classify.certainty(F.lit(float(miles)), F.lit(ra).cast("double"), F.lit(rb).cast("double"))).first()[0]
    assert got == level


def test_land_and_yard(spark):
    land = lambda a, b: spark.range(1).select(classify.land_value(F.lit(a), F.lit(b))).first()[0]
    assert [land("SC", "GA"), land("SC", "SC"), land("NC", "GA"), land("NC", "TN")] == [4800, 4500, 5100, 4800]
    one = spark.range(1).select(classify.yard(4.0, F.lit(4800.0), 0.1, F.lit(12), 0.5, mats=10000.0)).first()[0]
    assert one == pytest.approx(40000 + 4 * 4800 * 0.1 + 0.5 * 593636)


TITLES = [("Capacitor bank at Aiken", "Reactive device"), ("Relay upgrade", "Protection & control"), ("115 kV rebuild", "Line rebuild / reconductor"), ("Construct tap line", "New line or tap"), ("Paint", "Other / unspecified")]


@pytest.mark.parametrize("title,kind", TITLES)
def test_project_type(spark, title, kind):
    assert spark.range(1).select(classify.project_type(F.lit(title), F.lit(None).cast("string"))).first()[0] == kind


def test_orders(spark):
    rows = [("a", 3.0, 900, True), ("b", 20.0, 10, True), ("c", 26.0, 0, False), ("d", 10.0, None, True)]
    df = spark.createDataFrame(rows, "id string, miles double, gap_days int, qualifies boolean").withColumn("remaining_days", F.lit(None).cast("int")).withColumn("score_total", F.lit(1))
    order = lambda key: [r.id for r in pairs.ranked(df, key).orderBy("rank").collect()]
    assert order("time") == ["b", "a", "d", "c"] and order("distance") == ["a", "d", "b", "c"]


def test_distance_filter_and_search(spark):
    df = spark.createDataFrame([((6.0, "06371 D", "n", "u"), (0.5, "x", "n", "u"), 28.44, False)], "a struct<radius_mi:double,id:string,name:string,utility:string>, b struct<radius_mi:double,id:string,name:string,utility:string>, miles double, qualifies boolean")
    got = df.select(filters.within_distance(25), filters.within_distance(5), filters.matches_project("a", "06371D"), filters.matches_project("b", "06371D"), filters.matches_project("b", " ")).first()
    assert tuple(got) == (True, False, True, False, True)


def test_view_codec():
    q = filters.PairQuery(search="abc", distance=10, timing="365", include_possible=True)
    assert filters.PairQuery.decode(q.encode()) == q
    assert filters.PairQuery.decode({"distance": "99", "timing": "x", "sort": "y", "search": "Z" * 300}) == filters.PairQuery(search="z" * 200)
    assert q.active() == ["search", "distance", "timing", "include_possible"]


def test_ground_of_pairs(spark):
    row = "checked boolean, flood boolean, habitat array<string>, protected array<string>"
    grounds = [(False, False, [], []), (True, False, [], []), (True, True, [], []), (True, False, ["x"], []), (True, False, [], ["y"])]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grounds)], f"i long, ground struct<{row.replace(' boolean', ':boolean').replace(' array', ':array')}>")
    found = {k: [r.i for r in df.filter(filters.ground_matches(F.col("ground"), k)).orderBy("i").collect()] for k in [*filters.GROUNDS, "other"]}
    assert found == {"unchecked": [0], "clear": [1], "flood": [2], "habitat": [3], "protected": [4], "other": [0, 1, 2, 3, 4]}
    view = filters.PairQuery(ground="flood", utility="U2", shortlist=("a", "b"))
    assert filters.PairQuery.decode(view.encode()) == view and "ground" in view.conjuncts()


def test_near_join_far_north_loses_no_pair(spark):
    """Cells follow the greatest latitude of the rows, whatever the caller knows of it."""
    rng = random.Random(8)
    points = [(i, 58 + 3 * rng.random(), -100 + 4 * rng.random()) for i in range(150)] + [(200 + i, 89.9, 30.0 * i) for i in range(12)]
    side = lambda s, rows: spark.createDataFrame(rows, "id long, lat double, lon double").select(F.struct("id", "lat", "lon").alias(s))
    for reach in (5.0, 25.0, 60.0):
        met = pairs.near_join(side("a", points[:80] + points[150:155]), side("b", points[80:150] + points[155:]), reach)
        far = geo.haversine_asin(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
        got = {(r[0], r[1]) for r in met.filter(far < reach).select("a.id", "b.id").collect()}

        def miles(p, q):
            s = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
            return 2 * 3958.8 * math.asin(min(1, math.sqrt(s)))

        want = {(p[0], q[0]) for p in points[:80] + points[150:155] for q in points[80:150] + points[155:] if miles(p, q) < reach}
        assert got == want and want


def test_located_endpoints_keep_what_a_user_set(spark):
    """An owner's mismatch doubts references and named places alone; no place has no radius."""
    e = spark.createDataFrame([("p", i, n, 33.0, -81.0, True) for i, n in enumerate(["m", "own", "ref", "part", "exact", "none"])] + [("q", 0, "x", 33.0, -81.0, True)], "id string, pos int, name string, a_lat double, a_lon double, mismatch boolean")
    at = lambda rows, keys: spark.createDataFrame(rows, f"{keys}, lat double, lon double")
    manual = spark.createDataFrame([("p", 0, 33.0, -81.0, None, None), ("p", 1, 33.0, -81.0, "low", 2.5)], "id string, pos int, lat double, lon double, confidence string, radius_mi double")
    places = spark.createDataFrame([("part", 33.0, -81.0, "osm-partial"), ("exact", 33.0, -81.0, "osm-exact")], "name string, lat double, lon double, method string")
    found = rules.located_endpoints(e, manual, at([("ref", 33.1, -81.0)], "name string"), places, at([("q", 33.0, -81.0)], "id string"))
    got = {(r.id, r.pos): (r.method, r.confidence, r.radius_mi) for r in found.collect()}
    assert got == {
        ("p", 0): ("manual", "high", 0.5), ("p", 1): ("manual", "low", 2.5), ("p", 2): ("reference", "medium", 1.5), ("p", 3): ("osm-partial", "medium", 1.5),
        ("p", 4): ("osm-exact", "medium", 1.5), ("p", 5): (None, "none", None), ("q", 0): ("town", "low", 6.0),
    }


def test_joint_choice_with_an_anchor(spark):
    """Two names of two places each: together they are near either way, the anchor tells which."""
    east, west = -80.0, -83.0
    rows = [("p", pos, choice, 33.0, lon + pos / 100) for pos in (0, 1) for choice, lon in ((0, west), (1, east))] + [("q", 0, 0, 33.0, west), ("q", 0, 1, 33.0, east)]
    c = spark.createDataFrame(rows, "id string, pos int, choice int, lat double, lon double")
    chosen = lambda *a: {r.id: (r.choice0, r.choice2) for r in rules.best_combination(c, *a).collect()}
    assert chosen() == {"p": (0, 0), "q": (0, None)}
    anchors = spark.createDataFrame([("p", 33.1, east), ("q", 33.1, east)], "id string, lat double, lon double")
    assert chosen(anchors) == {"p": (1, 1), "q": (1, None)}
    with pytest.raises(ValueError, match="4 endpoints"):
        rules.best_combination(spark.createDataFrame([("p", i, 0, 33.0, west) for i in range(4)], c.schema))
