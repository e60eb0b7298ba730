"""Order-dependent operators against plain Python, and fixed expectations."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from meshwork.functions import dates, text
from meshwork.operators import graph, matching, shapes

DATES = [
    ("6/1/2027", "2027-06-01", "2027-06-01"), ("June 2027", "2027-06-30", "2027-06-01"), ("Q2 2028", "2028-06-30", "2028-04-01"), ("Summer 2027", "2027-08-31", "2027-06-01"), ("2029", "2029-12-31", "2029-01-01"),
    ("12/1/2026; 6/1/2028", "2028-06-01", "2026-12-01"), ("TBD", None, None), ("Phase 1: 2027; Phase 2: 2029", "2029-12-31", "2027-01-01"),
    ("June 2027 (Phase 1), December 2029 (Phase 2)", "2029-12-31", "2027-06-01"), ("delayed from 2025 to 2027", "2027-12-31", "2025-01-01"), ("Q1 2026 to 2027 Q3", "2027-09-30", "2026-01-01"), ("5 June, 2027 and Jan. '28", "2028-01-31", "2027-06-05"), ("13/2027", None, None), ("Marion 2027", "2027-12-31", "2027-01-01"), ("4/31/2026", "2026-04-30", "2026-04-30"), ("Dec 12/15/2026", "2026-12-15", "2026-12-15"), (None, None, None),
]


@pytest.mark.parametrize("raw,end,start", DATES)
def test_read_date(raw, end, start):
    iso = lambda d: d.isoformat() if d else None
    assert (iso(dates.read_date(raw, True)), iso(dates.read_date(raw, False))) == (end, start)


ISSUES = [
    ("6/1/2027", None), ("June 2027", "date given as a month ('June 2027'); read as 2027-06-30"), (" Q2 2028", "date given as a quarter ('Q2 2028'); read as 2028-06-30"),
    ("4/31/2026", "impossible date '4/31/2026' read as 4/30/2026"), ("13/2027", "invalid date '13/2027'"), ("TBD", "unparseable date 'TBD'"), (None, "unparseable date None"),
    ("from 2025 to 2027", "several dates in 'from 2025 to 2027'; read the latest, 2027-12-31"),
    ("2/30/2026, 1/5/2026", "several dates in '2/30/2026, 1/5/2026'; read the latest, 2026-02-28 (impossible date '2/30/2026' read as 2/28/2026)"), ("6/1/2027 (6/1/2027)", None),
]


@pytest.mark.parametrize("raw,issue", ISSUES)
def test_how_a_date_was_read(raw, issue):
    assert dates.read_dated(raw, True)[1] == issue


def test_any_date_in_batches(spark):
    df = spark.createDataFrame([(r,) for r, _, _ in DATES], "raw string")
    got = [r[0] for r in df.coalesce(1).select(dates.any_date(F.col("raw"))).collect()]
    assert got == [dt.date.fromisoformat(e) if e else None for _, e, _ in DATES]


def test_names(spark):
    cases = [("St. George Sub", "saint george"), ("N Augusta & W Hydroelectric Plant", "north augusta and west hydro"), ("Goshen (Sav)", "goshen"), ("Pri Rd 12", "primary road")]
    df = spark.createDataFrame(cases, "name string, norm string")
    assert [r[0] for r in df.select(text.norm_name(F.col("name"))).collect()] == [n for _, n in cases]
    ways = spark.createDataFrame([("east villa", "west villa"), ("east villa", "villa")], "a string, b string")
    assert [r[0] for r in ways.select(text.compatible_directions(F.col("a"), F.col("b"))).collect()] == [False, True]


def editions(spark, rows):
    return spark.createDataFrame(rows, "step string, rkey string, pos long, name string")


def test_reused_ids(spark):
    old = editions(spark, [("s", "001", 0, "Goshen to Kraft"), ("s", "001", 1, "Okatie line"), ("s", "7", 2, "Alpha works"), ("s", "9", 3, "Gone one")])
    new = editions(spark, [("s", "1", 0, "Okatie line"), ("s", "1", 1, "Zebra crossing"), ("s", "7", 2, "Quite different"), ("s", "5", 3, "Fresh")])
    got = {(r.old_pos, r.new_pos, r.how) for r in matching.match_editions(old, new, True).collect()}
    assert got == {(1, 0, "same"), (None, 1, "added"), (2, 2, "renamed"), (None, 3, "added"), (0, None, "removed"), (3, None, "removed")}
    unique = {(r.old_pos, r.new_pos, r.how) for r in matching.match_editions(old, new, False).collect()}
    assert (2, 2, "same") in unique


def test_lineage_ordinals(spark):
    rows = [("e1", 0, "K", "Same name", "SC"), ("e1", 1, "K", "Same name", "SC"), ("e2", 0, "K", "Same name", "SC"), ("e2", 1, "K", "Same name", "SC"), ("e2", 2, "K", "Same name", "SC")]
    df = spark.createDataFrame(rows, "filing string, pos long, rkey string, name string, state string")
    got = {(r.filing, r.pos): r.lineage for r in matching.lineage(df, [{"e1": None}, {"e2": "e1"}], False).collect()}
    assert got[("e1", 0)] == "SC:K:same name" and got[("e1", 1)] == "SC:K:same name:2"
    assert len({got[("e2", i)] for i in range(3)}) == 3 and got[("e2", 0)] == got[("e1", 0)]


def test_lineage_takes_the_next_free_ordinal(spark):
    """A record that drifts to another key's name keeps its lineage; new ones step over it."""
    name, editions_ = "Savannah River", [
        ("e1", ["Savannah River"] * 3), ("e2", ["Savannah River", "Savannah River", "Savannah River Site"]),
        ("e3", ["Savannah River", "Savannah River", "Savannah River Site"]), ("e4", ["Savannah River", "Savannah River Site", "Savannah River", "Savannah River"]),
    ]
    rows = [(f, i, "K", n, "SC") for f, names in editions_ for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "filing string, pos long, rkey string, name string, state string")
    steps = [{f: editions_[i - 1][0] if i else None} for i, (f, _) in enumerate(editions_)]
    got = {(r.filing, r.pos): r.lineage for r in matching.lineage(df, steps, False).collect()}
    for f, names in editions_:
        assert len({got[f, i] for i in range(len(names))}) == len(names)
    base = "SC:K:savannah river"
    assert [got["e1", i] for i in range(3)] == [base, f"{base}:2", f"{base}:3"]
    assert [got["e4", i] for i in range(4)] == [base, f"{base}:3", f"{base}:2", f"{base}:4"], name


def test_greedy_matches_against_all_pairs(spark):
    import difflib

    rng = random.Random(2)
    names = ["goshen line", "goshen lines", "goshen main line", "okatie tap", "okatie taps", "kraft", ""]
    rows = [(g, i, rng.choice(names) + rng.choice(["", "", " a"])) for g in ("x", "y") for i in range(40)]
    want = []
    for g in ("x", "y"):
        pairs = sorted((-difflib.SequenceMatcher(None, a, b).ratio(), i, j) for k, i, a in rows for m, j, b in rows if k == m == g and i % 2 == 0 and j % 2)
        free_l, free_r = set(range(40)), set(range(40))
        for ratio, i, j in pairs:
            if -ratio >= 0.8 and i in free_l and j in free_r:
                free_l.discard(i)
                free_r.discard(j)
                want.append((g, i, j, -ratio))
    df = spark.createDataFrame(rows, "g string, pos long, norm string")
    got = matching.greedy_matches(df.filter("pos % 2 = 0"), df.filter("pos % 2 = 1"), "g").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_maximum_matching(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(6), rng.randrange(6)) for _ in range(6 + 2 * seed)}
    got = matching.maximum_matching(spark.createDataFrame([(0, a, b) for a, b in edges], "g long, l long, r long"), "g").collect()
    assert {(r.l, r.r) for r in got} <= edges and len({r.l for r in got}) == len({r.r for r in got}) == len(got)
    best = max(n for n in range(7) for c in itertools.combinations(edges, n) if len({a for a, _ in c}) == len({b for _, b in c}) == n)
    assert len(got) == best


def test_shapes():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    moved = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    assert sorted(shapes.clip_ring_to_convex(square, moved)) == [(1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (2.0, 2.0)]
    assert shapes.clip_ring_to_convex(square, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]) == []
    assert sorted(shapes.clip_ring_to_convex(square, moved[::-1])) == [(1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (2.0, 2.0)]
    assert shapes.clip_path_to_box([(3.0, 0.0), (3.0, 1.0)], 0, 0, 2, 2) == [] and shapes.clip_path_to_box([(1.0, 1.0)], 0, 0, 2, 2) == []
    assert shapes.clip_path_to_box([(-1.0, 1.0), (1.0, 1.0), (1.0, 5.0)], 0, 0, 2, 2) == [[(0.0, 1.0), (1.0, 1.0), (1.0, 2.0)]]
    assert shapes.clip_path_to_box([(-1.0, 1.0), (5.0, 1.0)], 0, 0, 2, 2) == [[(0.0, 1.0), (2.0, 1.0)]]
    assert shapes.simplify([(0.0, 0.0), (1.0, 0.01), (2.0, 0.0)], 0.05) == [(0.0, 0.0), (2.0, 0.0)]
    assert len(shapes.corridor([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], 0.1)) == 2


def test_a_route_of_many_vertices(spark):
    edges = graph.bidirected(spark.range(70).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("miles")))
    got = graph.capped_distances(edges, spark.createDataFrame([(0, 1e9)], "source long, cap double")).collect()
    assert {(r.vertex, r.miles) for r in got} == {(i, float(i)) for i in range(71)}


def test_routes_against_a_walk_of_the_whole_network(spark):
    """Every leg by Dijkstra from all vertices near one end to all near the other."""
    import heapq
    import math

    def miles(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 3958.8 * math.asin(math.sqrt(x))

    rng = random.Random(6)
    at = {i: (33 + rng.random() / 5, -82 + rng.random() / 5) for i in range(60)}
    near = {(i, j) for i in at for j in at if i < j and miles(at[i], at[j]) < 2.6}
    legs = [(f"k{n // 2}", n % 2, *(c + rng.uniform(-0.004, 0.004) for c in at[rng.randrange(60)]), *(c + rng.uniform(-0.004, 0.004) for c in at[rng.randrange(60)])) for n in range(40)]
    legs.append(("far", 0, 35.0, -82.0, 33.1, -81.9))
    want = {}
    for key, leg, *points in legs:
        a, b = points[:2], points[2:]
        lat, lon = ([at[i][c] for i in at] for c in (0, 1))
        if not all(min(lat) <= p[0] <= max(lat) and min(lon) <= p[1] <= max(lon) for p in (a, b)):
            continue
        ends = {i: miles(b, at[i]) for i in at if miles(b, at[i]) <= 0.4}
        heap, seen, cap = [(miles(a, at[i]), i) for i in at if miles(a, at[i]) <= 0.4], {}, max(3 * miles(a, b), 2.0)
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if u in seen or d > cap:
                continue
            seen[u] = d
            for i, j in near:
                if u in (i, j):
                    heapq.heappush(heap, (d + miles(at[i], at[j]), j if u == i else i))
        if hits := [seen[i] + far for i, far in ends.items() if i in seen]:
            want[key, leg] = round(min(hits), 2)
    vertices = spark.createDataFrame([(i, *p) for i, p in at.items()], "vertex long, v_lat double, v_lon double")
    edges = graph.bidirected(spark.createDataFrame([(i, j, miles(at[i], at[j])) for i, j in near], "u long, v long, miles double"))
    told = spark.createDataFrame(legs, "key string, leg int, lat1 double, lon1 double, lat2 double, lon2 double")
    found = graph.routes(told, vertices, edges)
    assert {(r.key, r.leg): r.route_miles for r in found.collect()} == pytest.approx(want) and len(want) > 10
    whole = {k: want[k, 0] + want[k, 1] for k in {f"k{n}" for n in range(20)} if (k, 0) in want and (k, 1) in want}
    stated = {k: (m, 4 * m, m / 4, m * 1.5, None)[n % 5] for n, (k, m) in enumerate(sorted(whole.items()))}
    projects = spark.createDataFrame([(k, k != sorted(whole)[0], stated.get(k)) for k, *_ in {(x[0],) for x in legs}], "key string, eligible boolean, stated double")
    status = {r.key: (round(r.route_miles, 2), r.status) for r in graph.assembled(found, told, projects).collect()}
    labels = ["route", "rejected", "rejected", "route", "route"]
    assert status == {k: (round(m, 2), labels[n % 5]) for n, (k, m) in enumerate(sorted(whole.items())) if n}


def test_capped_distances(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 9.0)], "u long, v long, miles double")
    got = graph.capped_distances(graph.bidirected(edges), spark.createDataFrame([(1, 4.0)], "source long, cap double"))
    assert {(r.vertex, r.miles) for r in got.collect()} == {(1, 0.0), (2, 1.0), (3, 2.0)}


def test_groups_are_streamed_whole(spark):
    """each group is handed over once and in order, though it spans batches and its keys were joined before."""
    keyed = spark.range(4000).select((F.col("id") % 700).cast("string").alias("k"), "id")
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rule = lambda key, rows: [(*key, len(rows), rows == sorted(rows), rows[0][0])]
        got = matching.by_sorted_groups(keyed.join(sizes.filter("n > 1"), "k").select("k", "id"), 1, ("id",), rule, "k string, n long, in_order boolean, least long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, r.n, r.in_order, r.least) for r in got} == {(str(i), 6 if i < 500 else 5, True, i) for i in range(700)} and len(got) == 700
