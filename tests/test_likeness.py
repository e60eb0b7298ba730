"""Names that are nearly the same against all pairs, and station names of titles."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from meshwork.functions import text
from meshwork.operators import likeness, placement

TITLES = [
    ("LINE CREEK 115kV BREAKER REPLACEMENTS", "ga", ["LINE CREEK"]), ("GTC: NEW HAMPTON 230/115kV SUB", "ga", ["NEW HAMPTON"]), ("GTC: YATES - LINE CREEK 230kV REBUILD", "ga", ["YATES", "LINE CREEK"]),
    ("PROJECT SPEEDWAY 230kV SUBSTATION", "ga", ["PROJECT SPEEDWAY"]), ("GTC: SWITCH WAY - THORNTON ROAD 230kV LINE REBUILD", "ga", ["SWITCH WAY", "THORNTON ROAD"]),
    ("MORROW: REMOVE LIMITING ELEMENTS ON AUTO TRANSFORMER A", "ga", ["MORROW"]), ("CC: NORTH SPA 230kV (NETWORK IMPROVEMENTS)", "ga", ["NORTH SPA"]), ("SMART VALVES AT EAST VILLA RICA SWITCHING STATION", "ga", ["EAST VILLA RICA"]),
    ("OLIVER DAM & BULL CREEK 115kV PROTECTION RELAY UPGRADE", "ga", ["OLIVER DAM", "BULL CREEK"]), ("GORDON OVERSTRESSED 115kV BREAKERS REPLACEMENT", "ga", ["GORDON"]),
    ("CC - HILL VIEW & GRASSY HOLLOW SUB - IMPROVEMENTS", "ga", ["HILL VIEW", "GRASSY HOLLOW"]), ("SAV - OGEECHEE 115kV LINE", "x", ["SAV", "OGEECHEE"]), ("SAV: Goshen Rebuild", "ga", ["Goshen"]),
    ("SAV: Goshen Rebuild", "x", ["SAV"]), ("Lines rebuild - A - Kraft #2, /", "x", ["Kraft"]), ("A1 - B2 - C3 - D4", "x", ["A1", "B2", "C3"]), (None, "ga", None), ("", "ga", []),
]


def test_title_stations(spark):
    df = spark.createDataFrame(TITLES, "title string, plan string, want array<string>")
    got = df.select(text.title_stations(F.col("title"), F.col("plan")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_named_and_overridden_stations(spark):
    rows = [("a", "k1", "ga", "GTC: YATES 230kV", None), ("b", "k2", "x", "Purrysburg - Mcintosh 230 kV", ["Purrysburg", "McIntosh"]), ("c", "k3", "x", "Purrysburg - Mcintosh 230 kV", ["Purrysburg"])]
    projects = spark.createDataFrame(rows, "id string, override_key string, plan string, title string, named array<string>")
    overrides = spark.createDataFrame([("k3", ["McIntosh"]), ("k9", ["x"])], "override_key string, names array<string>")
    assert {r.id: r.names for r in placement.endpoint_names(projects, overrides).collect()} == {"a": ["YATES"], "b": ["Purrysburg", "McIntosh"], "c": ["McIntosh"]}


def names(rng, n):
    words = ["goshen", "kraft", "okatie", "line", "east", "west", "villa", "rica", "creek", "tap", "a", "ss"]
    out = []
    for _ in range(n):
        name = list(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))))
        for _ in range(rng.randrange(0, 3)):
            name[rng.randrange(len(name))] = rng.choice("abcz ")
        out.append(rng.choice(["".join(name)] * 9 + ["", None]))
    return out


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.9, 0.75, 0.5])
def test_no_pair_is_missed(spark, least):
    rng = random.Random(5)
    left, right = names(rng, 60), names(rng, 90)
    a = spark.createDataFrame([(i, t, str(i % 2)) for i, t in enumerate(left)], "id long, text string, block string")
    b = spark.createDataFrame([(i, t, str(i % 2), 100 - i) for i, t in enumerate(right)], "id long, text string, block string, pos long")
    want = {(i, j): ratio(x, y) for i, x in enumerate(left) for j, y in enumerate(right) if x and y and i % 2 == j % 2 and ratio(x, y) >= least}
    assert {(r.left, r.right): r.ratio for r in likeness.pairs_alike(a, b, least).collect()} == want
    best = {}
    for (i, j), r in sorted(want.items(), key=lambda w: (-w[1], -w[0][1])):
        best.setdefault(i, (j, r))
    assert {r.left: (r.right, r.ratio) for r in likeness.best_alike(a, b, least).collect()} == best and best
    met = likeness.candidates(a, b.drop("pos"), least).count()
    assert len(want) <= met and (least < 0.9 or met < 0.2 * 60 * 45)


def test_the_fourth_tier(spark):
    items = spark.createDataFrame(
        [(1, "West Villa Rica Substation", None, 33.0, -84.0, "GA", False), (2, "Thornton Roads", None, 33.0, -84.0, "GA", False), (3, "Thornton Roadz", None, 33.0, -84.0, "SC", False), (4, "Thornton Roadx", None, 33.0, -84.0, "GA", True)],
        "item long, name string, alt_name string, lat double, lon double, state string, off_grid boolean",
    )
    asked = spark.createDataFrame([(1, "East Villa Rica", "GA"), (2, "Thornton Road", "GA"), (3, "West Villa Rica", "GA"), (4, "Nowhere", "GA"), (5, "tap", "GA")], "query_id long, query string, state string")
    got = placement.find_places_nearly(asked, placement.gazetteer_items(items)).collect()
    assert {(r.query_id, r.tier, r.item) for r in got} == {(2, 4, 2), (3, 1, 1)}


def test_alternatives_of_a_title(spark):
    df = spark.createDataFrame([("Conway Station and Marion Line",), ("Kraft and 2",), ("Sand Hill",), ("",)], "t string")
    assert [r[0] for r in df.select(likeness.title_alternatives(F.col("t"))).collect()] == [["Conway Station and Marion Line", "Conway Station", "Marion Line"], ["Kraft and 2"], ["Sand Hill"], [""]]


def test_slides_of_list_rows(spark):
    slides = spark.createDataFrame(
        [(1, "Conway 230 kV Switching Station and Marion-Conway 230 kV Line", "b", 1), (2, "Sand Hill 115 kV Tap #2", "b", 2), (3, "Sand Hill Tap", "b", 3), (4, "Okatie 230 kV Station", "c", 4)],
        "id long, title string, block string, pos long",
    )
    rows = spark.createDataFrame([(1, "Conway Switching Station", "b"), (2, "Marion-Conway 230 kV Line", "b"), (3, "Sand Hill Tap", "b"), (4, "Okatie Station", "b"), (5, "Okatie Station", "c"), (6, None, "c")], "id long, title string, block string")
    assert {r.left: r.right for r in likeness.own_slides(rows, slides).collect()} == {1: 1, 2: 1, 3: 2, 5: 4}


def test_status_of_a_sample(spark):
    frame = lambda rows, more="": spark.createDataFrame(rows, "id long, name string, block string" + more)
    sample = frame([(1, "Goshen to Kraft line", "SC"), (2, "Okatie new tap", "GA"), (3, "Ritter", "GA"), (4, None, "GA")])
    records = frame([(7, "Goshen to Kraft lines", "SC", 1), (8, "Goshen to Kraft line", "GA", 2)], ", pos long")
    dropped = frame([(9, "Okatie tap", "GA", 1)], ", pos long")
    assert {r.id: (r.status, r.found) for r in likeness.sample_status(sample, records, dropped).collect()} == {1: ("still planned", 7), 2: ("dropped", 9), 3: ("not listed", None), 4: ("not listed", None)}
