"""Endpoints resolved: the joint choice against all combinations, and the cases of the ladder."""

import itertools
import math
import random

from meshwork.operators import resolution, rules

CANDIDATES = "id string, pos int, choice int, lat double, lon double, method string, label string, confidence string, radius_mi double, owner string"


def miles(p, q):
    s = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 3958.8 * math.asin(min(1, math.sqrt(s)))


def test_joint_choice_equals_all_combinations_up_to_the_cap(spark):
    """Projects of more combinations than are looked at, too: the best lies beyond the cap for some."""
    rng = random.Random(3)
    sizes = [(1,), (4,), (3, 5), (2, 3, 4), (30, 30, 30), (1, 1, 6000), (6000, 2), (2, 90, 80)]
    places, rows = {}, []
    for i, counts in enumerate(sizes):
        places[f"p{i}"] = [[(33 + rng.random(), -82 + rng.random()) for _ in range(n)] for n in counts]
        rows += [(f"p{i}", pos * 10, choice, *at) for pos, ats in enumerate(places[f"p{i}"]) for choice, at in enumerate(ats)]
    anchor = {"p2": (33.5, -81.5), "p4": (33.1, -81.1)}
    got = {r.id: [c for c in (r.choice0, r.choice1, r.choice2) if c is not None] for r in rules.best_combination(
        spark.createDataFrame(rows, "id string, pos int, choice int, lat double, lon double"), spark.createDataFrame([(k, *v) for k, v in anchor.items()], "id string, lat double, lon double")).collect()}
    beyond = 0
    for k, ats in places.items():
        cost = lambda c: sum(miles(p, q) for p, q in itertools.combinations([a[i] for a, i in zip(ats, c)] + ([anchor[k]] if k in anchor else []), 2))  # noqa: B023, E731
        every = list(itertools.product(*[range(len(a)) for a in ats]))
        assert got[k] == list(min(every[:5000], key=cost)), k
        beyond += min(every, key=cost) not in every[:5000]
    assert beyond > 0


def resolve(spark, endpoints, candidates, anchors=()):
    out = resolution.resolved_endpoints(
        spark.createDataFrame([(i, p, n, "clash") for i, p, n in endpoints], "id string, pos int, name string, method string"), spark.createDataFrame(candidates, CANDIDATES),
        spark.createDataFrame(list(anchors), "id string, lat double, lon double"))
    return {(r.id, r.pos): r for r in out.collect()}


def test_ladder(spark):
    near = lambda i, pos, choice=0, method="osm-exact", lat=33.0, lon=-81.0, conf=None, radius=None, owner=None, label="way": (i, pos, choice, lat, lon, method, label, conf, radius, owner)
    endpoints = [(i, p, f"{i}{p}") for i in ("alone", "zoned", "pair", "owner", "manual", "ref", "town", "far", "weak", "out") for p in (0, 1)]
    candidates = [
        near("alone", 0), near("alone", 0, 1, lon=-83.0),  # two places and nothing to tell them apart
        near("zoned", 0), near("zoned", 0, 1, lon=-83.0), near("pair", 0), near("pair", 0, 1, lon=-83.0), near("pair", 1, lon=-82.9),
        near("owner", 0, owner="Other"), near("owner", 1, method="osm-partial", owner="Other"), near("manual", 0, method="manual", conf="low", radius=2.0, owner="Other"), near("ref", 0, method="reference", owner="Other"), near("town", 0, method="town", owner="Other"),
        near("far", 0), near("far", 1, method="town", lon=-84.0), near("weak", 0, method="reference"), near("weak", 1, lat=36.0, label=None), near("out", 0, lat=36.0),
        near("out", 1, lat=None), near("town", 1, method="guess"),
    ]
    got = resolve(spark, endpoints, candidates, [("zoned", 33.0, -83.1), ("out", 33.0, -81.0)])
    told = {k: (r.method, r.confidence, r.radius_mi, r.lon) for k, r in got.items()}
    nothing = (None, "none", None, None)
    assert told == {
        ("alone", 0): ("osm-exact", "ambiguous", 0.5, -81.0), ("alone", 1): nothing, ("zoned", 0): ("osm-exact", "high", 0.5, -83.0), ("zoned", 1): nothing,
        ("pair", 0): ("osm-exact", "high", 0.5, -83.0), ("pair", 1): ("osm-exact", "high", 0.5, -82.9), ("owner", 0): ("osm-exact", "medium", 1.5, -81.0), ("owner", 1): ("osm-partial", "medium", 1.5, -81.0),
        ("manual", 0): ("manual", "low", 2.0, -81.0), ("manual", 1): nothing, ("ref", 0): ("reference", "medium", 1.5, -81.0), ("ref", 1): nothing, ("town", 0): ("town", "low", 6.0, -81.0), ("town", 1): nothing,
        ("far", 0): ("osm-exact", "high", 0.5, -81.0), ("far", 1): nothing, ("weak", 0): ("reference", "high", 0.5, -81.0), ("weak", 1): nothing, ("out", 0): nothing, ("out", 1): nothing,
    }
    assert got["alone", 0].evidence == "way; 2 places have this name, another one 116 mi away"
    assert got["zoned", 0].evidence.endswith("taken as nearest to the zone") and got["pair", 0].evidence.endswith("taken as nearest to the other endpoints")
    assert got["weak", 1].evidence == "rejected a osm-exact match 207 mi from the rest of the project (same name, another place)"
    assert got["out", 0].evidence == "rejected a osm-exact match 207 mi from the rest of the project (way)" and got["out", 1].evidence == "no place of this name is known"


def test_resolved_of_nothing(spark):
    assert resolve(spark, [("p", 0, "x")], [])["p", 0].confidence == "none"
    assert resolve(spark, [], [("p", 0, 0, 33.0, -81.0, "town", "t", None, None, None)]) == {}
