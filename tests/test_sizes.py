"""What findings on larger tables asked for: joins whose exploded side is never broadcast, and work that grows no faster than the input."""

import re

import pytest
from pyspark.sql import functions as F

from meshwork.operators import grounding, layers, likeness, overlay, pages, pairs, placement, rules
from meshwork.plans import catalog


def broadcast_sides(df) -> list[str]:
    """The plan below each broadcast, as text."""
    out = []

    def walk(p):
        if p.nodeName() == "BroadcastExchange":
            out.append(p.treeString())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return out


def explodes(side: str) -> bool:
    """Whether rows are exploded at the top of a broadcast, before any aggregate."""
    return "Generate" in re.split(r"Aggregate", side)[0]


def circles(spark):
    points = spark.range(300).select("id", (F.col("id") % 17 / 10).alias("lat"), (F.col("id") % 13 / 10).alias("lon"), (F.col("id") % 3 + 1).cast("double").alias("radius")).withColumnRenamed("id", "key")
    edges = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 0.0, 1.0), (1, 0.0, 1.0, 0.0, 0.0)], "area long, x1 double, y1 double, x2 double, y2 double")
    return points, edges


def test_samples_of_circles_are_not_broadcast(spark):
    """the index of areas goes to the samples, not the samples to all."""
    points, edges = circles(spark)
    shares = overlay.area_shares(points, edges, 0.5)
    assert not any(explodes(s) for s in broadcast_sides(shares))
    samples = overlay.circle_samples(points, 0.5)
    total = {r["key"]: r["count"] for r in samples.groupBy("key").count().collect()}
    hits = overlay.contains(samples.select(F.struct("key", "i", "j").alias("key"), "lon", "lat"), edges).groupBy("key.key").count().collect()
    assert {r["key"]: r["share"] for r in shares.collect()} == {r["key"]: round(r["count"] / total[r["key"]], 3) for r in hits}


def test_rows_spread_over_cells_are_not_broadcast(spark):
    """neither side of a near join is sent to the driver, by whatever its table was guessed to be."""
    rows = spark.range(40).select("id", (F.col("id") % 7 / 10).alias("lat"), (F.col("id") % 5 / 10).alias("lon"))
    a, b = rows.select(F.struct("*").alias("a")), rows.select(F.struct("*").alias("b"))
    met = pairs.near_join(a, b, 10.0)
    kinds = pairs.near_join_of_kinds(rows.select((F.col("id") % 2).alias("kind"), "lat", "lon", F.struct("id").alias("p")), {(x, y): 9.0 for x in (0, 1) for y in (0, 1)}, 1.0)
    assert not broadcast_sides(met) and not broadcast_sides(kinds)
    assert met.count() > 40 and kinds.count() > 40


def test_places_are_counted_without_a_row_for_each(spark):
    """equal queries and names are compared once."""
    items = spark.range(900).select(
        F.col("id").alias("item"), F.when(F.col("id") % 3 == 0, "Goshen Road").otherwise("Goshen").alias("name"), F.when(F.col("id") % 5 == 0, "Goshen").alias("alt_name"), F.lit(33.0).alias("lat"), F.lit(-84.0).alias("lon"), F.lit("GA").alias("state"), (F.col("id") % 2 == 0).alias("off_grid"))
    asked = spark.range(400).select(F.col("id").alias("query_id"), F.element_at(F.array(*map(F.lit, ("Goshen", "Road", "Goshen Primary", "Goshen Roads", None))), (F.col("id") % 5 + 1).cast("int")).alias("query"), F.lit("GA").alias("state"))
    named = placement.gazetteer_items(items)
    want = placement.find_places(asked, named, True).groupBy("query_id", "tier").agg(F.count("*").alias("n"), F.min("item").alias("first_item"))
    got = placement.count_places(asked, named, True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {(r.tier, r.n, r.first_item) for r in got.collect()} == {(1, 660, 0), (3, 150, 3), (2, 330, 1), (4, 150, 3)}


def test_equal_texts_are_compared_once(spark, monkeypatch):
    """F11, F12."""
    sizes, own = [], likeness.candidates
    monkeypatch.setattr(likeness, "candidates", lambda a, b, least: sizes.append((a.count(), b.count())) or own(a, b, least))
    left = spark.range(300).select("id", F.lit("goshen line").alias("text"), F.lit("x").alias("block"))
    right = spark.range(300).select("id", F.when(F.col("id") % 2 == 0, "goshen lines").otherwise("okatie").alias("text"), F.lit("x").alias("block"), (-F.col("id")).alias("pos"))
    best = likeness.best_alike(left, right, 0.5).collect()
    assert len(best) == 300 and {r.right for r in best} == {298}
    assert likeness.pairs_alike(left, right, 0.5).count() == 300 * 150
    assert sizes == [(1, 2), (1, 2)]


def test_sides_of_stations_are_told_by_item(spark, monkeypatch):
    """whether a place is in a state is asked of items, not of mentions."""
    asked, own = [], placement.layers.on_state_side
    monkeypatch.setattr(placement.layers, "on_state_side", lambda state, lat, lon: asked.append(1) or own(state, lat, lon))
    rows = [(i, "SC", None if i % 2 else 33.6, None if i % 2 else -81.0, "Rebuild the Goshen Tie bus near Okatie Tie.") for i in range(40)]
    records = spark.createDataFrame(rows, "id long, state string, a_lat double, a_lon double, description string")
    items = spark.createDataFrame([(1, "Goshen Tie", None, 33.6, -81.0, "SC", False), (2, "Okatie Tie", None, 33.6, -81.0, "SC", False), (3, "Okatie Tie", None, 33.9, -80.5, "SC", False)], "item long, name string, alt_name string, lat double, lon double, state string, off_grid boolean")
    found = placement.described_stations(records, placement.gazetteer_items(items))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.key, r.item) for r in found.collect()} == {(i, "goshen tie", 1) for i in range(40)} and len(asked) == 1
    assert "y1" not in plan


def test_inputs_are_not_broadcast(spark):
    """of tools' inputs and their schemas only the schemas may be sent to the driver and to all."""
    inputs = spark.range(50).select("id", F.lit("find").alias("tool"), F.lit('{"limit": 1}').alias("args"))
    schemas = spark.createDataFrame([("find", "query", "string", True, None), ("find", "limit", "integer", False, None)], "tool string, field string, type string, required boolean, items string")
    found = grounding.input_problems(inputs, schemas)
    assert not any("variant" in s or "Generate" in s or "id#" in s for s in broadcast_sides(found))
    assert {(r.id, r.problem) for r in found.collect()} == {(i, "missing query") for i in range(50)}


def test_projects_of_one_place_are_met_once(spark, monkeypatch):
    """places are compared, and told apart by project only where they are near."""
    joined, own = [], pairs.near_join_of_kinds
    monkeypatch.setattr(pairs, "near_join_of_kinds", lambda rows, *rest: joined.append(rows.count()) or own(rows, *rest))
    monkeypatch.setattr(pairs, "TOGETHER", 30)
    day = F.lit("2000-01-01").cast("date")
    projects = spark.range(160).select(
        F.concat(F.lit("p"), "id").alias("id"), (F.col("id") % 2).alias("plan_ord"), F.when(F.col("id") % 2 == 0, "SC").otherwise("GA").alias("state"), (32.0 + F.col("id") % 4 / 5).alias("lat"), F.lit(-81.0).alias("lon"),
        (F.col("id") % 3).cast("double").alias("radius_mi"), day.alias("isd"), day.alias("win_start"), day.alias("win_end"))
    found = pairs.distance_join(projects, as_of="2000-06-01", cutoff=20.0)
    assert {(r.a, r.b) for r in found.select("a.id", "b.id").toDF("a", "b").collect()} == {(f"p{i}", f"p{j}") for i in range(0, 160, 2) for j in range(1, 160, 2) if abs(i % 4 - j % 4) == 1}
    assert joined == [8]
    sizes, near = [], pairs.near_join
    monkeypatch.setattr(pairs, "near_join", lambda a, b, *rest: sizes.append((a.count(), b.count())) or near(a, b, *rest))
    assert pairs.in_pairing_range(projects, 13.0).count() == 160 and sizes == [(12, 4)]


def shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan()
    return (plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).treeString().count("Exchange hashpartitioning")


def test_phrases_are_looked_for_on_pages_of_their_rarest_token(spark, monkeypatch):
    """pages are shuffled as texts, to the phrases that may be on them; tokens are no rows to be joined."""
    sheets = spark.range(40).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("page"), F.concat(F.lit("Line "), "id", F.lit(" mill   rebuild")).alias("text"))
    phrases = spark.range(40).select(F.lit("d").alias("doc"), F.array(F.lit("line"), F.col("id").cast("string"), F.lit("mill")).alias("phrase"))
    asked, own = [], pages._search
    monkeypatch.setattr(pages, "_search", lambda of, what, wrapped: asked.append(what.count()) or own(of, what, wrapped))
    found = pages.find_phrases(sheets, phrases.unionByName(spark.createDataFrame([("d", ["line", "none"]), ("d", ["line 1", "mill"])], phrases.schema)))
    assert {(r.page, tuple(r.phrase), r.start, r["stop"]) for r in found.collect()} == {(i, ("line", str(i), "mill"), 0, 2) for i in range(40)} and asked == [40]
    wrapped = pages.find_wrapped(sheets, phrases.withColumn("page", F.col("phrase")[1].cast("int")).select("doc", "page", "phrase"))
    assert shuffles(wrapped) <= 3 and "Window" not in wrapped._jdf.queryExecution().optimizedPlan().toString() and wrapped.count() == 40


def test_cells_are_told_page_by_page(spark):
    """a page's cells come with its tokens, without a shuffle of tokens."""
    found = pages.cells(spark.createDataFrame([("d", 1, "Id 7   Goshen Tie\n --  x"), ("d", 2, None)], "doc string, page int, text string"))
    assert not shuffles(found)
    assert sorted(map(tuple, found.collect())) == [("d", 1, 0, 0, 4, "id 7"), ("d", 1, 0, 7, 17, "goshen tie"), ("d", 1, 1, 5, 6, "x")]


def test_nearest_pairs_are_told_by_place(spark, monkeypatch):
    """places are met once, and only the nearest of them are told apart by project."""
    joined, own = [], rules.near_join
    monkeypatch.setattr(rules, "near_join", lambda a, b, reach: joined.append((a.count(), b.count())) or own(a, b, reach))
    rows = spark.range(600).select(F.concat(F.lit("p"), "id").alias("id"), (32.0 + F.col("id") % 30 / 97).alias("lat"), (-81.0 + F.col("id") % 15 / 89).alias("lon"), (F.col("id") % 3 == 0).alias("own"))
    a, b = rows.filter("own"), rows.filter("NOT own")
    every = a.crossJoin(b.toDF("b_id", "lat2", "lon2", "o2")).select(F.col("id").alias("a_id"), "b_id", rules.geo.haversine_asin(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("miles"))
    got = rules.nearest_of_places(a, b, 9.0)
    assert rules.nearest_report(got).collect() == rules.nearest_report(every.filter("miles < 9")).collect()
    assert joined == [(10, 20)] and got.count() <= 1000


def shuffles_above_pairs(df) -> int:
    """Shuffles of rows for which miles are told already."""
    plan = df._jdf.queryExecution().executedPlan()
    lines = (plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).treeString().split("\n")
    return sum("Exchange hashpartitioning" in line for line in lines[: next(i for i, line in enumerate(lines) if "ATAN2" in line)])


@pytest.mark.parametrize("name", ["ground_filter", "flood_notes", "line_miles"])
def test_pairs_are_not_shuffled_to_what_is_told_of_projects(spark, sf_dir, name):
    """ground, stations and lines are joined to projects, before these are paired."""
    assert not shuffles_above_pairs(catalog.queries()[name](spark, sf_dir))


def test_endpoints_meet_before_their_projects(spark, monkeypatch):
    """pairs of projects are asked of endpoints that are near, in cells as wide as half a mile."""
    joined, own = [], pairs.near_join
    monkeypatch.setattr(pairs, "near_join", lambda a, b, reach, *rest: joined.append(reach) or own(a, b, reach, *rest))
    projects = spark.range(400).select(
        F.concat(F.lit("p"), "id").alias("id"), (F.col("id") % 2).alias("plan_ord"), F.when(F.col("id") % 2 == 0, "SC").otherwise("GA").alias("state"), (32.0 + F.floor(F.col("id") / 2) % 20 / 50).alias("lat"), (-81.0 + F.col("id") / 900).alias("lon"))
    ends = projects.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), F.lit("s").alias("name"), (F.col("lat") + F.col("pos") / 3).alias("lat"), (F.col("lon") - F.col("pos") / 7).alias("lon"))
    got = pairs.nearby_endpoints(projects, ends)
    a, b = (projects.join(ends.toDF("id", f"{s}_pos", "name", f"{s}_y", f"{s}_x"), "id").select(F.struct("id", "lat", "lon", "plan_ord").alias(s), f"{s}_pos", f"{s}_y", f"{s}_x") for s in "ab")
    far = pairs.geo.haversine
    want = a.crossJoin(b).filter("a.plan_ord < b.plan_ord").filter((far(F.col("a_y"), F.col("a_x"), F.col("b_y"), F.col("b_x")) <= 0.5) & (far(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) < 25))
    want = {(f"{r.a.id}__{r.b.id}", r.a_pos, r.b_pos) for r in want.collect()}
    assert {(r.pair, r.a_pos, r.b_pos) for r in got.collect()} == want and len(want) > 20 and joined == [0.5005]


@pytest.mark.parametrize("name", ["rank_score", "rank_distance", "rank_time", "rank_overlap", "csv_export"])
def test_pairs_are_put_in_order_with_their_keys_alone(spark, sf_dir, monkeypatch, name):
    """What is told of projects isn't shuffled and written with each pair that is ranked."""
    kinds, own = [], pairs.numbered
    monkeypatch.setattr(pairs, "numbered", lambda df, *order: kinds.append(dict(df.dtypes)) or own(df, *order))
    assert catalog.queries()[name](spark, sf_dir).count() > 100
    assert len(kinds) == 1 and len(kinds[0]) <= 9 and not any(k.startswith(("struct", "array")) for k in kinds[0].values())


def test_only_projects_that_may_pair_are_spread_over_cells(spark, monkeypatch):
    """F16: a project of the first plan is never the second of a pair, nor one of the last plan the first."""
    sides, own = [], pairs.near_join_of_kinds
    monkeypatch.setattr(pairs, "near_join_of_kinds", lambda rows, *rest: sides.extend(rows.filter(s).count() for s in rest[2]) or own(rows, *rest))
    day = F.lit("2000-01-01").cast("date")
    projects = spark.range(90).select(
        F.concat(F.lit("p"), "id").alias("id"), (F.col("id") % 3).alias("plan_ord"), F.when(F.col("id") % 3 == 2, "GA").otherwise("SC").alias("state"), (32.0 + F.col("id") / 500).alias("lat"), F.lit(-81.0).alias("lon"),
        F.lit(0.0).alias("radius_mi"), day.alias("isd"), day.alias("win_start"), day.alias("win_end"))
    assert pairs.distance_join(projects).count() == 60 * 30 and sides == [60, 30]
    assert pairs.distance_join(projects.filter("state = 'SC'")).count() == pairs.distance_join(projects.limit(0)).count() == 0
    # An early plan's project of one state goes before a late one's of another, wherever it stands.
    some = projects.withColumn("state", F.when(F.col("lat") < 32.0 + 44.5 / 500, "SC").otherwise("GA"))
    assert pairs.distance_join(some).count() == sum(i % 3 < j % 3 and (i < 45) != (j < 45) for i in range(90) for j in range(90)) > 0


def test_lines_are_compared_in_batches(spark):
    """miles of lines as by the functions over arrays, which aren't compiled; lines of one point, crossing and equal ones too."""
    lines = spark.range(40).select((F.col("id") % 20).alias("key"), F.col("id").alias("pos"), (33.0 + F.col("id") * 7 % 11 / 40).alias("lat"), (-81.0 + F.col("id") * 5 % 13 / 30).alias("lon"))
    lines = lines.unionByName(lines.filter("key > 9 AND key < 15").withColumn("pos", F.col("pos") + 50).withColumn("lat", F.col("lat") + 0.05)).filter("key > 2 OR pos < 20")
    legs = layers.legs_of_lines(lines)
    both = legs.select(F.struct("key", "legs").alias("a")).crossJoin(legs.select(F.struct("key", "legs").alias("b")))
    told = layers.lines_miles(both, legs).withColumn("want", layers.legs_miles(F.col("a.legs"), F.col("b.legs")))
    rows = told.select("miles", "want").collect()
    assert len(rows) == 400 and all(r.miles == pytest.approx(r.want, abs=1e-9) for r in rows) and sum(r.want == 0 for r in rows) > 25
    assert "ArrowEvalPython" in told.select("miles")._jdf.queryExecution().toString()
