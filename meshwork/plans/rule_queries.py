"""Queries over the rules of records, pairs and texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import editions, filters, overlay, rules
from ..operators.common import checkpointed
from ..sources.adapters import ENDPOINTS, FILINGS, GAZETTEER, PROJECTS, RECORDS, build, plain
from .edition_queries import CHANGES_CTE, ORDER_CTE, matched, ordered
from .pair_queries import HAV, PAIRS_CTE, pairs_with
from .place_queries import EDGES_CTE, HITS, edges_of, points_of

KINDS = "CASE area % 3 WHEN 0 THEN 'flood' WHEN 1 THEN 'habitat' ELSE 'protected' END"


def q_ground(spark, sf_dir):
    """Ground flags of both projects of a pair, and which filters it passes."""
    hits = overlay.contains(points_of(spark, sf_dir), edges_of(spark, sf_dir)).select("key", F.expr(KINDS).alias("kind"), F.concat(F.lit("area "), "area").alias("label"))
    checked = build(spark, sf_dir, PROJECTS).select(F.col("id").alias("key"), (F.col("ord") % 7 != 0).alias("checked"))
    ground = rules.project_ground(checked, hits)
    found = pairs_with(spark, sf_dir, ground.withColumnRenamed("key", "id"))
    both = found.select("id", rules.pair_ground(F.col("a.ground"), F.col("b.ground")).alias("ground"))
    g = F.col("ground")
    return both.select(
        "id", F.array_join(F.array_sort(g["habitat"]), ",").alias("habitat"), F.array_join(F.array_sort(g["protected"]), ",").alias("protected"),
        *[filters.ground_matches(g, k).alias(f"is_{k}") for k in filters.GROUNDS],
    )


SQL_GROUND = f"""WITH {PAIRS_CTE}, {EDGES_CTE}, hit AS ({HITS.format(k='key', p='points')}), told AS (
  SELECT id AS key, ord % 7 <> 0 AS checked, coalesce(bool_or(h.area % 3 = 0), false) AND ord % 7 <> 0 AS flood,
    CASE WHEN ord % 7 <> 0 THEN list('area ' || h.area) FILTER (WHERE h.area % 3 = 1) END AS habitat, CASE WHEN ord % 7 <> 0 THEN list('area ' || h.area) FILTER (WHERE h.area % 3 = 2) END AS protected
  FROM projects LEFT JOIN hit h ON h.key = id GROUP BY id, ord
), u AS (SELECT p.id, a.checked OR b.checked AS checked, a.flood OR b.flood AS flood, list_sort(list_distinct(list_concat(coalesce(a.habitat, []), coalesce(b.habitat, [])))) AS habitat,
  list_sort(list_distinct(list_concat(coalesce(a.protected, []), coalesce(b.protected, [])))) AS protected
  FROM pairs p JOIN told a ON a.key = p.a_id JOIN told b ON b.key = p.b_id WHERE certainty <> 'possible')
SELECT id, array_to_string(habitat, ',') AS habitat, array_to_string(protected, ',') AS protected, NOT checked AS is_unchecked, checked AND NOT flood AND len(habitat) + len(protected) = 0 AS is_clear,
  flood AS is_flood, len(habitat) > 0 AS is_habitat, len(protected) > 0 AS is_protected FROM u"""

#: The first plan's new list prints what was dropped: a quarter as cancelled, a quarter as completed.
DROPPED = "CASE WHEN step LIKE 'alpha%' AND CAST(substring(rkey, 2) AS INT) % 4 = 0 THEN 'cancelled' WHEN step LIKE 'alpha%' AND CAST(substring(rkey, 2) AS INT) % 4 = 1 THEN 'completed' END"


def q_removal_reasons(spark, sf_dir):
    """Why a project is no longer listed."""
    gone = matched(spark, sf_dir).filter("n IS NULL").select("step", "rkey", F.col("o.isd").alias("isd"))
    printed = gone.select("step", "rkey", F.expr(DROPPED).alias("status")).filter("status IS NOT NULL")
    return rules.removal_reasons(gone, printed, build(spark, sf_dir, FILINGS))


SQL_REASONS = f"""WITH {CHANGES_CTE}, gone AS (SELECT o.step, o.rkey, o.isd FROM o LEFT JOIN n USING (step, rkey) WHERE n.rkey IS NULL), t AS (SELECT *, {DROPPED} AS status FROM gone),
l AS (SELECT DISTINCT step FROM t WHERE status IS NOT NULL)
SELECT step, rkey, CASE WHEN status = 'cancelled' THEN 'Cancelled: listed in Table 3 of the new plan' WHEN status = 'completed' THEN 'Completed: listed in Table 4 of the new plan'
  WHEN step NOT IN (SELECT step FROM l) AND isd < f.fdate THEN 'No longer listed. Its in-service date (' || isd || ') was before the new list came out; the list doesn''t say whether it was finished or dropped.'
  ELSE 'No longer listed; the filing doesn''t say why.' END AS reason FROM t JOIN filings f ON f.id = t.step"""


def q_kept_locations(spark, sf_dir):
    """Places kept from the edition before, over all editions together."""
    told = rules.kept_locations(build(spark, sf_dir, RECORDS), editions.edition_steps(ordered(spark, sf_dir)))
    return told.select("filing", "rkey", F.round(F.col("lat").cast("double"), 6).alias("lat"), F.round(F.col("lon").cast("double"), 6).alias("lon"), "origin")


SQL_KEPT = f"""WITH {ORDER_CTE}, r AS ({plain(RECORDS)})
SELECT r.filing, r.rkey, round(CAST(o.lat AS DOUBLE), 6) AS lat, round(CAST(o.lon AS DOUBLE), 6) AS lon, CASE WHEN o.lat IS NOT NULL THEN 'kept' ELSE 'afresh' END AS origin
FROM r JOIN steps s ON s.id = r.filing LEFT JOIN r o ON o.filing = s.previous AND o.rkey = r.rkey AND o.lat IS NOT NULL"""


def q_change_items(spark, sf_dir):
    """Items of two kinds with the app id of projects that are current; removed ones have none."""
    c = rules.items_of(editions.project_changes(matched(spark, sf_dir)), ["removed", "cost"])
    steps = editions.edition_steps(ordered(spark, sf_dir)).filter("is_current").select(F.col("id").alias("filing"))
    current = build(spark, sf_dir, RECORDS).join(F.broadcast(steps), "filing").select("plan", "rkey", F.col("ord").alias("app"))
    told = c.withColumn("plan", F.substring_index("step", "-", 1)).join(current, ["plan", "rkey"], "left")
    app = F.when(F.col("kind") != "removed", F.concat(F.lit("P"), F.col("app").cast("string")))
    return told.select("step", "rkey", F.array_join("kinds", "+").alias("kinds"), app.alias("app_id"))


SQL_ITEMS = f"""WITH {CHANGES_CTE}, cur AS (SELECT r.plan, r.rkey, r.ord FROM records r JOIN steps s ON s.id = r.filing AND s.is_current)
SELECT c.step, c.rkey, CASE WHEN what <> '' THEN what ELSE kind END AS kinds, CASE WHEN kind <> 'removed' THEN 'P' || cur.ord END AS app_id
FROM changes c LEFT JOIN cur ON cur.plan = string_split(c.step, '-')[1] AND cur.rkey = c.rkey WHERE kind = 'removed' OR contains(what, 'cost')"""


def q_filing_entries(spark, sf_dir):
    """O3: entries of the log, the newest first; one filing has no date."""
    f = build(spark, sf_dir, FILINGS).withColumn("fdate", F.when(F.col("id") != "gamma-1995", F.col("fdate")))
    return rules.filing_entries(f).select("id", "entry")


SQL_ENTRIES = f"WITH f AS ({plain(FILINGS)}) SELECT id, row_number() OVER (ORDER BY CASE WHEN id <> 'gamma-1995' THEN CAST(fdate AS VARCHAR) ELSE '' END DESC, id DESC) AS entry FROM f"


def q_plan_editions(spark, sf_dir):
    """Plans in order, declared or seen on projects alone, and their current editions."""
    p = build(spark, sf_dir, PROJECTS)
    plans = rules.plan_dimension(p.filter("plan <> 'gamma'").select("plan").distinct().withColumn("at", F.when(F.col("plan") == "beta", 0).otherwise(1)), p)
    filings = build(spark, sf_dir, FILINGS).withColumn("url", F.concat(F.lit("u/"), "id")).withColumn("pos", F.col("edition"))
    told = plans.withColumn("url", F.when(F.col("plan") == "alpha", "u/alpha-1996")).withColumn("title", F.concat("plan", F.lit(" plan 2020 - 2024")))
    return plans.join(rules.current_editions(told, filings.filter("plan <> 'gamma'")), "plan").select("plan", "at", "edition")


SQL_PLAN_EDITIONS = f"""WITH f AS ({plain(FILINGS)}) SELECT 'beta' AS plan, 1::BIGINT AS at, (SELECT CAST(edition AS VARCHAR) FROM f WHERE plan = 'beta' ORDER BY fdate DESC, edition DESC LIMIT 1) AS edition
UNION ALL SELECT 'alpha', 2, '1996' UNION ALL SELECT 'gamma', 3, '2020–2024'"""


def q_project_views(spark, sf_dir):
    """What the map shows of a project."""
    e = build(spark, sf_dir, ENDPOINTS).filter("lat IS NOT NULL").groupBy("id").agg(F.count("*").alias("located"), F.max("method").alias("method"))
    p = build(spark, sf_dir, PROJECTS).join(e, "id", "left").withColumn("located", F.coalesce("located", F.lit(0)))
    edited, on_map = F.col("ord") % 10 == 0, F.col("state").isin("SC")
    kind = F.when(edited, "set by a user").when(F.col("located") >= 2, "line between stations").when(F.col("located") == 1, "one station").otherwise("zone")
    center = F.when(on_map, F.col("lat"))
    issues = F.array_compact(F.array(F.when(~on_map, "outside the covered states"), F.when(F.col("located") < 2, "no station for an endpoint"), F.when(edited, "moved by hand")))
    kept = F.filter(issues, lambda x: ~x.startswith("no station") & ~x.startswith("route rejected"))
    return p.select(
        "id", F.concat_ws(":", F.col("plan"), F.col("ord").cast("string")).alias("override_key"), kind.alias("point_kind"), F.col("method").alias("center_method"),
        (center.isNotNull() & (F.year("isd") <= 1998) & F.lower("name").contains("1")).alias("visible"), (F.col("located") + center.isNotNull().cast("int")).alias("points"), F.array_join(kept, "; ").alias("notes"),
    )


SQL_VIEWS = f"""WITH p AS ({plain(PROJECTS)}), e AS (SELECT id, count(*) AS located, max(method) AS method FROM ({plain(ENDPOINTS)}) WHERE lat IS NOT NULL GROUP BY id), t AS (SELECT p.*, coalesce(located, 0) AS located, method FROM p LEFT JOIN e USING (id))
SELECT id, plan || ':' || ord AS override_key, CASE WHEN ord % 10 = 0 THEN 'set by a user' WHEN located >= 2 THEN 'line between stations' WHEN located = 1 THEN 'one station' ELSE 'zone' END AS point_kind, method AS center_method,
  CASE WHEN state = 'SC' AND lat IS NOT NULL THEN year(isd) <= 1998 AND contains(lower(name), '1') ELSE false END AS visible,
  located + CASE WHEN state = 'SC' AND lat IS NOT NULL THEN 1 ELSE 0 END AS points, array_to_string(list_filter([CASE WHEN state <> 'SC' THEN 'outside the covered states' END, CASE WHEN ord % 10 = 0 THEN 'moved by hand' END], lambda x: x IS NOT NULL), '; ') AS notes FROM t"""

MEANT = f"SELECT e.id, e.pos, e.name, CAST(substring(e.name, 2) AS BIGINT) AS n, CAST(p.lat AS DOUBLE) AS a_lat, CAST(p.lon AS DOUBLE) AS a_lon, e.ord % 6 = 0 AS mismatch, e.ord, e.lat, e.lon FROM ({ENDPOINTS}) e JOIN ({PROJECTS}) q ON q.id = e.id JOIN ({PROJECTS}) p ON p.id = e.id"


def q_located(spark, sf_dir):
    """The trust cascade of each endpoint, with confidence and radius by method, override and owner."""
    e = build(spark, sf_dir, MEANT)
    g = build(spark, sf_dir, GAZETTEER).select(F.concat(F.lit("S"), F.col("item").cast("string")).alias("name"), "item", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    manual = e.filter("ord % 29 = 0 AND pos = 0 AND lat IS NOT NULL").select("id", "pos", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.when(F.expr("ord % 58 = 0"), "medium").alias("confidence"), F.when(F.expr("ord % 58 = 0"), 0.75).alias("radius_mi"))
    towns = e.filter("pos = 0 AND a_lat IS NOT NULL AND ord % 4 <> 0").select("id", (F.col("a_lat") + 0.05).alias("lat"), F.col("a_lon").alias("lon"))
    found = rules.located_endpoints(e, manual, g.filter("item % 3 = 0").drop("item"), g.filter("item % 3 = 1").withColumn("method", F.expr("CASE WHEN item % 6 = 1 THEN 'osm-exact' ELSE 'osm-partial' END")).drop("item"), towns)
    return found.select("id", "pos", "method", "confidence", "radius_mi", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


ASIN = "CASE WHEN {a_lat} + {a_lon} + {b_lat} + {b_lon} IS NOT NULL THEN 2 * 3958.8 * asin(sqrt(least(1, pow(sin(radians({b_lat} - {a_lat}) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin(radians({b_lon} - {a_lon}) / 2), 2)))) END"
SQL_LOCATED = f"""WITH e AS ({plain(MEANT)}), g AS (SELECT item, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({plain(GAZETTEER)})), t AS (
SELECT e.id, e.pos, e.mismatch, CASE WHEN e.ord % 29 = 0 AND e.pos = 0 AND e.lat IS NOT NULL THEN 'manual'
  WHEN g.item % 3 = 0 AND (a_lat IS NULL OR {ASIN.format(a_lat='g.lat', a_lon='g.lon', b_lat='a_lat', b_lon='a_lon')} <= 80) THEN 'reference' WHEN g.item % 6 = 1 THEN 'osm-exact' WHEN g.item % 3 = 1 THEN 'osm-partial'
  WHEN a_lat IS NOT NULL AND e.ord % 4 <> 0 THEN 'town' END AS method, e.ord, e.lat AS e_lat, e.lon AS e_lon, g.lat AS g_lat, g.lon AS g_lon, a_lat, a_lon FROM e LEFT JOIN g ON g.item = e.n)
SELECT id, pos, method, CASE WHEN method IS NULL THEN 'none' WHEN method = 'manual' THEN CASE WHEN ord % 58 = 0 THEN 'medium' ELSE 'high' END WHEN method = 'town' THEN 'low' WHEN mismatch OR method = 'osm-partial' THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN method = 'town' THEN 6.0 WHEN method = 'manual' THEN CASE WHEN ord % 58 = 0 THEN 0.75 ELSE 0.5 END WHEN method IS NOT NULL THEN CASE WHEN mismatch OR method = 'osm-partial' THEN 1.5 ELSE 0.5 END END::DOUBLE AS radius_mi,
  round(CASE method WHEN 'manual' THEN CAST(e_lat AS DOUBLE) WHEN 'town' THEN a_lat + 0.05 ELSE CASE WHEN method IS NOT NULL THEN g_lat END END, 6) AS lat,
  round(CASE method WHEN 'manual' THEN CAST(e_lon AS DOUBLE) WHEN 'town' THEN a_lon ELSE CASE WHEN method IS NOT NULL THEN g_lon END END, 6) AS lon FROM t"""

CHOICES = f"SELECT e.id, e.pos, c.choice, CAST(e.lat AS DOUBLE) + c.choice * CAST((e.ord * 13 + e.pos * 7) % 11 - 5 AS DOUBLE) / 20 AS lat, CAST(e.lon AS DOUBLE) - c.choice * CAST((e.ord * 5 + e.pos * 3) % 13 - 6 AS DOUBLE) / 20 AS lon FROM ({ENDPOINTS}) e CROSS JOIN (SELECT 0 AS choice UNION ALL SELECT 1 UNION ALL SELECT 2) c WHERE e.lat IS NOT NULL"


def q_disambiguated(spark, sf_dir):
    """Joint choice among the places that the endpoints of a project may be, near its anchor where it has one."""
    return rules.best_combination(build(spark, sf_dir, CHOICES), build(spark, sf_dir, ZONE_ANCHORS))


#: Every second project has a place from its zone.
ZONE_ANCHORS = f"SELECT id, CAST(lat AS DOUBLE) + 0.1 AS lat, CAST(lon AS DOUBLE) - 0.1 AS lon FROM ({PROJECTS}) p WHERE lat IS NOT NULL AND ord % 2 = 0"


_FAR = lambda a, b: f"coalesce({ASIN.format(a_lat=f'{a}.lat', a_lon=f'{a}.lon', b_lat=f'{b}.lat', b_lon=f'{b}.lon')}, 0)"
SQL_DISAMBIGUATED = f"""WITH c AS ({plain(CHOICES)}), f AS (SELECT id, min(pos) AS p0, max(pos) AS p2 FROM c GROUP BY id), t AS (SELECT c.*, CASE WHEN pos = p0 THEN 0 WHEN pos = p2 THEN 2 ELSE 1 END AS turn FROM c JOIN f USING (id)),
k AS (SELECT x.id, x.choice AS choice0, y.choice AS choice1, z.choice AS choice2, {_FAR('x', 'y')} + {_FAR('x', 'z')} + {_FAR('y', 'z')} + {_FAR('x', 'n')} + {_FAR('y', 'n')} + {_FAR('z', 'n')} AS cost
  FROM (SELECT * FROM t WHERE turn = 0) x LEFT JOIN (SELECT * FROM t WHERE turn = 1) y ON y.id = x.id LEFT JOIN (SELECT * FROM t WHERE turn = 2) z ON z.id = x.id LEFT JOIN ({plain(ZONE_ANCHORS)}) n ON n.id = x.id)
SELECT id, choice0, choice1, choice2, round(cost, 6) AS cost FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(cost, 9), choice0, choice1 NULLS FIRST, choice2 NULLS FIRST) = 1"""


def q_reference_points(spark, sf_dir):
    """The first point printed for a name, and how many lie elsewhere."""
    e = build(spark, sf_dir, ENDPOINTS).filter("lat IS NOT NULL").select(F.concat_ws(":", "state", "name").alias("key"), (F.col("ord") * 3 + F.col("pos")).alias("ord"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return rules.reference_points(e).select("key", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "issues")


SQL_REFERENCES = f"""WITH e AS (SELECT state || ':' || name AS key, ord * 3 + pos AS nth, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({plain(ENDPOINTS)}) WHERE lat IS NOT NULL),
f AS (SELECT key, arg_min(lat, nth) AS lat, arg_min(lon, nth) AS lon FROM e GROUP BY key)
SELECT f.key, round(f.lat, 6) AS lat, round(f.lon, 6) AS lon, count(*) FILTER (WHERE {ASIN.format(a_lat='e.lat', a_lon='e.lon', b_lat='f.lat', b_lon='f.lon')} > 0.05) AS issues FROM f JOIN e USING (key) GROUP BY f.key, f.lat, f.lon"""


def q_cost_checks(spark, sf_dir):
    """M3, M4: in which unit an order's total agrees with the amount printed, and its yearly amounts with it."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("double").alias("total"))
    years = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(F.col("l_extendedprice").cast("double")), 2).alias("yearly"))
    k, own = F.col("o_orderkey") % 4, F.col("o_orderkey") % 4 == 3
    unit = F.when(k == 1, 1000.0).otherwise(1.0)
    printed = F.when(k == 1, F.floor(F.col("total") / 10) / 100).when(k == 2, F.col("total") * 2).otherwise(F.col("total"))
    told = o.join(years, "o_orderkey", "left").withColumn("unit", rules.cost_agreement(F.col("total"), printed, unit, own))
    # Half of the orders have a total that is the sum of their items, within a thousandth.
    near = F.when(F.col("o_orderkey") % 2 == 0, F.round(F.col("yearly") * (1 + (F.col("o_orderkey") % 16) / 2000), 2)).otherwise(F.col("total"))
    differs = ~rules.amounts_agree(F.col("yearly"), near)
    return told.select("o_orderkey", "unit", F.col("unit").isNull().alias("disagrees"), F.coalesce(differs, F.lit(False)).alias("yearly_differs"))


SQL_COSTS = """WITH y AS (SELECT l_orderkey, round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS yearly FROM lineitem GROUP BY l_orderkey), t AS (
SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS total, CASE o_orderkey % 4 WHEN 1 THEN floor(CAST(o_totalprice AS DOUBLE) / 10) / 100 WHEN 2 THEN CAST(o_totalprice AS DOUBLE) * 2 ELSE CAST(o_totalprice AS DOUBLE) END AS printed,
  CASE WHEN o_orderkey % 4 = 1 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS unit, yearly FROM orders LEFT JOIN y ON l_orderkey = o_orderkey),
u AS (SELECT *, CASE WHEN abs(total - printed * unit) <= 0.005 * printed * unit + 1 THEN unit END AS used FROM t)
SELECT o_orderkey, used AS unit, used IS NULL AS disagrees, coalesce(abs(yearly - near) > 0.005 * abs(near) + 1, false) AS yearly_differs FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN round(yearly * (1 + (o_orderkey % 16) / 2000), 2) ELSE total END AS near FROM u)"""


def q_accepted(spark, sf_dir):
    """Editions whose records are accepted; numbers of the checked edition bind later ones only."""
    shapes = editions.edition_shape(build(spark, sf_dir, RECORDS).withColumn("isd", F.when(~((F.col("edition") == 1997) & (F.col("ord") % 5 < 3)), F.col("isd"))))
    shapes = shapes.withColumns({"plan": F.substring_index("filing", "-", 1), "edition": F.substring_index("filing", "-", -1).cast("long")})
    checked = shapes.filter("edition = 1995").select("plan", F.col("edition").alias("c_edition"), F.col("records").alias("c_records"), F.col("dated").alias("c_dated"))
    return rules.accepted(shapes, checked)


SQL_ACCEPTED = f"""WITH s AS (SELECT filing, plan, edition, count(*) AS records, count(CASE WHEN NOT (edition = 1997 AND ord % 5 < 3) THEN isd END) AS dated FROM ({plain(RECORDS)}) GROUP BY filing, plan, edition),
t AS (SELECT s.filing, list_filter([CASE WHEN s.dated < 0.5 * s.records THEN 'few dates' END, CASE WHEN s.edition > c.edition AND s.records < 0.5 * c.records THEN 'few records' END,
  CASE WHEN s.edition > c.edition AND s.dated / s.records < c.dated / c.records - 0.25 THEN 'fewer dates' END], lambda x: x IS NOT NULL) AS why FROM s LEFT JOIN s c ON c.plan = s.plan AND c.edition = 1995)
SELECT filing, len(why) = 0 AS accepted, array_to_string(why, '; ') AS why FROM t"""


def q_pair_report(spark, sf_dir):
    """The ten nearest pairs of a plan's projects and others, whatever their states."""
    # Written once: both sides are read from it.
    p = checkpointed(build(spark, sf_dir, PROJECTS).filter("lat IS NOT NULL").select("id", "plan", "lat", "lon"))
    return rules.nearest_report(rules.nearest_of_places(p.filter("plan = 'alpha'"), p.filter("plan <> 'alpha'"), 25.0))


SQL_REPORT = f"""WITH p AS (SELECT id, plan, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({plain(PROJECTS)}) WHERE lat IS NOT NULL)
SELECT a_id, b_id, round(miles, 1) AS miles FROM (SELECT a.id AS a_id, b.id AS b_id, {ASIN.format(a_lat='a.lat', a_lon='a.lon', b_lat='b.lat', b_lon='b.lon')} AS miles FROM p a JOIN p b ON a.plan = 'alpha' AND b.plan <> 'alpha') WHERE miles < 25 ORDER BY round(miles, 1), a_id, b_id LIMIT 10"""


def q_run_summary(spark, sf_dir):
    """Counts and filled fields of each edition, and evenly spaced samples of it, eight at most."""
    w = Window.partitionBy("filing").orderBy("ord")
    r = build(spark, sf_dir, RECORDS).withColumns({"at": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("filing"))})
    step = F.greatest(F.floor(F.col("n") / 6), F.lit(1))
    sample = F.when((F.col("at") % step == 0) | (F.col("at") == F.col("n") - 1), F.struct("at", "rkey"))
    told = r.groupBy("filing").agg(F.count("*").alias("records"), F.count("isd").alias("dated"), F.count_if(F.col("name") != "").alias("named"), F.sort_array(F.collect_list(sample)).alias("s"))
    return told.select("filing", "records", "dated", "named", F.array_join(F.transform(F.slice("s", 1, 8), lambda x: x["rkey"]), ",").alias("sample"), F.row_number().over(Window.orderBy(F.desc("records"), "filing")).cast("long").alias("place"))


SQL_SUMMARY = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY filing ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY filing) AS n FROM ({plain(RECORDS)})),
k AS (SELECT filing, rkey, row_number() OVER (PARTITION BY filing ORDER BY pos) AS nth FROM r WHERE pos % greatest(n // 6, 1) = 0 OR pos = n - 1), s AS (SELECT filing, string_agg(rkey, ',' ORDER BY nth) AS sample FROM k WHERE nth <= 8 GROUP BY filing),
c AS (SELECT filing, count(*) AS records, count(isd) AS dated, count(*) FILTER (WHERE name <> '') AS named FROM r GROUP BY filing)
SELECT c.*, sample, row_number() OVER (ORDER BY records DESC, filing) AS place FROM c JOIN s USING (filing)"""


def q_table_joins(spark, sf_dir):
    """Rows of a list without a detail page, with another year there, or removed as well; pages of no row."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("at"))
    first = o.groupBy("key").agg(F.min_by("y", "at").alias("detail"), F.max((F.col("status") == "P").cast("int")).alias("removed"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 7 + 1992).cast("int").alias("listed"))
    told = rows.join(first, "key", "left")
    issue = F.array_join(F.array_compact(F.array(F.when(F.col("detail").isNull(), "no page"), F.when(F.col("detail") != F.col("listed"), "year differs"), F.when(F.col("removed") == 1, "also removed"))), "; ")
    unused = first.join(rows, "key", "left_anti").select("key", F.lit("page of no row").alias("issue"))
    return told.select("key", issue.alias("issue")).filter("issue <> ''").unionByName(unused)


SQL_TABLE_JOINS = """WITH f AS (SELECT o_custkey AS key, arg_min(year(o_orderdate), o_orderkey) AS detail, bool_or(o_orderstatus = 'P') AS removed FROM orders GROUP BY o_custkey),
r AS (SELECT c_custkey AS key, c_custkey % 7 + 1992 AS listed FROM customer),
t AS (SELECT r.key, array_to_string(list_filter([CASE WHEN f.key IS NULL THEN 'no page' END, CASE WHEN detail <> listed THEN 'year differs' END, CASE WHEN removed THEN 'also removed' END], lambda x: x IS NOT NULL), '; ') AS issue FROM r LEFT JOIN f USING (key))
SELECT key, issue FROM t WHERE issue <> '' UNION ALL SELECT key, 'page of no row' FROM f WHERE key NOT IN (SELECT key FROM r)"""


def q_text_rules(spark, sf_dir):
    """Codes, titles, spellings, inverted names, stated miles and digests of texts."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9 \n]", ""), "[ \n]+")
    first, second = F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))
    at = F.locate("the", F.lower("text"))
    amounts = F.transform(F.regexp_extract_all("text", F.lit(r"([0-9]{1,3}) "), F.lit(1)), lambda x: x.cast("int"))
    return d.select(
        "doc_id", F.col("text").rlike(r"(?<![A-Za-z0-9-])MIT(?![A-Za-z0-9-])").alias("whole_code"), F.replace(F.replace(F.lit("{kind}: {id}"), F.lit("{kind}"), F.col("source")), F.lit("{id}"), F.col("doc_id").cast("string")).alias("title"),
        F.when(at > 0, F.substring("text", at, F.lit(3))).alias("spelling"), F.array_join(F.slice(F.array_distinct(words), 1, 5), " ").alias("first_words"),
        (F.size(F.array_except(F.array(F.lit("the"), F.lit("of")), words)) <= 1).alias("nearly_all"), F.concat_ws(" ", second, F.lower(first)).alias("inverted"), F.array_max(amounts).alias("most"),
        F.sha2(F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit(',"source":"'), F.col("source"), F.lit('"}')), 256).alias("digest"),
    )


SQL_TEXT_RULES = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents), w AS (SELECT *, string_split_regex(regexp_replace(lower(text), '[^a-z0-9 \n]', '', 'g'), '[ \n]+') AS words, regexp_extract_all(text, '([0-9]{1,3}) ', 1) AS amounts FROM d)
SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9-])MIT([^A-Za-z0-9-]|$)') AS whole_code, source || ': ' || doc_id AS title, CASE WHEN strpos(lower(text), 'the') > 0 THEN substr(text, strpos(lower(text), 'the'), 3) END AS spelling,
  array_to_string(list_filter(words, lambda x, i: list_position(words, x) = i)[1:5], ' ') AS first_words, list_contains(words, 'the') OR list_contains(words, 'of') AS nearly_all,
  split_part(text, ' ', 2) || ' ' || lower(split_part(text, ' ', 1)) AS inverted, CAST(list_max(list_transform(amounts, lambda x: CAST(x AS INT))) AS INT) AS most, sha256('{"id":' || doc_id || ',"source":"' || source || '"}') AS digest FROM w"""


def q_date_checks(spark, sf_dir):
    """A second printing of a date against the first, a planned month against the list, and which date a filing has."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    k = F.col("o_orderkey") % 5
    start = F.when(k < 2, F.col("d")).when(k == 2, F.trunc("d", "month")).otherwise(F.trunc("d", "year"))
    end = F.when(k < 2, F.col("d")).when(k == 2, F.last_day("d")).otherwise(F.date_add(F.add_months(F.trunc("d", "year"), 12), -1))
    other = F.when(k == 4, F.add_months("d", 24)).otherwise(F.col("d"))
    told = F.when((other < start) | (other > end), "disjoint").when(start < end, "less precise").otherwise("agrees")
    printed = F.when(k != 3, F.date_format("d", "MMMM yyyy"))
    month = F.months_between(F.trunc("d", "month"), F.to_date(printed, "MMMM yyyy")).cast("int")
    basis = F.when(k == 0, "flag").when(k == 1, "printed").when(k == 2, "metadata").otherwise("unknown")
    filed = F.coalesce(F.when(k == 0, F.col("d")), F.when(k == 1, F.date_add("d", 1)), F.when(k == 2, F.date_add("d", 2)))
    return o.select("o_orderkey", told.alias("printing"), month.alias("months_off"), basis.alias("basis"), filed.cast("string").alias("filed"))


SQL_DATE_CHECKS = """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS k FROM orders), t AS (SELECT *, CASE WHEN k < 2 THEN d WHEN k = 2 THEN CAST(date_trunc('month', d) AS DATE) ELSE CAST(date_trunc('year', d) AS DATE) END AS s,
CASE WHEN k < 2 THEN d WHEN k = 2 THEN last_day(d) ELSE make_date(year(d), 12, 31) END AS e, CASE WHEN k = 4 THEN CAST(d + INTERVAL 24 MONTH AS DATE) ELSE d END AS other FROM o)
SELECT o_orderkey, CASE WHEN other < s OR other > e THEN 'disjoint' WHEN s < e THEN 'less precise' ELSE 'agrees' END AS printing, CASE WHEN k <> 3 THEN 0 END AS months_off,
  CASE k WHEN 0 THEN 'flag' WHEN 1 THEN 'printed' WHEN 2 THEN 'metadata' ELSE 'unknown' END AS basis, CASE WHEN k < 3 THEN CAST(d + CAST(k AS INT) AS VARCHAR) END AS filed FROM t"""

QUERIES = {"ground_filter": q_ground, "removal_reasons": q_removal_reasons, "kept_locations": q_kept_locations, "change_items": q_change_items, "filing_entries": q_filing_entries, "plan_editions": q_plan_editions,
           "project_views": q_project_views, "located_endpoints": q_located, "disambiguated": q_disambiguated, "reference_points": q_reference_points, "cost_checks": q_cost_checks, "accepted": q_accepted,
           "pair_report": q_pair_report, "run_summary": q_run_summary, "table_joins": q_table_joins, "text_rules": q_text_rules, "date_checks": q_date_checks}
SQL = {"ground_filter": SQL_GROUND, "removal_reasons": SQL_REASONS, "kept_locations": SQL_KEPT, "change_items": SQL_ITEMS, "filing_entries": SQL_ENTRIES, "plan_editions": SQL_PLAN_EDITIONS,
       "project_views": SQL_VIEWS, "located_endpoints": SQL_LOCATED, "disambiguated": SQL_DISAMBIGUATED, "reference_points": SQL_REFERENCES, "cost_checks": SQL_COSTS, "accepted": SQL_ACCEPTED,
       "pair_report": SQL_REPORT, "run_summary": SQL_SUMMARY, "table_joins": SQL_TABLE_JOINS, "text_rules": SQL_TEXT_RULES, "date_checks": SQL_DATE_CHECKS}
