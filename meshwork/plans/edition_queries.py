"""Queries over editions and their changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import editions
from ..sources.adapters import FILINGS, RECORDS, build, plain
from .pair_queries import HAV


def ordered(spark, sf_dir):
    return editions.edition_order(build(spark, sf_dir, FILINGS))


def q_order(spark, sf_dir):
    """Replay order, previous and closest edition, baseline and current."""
    s = editions.edition_steps(ordered(spark, sf_dir))
    return s.select("id", "plan", "seq", "previous", "closest", "is_baseline", "is_current")


ORDER_CTE = f"""filings AS ({plain(FILINGS)}), nth AS (
  SELECT *, row_number() OVER w AS nth, max(fdate) OVER (PARTITION BY plan ORDER BY edition, fdate, id ROWS UNBOUNDED PRECEDING) AS merge FROM filings WINDOW w AS (PARTITION BY plan ORDER BY edition, fdate, id)
), heads AS (SELECT plan, row_number() OVER (ORDER BY edition, fdate, plan_ord) AS plan_at FROM nth WHERE nth = 1),
ordered AS (SELECT nth.*, plan_at, row_number() OVER (ORDER BY merge, plan_at, nth) AS seq FROM nth JOIN heads USING (plan)),
steps AS (SELECT *, lag(id) OVER p AS previous, coalesce(lag(id) OVER p, lead(id) OVER p) AS closest, row_number() OVER p = 1 AS is_baseline, lead(id) OVER p IS NULL AS is_current
  FROM ordered WINDOW p AS (PARTITION BY plan ORDER BY seq))"""
SQL_ORDER = f"WITH {ORDER_CTE} SELECT id, plan, seq, previous, closest, is_baseline, is_current FROM steps"


def q_snapshots(spark, sf_dir):
    """Every plan's latest edition at each filing."""
    return editions.snapshots(ordered(spark, sf_dir))


SQL_SNAPSHOTS = f"""WITH {ORDER_CTE} SELECT o.id, s.plan AS other_plan, s.id AS latest FROM ordered o JOIN ordered s ON s.seq <= o.seq
QUALIFY row_number() OVER (PARTITION BY o.id, s.plan ORDER BY s.seq DESC) = 1"""


def matched(spark, sf_dir):
    steps = editions.edition_steps(ordered(spark, sf_dir)).filter("previous IS NOT NULL").select(F.col("id").alias("step"), "previous")
    r = build(spark, sf_dir, RECORDS)
    old = r.join(F.broadcast(steps), r["filing"] == steps["previous"])
    new = r.join(F.broadcast(steps), r["filing"] == steps["step"])
    return editions.match_unique(old, new)


def q_changes(spark, sf_dir):
    """J9 for unique keys, E14: changes of every step."""
    c = editions.project_changes(matched(spark, sf_dir))
    return c.select("step", "rkey", "kind", F.array_join("what", "+").alias("what"), "days", "old_cost", "cost")


CHANGES_CTE = f"""{ORDER_CTE}, records AS ({plain(RECORDS)}), p AS (SELECT id AS step, previous FROM steps WHERE previous IS NOT NULL),
o AS (SELECT p.step, r.* FROM records r JOIN p ON r.filing = p.previous), n AS (SELECT p.step, r.* FROM records r JOIN p ON r.filing = p.step),
m AS (SELECT coalesce(o.step, n.step) AS step, coalesce(o.rkey, n.rkey) AS rkey, o.rkey IS NULL AS is_new, n.rkey IS NULL AS is_gone, o.name IS DISTINCT FROM n.name AS named, o.isd IS DISTINCT FROM n.isd AS dated,
  coalesce(o.cost_cents, 0) <> 0 AND coalesce(n.cost_cents, 0) <> 0 AND o.cost_cents <> n.cost_cents AS costed, datediff('day', o.isd, n.isd) AS days, o.cost_cents AS old_cost, n.cost_cents AS cost
  FROM o FULL JOIN n ON o.step = n.step AND o.rkey = n.rkey),
changes AS (SELECT step, rkey, CASE WHEN is_new THEN 'added' WHEN is_gone THEN 'removed' ELSE 'changed' END AS kind, CASE WHEN is_new OR is_gone THEN '' ELSE array_to_string(list_filter([CASE WHEN named THEN 'name' END, CASE WHEN dated THEN 'date' END, CASE WHEN costed THEN 'cost' END], lambda x: x IS NOT NULL), '+') END AS what,
  CASE WHEN NOT is_new AND NOT is_gone THEN days END AS days, CASE WHEN NOT is_new AND NOT is_gone AND costed THEN old_cost END AS old_cost, CASE WHEN NOT is_new AND NOT is_gone AND costed THEN cost END AS cost
  FROM m WHERE is_new OR is_gone OR named OR dated OR costed)"""
SQL_CHANGES = f"WITH {CHANGES_CTE} SELECT * FROM changes"


def q_counts(spark, sf_dir):
    """A10: counts of every event."""
    return editions.change_counts(editions.project_changes(matched(spark, sf_dir)))


SQL_COUNTS = f"""WITH {CHANGES_CTE} SELECT step, count(*) FILTER (WHERE kind = 'added') AS added, count(*) FILTER (WHERE kind = 'removed') AS removed, count(*) FILTER (WHERE contains(what, 'date')) AS rescheduled,
count(*) FILTER (WHERE contains(what, 'name')) AS renamed, count(*) FILTER (WHERE contains(what, 'cost')) AS recosted FROM changes GROUP BY step"""


def q_kinds(spark, sf_dir):
    """Changes by kind, kinds in a fixed order, zeros kept."""
    kinds = ["new", "gone", "timing", "added", "removed", "date", "name", "cost"]
    c = editions.project_changes(matched(spark, sf_dir))
    each = c.select(F.explode(F.when(F.size("what") > 0, F.col("what")).otherwise(F.array("kind"))).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    dim = c.sparkSession.createDataFrame([(i, k) for i, k in enumerate(kinds)], "pos int, item string")
    return dim.join(each, "item", "left").select("pos", "item", F.coalesce("n", F.lit(0)).alias("n"))


SQL_KINDS = f"""WITH {CHANGES_CTE}, e AS (SELECT unnest(CASE WHEN what <> '' THEN string_split(what, '+') ELSE [kind] END) AS item FROM changes),
d AS (SELECT * FROM (VALUES (0, 'new'), (1, 'gone'), (2, 'timing'), (3, 'added'), (4, 'removed'), (5, 'date'), (6, 'name'), (7, 'cost')) t(pos, item))
SELECT d.pos, d.item, count(e.item) AS n FROM d LEFT JOIN e USING (item) GROUP BY d.pos, d.item"""


def q_pair_changes(spark, sf_dir):
    """Pairs that appear, go or move between yearly snapshots."""
    r = build(spark, sf_dir, RECORDS).withColumn("plan_ord", F.when(F.col("plan") == "alpha", 0).when(F.col("plan") == "beta", 1).otherwise(2))
    after = editions.qualifying_pairs(r.withColumn("snap", F.col("edition").cast("int")), 10.0)
    first = r.agg(F.min("edition"), F.max("edition")).first()
    before = editions.qualifying_pairs(r.withColumn("snap", (F.col("edition") + 1).cast("int")), 10.0)
    c = editions.pair_changes(before, after)
    return c.filter((F.col("snap") > first[0]) & (F.col("snap") <= first[1]))


SQL_PAIR_CHANGES = f"""WITH records AS (SELECT *, CASE plan WHEN 'alpha' THEN 0 WHEN 'beta' THEN 1 ELSE 2 END AS plan_ord FROM ({plain(RECORDS)})),
q AS (SELECT a.edition AS snap, a.plan_ord AS a_plan, a.rkey AS a_key, b.plan_ord AS b_plan, b.rkey AS b_key, {HAV.format(r=3958.7613, a='a', b='b')} AS miles, abs(datediff('day', a.isd, b.isd)) AS gap
  FROM records a JOIN records b ON a.edition = b.edition AND a.plan_ord < b.plan_ord AND a.state <> b.state),
p AS (SELECT * FROM q WHERE miles < 10), before AS (SELECT snap + 1 AS snap, a_plan, a_key, b_plan, b_key, miles, gap FROM p),
j AS (SELECT coalesce(p.snap, o.snap) AS snap, coalesce(p.a_plan, o.a_plan) AS a_plan, coalesce(p.a_key, o.a_key) AS a_key, coalesce(p.b_plan, o.b_plan) AS b_plan, coalesce(p.b_key, o.b_key) AS b_key,
  CASE WHEN o.snap IS NULL THEN 'new' WHEN p.snap IS NULL THEN 'gone' WHEN abs(p.gap - o.gap) >= 30 THEN 'timing' END AS kind, round(coalesce(p.miles, o.miles), 2) AS miles, coalesce(p.gap, o.gap) AS gap, o.gap AS og
  FROM p FULL JOIN before o USING (snap, a_plan, a_key, b_plan, b_key))
SELECT snap, a_plan, a_key, b_plan, b_key, kind, miles, gap, CASE WHEN kind = 'timing' THEN og END AS old_gap FROM j
WHERE kind IS NOT NULL AND snap > (SELECT min(edition) FROM records) AND snap <= (SELECT max(edition) FROM records)"""


def q_shape(spark, sf_dir):
    """Shape of each edition and its drift from the one before."""
    r = build(spark, sf_dir, RECORDS)
    shapes = editions.edition_shape(r)
    drift = editions.shape_drift(shapes, editions.edition_steps(ordered(spark, sf_dir)))
    return shapes.join(drift, F.col("filing") == F.col("id"), "left").drop("id")


SQL_SHAPE = f"""WITH {ORDER_CTE}, records AS ({plain(RECORDS)}), s AS (SELECT filing, count(*) AS records, count(isd) AS dated, count(*) FILTER (WHERE rkey <> '') AS with_id, list_sort(list(length(name)))[count(*) // 2 + 1] AS name_length FROM records GROUP BY filing)
SELECT n.*, n.records * 2 < o.records OR n.records > 2 * o.records AS count_drift, n.dated * o.records * 2 < o.dated * n.records AS date_drift,
  n.name_length > 2 * o.name_length AND n.name_length > o.name_length + 20 AS name_drift FROM s n JOIN steps st ON st.id = n.filing LEFT JOIN s o ON o.filing = st.previous"""

QUERIES = {"edition_order": q_order, "edition_snapshots": q_snapshots, "project_changes": q_changes, "change_counts": q_counts, "change_kinds": q_kinds, "pair_changes": q_pair_changes, "edition_shape": q_shape}
SQL = {"edition_order": SQL_ORDER, "edition_snapshots": SQL_SNAPSHOTS, "project_changes": SQL_CHANGES, "change_counts": SQL_COUNTS, "change_kinds": SQL_KINDS, "pair_changes": SQL_PAIR_CHANGES, "edition_shape": SQL_SHAPE}
