"""Domain tables derived from the given star schema, in SQL that Spark and other engines share.

Table names stand in braces; ``build`` replaces them by DataFrames, ``plain`` by names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PLANS = "CASE {0} % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END"

#: One project per customer; points keep their density as the table grows.
PROJECTS = """
SELECT c.c_custkey AS ord, 'P' || CAST(c.c_custkey AS STRING) AS id, c.c_nationkey % 3 AS plan_ord,
       CASE c.c_nationkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS plan,
       CASE c.c_nationkey % 3 WHEN 2 THEN 'GA' ELSE 'SC' END AS state,
       'U' || CAST(c.c_nationkey AS STRING) AS utility, c.c_name AS name, c.c_mktsegment AS zone,
       CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE 31.4 + ((c.c_custkey * 7919) % 3000) / 1000.0 END AS lat,
       CASE WHEN c.c_custkey % 13 = 0 THEN NULL
            ELSE -83.3 + ((c.c_custkey * 6007) % 3300) / 1000.0 + 5.0 * (CAST(floor(c.c_custkey / 3000.0) AS BIGINT) % 30) END AS lon,
       CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(c.c_custkey % 7 AS DOUBLE) END AS radius_mi,
       o.last_date AS isd, CASE WHEN c.c_nationkey % 3 = 1 AND c.c_custkey % 2 = 0 THEN NULL ELSE o.first_date END AS win_start, o.last_date AS win_end,
       o.cents AS cost_cents, CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE CAST(c.c_custkey % 40 AS DOUBLE) END AS miles
FROM {customer} c LEFT JOIN (
  SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM {orders} GROUP BY o_custkey
) o ON o.o_custkey = c.c_custkey
"""

#: Three title endpoints per project, some without a point.
ENDPOINTS = f"""
SELECT p.id, p.ord, p.plan, p.state, p.zone, e.pos, 'S' || CAST((p.ord * 31 + e.pos * 17) % 997 AS STRING) AS name,
       CASE WHEN (p.ord + e.pos) % 5 = 0 THEN NULL ELSE p.lat + (((p.ord * 37 + e.pos * 101) % 200) - 100) / 1000.0 END AS lat,
       CASE WHEN (p.ord + e.pos) % 5 = 0 THEN NULL ELSE p.lon + (((p.ord * 53 + e.pos * 211) % 200) - 100) / 1000.0 END AS lon,
       CASE (p.ord + e.pos) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'ambiguous' ELSE 'low' END AS confidence,
       CAST(((p.ord + e.pos) % 3) AS DOUBLE) / 2 AS radius_mi,
       CASE (p.ord + e.pos) % 3 WHEN 0 THEN 'osm-exact' WHEN 1 THEN 'reference' ELSE 'town' END AS method
FROM ({PROJECTS}) p CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2) e
"""

#: Editions: a plan lists in each year the customers that ordered in it.
RECORDS = """
SELECT CASE c.c_nationkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS plan, o.y AS edition,
       CASE c.c_nationkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END || '-' || CAST(o.y AS STRING) AS filing,
       CASE c.c_nationkey % 3 WHEN 2 THEN 'GA' ELSE 'SC' END AS state,
       c.c_custkey AS ord, 'K' || CAST(c.c_custkey AS STRING) AS rkey,
       CASE WHEN (c.c_custkey + o.y) % 17 = 0 THEN 'Quite Unlike Yjzvwk' ELSE c.c_name END AS name,
       o.last_date AS isd, o.cents AS cost_cents, o.status,
       31.4 + ((c.c_custkey * 7919) % 3000) / 1000.0 AS lat,
       -83.3 + ((c.c_custkey * 6007) % 3300) / 1000.0 + 5.0 * (CAST(floor(c.c_custkey / 3000.0) AS BIGINT) % 30) AS lon
FROM {customer} c JOIN (
  SELECT o_custkey, extract(year FROM o_orderdate) AS y, CAST(max(o_orderdate) AS DATE) AS last_date,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, max(o_orderstatus) AS status
  FROM {orders} GROUP BY o_custkey, extract(year FROM o_orderdate)
) o ON o.o_custkey = c.c_custkey
"""

#: One filing per plan and year; the middle plan's second one is dated late.
FILINGS = f"""
SELECT filing AS id, plan, min(plan_ord) AS plan_ord, edition, min(CASE WHEN plan = 'beta' AND edition = 1996 THEN DATE '1999-06-30' ELSE day END) AS fdate
FROM (SELECT filing, plan, CASE plan WHEN 'alpha' THEN 0 WHEN 'beta' THEN 1 ELSE 2 END AS plan_ord, edition,
             CAST(CAST(edition AS STRING) || '-12-15' AS DATE) AS day FROM ({RECORDS}) r)
GROUP BY filing, plan, edition
"""

#: Named places: one row per part, names as printed in a gazetteer.
GAZETTEER = """
SELECT p_partkey AS item, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS alt_name,
       31.4 + ((p_partkey * 4391) % 3000) / 1000.0 AS lat, -83.3 + ((p_partkey * 2713) % 3300) / 1000.0 AS lon,
       CASE WHEN p_size % 2 = 0 THEN 'SC' ELSE 'GA' END AS state, p_size % 5 = 0 AS off_grid
FROM {part}
"""

#: Eight-sided areas, one per nation and block of the region.
AREAS = """
SELECT n_nationkey AS area, n_name AS name, k AS pos,
       -83.3 + (n_nationkey % 5) * 0.7 + 0.35 * cos(radians(45.0 * k + 10.0)) + 0.3 AS x,
       31.4 + floor(n_nationkey / 5.0) * 0.6 + 0.3 * sin(radians(45.0 * k + 10.0)) + 0.3 AS y
FROM {nation} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) s
"""

#: The cell of a part's place in a lattice of a fifth of a degree, in whole thousandths, so that all engines agree on its edge.
PART_CELLS = """
SELECT p_partkey AS item, CAST(floor((31400 + (p_partkey * 4391) % 3000) / 200.0) AS BIGINT) AS i, CAST(floor((16700 + (p_partkey * 2713) % 3300) / 200.0) AS BIGINT) AS j
FROM {part}
"""

#: Lines: the lattice where it holds a part's place; neighbours to the north and east are joined.
VERTICES = f"SELECT i * 1000 + j AS vertex, i, j, i / 5.0 AS v_lat, j / 5.0 - 100.0 AS v_lon FROM (SELECT DISTINCT i, j FROM ({PART_CELLS}) p) c"

TABLES = re.compile(r"\{(\w+)\}")


def build(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived table as a DataFrame."""
    names = sorted(set(TABLES.findall(sql)))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


#: A decimal number outside of names, quotes and other numbers.
DECIMAL = re.compile(r"('[^']*')|(?<![\w.])(\d+\.\d+)(?![\w.])")


def in_doubles(sql: str) -> str:
    """The same text with its decimal numbers as doubles, so that places are added up in the steps, and to the last bit, of
    engines that divide and add in doubles; Spark would add decimals exactly and round once."""
    return DECIMAL.sub(lambda m: m[1] or m[2] + "D", sql)


def plain(sql: str) -> str:
    """The same text over tables of those names."""
    return TABLES.sub(lambda m: m[1], sql)
