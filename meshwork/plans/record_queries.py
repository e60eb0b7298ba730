"""Queries over records, registries and their parts: ids, costs, histories, signatures, headings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, text
from ..sources.adapters import PROJECTS, RECORDS, build, plain
from .text_queries import TITLES, sql_chain

RAW = TITLES.replace("|| p_partkey ||", "|| CAST(p_partkey AS STRING) ||")


def q_company_plans(spark, sf_dir):
    """The plan whose reduced name a company has, the first in order."""
    companies = build(spark, sf_dir, RAW).select("k", text.company_key(F.col("company")).alias("key")).filter("key <> ''")
    plans = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(text.company_key(F.col("p_brand")).alias("key")).agg(F.min("p_partkey").alias("plan"))
    return companies.join(plans, "key").select("k", "key", "plan")


_CK = "trim(" + sql_chain("lower(coalesce({0}, ''))", text.COMPANY_STEPS) + ")"
SQL_COMPANY = f"""WITH t AS ({TITLES.replace("{part}", "part")}), c AS (SELECT k, {_CK.replace("{0}", "company")} AS key FROM t), p AS (SELECT {_CK.replace("{0}", "p_brand")} AS key, min(p_partkey) AS plan FROM part GROUP BY 1)
SELECT k, key, plan FROM c JOIN p USING (key) WHERE key <> ''"""

#: Signatures of four document kinds; a kind matches if all its patterns occur.
SIGNATURES = {"licensed": (r"(?i)licen[sc]ed", r"(?i)version|\d\.\d"), "contact": (r"[a-z0-9.]+@[a-z0-9.]+", r"\d{3}"), "network": (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",), "listing": (r" \| ", r"\.")}


def q_signatures(spark, sf_dir):
    """Kinds all of whose patterns occur, and texts that just one kind claims."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")
    kinds = []
    for kind, patterns in SIGNATURES.items():
        hit = F.lit(True)
        for p in patterns:
            hit = hit & F.col("text").rlike(p)
        kinds.append(F.when(hit, F.lit(kind)))
    found = docs.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)
    return found.select("doc_id", F.explode("kinds").alias("kind"), (F.size("kinds") == 1).alias("is_unique"))


_SIG = ", ".join(f"CASE WHEN {' AND '.join(f'''regexp_matches(text, '{p}')''' for p in ps)} THEN '{k}' END" for k, ps in SIGNATURES.items())
SQL_SIGNATURES = f"WITH k AS (SELECT doc_id, list_filter([{_SIG}], lambda x: x IS NOT NULL) AS kinds FROM documents) SELECT doc_id, unnest(kinds) AS kind, len(kinds) = 1 AS is_unique FROM k WHERE len(kinds) > 0"


def q_id_collisions(spark, sf_dir):
    """Ids printed more than once in an edition, and ids that others begin with."""
    ids = build(spark, sf_dir, RECORDS).select("edition", F.floor(F.col("ord") / 2).cast("string").alias("key"))
    counted = ids.groupBy("edition", "key").agg(F.count("*").alias("n"))
    lengths = F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("key") - 1))
    starts = counted.filter(F.length("key") > 2).select("edition", F.col("key").alias("longer"), F.explode(F.transform(lengths, lambda i: F.substring("key", F.lit(1), i))).alias("key"))
    begun = starts.groupBy("edition", "key").agg(F.count("*").alias("begun"))
    joined = counted.join(begun.filter(F.length("key") >= 2), ["edition", "key"], "left")
    return joined.select(F.col("edition").cast("long").alias("edition"), "key", "n", F.coalesce("begun", F.lit(0)).alias("begun")).filter("n > 1 OR begun > 0")


SQL_IDS = f"""WITH r AS ({plain(RECORDS)}), c AS (SELECT CAST(edition AS BIGINT) AS edition, CAST(ord // 2 AS VARCHAR) AS key, count(*) AS n FROM r GROUP BY 1, 2),
b AS (SELECT a.edition, a.key, count(*) AS begun FROM c a JOIN c b ON a.edition = b.edition AND length(a.key) >= 2 AND length(b.key) > length(a.key) AND starts_with(b.key, a.key) GROUP BY a.edition, a.key)
SELECT c.edition, c.key, n, coalesce(begun, 0) AS begun FROM c LEFT JOIN b USING (edition, key) WHERE n > 1 OR begun > 0"""


def q_cost_coverage(spark, sf_dir):
    """What each plan publishes of its costs, and how many projects it has."""
    p = build(spark, sf_dir, PROJECTS).withColumn("cents", F.when((F.col("plan") != "beta") & (F.col("ord") % 4 != 0), F.col("cost_cents")))
    some, every = F.bool_or(F.col("cents").isNotNull()), F.bool_and(F.col("cents").isNotNull())
    return p.groupBy("plan").agg(F.count("*").alias("n"), F.when(every, "all").when(some, "partial").otherwise("withheld").alias("coverage"), F.count("cents").alias("with_cost"))


SQL_COVERAGE = f"""WITH p AS (SELECT *, CASE WHEN plan <> 'beta' AND ord % 4 <> 0 THEN cost_cents END AS cents FROM ({plain(PROJECTS)}))
SELECT plan, count(*) AS n, CASE WHEN count(cents) = count(*) THEN 'all' WHEN count(cents) > 0 THEN 'partial' ELSE 'withheld' END AS coverage, count(cents) AS with_cost FROM p GROUP BY plan"""


def q_spend_start(spark, sf_dir):
    """Yearly amounts as a map, their sum, and the first year that counts."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.year("o_orderdate").alias("y"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    yearly = o.groupBy("o_custkey", "y").agg(F.sum("cents").alias("cents"))
    maps = yearly.groupBy("o_custkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("y", "cents")))).alias("by_year"))
    big = F.map_filter("by_year", lambda y, c: c > 10000000)
    first = F.array_min(F.map_keys(big))
    start = F.when(F.col("o_custkey") % 5 == 0, first - 1).otherwise(first)
    return maps.select("o_custkey", F.aggregate(F.map_values("by_year"), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.size("by_year").alias("years"), F.make_date(start, F.lit(1), F.lit(1)).alias("start"))


SQL_SPEND = """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY ALL)
SELECT o_custkey, CAST(sum(cents) AS BIGINT) AS total, CAST(count(*) AS INTEGER) AS years, make_date(CAST(min(CASE WHEN cents > 10000000 THEN y END) - CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER), 1, 1) AS start FROM y GROUP BY o_custkey"""


def q_slip_history(spark, sf_dir):
    """Days by which a record's date moved since the first dated earlier edition."""
    r = build(spark, sf_dir, RECORDS)
    w = Window.partitionBy("plan", "rkey").orderBy("edition").rowsBetween(Window.unboundedPreceding, -1)
    told = r.withColumn("earlier", F.first("isd", ignorenulls=True).over(w)).withColumn("editions", F.count("*").over(w))
    slip = F.when(F.col("editions") == 0, None).otherwise(F.coalesce(F.datediff("isd", "earlier"), F.lit(0)))
    return told.select("filing", "rkey", "editions", slip.alias("slip_days"))


SQL_SLIP = f"""WITH r AS ({plain(RECORDS)}), t AS (SELECT *, first_value(isd IGNORE NULLS) OVER w AS earlier, count(*) OVER w AS editions FROM r WINDOW w AS (PARTITION BY plan, rkey ORDER BY edition ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT filing, rkey, editions, CASE WHEN editions > 0 THEN coalesce(datediff('day', earlier, isd), 0) END AS slip_days FROM t"""


def q_nearest_heading(spark, sf_dir):
    """The last heading above each entry and the entry's end."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    heading = F.last(F.when(F.col("event_type") == HEADING, F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", heading.alias("heading"), F.lead("event_id").over(w).alias("until"))


HEADING = "purchase"
SQL_HEADING = f"""SELECT event_id, last_value(CASE WHEN event_type = '{HEADING}' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading,
lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events"""


def q_edition_mode(spark, sf_dir):
    """The commonest year of each customer's orders, ties to the first seen, and its longest run of years."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderkey")
    years = o.groupBy("o_custkey", "y").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("seen"))
    mode = years.groupBy("o_custkey").agg(F.min_by("y", F.struct((-F.col("n")).alias("less"), "seen")).alias("mode"))
    run = F.row_number().over(Window.partitionBy("o_custkey").orderBy("y"))
    runs = years.withColumn("island", F.col("y") - run).groupBy("o_custkey", "island").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.max("n").alias("longest"))
    return mode.join(runs, "o_custkey")


SQL_MODE = """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY ALL),
i AS (SELECT o_custkey, y - row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS island FROM y), r AS (SELECT o_custkey, max(n) AS longest FROM (SELECT o_custkey, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY o_custkey),
m AS (SELECT o_custkey, y AS mode FROM y QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, seen) = 1)
SELECT o_custkey, mode, longest FROM m JOIN r USING (o_custkey)"""


def q_flood_zones(spark, sf_dir):
    """Classes of flood zone codes."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    zone = F.get(F.array(*[F.lit(z) for z in ZONES]), (F.col("p_partkey") % len(ZONES)).cast("int"))
    subtype = F.when(F.col("p_size") % 2 == 0, "0.2 PCT ANNUAL CHANCE FLOOD HAZARD").otherwise("AREA OF MINIMAL FLOOD HAZARD")
    return p.groupBy(zone.alias("zone"), classify.flood_text(zone, subtype).alias("kind")).agg(F.count("*").alias("n"))


ZONES = ("V", "VE", "A", "AE", "AO", "X", "D", "OPEN WATER", "B", None)
SQL_FLOOD = """WITH z AS (SELECT CASE p_partkey % 10 WHEN 0 THEN 'V' WHEN 1 THEN 'VE' WHEN 2 THEN 'A' WHEN 3 THEN 'AE' WHEN 4 THEN 'AO' WHEN 5 THEN 'X' WHEN 6 THEN 'D' WHEN 7 THEN 'OPEN WATER' WHEN 8 THEN 'B' END AS zone, p_size % 2 = 0 AS low FROM part)
SELECT zone, CASE WHEN zone LIKE 'V%' THEN 'coastal high hazard' WHEN zone LIKE 'A%' THEN '1% annual chance' WHEN zone = 'X' AND low THEN '0.2% annual chance' WHEN zone = 'X' THEN 'minimal' WHEN zone = 'D' THEN 'undetermined' WHEN zone = 'OPEN WATER' THEN 'open water' END AS kind, count(*) AS n FROM z GROUP BY ALL"""


def q_serial_dates(spark, sf_dir):
    """Serial day numbers as dates, the last of several, and whether it has passed."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    serial = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date"))
    listed = F.concat_ws("; ", F.date_format("o_orderdate", "M/d/yyyy"), F.date_format(F.date_add("o_orderdate", 400), "M/d/yyyy"))
    last = F.element_at(F.regexp_extract_all(listed, F.lit(r"(\d+/\d+/\d{4})"), F.lit(1)), -1)
    day = F.to_date(last, "M/d/yyyy")
    return o.select("o_orderkey", F.date_add(F.lit("1899-12-30").cast("date"), serial).alias("from_serial"), day.alias("last_listed"), (day < F.lit("1999-01-01").cast("date")).alias("passed"))


SQL_SERIAL = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_serial, CAST(o_orderdate AS DATE) + 400 AS last_listed, CAST(o_orderdate AS DATE) + 400 < DATE '1999-01-01' AS passed FROM orders"


def q_date_basis(spark, sf_dir):
    """Plans grouped by the bases of their dates."""
    o = build(spark, sf_dir, RECORDS).select("plan", F.when(F.col("status") == "F", "printed").when(F.col("status") == "O", "metadata").otherwise("filing").alias("basis"))
    per = o.groupBy("plan").agg(F.array_join(F.array_sort(F.collect_set("basis")), " or ").alias("basis"))
    return per.groupBy("basis").agg(F.array_join(F.array_sort(F.collect_set("plan")), ", ").alias("plans"))


SQL_BASIS = f"""WITH p AS (SELECT plan, array_to_string(list_sort(list(DISTINCT CASE status WHEN 'F' THEN 'printed' WHEN 'O' THEN 'metadata' ELSE 'filing' END)), ' or ') AS basis FROM ({plain(RECORDS)}) GROUP BY plan)
SELECT basis, array_to_string(list_sort(list(DISTINCT plan)), ', ') AS plans FROM p GROUP BY basis"""

QUERIES = {"company_plans": q_company_plans, "signatures": q_signatures, "id_collisions": q_id_collisions, "cost_coverage": q_cost_coverage, "spend_start": q_spend_start, "slip_history": q_slip_history,
           "nearest_heading": q_nearest_heading, "edition_mode": q_edition_mode, "flood_zones": q_flood_zones, "serial_dates": q_serial_dates, "date_basis": q_date_basis}
SQL = {"company_plans": SQL_COMPANY, "signatures": SQL_SIGNATURES, "id_collisions": SQL_IDS, "cost_coverage": SQL_COVERAGE, "spend_start": SQL_SPEND, "slip_history": SQL_SLIP,
       "nearest_heading": SQL_HEADING, "edition_mode": SQL_MODE, "flood_zones": SQL_FLOOD, "serial_dates": SQL_SERIAL, "date_basis": SQL_BASIS}
