"""Queries over printed text: names, keys, dates, money, links, editions and issues."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import links
from ..sources.adapters import build

TITLES = """
SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'St. ' WHEN 1 THEN 'N ' WHEN 2 THEN 'The ' WHEN 3 THEN '' WHEN 4 THEN 'Mt ' ELSE 'E & W ' END || p_name ||
  CASE p_partkey % 5 WHEN 0 THEN ' Substation' WHEN 1 THEN ' - ' || p_type || ' 115 kV Line' WHEN 2 THEN ' Rd #2 (SAV)' WHEN 3 THEN ': rebuild' ELSE ' & Plant Tap' END AS title,
  CASE p_partkey % 4 WHEN 0 THEN ' 0' || p_partkey || ' D* ' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE '(' || p_partkey || ')' END AS printed,
  p_brand || CASE p_partkey % 3 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' & Co' ELSE ' Corporation' END AS company
FROM {part}
"""


def sql_chain(column: str, steps) -> str:
    for pattern, to in steps:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return column


def q_names(spark, sf_dir):
    """Normalised names and keys."""
    t = build(spark, sf_dir, TITLES.replace("|| p_partkey ||", "|| CAST(p_partkey AS STRING) ||"))
    title = F.col("title")
    return t.select(
        "k", text.norm_name(title).alias("norm"), text.company_key(F.col("company")).alias("company_key"), text.title_key(title).alias("title_key"),
        text.record_key(F.col("printed"), title).alias("record_key"), text.slug(title).alias("slug"), F.array_join(text.stations(title), "|").alias("stations"),
    )


NORM_SQL = "trim(" + sql_chain("lower(title)", text.NAME_STEPS) + ")"
_VOLT = [(text.TITLE_VOLTAGE, ""), (r"#\s*\d+", " ")]
SQL_NAMES = f"""WITH t AS ({TITLES.replace("{part}", "part")}), u AS (SELECT *, {sql_chain("title", _VOLT)} AS plain_title,
  {sql_chain("string_split(title, ':')[1]", [(r"[(][^)]*[)]", " "), (r"#\s*\d+", " "), (text.TITLE_VOLTAGE, "")])} AS head FROM t)
SELECT k, {NORM_SQL} AS norm, trim({sql_chain("lower(coalesce(company, ''))", text.COMPANY_STEPS)}) AS company_key,
  replace(upper(trim({sql_chain("lower(plain_title)", text.NAME_STEPS)})), ' ', '-') AS title_key,
  coalesce(nullif(upper({sql_chain("coalesce(printed, '')", [(r"\s+", ""), (r"^\W+|\W+$", "")])}), ''), {sql_chain("lower(title)", [("[^a-z0-9]+", "-"), ("^-+|-+$", "")])}) AS record_key,
  {sql_chain("lower(title)", [("[^a-z0-9]+", "-"), ("^-+|-+$", "")])} AS slug,
  array_to_string(list_filter(list_transform(string_split_regex(head, '\\s*[-–&]\\s*'), lambda x: trim(regexp_replace(trim(x), '^[ ,/]+|[ ,/]+$', '', 'g'))), lambda x: length(x) > 1)[1:3], '|') AS stations
FROM u"""

DATES = """
SELECT o_orderkey AS k, 'In service ' || CASE WHEN o_orderkey % 9 = 0 THEN 'TBD' ELSE
  CAST(extract(month FROM o_orderdate) + CASE WHEN o_orderkey % 31 = 0 THEN 12 ELSE 0 END AS STRING) || '/' || CAST(o_orderkey % 31 + 1 AS STRING) || '/' ||
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(extract(year FROM o_orderdate) AS STRING) ELSE substring(CAST(extract(year FROM o_orderdate) + 20 AS STRING), 3, 2) END END AS raw
FROM {orders}
"""


def q_dates(spark, sf_dir):
    """D1 strict dates with repair."""
    d = build(spark, sf_dir, DATES).select("k", text.printed_date(F.col("raw")).alias("d"))
    return d.select("k", F.col("d.date").alias("date"), F.col("d.issue").alias("issue"))


SQL_DATES = f"""WITH t AS ({DATES.replace("{orders}", "orders")}), g AS (
  SELECT k, regexp_extract(raw, '(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{2,4}})', 0) <> '' AS found, TRY_CAST(regexp_extract(raw, '(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{2,4}})', 1) AS INTEGER) AS m,
         TRY_CAST(regexp_extract(raw, '(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{2,4}})', 2) AS INTEGER) AS d, TRY_CAST(regexp_extract(raw, '(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{2,4}})', 3) AS INTEGER) AS y0 FROM t
), p AS (SELECT *, CASE WHEN y0 < 100 THEN y0 + 2000 ELSE y0 END AS y FROM g),
q AS (SELECT *, TRY_CAST(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) AS exact, TRY_CAST(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-01' AS DATE) AS opening FROM p)
SELECT k, coalesce(exact, last_day(opening)) AS date, CASE WHEN NOT found THEN 'unparseable' WHEN exact IS NOT NULL THEN NULL WHEN opening IS NOT NULL THEN 'impossible day' ELSE 'invalid date' END AS issue FROM q"""

MONEY = """
SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '$' || CAST(o_orderkey AS STRING) || ',250' WHEN 1 THEN CAST(o_orderkey % 90 AS STRING) || '.5 million' WHEN 2 THEN '$' || CAST(o_orderkey % 700 AS STRING) || 'k'
  WHEN 3 THEN 'Delayed from 2025 to ' || CAST(2025 + o_orderkey % 7 AS STRING) ELSE 'none' END AS raw FROM {orders}
"""


def q_money(spark, sf_dir):
    """M1 printed money; A22 slip years."""
    m = build(spark, sf_dir, MONEY)
    money = F.when(F.col("raw").contains("from"), None).otherwise(text.dollars(F.col("raw")))
    return m.select("k", money.alias("dollars"), text.slip_years(F.col("raw")).alias("slip_years"))


SQL_MONEY = f"""WITH t AS ({MONEY.replace("{orders}", "orders")}), n AS (
  SELECT k, raw, replace(regexp_extract(raw, '\\$?\\s*([0-9][0-9,]*(\\.[0-9]+)?)', 1), ',', '') AS num, lower(regexp_extract(raw, '(?i)[0-9]\\s*(k|m|b|thousand|million|billion)\\b', 1)) AS unit FROM t)
SELECT k, CASE WHEN num <> '' AND NOT contains(raw, 'from') THEN CAST(num AS DOUBLE) * CASE unit WHEN 'k' THEN 1e3 WHEN 'million' THEN 1e6 ELSE 1 END END AS dollars,
  CAST(CASE WHEN contains(raw, 'Delayed') THEN CAST(regexp_extract(raw, 'to (\\d{{4}})', 1) AS INTEGER) - 2025 END AS INTEGER) AS slip_years FROM n"""


def q_tokens(spark, sf_dir):
    """Tokens of a text, its first lines, its sentences with digits."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    head = F.array_join(F.transform(F.slice(lines, 1, 8), lambda x: F.substring(F.regexp_replace(x, " +", " "), 1, 60)), " / ")
    return d.select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"), head.alias("head"), F.regexp_count("text", F.lit("[0-9]+")).alias("n_numbers"))


SQL_TOKENS = r"""SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.,/][a-z0-9]+)*')) AS INTEGER) AS n_tokens,
  array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:8], lambda x: substr(regexp_replace(x, ' +', ' ', 'g'), 1, 60)), ' / ') AS head,
  CAST(len(regexp_extract_all(text, '[0-9]+')) AS INTEGER) AS n_numbers FROM documents WHERE text IS NOT NULL"""


def q_links(spark, sf_dir):
    """Links of every page, first of each address, PDF addresses first, at most 200 a page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    cells = pages.select("page_id", F.posexplode(found).alias("pos", "a"))
    part = lambda g: F.regexp_extract("a", r'<a href="([^"]*)">([^<]*)</a>', g)
    named = cells.select("page_id", "pos", part(1).alias("href"), part(2).alias("anchor"))
    first = named.groupBy("page_id", "href").agg(F.min(F.struct("pos", "anchor")).alias("f")).select("page_id", "href", "f.pos", "f.anchor")


    order = Window.partitionBy("page_id").orderBy(F.col("href").endswith(".pdf").desc(), "pos")
    return first.withColumn("n", F.row_number().over(order)).filter("n <= 200").select("page_id", "n", "href", "anchor")


SQL_LINKS = r"""WITH c AS (SELECT page_id, unnest(x) AS a, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>') AS x FROM pages)),
n AS (SELECT page_id, pos, regexp_extract(a, '<a href="([^"]*)">([^<]*)</a>', 1) AS href, regexp_extract(a, '<a href="([^"]*)">([^<]*)</a>', 2) AS anchor FROM c),
f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ends_with(href, '.pdf') DESC, pos) AS INTEGER) AS n, href, anchor FROM f QUALIFY n <= 200"""


def q_report(spark, sf_dir):
    """Title and links of whole pages, addresses in full."""
    scanned = links.scan_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return links.page_report(scanned).select("page_id", "title", "n", "href", "text")


SQL_REPORT = r"""WITH p AS (SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site FROM pages), c AS (SELECT page_id, site, unnest(x) AS a, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT page_id, site, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS x FROM p)),
l AS (SELECT page_id, pos, site || regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(a, '>([^<]*)<', 1), '\s+', ' ', 'g')) AS text FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY contains(lower(href), '.pdf') DESC, pos) AS n FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1))
SELECT p.page_id, substr(trim(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '\s+', ' ', 'g')), 1, 200) AS title, n, substr(href, 1, 300) AS href, substr(replace(text, '&amp;', '&'), 1, 90) AS text
FROM p LEFT JOIN (SELECT * FROM f WHERE n <= 200) f USING (page_id)"""


def q_quality(spark, sf_dir):
    """Issues of documents by level, in order of severity."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    issues = labels.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("toxic") == 1, "error"), F.when(F.col("quality") == 0, "warn"), F.when((F.col("toxic") == 0) & (F.col("quality") == 1), "info")))).alias("level"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    rank = F.when(F.col("level") == "error", 0).when(F.col("level") == "warn", 1).otherwise(2)
    return issues.join(docs, "doc_id").groupBy("source", "level").agg(F.count("*").alias("n")).withColumn("severity", rank)


SQL_QUALITY = """WITH i AS (SELECT doc_id, 'error' AS level FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'warn' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'info' FROM labels WHERE toxic = 0 AND quality = 1)
SELECT source, level, count(*) AS n, CASE level WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS severity FROM i JOIN documents USING (doc_id) GROUP BY source, level"""

QUERIES = {"names_and_keys": q_names, "printed_dates": q_dates, "printed_money": q_money, "page_tokens": q_tokens, "page_links": q_links, "page_report": q_report, "issue_levels": q_quality}
SQL = {"names_and_keys": SQL_NAMES, "printed_dates": SQL_DATES, "printed_money": SQL_MONEY, "page_tokens": SQL_TOKENS, "page_links": SQL_LINKS, "page_report": SQL_REPORT, "issue_levels": SQL_QUALITY}
