"""Queries over names: stations of titles, and names that are nearly the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import likeness, placement
from ..sources.adapters import GAZETTEER, build, plain
from .text_queries import sql_chain

#: Titles of many kinds over the words of parts' names.
TITLES = """
SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE 'ga' END AS plan, CASE p_partkey % 9
  WHEN 0 THEN 'GTC: ' || split_part(p_name, ' ', 1) || ' - LINE ' || split_part(p_name, ' ', 2) || ' 230kV REBUILD' WHEN 1 THEN 'SAV - ' || split_part(p_name, ' ', 1) || ' Creek 115 kV line' WHEN 2 THEN 'CC: ' || split_part(p_name, ' ', 1) || ' (phase 2) & ' || split_part(p_name, ' ', 2) || ' Dam sub - improvements'
  WHEN 3 THEN 'Project ' || split_part(p_name, ' ', 1) || ' 115/46 kV substation' WHEN 4 THEN 'Smart valves at ' || p_name || ' switching station' WHEN 5 THEN split_part(p_name, ' ', 1) || ': remove limiting elements on ' || split_part(p_name, ' ', 2)
  WHEN 6 THEN 'New ' || split_part(p_name, ' ', 1) || ' #' || CAST(p_size AS STRING) || ' breaker - ' || split_part(p_name, ' ', 2) || ' tap, - ' || split_part(p_name, ' ', 1) || ' Road - ' || p_brand WHEN 7 THEN split_part(p_name, ' ', 2) || ' overstressed 115kV breakers' ELSE 'Switch ' || split_part(p_name, ' ', 1) || '/ – Lines ' || p_name END AS title
FROM {part}
"""


def q_title_stations(spark, sf_dir):
    """T4: stations of titles, with the stop words and the prefixes of one plan."""
    return build(spark, sf_dir, TITLES).select("k", F.array_join(text.title_stations(F.col("title"), F.col("plan")), "|").alias("stations"))


_LEAD = "regexp_extract(x, '" + text.LEAD + "', 1)"
SQL_STATIONS = f"""WITH t AS ({plain(TITLES)}), u AS (SELECT k, CASE WHEN plan = 'ga' THEN {sql_chain('title', text.PLAN_PREFIXES)} ELSE title END AS title FROM t),
h AS (SELECT k, {sql_chain("split_part(title, ':', 1)", text.TITLE_MARKS)} AS head FROM u), p AS (SELECT k, list_transform(string_split_regex(head, '\\s*[-–&]\\s*'), lambda x: regexp_replace(x, '^[ ,/]+|[ ,/]+$', '', 'g')) AS parts FROM h)
SELECT k, array_to_string(list_filter(list_transform(parts, lambda x: trim({_LEAD} || regexp_replace(substr(x, length({_LEAD}) + 1), '{text.STOP}', '', 'g'))), lambda x: length(x) > 1)[1:3], '|') AS stations FROM p"""


def q_nearly_placed(spark, sf_dir):
    """Places by four tiers; a third of the queries are a letter short of a name."""
    asked = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 3 == 0, F.expr("substring(p_name, 1, length(p_name) - 1)")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" Primary"))).otherwise(F.col("p_name")).alias("query"),
        F.when(F.col("p_size") % 2 == 0, "SC").otherwise("GA").alias("state"),
    )
    return placement.count_places(asked, placement.gazetteer_items(build(spark, sf_dir, GAZETTEER)), True)


def q_own_slides(spark, sf_dir):
    """The slide of each list row of a brand, by its title or one of the works that it names."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), F.col("p_partkey").alias("pos"), "p_name", "p_type")
    slides = parts.filter("pos % 2 = 0").withColumn("title", F.concat(F.col("p_name"), F.lit(" 115 kV Station and "), F.col("p_type"), F.lit(" Line")))
    rows = parts.withColumn("title", F.when(F.col("pos") % 4 < 2, F.concat("p_name", F.lit(" station"))).otherwise(F.concat("p_type", F.lit(" line"))))
    return likeness.own_slides(rows.select("id", "title", "block"), slides.select("id", "title", "block", "pos")).select("left", "right", F.round("ratio", 6).alias("ratio"))


def q_sample_status(spark, sf_dir):
    """What became of projects of a sample, in the list of their brand and among those dropped from it."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("block"), F.col("p_partkey").alias("pos"))
    sample = parts.withColumn("name", F.when(F.col("pos") % 2 == 0, F.concat("name", F.lit("s"))).otherwise(F.col("name"))).select("id", "name", "block")
    return likeness.sample_status(sample, parts.filter("pos % 3 = 0"), parts.filter("pos % 3 = 1"))


QUERIES = {"title_stations": q_title_stations, "nearly_placed": q_nearly_placed, "own_slides": q_own_slides, "sample_status": q_sample_status}
SQL = {"title_stations": SQL_STATIONS}
