"""Pairs that lie equally far apart but for the last bit of their miles."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from meshwork.functions import classify, geo
from meshwork.operators import pairs
from meshwork.plans import catalog
from meshwork.sources.adapters import in_doubles


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Customers whose places stand in the same pattern in each of five regions."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    spark.range(300).select((F.col("id") % 60 + F.floor(F.col("id") / 60) * 3000).alias("c_custkey")).select(
        "c_custkey", F.concat(F.lit("C"), "c_custkey").alias("c_name"), (F.col("c_custkey") % 3000 % 5 % 3).cast("int").alias("c_nationkey"), F.lit("X").alias("c_mktsegment")).write.parquet(f"{folder}/customer.parquet")
    spark.range(1).selectExpr("id AS o_orderkey", "CAST(3 AS BIGINT) AS o_custkey", "TIMESTAMP '1995-01-01 00:00:00' AS o_orderdate", "CAST(5 AS DOUBLE) AS o_totalprice").write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", ["rank_distance", "rank_time"])
def test_equal_distances_are_ranked_as_in_sql(spark, repeated, name):
    """F15 to F19."""
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{repeated}/{t}.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).fetchall()
    got = catalog.queries()[name](spark, repeated)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 300


def test_miles_to_the_last_bit(spark):
    rows = [(31.4 + i / 1000, -83.3 + i / 700, 31.5 + i / 900, -83.2 + i / 1100) for i in range(500)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double, c double, d double").coalesce(1).select(geo.haversine_libm("a", "b", "c", "d")).collect()]

    def miles(a, b, c, d):
        x = math.pow(math.sin(math.radians(c - a) / 2), 2) + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.pow(math.sin(math.radians(d - b) / 2), 2)
        return 2 * 3958.7613 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    assert got == [miles(*r) for r in rows]


def test_decimals_as_doubles():
    assert in_doubles("SELECT 31.4 + c1.5 / 1000.0, 7, 'v 2.5', t1.x FROM t1") == "SELECT 31.4D + c1.5 / 1000.0D, 7, 'v 2.5', t1.x FROM t1"


def test_pairs_to_be_ordered_are_scored_by_exact_miles(spark):
    """class and score hang on the same miles as the order."""
    day = F.lit("2000-01-01").cast("date")
    projects = spark.range(120).select(
        F.concat(F.lit("p"), "id").alias("id"), (F.col("id") % 2).alias("plan_ord"), F.when(F.col("id") % 2 == 0, "SC").otherwise("GA").alias("state"), (31.4 + F.col("id") / 300).alias("lat"), (-83.3 + F.col("id") % 7 / 90).alias("lon"),
        (F.col("id") % 4).cast("double").alias("radius_mi"), day.alias("isd"), day.alias("win_start"), day.alias("win_end"))
    got = pairs.distance_join(projects, include_possible=True, exact=True)
    exact = geo.haversine_libm(*[F.col(f"{s}.{c}") for s in "ab" for c in ("lat", "lon")])
    score = classify.score(F.col("exact"), F.col("remaining_days"), F.col("overlap_days"), F.col("gap_days"), F.col("certainty"))["total"]
    told = got.withColumn("exact", exact).select("miles", "exact", "score_total", score.alias("score")).collect()
    assert len(told) > 1000 and all(r.miles == r.exact and r.score_total == r.score for r in told)
