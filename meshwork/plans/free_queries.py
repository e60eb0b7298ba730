"""Queries without SQL: order-dependent matching, free dates and shapes; and the streamed replay, whose SQL is that of the batch."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions import text
from ..functions import dates
from ..operators import editions, matching, shapes
from ..operators.common import shared_path
from ..sources import sinks
from ..sources.adapters import AREAS, ENDPOINTS, GAZETTEER, RECORDS, build
from ..streaming import replay
from .edition_queries import SQL_CHANGES, ordered
from .place_queries import q_area_shares

#: Keys repeat here: the customer's key without its last digit, so that up to ten share one.
REPEATING = f"SELECT filing, plan, state, ord AS pos, CAST(CAST(floor(ord / 4.0) AS BIGINT) AS STRING) AS rkey, name || ' ' || CAST(ord % 97 AS STRING) AS name FROM ({RECORDS}) r"


def q_match_reused(spark, sf_dir):
    """Matching of editions whose plan reuses ids."""
    steps = editions.edition_steps(ordered(spark, sf_dir)).filter("previous IS NOT NULL").select(F.col("id").alias("step"), "previous")
    r = build(spark, sf_dir, REPEATING)
    old = r.join(F.broadcast(steps), r["filing"] == steps["previous"]).select("step", "rkey", "pos", "name")
    new = r.join(F.broadcast(steps), r["filing"] == steps["step"]).select("step", "rkey", "pos", "name")
    return matching.match_editions(old, new, True)


def q_lineage(spark, sf_dir):
    """Lineage of all plans' records; a lineage holds within its plan."""
    steps = editions.edition_steps(ordered(spark, sf_dir)).orderBy("seq").select("plan", "id", "previous").collect()
    by_plan: dict[str, list] = {}
    for r in steps:
        by_plan.setdefault(r["plan"], []).append((r["id"], r["previous"]))
    rounds = [dict(filter(None, nth)) for nth in itertools.zip_longest(*by_plan.values())]
    return matching.lineage(build(spark, sf_dir, REPEATING), rounds, True)


def q_clusters(spark, sf_dir):
    """Leader clusters of endpoints of a project."""
    e = build(spark, sf_dir, ENDPOINTS).filter("lat IS NOT NULL").select("id", F.col("pos").cast("long").alias("pos"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return matching.leader_clusters(e, "id", 5.0)


def q_greedy(spark, sf_dir):
    """Greedy one-to-one match of the names of a brand's parts; even rows stand for titles, odd ones for list rows."""
    g = build(spark, sf_dir, GAZETTEER.replace("p_partkey AS item", "p_partkey AS item, p_brand AS brand"))
    rows = g.select("brand", F.col("item").alias("pos"), text.norm_name(F.col("name")).alias("norm"))
    return matching.greedy_matches(rows.filter("pos % 2 = 0"), rows.filter("pos % 2 = 1"), "brand")


def q_bipartite(spark, sf_dir):
    """Largest matching of order lines and suppliers within a part's group."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = lines.select(F.floor(F.col("l_partkey") / 5).alias("g"), F.col("l_partkey").alias("l"), F.col("l_suppkey").alias("r"))
    return matching.maximum_matching(edges, "g")


def q_any_date(spark, sf_dir):
    """Any printed date, as the end and as the start of its period, and how it was read."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    y, m = F.year("o_orderdate").cast("string"), F.date_format("o_orderdate", "MMMM")
    forms = F.array(
        F.date_format("o_orderdate", "M/d/yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat_ws(" ", m, y), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), y),
        F.concat(F.lit("Summer "), y), F.concat(F.lit("phase 1: "), y, F.lit("; phase 2: "), (F.year("o_orderdate") + 2).cast("string")), F.lit("TBD"),
    )
    raw = F.get(forms, (F.col("o_orderkey") % 7).cast("int"))
    return o.select("o_orderkey", raw.alias("raw")).select("o_orderkey", dates.dated(F.col("raw")).alias("e"), dates.dated(F.col("raw"), False).alias("s")).select(
        "o_orderkey", F.col("e.day").alias("last_day"), F.col("s.day").alias("first_day"), F.col("e.issue").alias("last_issue"), F.col("s.issue").alias("first_issue"))


def q_shapes(spark, sf_dir):
    """Areas clipped to a window, outlines simplified, corridors along them."""
    rings = build(spark, sf_dir, AREAS).groupBy("area").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("ring"))
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    window = F.array(point(-83.0, 31.5), point(-80.5, 31.5), point(-80.5, 33.5), point(-83.0, 33.5))
    box = [F.lit(v) for v in (-83.0, 31.5, -80.5, 33.5)]
    return rings.select(
        "area", F.size(shapes.clipped_ring("ring", window)).alias("clipped_points"), F.size(shapes.clipped_path("ring", *box)).alias("path_parts"),
        F.size(shapes.simplified("ring", F.lit(0.15))).alias("kept_points"), F.size(shapes.corridor_quads("ring", F.lit(0.01))).alias("quads"),
    )


def q_evidence(spark, sf_dir):
    """Evidence features of areas that projects' circles meet."""
    return sinks.evidence(build(spark, sf_dir, AREAS), q_area_shares(spark, sf_dir), 0.002)


def q_stream_replay(spark, sf_dir):
    """Editions replayed as a stream, removals included: equal to the batch change log."""
    folder = shared_path(spark, "replay")
    rows = replay.marked(build(spark, sf_dir, RECORDS), editions.edition_steps(ordered(spark, sf_dir)))
    rows.write.parquet(f"{folder}/rows")
    log = replay.run(spark.readStream.schema(rows.schema).parquet(f"{folder}/rows"), folder)
    return log.select("step", "rkey", "kind", F.array_join("what", "+").alias("what"), "days", "old_cost", "cost")


QUERIES = {"match_reused_ids": q_match_reused, "lineage": q_lineage, "leader_clusters": q_clusters, "greedy_matches": q_greedy, "bipartite_matching": q_bipartite, "any_date": q_any_date, "shapes": q_shapes, "evidence": q_evidence, "stream_replay": q_stream_replay}
SQL = {"stream_replay": SQL_CHANGES}
