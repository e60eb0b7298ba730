"""Routes over a line network."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .common import checkpointed


def bidirected(edges: DataFrame) -> DataFrame:
    """Each edge ``u, v, miles`` both ways, the shortest of parallel ones."""
    both = edges.select("u", "v", "miles").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "miles"))
    return both.groupBy("u", "v").agg(F.min("miles").alias("miles"))


def snap(points: DataFrame, vertices: DataFrame, within: float = 0.4, cell: float = 0.05) -> DataFrame:
    """Vertices within so many miles of each point, by cells and their neighbours."""

    at = lambda c, d=0: F.floor(F.col(c) / cell) + d
    spread = F.explode(F.array(*[F.struct(at("lat", a).alias("i"), at("lon", b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = points.withColumn("c", spread).join(
        vertices.select(F.struct(at("v_lat").alias("i"), at("v_lon").alias("j")).alias("c"), "vertex", "v_lat", "v_lon"), "c"
    )
    miles = geo.haversine_asin(F.col("lat"), F.col("lon"), F.col("v_lat"), F.col("v_lon"))
    return near.withColumn("miles", miles).filter(F.col("miles") <= within).select("key", "vertex", "miles")


#: Tables of what a hop reached are put together after so many hops.
LEVELS = 8


def capped_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Shortest distances ``source, vertex, miles`` from each source up to its ``cap``.

    ``sources`` has ``source, cap`` and, if a source starts at several vertices or at some
    distance from its own, ``vertex, miles``.  All grow their frontiers together, a hop at a
    time; only vertices that were reached by a shorter way go on, until nothing improves: there
    is no limit on hops.  A hop writes what it reached, not all distances again.
    """
    edges = checkpointed(edges)
    starts = sources if "vertex" in sources.columns else sources.select("source", "cap", F.col("source").alias("vertex"), F.lit(0.0).alias("miles"))
    caps = checkpointed(sources.groupBy("source").agg(F.max("cap").alias("cap")))
    least = lambda d: d.groupBy("source", "vertex").agg(F.min("miles").alias("miles"))
    frontier = checkpointed(least(starts.filter(F.col("miles") <= F.col("cap"))))
    levels = [frontier]
    while frontier.limit(1).count():
        step = (
            frontier.join(edges, F.col("vertex") == F.col("u")).select("source", F.col("v").alias("vertex"), (frontier["miles"] + edges["miles"]).alias("miles"))
            .join(caps, "source").filter(F.col("miles") <= F.col("cap"))
        )
        if len(levels) > LEVELS:
            levels = [checkpointed(least(functools.reduce(DataFrame.unionByName, levels)))]
        known = least(functools.reduce(DataFrame.unionByName, levels)).withColumnRenamed("miles", "known")
        better = least(step).join(known, ["source", "vertex"], "left").filter("known IS NULL OR miles < known")
        frontier = checkpointed(better.select("source", "vertex", "miles"))
        levels.append(frontier)
    return least(functools.reduce(DataFrame.unionByName, levels))


def routes(legs: DataFrame, vertices: DataFrame, edges: DataFrame, ratio: float = 3.0, least: float = 2.0, within: float = 0.4, cell: float = 0.05) -> DataFrame:
    """``key, leg, route_miles`` of legs ``key, leg, lat1, lon1, lat2, lon2`` along the lines.

    Both ends are snapped to all vertices within reach, and the way to a vertex counts; a route of
    more than ``ratio`` times the straight line (and than ``least`` miles) is none.  Legs with an
    end outside the lines' box or far from every vertex have none.  A cell, in degrees, must be as
    wide and as high as the reach of the snap.
    """
    named = legs.withColumn("source", F.concat_ws("/", "key", "leg"))
    box = vertices.agg(F.min("v_lat").alias("s"), F.max("v_lat").alias("n"), F.min("v_lon").alias("w"), F.max("v_lon").alias("e"))
    within_box = F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))
    ends = lambda n: snap(named.select(F.col("source").alias("key"), F.col(f"lat{n}").alias("lat"), F.col(f"lon{n}").alias("lon")).join(F.broadcast(box), within_box), vertices, within, cell)
    straight = geo.haversine_asin(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    caps = named.select("source", F.greatest(straight * ratio, F.lit(least)).alias("cap"))
    goals = checkpointed(ends(2).withColumnRenamed("miles", "last"))
    starts = ends(1).join(goals.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("source"), "vertex", "miles").join(caps, "source")
    reached = capped_distances(edges, starts)
    arrived = reached.join(goals.withColumnRenamed("key", "source"), ["source", "vertex"]).groupBy("source").agg(F.min(F.col("miles") + F.col("last")).alias("miles"))
    return named.join(arrived, "source").select("key", "leg", F.round("miles", 2).alias("route_miles"))


def assembled(route_legs: DataFrame, legs: DataFrame, projects: DataFrame) -> DataFrame:
    """``key, route_miles, status`` of projects whose every leg has a route.

    ``projects`` has ``key``, ``eligible`` and the ``stated`` miles: a route of more than three times
    these, or less than a third, is rejected; one that is off by more than 35 in 100 is told so.
    """
    wanted = legs.groupBy("key").agg(F.count("*").alias("legs"))
    found = route_legs.groupBy("key").agg(F.count("*").alias("found"), F.round(F.sum("route_miles"), 2).alias("route_miles"))
    whole = wanted.join(found, "key").filter("legs = found").join(projects.filter("eligible"), "key")
    miles, stated = F.col("route_miles"), F.nullif("stated", F.lit(0.0))
    rejected = (miles > 3 * stated) | (miles < stated / 3)
    status = F.when(F.coalesce(rejected, F.lit(False)), "rejected").when(F.coalesce(F.abs(miles - stated) / stated > 0.35, F.lit(False)), "differs").otherwise("route")
    return whole.select("key", "route_miles", status.alias("status"))
