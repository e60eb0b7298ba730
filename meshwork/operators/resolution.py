"""Endpoints resolved in one flow: joint choice, rejection, and how far the outcome can be trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .common import checkpointed
from .placement import reject_far
from .rules import METHODS, chosen_places


def resolved_endpoints(endpoints: DataFrame, candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """``id, pos, name, method, confidence, radius_mi, lat, lon, places, evidence``, one row for each endpoint.

    ``endpoints`` has ``id, pos, name`` (id and pos unique); ``candidates`` the places each may be, ``id, pos, choice, lat, lon, method,
    label`` and, where known, ``confidence, radius_mi`` of their own and ``owner``, another one than the project's;
    ``anchors`` ``id, lat, lon`` of projects whose zone is known.

    The places are chosen together, near each other and the anchor.  Then one that is far from all
    others, and not better known than they are, is rejected.  What is left has the confidence and radius of its method or its own; another
    owner makes a high confidence medium and widens the radius; where a name has several places and neither an
    anchor nor another endpoint could tell them apart, the confidence is "ambiguous".  An endpoint without a place, or whose
    place was rejected, has the confidence "none" and no point.  Candidates without a point or of an unknown method are left out.
    """
    known = candidates.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("method").isin(*METHODS))
    extra = {"confidence": "string", "radius_mi": "double", "owner": "string"}
    own = [(F.col(c) if c in candidates.columns else F.lit(None)).cast(kind).alias(c) for c, kind in extra.items()]
    known = checkpointed(known.select("id", "pos", "choice", "lat", "lon", "method", "label", *own))
    taken = checkpointed(known.join(chosen_places(known, anchors), ["id", "pos", "choice"]))
    far_off = reject_far(taken, anchors)
    zone = anchors.select("id", F.struct("lat", "lon").alias("zone"))
    placed = taken.join(far_off, ["id", "pos"]).join(zone, "id", "left")
    miles = lambda p, q: geo.haversine_asin(p["lat"], p["lon"], q["lat"], q["lon"])
    here = F.struct("lat", "lon")
    # The other places of the name, and the farthest of them.
    others = known.select("id", "pos", F.struct("lat", "lon").alias("other"), F.col("choice").alias("__c")).join(taken.select("id", "pos", "choice", here.alias("here")), ["id", "pos"])
    spread = others.groupBy("id", "pos").agg(F.count("*").alias("places"), F.max(F.when(F.col("__c") != F.col("choice"), miles(F.col("here"), F.col("other")))).alias("spread"))
    # What a rejected one was held against: the endpoints not rejected before it, else the anchor.
    peers = placed.groupBy("id").agg(F.collect_list(F.struct("pos", "lat", "lon", "rejected")).alias("peers"), F.count("*").alias("located"))
    told = placed.join(spread, ["id", "pos"]).join(peers, "id")
    held = F.filter("peers", lambda q: (q["pos"] != F.col("pos")) & ~(q["rejected"] & (q["pos"] < F.col("pos"))))
    # A column of its own: among the columns below, a lambda would take the new "lat" for the old one.
    told = told.withColumn("nearest", F.coalesce(F.array_min(F.transform(held, lambda q: miles(here, q))), miles(here, F.col("zone"))))
    by = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for m, v in METHODS.items() for x in (m, v[i])]), F.col("method"))
    confidence, radius = F.coalesce("confidence", by(1)), F.coalesce("radius_mi", by(0))
    doubted = F.col("owner").isNotNull() & F.col("method").isin("reference", "osm-exact", "osm-partial")
    several, apart = F.col("places") > 1, F.col("zone").isNotNull() | (F.col("located") > 1)
    whole = lambda c: F.round(c).cast("long").cast("string")
    notes = F.concat_ws(
        "; ", F.col("label"), F.when(doubted, F.concat(F.lit("owned by "), F.col("owner"), F.lit(", so it may be another station of this name"))),
        F.when(several, F.concat(F.col("places").cast("string"), F.lit(" places have this name, another one "), whole(F.col("spread")), F.lit(" mi away"))),
        F.when(several & apart, F.concat(F.lit("taken as nearest to "), F.concat_ws(" and ", F.when(F.col("located") > 1, "the other endpoints"), F.when(F.col("zone").isNotNull(), "the zone")))),
    )
    rejection = F.concat(F.lit("rejected a "), F.col("method"), F.lit(" match "), whole(F.col("nearest")), F.lit(" mi from the rest of the project ("), F.coalesce("label", F.lit("same name, another place")), F.lit(")"))
    kept = lambda c: F.when(~F.col("rejected"), c)
    found = told.select(
        "id", "pos", kept(F.col("method")).alias("method"),
        F.when(F.col("rejected"), "none").when(several & ~apart, "ambiguous").when(doubted & (confidence == "high"), "medium").otherwise(confidence).alias("confidence"),
        kept(F.when(doubted, F.greatest(radius, F.lit(METHODS["osm-partial"][0]))).otherwise(radius)).alias("radius_mi"), kept(F.round("lat", 6)).alias("lat"), kept(F.round("lon", 6)).alias("lon"),
        "places", F.when(F.col("rejected"), rejection).otherwise(notes).alias("evidence"),
    )
    out = endpoints.select("id", "pos", "name").join(found, ["id", "pos"], "left")
    return out.withColumns({"confidence": F.coalesce("confidence", F.lit("none")), "places": F.coalesce("places", F.lit(0)), "evidence": F.coalesce("evidence", F.lit("no place of this name is known"))})
