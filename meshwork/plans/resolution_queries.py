"""Endpoints resolved from all the places that their names may mean."""

from __future__ import annotations

from ..operators import placement, resolution, rules
from ..sources.adapters import ENDPOINTS, build, plain
from .layer_queries import ANCHORS, _judged
from .rule_queries import ASIN, CHOICES, _FAR

#: One to three places for each endpoint; those of every seventh name lie far away, some have another owner.
FOUND = f"""SELECT c.id, c.pos, c.choice, c.lat + CASE WHEN (e.ord + e.pos * 2) % 7 < 2 THEN 3.0 ELSE 0.0 END AS lat, c.lon, CASE e.method WHEN 'town' THEN 'town' WHEN 'reference' THEN 'reference' ELSE 'osm-exact' END AS method,
  e.name || '/' || CAST(c.choice AS STRING) AS label, CASE WHEN e.ord % 6 = 0 THEN 'Another Utility' END AS owner
FROM ({CHOICES}) c JOIN ({ENDPOINTS}) e ON e.id = c.id AND e.pos = c.pos WHERE c.choice <= (e.ord + e.pos * 2) % 3 AND (e.ord % 5 > 0 OR e.pos = 1)"""


def q_resolved(spark, sf_dir):
    """Endpoints by joint choice, rejection and the ladder of confidence."""
    return resolution.resolved_endpoints(build(spark, sf_dir, ENDPOINTS), build(spark, sf_dir, FOUND), build(spark, sf_dir, ANCHORS))


_MI = lambda p, q: ASIN.format(a_lat=f"{p}.lat", a_lon=f"{p}.lon", b_lat=f"{q}.lat", b_lon=f"{q}.lon")
_BY = lambda i: "CASE t.method " + " ".join(f"WHEN '{m}' THEN {v[i]!r}" for m, v in rules.METHODS.items()) + " END"
_TURN = lambda t: f"(SELECT c.* FROM c JOIN f USING (id) WHERE CASE WHEN pos = p0 THEN 0 WHEN pos = p2 THEN 2 ELSE 1 END = {t})"
SQL_RESOLVED = f"""WITH c AS MATERIALIZED ({plain(FOUND)}), a AS ({plain(ANCHORS)}), f AS (SELECT id, min(pos) AS p0, max(pos) AS p2 FROM c GROUP BY id),
k AS (SELECT x.id, x.pos AS q0, y.pos AS q1, z.pos AS q2, x.choice AS c0, y.choice AS c1, z.choice AS c2, {_FAR('x', 'y')} + {_FAR('x', 'z')} + {_FAR('y', 'z')} + {_FAR('x', 'n')} + {_FAR('y', 'n')} + {_FAR('z', 'n')} AS cost
  FROM {_TURN(0)} x LEFT JOIN {_TURN(1)} y ON y.id = x.id LEFT JOIN {_TURN(2)} z ON z.id = x.id LEFT JOIN a n ON n.id = x.id),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(cost, 9), c0, c1 NULLS FIRST, c2 NULLS FIRST) = 1),
h AS (SELECT id, q0 AS pos, c0 AS choice FROM b UNION ALL SELECT id, q1, c1 FROM b WHERE q1 IS NOT NULL UNION ALL SELECT id, q2, c2 FROM b WHERE q2 IS NOT NULL),
e AS MATERIALIZED (SELECT c.*, CASE method {' '.join(f"WHEN '{m}' THEN {r}" for m, r in placement.METHOD_RANKS.items())} END AS rank FROM c JOIN h USING (id, pos, choice)),
r0 AS {_judged(0, 'e')}, e1 AS (SELECT * FROM e ANTI JOIN r0 USING (id, pos)), r1 AS {_judged(1, 'e1')}, e2 AS (SELECT * FROM e1 ANTI JOIN r1 USING (id, pos)), r2 AS {_judged(2, 'e2')},
gone AS MATERIALIZED (SELECT id, pos FROM r0 UNION ALL SELECT id, pos FROM r1 UNION ALL SELECT id, pos FROM r2),
s AS (SELECT e.id, e.pos, count(*) AS places, max(CASE WHEN c.choice <> e.choice THEN {_MI('e', 'c')} END) AS spread FROM e JOIN c ON c.id = e.id AND c.pos = e.pos GROUP BY e.id, e.pos),
d AS (SELECT p.id, p.pos, min({_MI('p', 'q')}) AS off FROM e p JOIN e q ON q.id = p.id AND q.pos <> p.pos LEFT JOIN gone g ON g.id = q.id AND g.pos = q.pos WHERE g.id IS NULL OR q.pos > p.pos GROUP BY p.id, p.pos),
l AS (SELECT id, count(*) AS located FROM e GROUP BY id),
t AS (SELECT e.*, g.id IS NOT NULL AS rejected, s.places, s.spread, l.located, a.id IS NOT NULL AS zoned, coalesce(d.off, {_MI('e', 'a')}) AS off FROM e JOIN s USING (id, pos) JOIN l USING (id) LEFT JOIN gone g ON g.id = e.id AND g.pos = e.pos LEFT JOIN d ON d.id = e.id AND d.pos = e.pos LEFT JOIN a ON a.id = e.id),
v AS (SELECT t.*, owner IS NOT NULL AND method <> 'town' AS doubted, {_BY(1)} AS conf, {_BY(0)}::DOUBLE AS radius FROM t)
SELECT n.id, n.pos, n.name, CASE WHEN NOT rejected THEN v.method END AS method,
  CASE WHEN v.id IS NULL OR rejected THEN 'none' WHEN places > 1 AND NOT zoned AND located = 1 THEN 'ambiguous' WHEN doubted AND conf = 'high' THEN 'medium' ELSE conf END AS confidence,
  CASE WHEN NOT rejected THEN CASE WHEN doubted THEN greatest(radius, 1.5) ELSE radius END END AS radius_mi, CASE WHEN NOT rejected THEN round(v.lat, 6) END AS lat, CASE WHEN NOT rejected THEN round(v.lon, 6) END AS lon, coalesce(places, 0) AS places,
  CASE WHEN v.id IS NULL THEN 'no place of this name is known' WHEN rejected THEN 'rejected a ' || v.method || ' match ' || CAST(CAST(round(off) AS BIGINT) AS VARCHAR) || ' mi from the rest of the project (' || label || ')'
    ELSE concat_ws('; ', label, CASE WHEN doubted THEN 'owned by ' || owner || ', so it may be another station of this name' END, CASE WHEN places > 1 THEN places || ' places have this name, another one ' || CAST(CAST(round(spread) AS BIGINT) AS VARCHAR) || ' mi away' END,
      CASE WHEN places > 1 AND (zoned OR located > 1) THEN 'taken as nearest to ' || concat_ws(' and ', CASE WHEN located > 1 THEN 'the other endpoints' END, CASE WHEN zoned THEN 'the zone' END) END) END AS evidence
FROM ({plain(ENDPOINTS)}) n LEFT JOIN v ON v.id = n.id AND v.pos = n.pos"""

QUERIES = {"resolved_endpoints": q_resolved}
SQL = {"resolved_endpoints": SQL_RESOLVED}
