"""Queries over project pairs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..operators import filters, pairs
from ..operators.common import checkpointed

from ..sources.adapters import ENDPOINTS, PROJECTS, build, in_doubles, plain

AS_OF = "2000-06-01"
VIEW = filters.PairQuery(search="u1", distance=15.0, year=2000, timing="overlap", utility="U4", include_possible=True)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir, in_doubles(PROJECTS))


#: What the distance join asks of a project; pairs carry no more than this and what a query names.
ASKED = ("id", "plan_ord", "state", "lat", "lon", "radius_mi", "isd", "win_start", "win_end")


def all_pairs(spark: SparkSession, sf_dir: str, possible: bool = True, exact: bool = False, told: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose projects carry ``told`` beside what the join asks."""
    return pairs.distance_join(projects(spark, sf_dir).select(*ASKED, *told), include_possible=possible, as_of=AS_OF, exact=exact)


def pairs_with(spark: SparkSession, sf_dir: str, told: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs without possible ones, whose projects carry what is ``told`` of each (``id`` and more), and little else: it is joined
    to projects, so that pairs need no shuffle."""
    slim = projects(spark, sf_dir).select(*ASKED)
    return pairs.distance_join(slim.join(told, "id", how))


def miles6(c: str = "miles"):
    return F.round(F.col(c), 6).alias(c)


def q_pairs(spark, sf_dir):
    """J1 distance join with class, windows, gap and score; C1, C2, J3, J4, F9, F22, G2."""
    p = all_pairs(spark, sf_dir)
    return p.select("id", miles6(), "certainty", "qualifies", "gap_days", "overlap_days", "remaining_days", "both_past", "score_total", "score_proximity", "score_timing")


HAV = """{r} * 2 * atan2(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)),
       sqrt(1 - (pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"""
MILES = HAV.format(r=3958.7613, a="a", b="b")

PAIRS_CTE = f"""
projects AS ({plain(PROJECTS)}),
met AS (
  SELECT a.id || '__' || b.id AS id, a.id AS a_id, b.id AS b_id, a.ord AS a_ord, b.ord AS b_ord, {MILES} AS miles, coalesce(a.radius_mi, 0) + coalesce(b.radius_mi, 0) AS slack,
         a.isd AS a_isd, b.isd AS b_isd, a.win_start AS s1, a.win_end AS e1, b.win_start AS s2, b.win_end AS e2, a.state AS a_state, b.state AS b_state,
         a.utility AS a_utility, b.utility AS b_utility, a.name AS a_name, b.name AS b_name, a.cost_cents AS a_cents, b.cost_cents AS b_cents, a.miles AS a_miles, b.miles AS b_miles
  FROM projects a JOIN projects b ON a.plan_ord < b.plan_ord AND a.state <> b.state AND a.lat IS NOT NULL AND b.lat IS NOT NULL
), classed AS (
  SELECT *, CASE WHEN miles + slack < 25 THEN 'robust' WHEN miles < 25 THEN 'sensitive' WHEN miles - slack < 25 THEN 'possible' END AS certainty,
         miles < 25 AS qualifies, abs(datediff('day', a_isd, b_isd)) AS gap_days,
         CASE WHEN s1 IS NOT NULL AND e1 IS NOT NULL AND s2 IS NOT NULL AND e2 IS NOT NULL THEN greatest(0, datediff('day', greatest(s1, s2), least(e1, e2))) END AS overlap_days,
         CASE WHEN coalesce(e1 < DATE '{AS_OF}', false) OR coalesce(e2 < DATE '{AS_OF}', false) THEN 0
              WHEN s1 IS NOT NULL AND e1 IS NOT NULL AND s2 IS NOT NULL AND e2 IS NOT NULL
              THEN greatest(0, datediff('day', greatest(s1, s2, DATE '{AS_OF}'), least(e1, e2))) END AS remaining_days,
         coalesce(a_isd < DATE '{AS_OF}' AND b_isd < DATE '{AS_OF}', false) AS both_past
  FROM met WHERE miles - slack < 25
), scored AS (
  SELECT *, 60 * greatest(0, 1 - miles / 25) AS prox,
         CASE WHEN coalesce(remaining_days, overlap_days) > 0 THEN 40 * least(1, 0.5 + coalesce(remaining_days, overlap_days) / 730.0)
              WHEN gap_days IS NOT NULL THEN 20 * greatest(0, 1 - gap_days / 1095.0) ELSE 0 END AS timing
  FROM classed
), pairs AS MATERIALIZED (
  SELECT *, CAST(floor((prox + timing) * CASE WHEN certainty = 'robust' THEN 1 ELSE 0.85 END + 0.5) AS BIGINT) AS score_total,
         CAST(floor(prox + 0.5) AS BIGINT) AS score_proximity, CAST(floor(timing + 0.5) AS BIGINT) AS score_timing
  FROM scored
)"""

SQL_PAIRS = f"WITH {PAIRS_CTE} SELECT id, round(miles, 6) AS miles, certainty, qualifies, gap_days, overlap_days, remaining_days, both_past, score_total, score_proximity, score_timing FROM pairs"


def q_rank(key):
    def run(spark, sf_dir):
        """O1 order by the key and W9 rank of qualifying pairs."""
        found = all_pairs(spark, sf_dir, exact=True).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), *pairs.ordered_by(key))
        pair = F.concat("a", F.lit("__"), "b")
        # Written once, with keys that repeat: the sample that ranges are cut by would ask for all miles a second time.
        return pairs.shown_rank(checkpointed(found), key, pair).select(pair.alias("id"), "rank", "shown_rank")

    return run


def sql_rank(by):
    return f"""WITH {PAIRS_CTE}, r AS (SELECT id, qualifies, row_number() OVER (ORDER BY qualifies DESC, {by}, id) AS rank FROM pairs)
SELECT id, rank, CASE WHEN qualifies THEN rank END AS shown_rank FROM r"""


RANKS = {
    "score": "score_total DESC, miles", "distance": "miles", "time": "gap_days ASC NULLS LAST, miles", "overlap": "coalesce(remaining_days, -1) DESC, miles",
}


def q_filter_flags(spark, sf_dir):
    """Every conjunct of a view, and whether the pair is kept."""
    parts = VIEW.conjuncts()
    return all_pairs(spark, sf_dir, told=("name", "utility")).select("id", *[v.alias(f"is_{k}") for k, v in parts.items()], VIEW.predicate().alias("kept"))


def _conjuncts_sql() -> dict[str, str]:
    low = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g') LIKE '%u1%'"
    fields = ["a_id", "a_name", "a_utility", "b_id", "b_name", "b_utility"]
    return {
        "include_possible": "true",
        "year": "(a_isd IS NULL OR year(a_isd) <= 2000) AND (b_isd IS NULL OR year(b_isd) <= 2000)",
        "distance": "CASE WHEN qualifies THEN miles ELSE greatest(0, miles - slack) END < 15",
        "utility": "(a_state <> 'SC' OR a_utility = 'U4') AND (b_state <> 'SC' OR b_utility = 'U4')",
        "hide_past": "NOT both_past",
        "timing": "coalesce(overlap_days > 0, false)",
        "shortlist": "true",
        "search": "(" + " OR ".join(low.format(f) for f in fields) + ")",
        "project": "true",
        "ground": "true",
    }


def sql_filter_flags():
    parts = _conjuncts_sql()
    return f"WITH {PAIRS_CTE} SELECT id, {', '.join(f'{v} AS is_{k}' for k, v in parts.items())}, {' AND '.join(f'({v})' for v in parts.values())} AS kept FROM pairs"


def q_leave_one_out(spark, sf_dir):
    """Active settings and what there would be without each."""
    return filters.leave_one_out(all_pairs(spark, sf_dir, told=("name", "utility")), VIEW)


def sql_leave_one_out():
    parts = _conjuncts_sql()
    free = {"include_possible": "qualifies", "distance": "CASE WHEN qualifies THEN miles ELSE greatest(0, miles - slack) END < 25"}
    rows = []
    for name in ["hide_past", "search", "distance", "year", "timing", "utility", "include_possible"]:
        keep = " AND ".join(f"({free.get(k, 'true') if k == name else v})" for k, v in parts.items())
        rows.append(f"SELECT '{name}' AS setting, count(*) FILTER (WHERE {keep}) AS n FROM pairs")
    return f"WITH {PAIRS_CTE} SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE n > 0"


def q_labels(spark, sf_dir):
    """C4, C7, C10 labels of pairs."""
    p = all_pairs(spark, sf_dir)
    ahead = F.coalesce("remaining_days", "overlap_days")
    return p.select(
        "id", classify.opportunity(F.col("qualifies"), F.lit(0), ahead, F.col("miles")).alias("opportunity"),
        classify.gap_label(F.col("gap_days")).alias("gap_label"), classify.overlap_label(F.col("overlap_days")).alias("overlap_label"),
    )


SQL_LABELS = f"""WITH {PAIRS_CTE}, x AS (SELECT *, coalesce(remaining_days, overlap_days) AS ahead FROM pairs)
SELECT id, CASE WHEN NOT qualifies THEN 'verify locations' WHEN ahead > 0 AND miles < 10 THEN 'nearby with overlap' WHEN ahead > 0 THEN 'overlap in region'
                WHEN miles < 5 THEN 'nearby' ELSE 'regional' END AS opportunity,
       CASE WHEN gap_days IS NULL THEN 'Timing unknown' WHEN gap_days < 365 THEN gap_days || ' days apart' ELSE printf('%.1f', round(gap_days / 365.25::DOUBLE, 1)) || ' years apart' END AS gap_label,
       CASE WHEN overlap_days IS NULL THEN 'Planning window unknown' WHEN overlap_days = 0 THEN 'Planning windows don''t overlap'
            WHEN overlap_days < 60 THEN 'Planning windows overlap ' || overlap_days || ' days'
            ELSE 'Planning windows overlap ' || CAST(floor(overlap_days / 30.44 + 0.5) AS BIGINT) || ' months' END AS overlap_label
FROM x"""


def q_scenario(spark, sf_dir):
    """M5 to M8: yard scenario, its availability and months, land value, and savings for scale."""
    p = all_pairs(spark, sf_dir, told=("cost_cents", "miles"))
    ahead = F.coalesce("remaining_days", "overlap_days", F.lit(0))
    reason = classify.scenario_reason(F.col("qualifies"), F.col("remaining_days"), F.col("overlap_days"))
    months = classify.scenario_months(ahead)
    land = classify.land_value(F.col("a.state"), F.col("b.state"))
    yard = classify.yard(5.0, land, 0.10, months, 0.25)
    cost = lambda s: F.coalesce(F.col(f"{s}.cost_cents") / 100.0, F.when(F.col(f"{s}.miles") != 0, F.col(f"{s}.miles") * 1000000.0))
    least = F.when(cost("a").isNotNull() & cost("b").isNotNull() & reason.isNull(), F.least(cost("a"), cost("b")))
    return p.select(
        "id", reason.alias("reason"), months.alias("months"), land.alias("land_per_acre"), F.round(F.when(reason.isNull(), yard).otherwise(0.0), 4).alias("yard_high"),
        F.round(F.when(reason.isNull(), yard * 0.5).otherwise(0.0), 4).alias("yard_low"), F.round(least * 0.04 * 0.5, 4).alias("saving_low"), F.round(least * 0.04 * 1.5, 4).alias("saving_high"),
    )


SQL_SCENARIO = f"""WITH {PAIRS_CTE}, x AS (
  SELECT *, coalesce(remaining_days, overlap_days, 0) AS ahead, (CASE WHEN a_state = 'SC' THEN 4500.0 ELSE 5100.0 END + CASE WHEN b_state = 'SC' THEN 4500.0 ELSE 5100.0 END) / 2 AS land,
         CASE WHEN NOT qualifies THEN 'not qualifying' WHEN NOT (coalesce(remaining_days, overlap_days, 0) > 0) AND (remaining_days IS NOT NULL OR overlap_days IS NOT NULL) THEN 'no overlap ahead'
              WHEN NOT (coalesce(remaining_days, overlap_days, 0) > 0) THEN 'window unknown' END AS reason,
         coalesce(a_cents / 100.0::DOUBLE, CASE WHEN a_miles <> 0 THEN a_miles * 1000000.0 END) AS ca, coalesce(b_cents / 100.0::DOUBLE, CASE WHEN b_miles <> 0 THEN b_miles * 1000000.0 END) AS cb
  FROM pairs
), y AS (
  SELECT *, CASE WHEN ahead > 0 THEN greatest(1, CAST(floor(ahead / 30.44 + 0.5) AS BIGINT)) ELSE 0 END AS months FROM x
)
SELECT id, reason, months, CAST(land AS DOUBLE) AS land_per_acre,
       round(CASE WHEN reason IS NULL THEN CAST(5 * 69975.0 + 0.25 * 593636.0 AS DOUBLE) + 5.0::DOUBLE * land * 0.10::DOUBLE * months / 12 ELSE 0 END, 4) AS yard_high,
       round(CASE WHEN reason IS NULL THEN (CAST(5 * 69975.0 + 0.25 * 593636.0 AS DOUBLE) + 5.0::DOUBLE * land * 0.10::DOUBLE * months / 12) * 0.5::DOUBLE ELSE 0 END, 4) AS yard_low,
       CASE WHEN reason IS NULL AND ca IS NOT NULL AND cb IS NOT NULL THEN round(least(ca, cb) * 0.04::DOUBLE * 0.5::DOUBLE, 4) END AS saving_low,
       CASE WHEN reason IS NULL AND ca IS NOT NULL AND cb IS NOT NULL THEN round(least(ca, cb) * 0.04::DOUBLE * 1.5::DOUBLE, 4) END AS saving_high
FROM y"""


def q_nearby_endpoints(spark, sf_dir):
    """J5 endpoint pairs at most half a mile apart."""
    found = pairs.nearby_endpoints(projects(spark, sf_dir), build(spark, sf_dir, ENDPOINTS))
    return found.select("pair", "a_name", "b_name", "a_pos", "b_pos", miles6())


SQL_NEARBY = f"""WITH {PAIRS_CTE}, endpoints AS ({plain(ENDPOINTS)}), e AS (
  SELECT p.id AS pair, a.name AS a_name, b.name AS b_name, a.pos AS a_pos, b.pos AS b_pos, {MILES} AS miles
  FROM pairs p JOIN endpoints a ON a.id = p.a_id JOIN endpoints b ON b.id = p.b_id WHERE p.certainty <> 'possible' AND a.lat IS NOT NULL AND b.lat IS NOT NULL
) SELECT pair, a_name, b_name, a_pos, b_pos, round(miles, 6) AS miles FROM e WHERE miles <= 0.5"""


def q_nearest_partner(spark, sf_dir):
    """J6 nearest project of another plan and state."""
    return pairs.nearest_partner(projects(spark, sf_dir)).select("id", "partner", miles6())


SQL_NEAREST = f"""WITH projects AS ({plain(PROJECTS)}), m AS (
  SELECT a.id, b.id AS partner, b.ord, {MILES} AS miles FROM projects a JOIN projects b ON a.plan_ord <> b.plan_ord AND a.state <> b.state AND a.lat IS NOT NULL AND b.lat IS NOT NULL
) SELECT id, partner, round(miles, 6) AS miles FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY miles, ord) = 1"""


def q_partner_counts(spark, sf_dir):
    """J8 pairs of each located project."""
    return pairs.partner_counts(all_pairs(spark, sf_dir, False), projects(spark, sf_dir))


SQL_PARTNERS = f"""WITH {PAIRS_CTE}, s AS (SELECT a_id AS id FROM pairs WHERE certainty <> 'possible' UNION ALL SELECT b_id FROM pairs WHERE certainty <> 'possible')
SELECT p.id, count(s.id) AS partners FROM projects p LEFT JOIN s ON s.id = p.id WHERE p.lat IS NOT NULL GROUP BY p.id"""


def q_overview(spark, sf_dir):
    """A13 overview, A28 bounds, A29 years: one row."""
    p = projects(spark, sf_dir)
    found = all_pairs(spark, sf_dir, False)
    counted = found.agg(F.count_if("qualifies").alias("qualifying"), F.count_if(F.coalesce("remaining_days", "overlap_days") > 0).alias("overlapping"))
    alone = pairs.partner_counts(found, p).agg(F.count_if(F.col("partners") == 0).alias("unpaired"))
    basics = p.agg(
        F.count("*").alias("projects"), F.count("lat").alias("located"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"),
        F.min(F.year("isd")).alias("first_year"), F.max(F.year("isd")).alias("last_year"),
    )
    return basics.join(counted, F.lit(True)).join(alone, F.lit(True))


SQL_OVERVIEW = f"""WITH {PAIRS_CTE}, good AS (SELECT * FROM pairs WHERE certainty <> 'possible')
SELECT count(*) AS projects, count(lat) AS located, CAST(min(lat) AS DOUBLE) AS south, CAST(max(lat) AS DOUBLE) AS north, CAST(min(lon) AS DOUBLE) AS west, CAST(max(lon) AS DOUBLE) AS east,
       CAST(min(year(isd)) AS INTEGER) AS first_year, CAST(max(year(isd)) AS INTEGER) AS last_year,
       (SELECT count(*) FROM good WHERE qualifies) AS qualifying, (SELECT count(*) FROM good WHERE coalesce(remaining_days, overlap_days) > 0) AS overlapping,
       (SELECT count(*) FROM projects WHERE lat IS NOT NULL AND id NOT IN (SELECT a_id FROM good UNION ALL SELECT b_id FROM good)) AS unpaired
FROM projects"""


def q_same_stations(spark, sf_dir):
    """J7 projects of a plan with the same endpoint names."""
    return pairs.same_stations(projects(spark, sf_dir), build(spark, sf_dir, ENDPOINTS))


SQL_SAME = f"""WITH e AS ({plain(ENDPOINTS)}), n AS (SELECT id, plan, list_sort(list(DISTINCT upper(name))) AS names FROM e GROUP BY id, plan HAVING count(DISTINCT upper(name)) >= 2),
k AS (SELECT id, plan || '|' || array_to_string(names, '+') AS key FROM n)
SELECT id, key, count(*) OVER (PARTITION BY key) - 1 AS others FROM k QUALIFY others > 0"""


def q_pairing_range(spark, sf_dir):
    """F20 projects with a possible partner in range."""
    return pairs.in_pairing_range(projects(spark, sf_dir))


SQL_RANGE = f"""WITH p AS ({plain(PROJECTS)}), m AS (
  SELECT a.id, {HAV.format(r=3958.8, a='a', b='b')} AS miles, coalesce(a.radius_mi, 0) + coalesce(b.radius_mi, 0) AS slack
  FROM p a JOIN p b ON a.plan_ord <> b.plan_ord AND a.state <> b.state AND a.lat IS NOT NULL AND b.lat IS NOT NULL)
SELECT DISTINCT id FROM m WHERE miles < 25 + slack"""


def q_project_types(spark, sf_dir):
    """C3 project types of part names and kinds, as titles and descriptions."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = F.element_at(F.array(*[F.lit(w) for w in TITLE_WORDS]), (F.col("p_partkey") % len(TITLE_WORDS) + 1).cast("int"))
    return parts.select("p_partkey", classify.project_type(F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 2 == 0, words)), words).alias("kind"))


def q_rationale(spark, sf_dir):
    """Why pairs are listed and what they may share."""
    p = all_pairs(spark, sf_dir, told=("zone",))
    why = classify.reasons(F.col("qualifies"), F.col("miles"), F.col("certainty"), F.col("remaining_days"), F.col("overlap_days"), F.col("gap_days"))
    share = classify.shared_resources(F.col("qualifies"), F.col("remaining_days"), F.col("a.zone") == F.col("b.zone"))
    return p.select("id", F.array_join(F.slice(why, 2, 9), "; ").alias("why"), F.size(why).alias("n_reasons"), F.array_join(share, "; ").alias("share"))


SQL_RATIONALE = f"""WITH {PAIRS_CTE}, z AS (SELECT p.*, a.zone = b.zone AS same FROM pairs p JOIN projects a ON a.id = p.a_id JOIN projects b ON b.id = p.b_id), w AS (
  SELECT *, list_filter([CASE WHEN remaining_days > 0 THEN 'windows overlap ' || CAST(floor(remaining_days / 30.44 + 0.5) AS BIGINT) || ' months ahead' WHEN overlap_days > 0 THEN 'windows overlapped in the past' WHEN gap_days IS NOT NULL THEN 'dates ' || gap_days || ' days apart' END,
    CASE WHEN certainty = 'sensitive' THEN 'only at best-estimate locations' END], lambda x: x IS NOT NULL) AS why,
    list_filter([CASE WHEN remaining_days > 0 THEN 'one yard instead of two' END, CASE WHEN remaining_days > 0 THEN 'crane, mat and crew mobilisations' END, CASE WHEN same THEN 'procurement, spares or one contractor' END], lambda x: x IS NOT NULL) AS listed FROM z)
SELECT id, array_to_string(why, '; ') AS why, CAST(len(why) + 1 AS INTEGER) AS n_reasons, CASE WHEN NOT qualifies THEN 'verify locations first' WHEN len(listed) = 0 THEN 'crew and contractor scheduling' ELSE array_to_string(listed, '; ') END AS share FROM w"""


TITLE_WORDS = ("new line", "capacitor bank", "SCADA relay", "rebuild", "river crossing", "jumpers", "substation", "misc")


def sql_project_types():
    def cases(place: str) -> str:
        return " ".join(f"WHEN regexp_matches({place}, '(?i){p}') THEN '{k}'" for k, p in classify.PROJECT_TYPES)

    words = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(TITLE_WORDS)) + " END"
    return f"""WITH t AS (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' ' || {words} ELSE '' END AS title, {words} AS d FROM part)
SELECT p_partkey, CASE {cases('title')} {cases("(title || ' ' || d)")} ELSE '{classify.OTHER_TYPE}' END AS kind FROM t"""


QUERIES = {
    "pairs": q_pairs, **{f"rank_{k}": q_rank(k) for k in RANKS}, "pair_filter": q_filter_flags, "leave_one_out": q_leave_one_out, "pair_labels": q_labels,
    "yard_scenario": q_scenario, "nearby_endpoints": q_nearby_endpoints, "nearest_partner": q_nearest_partner, "partner_counts": q_partner_counts, "overview": q_overview,
    "same_stations": q_same_stations, "pairing_range": q_pairing_range, "project_types": q_project_types, "rationale": q_rationale,
}
SQL = {
    "pairs": SQL_PAIRS, **{f"rank_{k}": sql_rank(v) for k, v in RANKS.items()}, "pair_filter": sql_filter_flags(), "leave_one_out": sql_leave_one_out(), "pair_labels": SQL_LABELS,
    "yard_scenario": SQL_SCENARIO, "nearby_endpoints": SQL_NEARBY, "nearest_partner": SQL_NEAREST, "partner_counts": SQL_PARTNERS, "overview": SQL_OVERVIEW,
    "same_stations": SQL_SAME, "pairing_range": SQL_RANGE, "project_types": sql_project_types(), "rationale": SQL_RATIONALE,
}
