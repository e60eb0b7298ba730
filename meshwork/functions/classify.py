"""Classes, scores, labels and scenario figures of pairs and projects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import js_round

#: The pair rule's miles, score weights and time scales.
CUTOFF = 25.0
PROXIMITY, TIMING = 60.0, 40.0
AHEAD_DAYS, GAP_DAYS = 730.0, 1095.0
#: Unit costs of the shared yard scenario, and days in a month and year.
LAND_PER_ACRE = {"GA": 5100.0, "SC": 4500.0}
MATS_PER_ACRE, ROAD_PER_MILE = 69975.0, 593636.0
MONTH_DAYS, YEAR_DAYS = 30.44, 365.25
#: Project types by pattern, in the order that decides.
PROJECT_TYPES = (
    ("Reactive device", r"\b(reactors?|capacitors?|capacitor banks?|statcom|svc|synchronous condensers?)\b"),
    ("Protection & control", r"\b(relays?|protection|scada|rtu|sw(itch)? house)\b"),
    ("Line rebuild / reconductor", r"\b(rebuild|reconductor|uprate|re-?rate)\b"),
    ("Line relocation / structures", r"\b(move line|relocat\w*|river crossing|structures|angles|dead ends)\b"),
    ("New line or tap", r"\b(new|construct\w*|build|add)\b.*\b(line|tie|tap|spdc)\b|\b(line|tie|tap)\b.*\bconstruct"),
    ("Terminal equipment / limiting element", r"\b(jumpers?|switch(es)?|line traps?|trap|terminal equipment|limiting elements?|equipment upgrade|buses)\b"),
    ("Substation / switching station", r"\b(substation|switching station|switchyard|transformers?|bus|breakers?|sub)\b"),
)
OTHER_TYPE = "Other / unspecified"


def slack(ra: Column, rb: Column) -> Column:
    return F.coalesce(ra, F.lit(0.0)) + F.coalesce(rb, F.lit(0.0))


def certainty(miles: Column, ra: Column, rb: Column, cutoff: float = CUTOFF) -> Column:
    """How sure it is that the centres are within the cutoff, given their radii."""
    s = slack(ra, rb)
    return F.when(miles + s < cutoff, "robust").when(miles < cutoff, "sensitive").when(miles - s < cutoff, "possible").otherwise("none")


def score(miles: Column, remaining: Column, overlap: Column, gap: Column, level: Column) -> dict[str, Column]:
    """Total and parts, each rounded from the unrounded parts."""
    proximity = PROXIMITY * F.greatest(F.lit(0.0), 1 - miles / CUTOFF)
    ahead = F.coalesce(remaining, overlap)
    timing = (
        F.when(ahead > 0, TIMING * F.least(F.lit(1.0), 0.5 + ahead / AHEAD_DAYS))
        .when(gap.isNotNull(), TIMING / 2 * F.greatest(F.lit(0.0), 1 - gap / GAP_DAYS)).otherwise(0.0)
    )
    factor = F.when(level == "robust", 1.0).otherwise(0.85)
    return {"total": js_round((proximity + timing) * factor), "proximity": js_round(proximity), "timing": js_round(timing)}


def project_type(title: Column, description: Column) -> Column:
    """First pattern found in the title, else the first found in title and description."""
    title = F.coalesce(title, F.lit(""))
    text = F.concat(title, F.lit(" "), F.coalesce(description, F.lit("")))
    out = None
    for place in (title, text):
        for label, pattern in PROJECT_TYPES:
            hit = place.rlike("(?i)" + pattern)
            out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(OTHER_TYPE)


def opportunity(qualifies: Column, near_endpoints: Column, ahead: Column, miles: Column) -> Column:
    """Kind of opportunity, by priority."""
    return (
        F.when(~qualifies, "verify locations").when(near_endpoints > 0, "common endpoints")
        .when((ahead > 0) & (miles < 10), "nearby with overlap").when(ahead > 0, "overlap in region")
        .when(miles < 5, "nearby").otherwise("regional")
    )


def gap_label(days: Column) -> Column:
    return F.when(days.isNull(), "Timing unknown").when(days < 365, F.concat(days.cast("string"), F.lit(" days apart"))).otherwise(
        F.concat(F.format_string("%.1f", F.round(days / YEAR_DAYS, 1)), F.lit(" years apart"))
    )


def overlap_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), "Planning window unknown").when(days == 0, "Planning windows don't overlap")
        .when(days < 60, F.concat(F.lit("Planning windows overlap "), days.cast("string"), F.lit(" days")))
        .otherwise(F.concat(F.lit("Planning windows overlap "), js_round(days / MONTH_DAYS).cast("string"), F.lit(" months")))
    )


def scenario_months(ahead: Column) -> Column:
    return F.when(ahead > 0, F.greatest(F.lit(1), js_round(ahead / MONTH_DAYS))).otherwise(F.lit(0)).cast("long")


def scenario_reason(qualifies: Column, remaining: Column, overlap: Column) -> Column:
    """Why no shared yard is modelled; null if one is."""
    ahead = F.coalesce(remaining, overlap, F.lit(0))
    known = remaining.isNotNull() | overlap.isNotNull()
    return F.when(~qualifies, "not qualifying").when(~(ahead > 0) & known, "no overlap ahead").when(~(ahead > 0), "window unknown")


def land_value(state_a: Column, state_b: Column) -> Column:
    """Mean of the cited values of the pair's states; of all cited ones if neither is."""
    cited = F.create_map(*[F.lit(x) for kv in LAND_PER_ACRE.items() for x in kv])
    both = F.array_distinct(F.array_compact(F.array(state_a, state_b)))
    have = F.array_compact(F.transform(both, lambda s: F.try_element_at(cited, s)))
    mean = F.aggregate(have, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(have), F.lit(0))
    return F.coalesce(mean, F.lit(sum(LAND_PER_ACRE.values()) / len(LAND_PER_ACRE)))


def yard(acres: float, land: Column, lease_rate: float, months: Column, road_miles: float, mats: float = MATS_PER_ACRE) -> Column:
    """Cost of one staging yard."""
    return F.lit(acres * mats + road_miles * ROAD_PER_MILE) + acres * land * lease_rate * months / 12


def flood_text(zone: Column, subtype: Column) -> Column:
    """Class of a flood zone code."""
    return (
        F.when(zone.isNull(), None).when(zone.startswith("V"), "coastal high hazard").when(zone.rlike("^A"), "1% annual chance")
        .when((zone == "X") & subtype.contains("0.2"), "0.2% annual chance").when(zone == "X", "minimal")
        .when(zone == "D", "undetermined").when(zone == "OPEN WATER", "open water")
    )


def reasons(qualifies: Column, miles: Column, level: Column, remaining: Column, overlap: Column, gap: Column) -> Column:
    """Why a pair is listed, as ordered short statements; those that do not apply are left out."""
    first = F.when(qualifies, F.format_string("centres %.2f mi apart, under the rule", F.round(miles, 2))).otherwise(F.format_string("centres %.2f mi apart, outside the rule", F.round(miles, 2)))
    windows = (
        F.when(remaining > 0, F.format_string("windows overlap %d months ahead", js_round(remaining / MONTH_DAYS)))
        .when(overlap > 0, "windows overlapped in the past").when(gap.isNotNull(), F.format_string("dates %d days apart", gap.cast("long")))
    )
    return F.array_compact(F.array(first, windows, F.when(level == "sensitive", "only at best-estimate locations")))


def shared_resources(qualifies: Column, remaining: Column, same_type: Column) -> Column:
    """What two projects may share, as ordered short statements."""
    ahead = F.coalesce(remaining > 0, F.lit(False))
    listed = F.array_compact(F.array(
        F.when(ahead, "one yard instead of two"), F.when(ahead, "crane, mat and crew mobilisations"), F.when(same_type, "procurement, spares or one contractor"),
    ))
    return F.when(~qualifies, F.array(F.lit("verify locations first"))).when(F.size(listed) == 0, F.array(F.lit("crew and contractor scheduling"))).otherwise(listed)
