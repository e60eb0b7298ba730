"""Names, keys, dates, money and labels from printed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a place, and what abbreviations stand for.
NOISE = (
    "substation|sub|ss|switching station|switchyard|station|generating plant|power plant|plant|"
    "tap|jct|junction|kv|the|of|inc|scana|sce g|desc|gpc|georgia power|dominion energy"
)
LEADING = {"st": "saint", "ft": "fort", "mt": "mount"}
DIRECTIONS = {"n": "north", "s": "south", "e": "east", "w": "west"}
ROADS = {"dr": "drive", "ave": "avenue", "av": "avenue", "hwy": "highway", "pkwy": "parkway", "blvd": "boulevard", "ln": "lane", "co": "county", "cty": "county"}
PLACE_CLASSES = ("place", "boundary", "highway", "waterway", "landuse", "power")
REGIONS = r"\b(georgia|carolina)\b"
COMPANY_NOISE = "inc|llc|corp|corporation|company|co|the"


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


NAME_STEPS = (
    ("&", " and "), ("['’]", ""), (r"\bhydroelectric\b", "hydro"), (r"\((sav|usa|aug)\)", " "),
    *[(rf"\b{a}\.?\s", f"{b} ") for a, b in LEADING.items()],
    ("[^a-z0-9 ]", " "), (rf"\b({NOISE})\b", " "), (r"\brd\b", "road"),
    *[(rf"\b{a}\b", b) for a, b in DIRECTIONS.items()],
    (r"\bpri\b", "primary"), (r"\b\d+\b", " "), (r"\s+", " "),
)
COMPANY_STEPS = (("[^a-z0-9& ]", " "), ("&", " and "), (rf"\b({COMPANY_NOISE})\b", " "), (r"\s+", " "))
TITLE_VOLTAGE = r"(?i)\b\d{2,3}(\s*[-/]\s*\d{1,3}(\.\d)?)?\s*kv\b.*$"


def norm_name(name: Column) -> Column:
    """A place name without what differs between printings; the order of steps matters."""
    return F.trim(_chain(F.lower(name), *NAME_STEPS))


def place_key(name: Column) -> Column:
    """A normalised name with the words of roads and counties in full."""
    full = F.create_map(*[F.lit(w) for pair in ROADS.items() for w in pair])
    return F.array_join(F.transform(F.split(norm_name(name), " "), lambda w: F.coalesce(full[w], w)), " ")


def stands_in(kind: Column, name: Column, query: Column) -> Column:
    """Whether a place of that kind carries the asked name: the same, or one of two or more words after a qualifier."""
    n, q = place_key(name), place_key(query)
    named = (n == q) | ((F.size(F.split(q, " ")) >= 2) & F.endswith(n, F.concat(F.lit(" "), q)))
    return F.coalesce(kind.isin(*PLACE_CLASSES) & named & ~q.rlike(REGIONS), F.lit(False))


def company_key(name: Column) -> Column:
    return F.trim(_chain(F.lower(F.coalesce(name, F.lit(""))), *COMPANY_STEPS))


def title_key(title: Column) -> Column:
    """Key of a title: no voltage, no ordinal, the normalised name in upper case with hyphens."""
    return F.regexp_replace(F.upper(norm_name(_chain(title, (TITLE_VOLTAGE, ""), (r"#\s*\d+", " ")))), " ", "-")


def record_key(printed: Column, name: Column) -> Column:
    """The printed id without blanks and outer marks, else a slug of the name."""
    own = F.upper(_chain(F.coalesce(printed, F.lit("")), (r"\s+", ""), (r"^\W+|\W+$", "")))
    return F.coalesce(F.nullif(own, F.lit("")), slug(name))


def slug(text: Column) -> Column:
    return _chain(F.lower(text), ("[^a-z0-9]+", "-"), ("^-+|-+$", ""))


def tokens(text: Column) -> Column:
    """Words and numbers in lower case, keeping inner ``. , /``."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:[.,/][a-z0-9]+)*)"), F.lit(1))


def compatible_directions(a: Column, b: Column) -> Column:
    """Whether no opposite directions stand against each other in two normalised names."""
    wa, wb = F.split(a, " "), F.split(b, " ")
    clash = F.lit(False)
    for x, y in (("east", "west"), ("north", "south")):
        for p, q in ((x, y), (y, x)):
            clash = clash | (F.array_contains(wa, p) & F.array_contains(wb, q))
    return ~clash


def printed_date(text: Column) -> Column:
    """``struct(date, issue)`` of the first m/d/y; an impossible day becomes the month's last, and an issue."""
    part = lambda g: F.regexp_extract(text, r"(\d{1,2})/(\d{1,2})/(\d{2,4})", g)
    found = part(0) != ""
    year = F.when(found, part(3).cast("int"))
    year = F.when(year < 100, year + 2000).otherwise(year)
    stated = lambda day: F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.when(found, part(1)), day), "yyyy-M-d")
    exact = stated(F.when(found, part(2)))
    last = F.last_day(stated(F.lit("1")))
    issue = (
        F.when(~found | text.isNull(), "unparseable").when(exact.isNotNull(), None).when(last.isNotNull(), "impossible day").otherwise("invalid date")
    )
    return F.struct(F.coalesce(exact, last).alias("date"), issue.alias("issue"))


def dollars(text: Column) -> Column:
    """Printed money as dollars, with k, M or B behind it or in words."""
    number = F.regexp_replace(F.regexp_extract(text, r"\$?\s*([0-9][0-9,]*(\.[0-9]+)?)", 1), ",", "")
    unit = F.lower(F.regexp_extract(text, r"(?i)[0-9]\s*(k|m|b|thousand|million|billion)\b", 1))
    times = F.when(unit.isin("k", "thousand"), 1e3).when(unit.isin("m", "million"), 1e6).when(unit.isin("b", "billion"), 1e9).otherwise(1.0)
    return F.when(number != "", F.expr("1") * number.cast("double") * times)


def stations(title: Column, limit: int = 3) -> Column:
    """Station names of a title: before the colon, without brackets, ordinals and voltage, cut at dashes and &."""
    plain = _chain(F.split(title, ":").getItem(0), (r"\([^)]*\)", " "), (r"#\s*\d+", " "), (TITLE_VOLTAGE, ""))
    parts = F.transform(F.split(plain, r"\s*[-–&]\s*"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[ ,/]+|[ ,/]+$", "")))
    return F.slice(F.filter(parts, lambda x: F.length(x) > 1), 1, limit)


#: Prefixes of the first plan's titles, voltages, words that end a station's name, and those that may begin one.
PLAN_PREFIXES = ((r"(?i)^(SAV|GTC|MEAG|DU|SPC|GRID)\s*[:\-]\s*", ""), (r"(?i)^CC\s*[:\-–]\s*", ""), (r"(?i)^.*\bAT\s+", ""))
VOLTAGE = r"(?i)\b\d{2,3}(?:\s*[-/]\s*\d{1,3})?\s*kv\b.*$"
STOP_WORDS = (
    "rebuild", "rebuilds", "reconductor", "construct", "construction", "upgrade", "upgrades", "replace", "replacement", "new", "line", "lines",
    "tie", "tap", "loop", "sub", "substation", "switching station", "fold-in", "fold in", "network improvements", "improvements",
    "relay", "modernization", "breaker", "breakers", "auto transformer", "autotransformer", "transformer", "statcom", "cap bank",
    "series reactor", "reactors?", "conversion", "strategic", "solution", "project", "area", "bus", "jumper", "spdc", "second", "add",
    "overstressed", "network", "switch", "transmission", "terminal", "equipment", "protection", "capacitor",
)
NAME_PREFIXES = ("line", "new", "project", "switch")
STOP = rf"(?i)\b({'|'.join(STOP_WORDS)})\b.*$"
LEAD = rf"(?i)^({'|'.join(NAME_PREFIXES)})\b"
TITLE_MARKS = ((r"\([^)]*\)", " "), (r"#\s*\d+", " "), (VOLTAGE, ""))


def title_stations(title: Column, plan: Column | None = None, limit: int = 3) -> Column:
    """Station names of a title: before the colon, without brackets, ordinals and voltage, cut at dashes and &, and
    each cut off where it turns into a description.  A descriptor may begin a name (Line Creek, Project Speedway).

    Prefixes of sponsors are conventions of the plan "ga" alone.
    """
    if plan is not None:
        title = F.when(plan == "ga", _chain(title, *PLAN_PREFIXES)).otherwise(title)
    plain = _chain(F.split(title, ":").getItem(0), *TITLE_MARKS)
    parts = F.transform(F.split(plain, r"\s*[-–&]\s*"), lambda x: F.regexp_replace(x, r"^[ ,/]+|[ ,/]+$", ""))
    lead = lambda x: F.regexp_extract(x, LEAD, 1)
    cut = lambda x: F.concat(lead(x), F.regexp_replace(F.substring(x, F.length(lead(x)) + 1, F.length(x)), STOP, ""))
    return F.slice(F.filter(F.transform(parts, lambda x: F.trim(cut(x))), lambda x: F.length(x) > 1), 1, limit)


def slip_years(text: Column) -> Column:
    """Years moved by 'Delayed from Y1 to Y2' or 'Advanced from Y1 to Y2'."""
    part = lambda g: F.regexp_extract(text, r"(?i)(?:delayed|advanced) from (\d{4}) to (\d{4})", g)
    return F.when(part(1) != "", F.nullif(part(2), F.lit("")).cast("int") - F.nullif(part(1), F.lit("")).cast("int"))


#: What may open a title of the second plan, where its head ends, its voltage, and what ends a station's name.
TITLE_LEAD = r"(?i)^(reconductor|rebuild|construct|upgrade|replace|install(\s+\d+(st|nd|rd|th))?)\s+"
TITLE_END = r"(?i)(\s+as\s+a\s+|:|\s+at\s+).*$"
TITLE_ORDINALS = r"(?i)#\s*\d+(\s*(and|&)\s*#\s*\d+)?"
TITLE_VOLTS = r"(?i)\b\d{2,3}(\s*[-/]\s*\d{1,3})*\s*kv\b.*$"
NAME_END = (
    r"(?i)\s+(station|substation|switching|switchyard|improvements?|upgrades?|transformers?|xfmr|tap|lines?|tie|"
    r"series|bus|breakers?|rebuild|limiting|elements|reconductor)\b.*$"
)
TITLE_STEPS = ((r"\([^)]*\)", " "), (r"^\s+|\s+$", ""), (TITLE_LEAD, ""), (TITLE_END, ""), (TITLE_ORDINALS, " "), (TITLE_VOLTS, ""))
NAME_CUT = r"(?i)\s*[-–]\s*|\s+to\s+"


def second_plan_stations(title: Column) -> Column:
    """Station names of a title of the second plan: its head without verb, ordinals and voltage, cut at dashes and "to"."""
    parts = F.transform(F.split(_chain(title, *TITLE_STEPS), NAME_CUT), lambda x: F.trim(F.regexp_replace(F.concat(F.lit(" "), F.trim(x)), NAME_END, "")))
    return F.filter(parts, lambda x: F.length(x) > 1)


#: Words that open a sentence or an instruction, not a station's name.
OPENING_WORDS = (
    "at the a an and or to from in on near with for of this also both existing new build building rebuild rebuilding construct constructing install installing "
    "replace replacing upgrade upgrading reconductor add loop convert make remove expand approximately retire disconnect terminate connect fold split relocate extend move "
    "complete energize cut reconfigure gpc gtc meag desc apc sav"
).split()
CAPITALISED = r"([A-Z][A-Za-z'’]*\.?([ \t]+[A-Z][A-Za-z'’]*\.?)*)"


def capitalised_names(text: Column) -> Column:
    """Whole runs of capitalised words of a text, without the opening words before a name; in order."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(1)), lambda r: F.split(F.regexp_replace(r, r"\.+$", ""), r"[ \t]+"))
    opening = F.array(*[F.lit(w) for w in OPENING_WORDS])
    at = lambda r: F.array_position(F.transform(r, lambda w: F.array_contains(opening, F.regexp_replace(F.lower(w), r"\.+$", ""))), F.lit(False))
    return F.filter(F.transform(runs, lambda r: F.when(at(r) > 0, F.array_join(F.slice(r, at(r).cast("int"), F.size(r)), " "))), lambda n: n.isNotNull())
