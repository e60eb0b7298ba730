"""Documents recognised by their text, and the plan that a company's list belongs to.

A signature is a set of patterns that all occur in every document of one layout.  The patterns
are a table.  What every match of a pattern must hold as plain text goes into one automaton,
which reads a text once; only signatures whose plain texts all occur are tried pattern by pattern.
So a text costs what it holds, not what there are patterns.
"""

from __future__ import annotations

import re
import re._parser as syntax
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import company_key
from .common import checkpointed

#: Most patterns of a table, and most characters of all of them: what is sent to each task.
MOST_PATTERNS, MOST_CHARACTERS = 100_000, 16_000_000
#: Fixed value: most patterns of one signature.
SIGNATURE_SIZE = 6


def required_text(pattern: str) -> str:
    """The longest plain text that every match of a pattern holds; empty where none can be told.

    Alternatives, classes, what may be left out and patterns that ignore case promise nothing.
    """
    parsed = syntax.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ""
    runs = [""]

    def walk(items) -> None:
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(value)
            elif name == "SUBPATTERN" and not value[1] & re.IGNORECASE:
                walk(value[3])
            elif name == "ATOMIC_GROUP":
                walk(value)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                runs.append("")
                walk(value[2])
                runs.append("")
            elif name != "AT":
                runs.append("")

    walk(parsed)
    return max(runs, key=len)


class Signatures:
    """Signatures made ready for reading texts; ``claiming`` tells which ones claim a text."""

    def __init__(self, patterns: dict[str, tuple[str, ...]]):
        self.patterns = {s: [re.compile(p) for p in ps] for s, ps in patterns.items()}
        self.needs: dict[str, int] = {}
        self.asking: dict[str, list[str]] = defaultdict(list)
        for signature, ps in patterns.items():
            wanted = {required_text(p) for p in ps} - {""}
            self.needs[signature] = len(wanted)
            for w in wanted:
                self.asking[w].append(signature)
        self.always = [s for s, n in self.needs.items() if n == 0]
        self.automaton = ahocorasick.Automaton()
        for w in self.asking:
            self.automaton.add_word(w, w)
        if self.asking:
            self.automaton.make_automaton()

    def claiming(self, text: str) -> list[str]:
        found = {w for _, w in self.automaton.iter(text)} if self.asking else ()
        met = Counter(s for w in found for s in self.asking[w])
        tried = [s for s, n in met.items() if n == self.needs[s]] + self.always
        hits: dict[re.Pattern, bool] = {}

        def occurs(p: re.Pattern) -> bool:
            if p not in hits:
                hits[p] = p.search(text) is not None
            return hits[p]

        return sorted(s for s in tried if all(map(occurs, self.patterns[s])))


def read_signatures(signatures: DataFrame) -> dict[str, tuple[str, ...]]:
    """The table ``signature, patterns`` as a mapping, its size checked and its patterns compiled once.

    Patterns of equal signatures are put together.  A signature without patterns claims nothing; a null
    or invalid pattern raises, and so does a table of more patterns than a task should hold.
    """
    each = signatures.filter("signature IS NOT NULL").select(F.col("signature").cast("string").alias("signature"), F.explode("patterns").alias("pattern")).distinct()
    size = each.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("c")).first()
    if size["n"] > MOST_PATTERNS or size["c"] > MOST_CHARACTERS:
        raise ValueError(f"{size['n']} patterns of {size['c']} characters, of {MOST_PATTERNS} and {MOST_CHARACTERS} at most")
    out: dict[str, set[str]] = defaultdict(set)
    for row in each.collect():
        try:
            re.compile(row["pattern"])
        except (re.error, TypeError) as wrong:
            raise ValueError(f"signature {row['signature']!r} has an unusable pattern {row['pattern']!r}: {wrong}") from wrong
        out[row["signature"]].add(row["pattern"])
    return {s: tuple(sorted(ps)) for s, ps in out.items()}


def claims(texts: DataFrame, signatures: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, signature``: the signatures that claim each whole text; a null text has none, an empty one those that an empty text meets.

    Texts are read where they lie: no shuffle.  Rows with equal keys are claimed one by one.
    """
    patterns = read_signatures(signatures)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = Signatures(patterns)
        for batch in batches:
            told = batch.assign(signature=[ready.claiming(t) for t in batch["__text"]]).drop(columns="__text")
            yield told.explode("signature").dropna(subset=["signature"])

    slim = texts.select(F.col(key).alias(key), F.col(text).alias("__text")).filter("__text IS NOT NULL")
    return slim.mapInPandas(scan, StructType([slim.schema[key], StructField("signature", StringType())]))


def unique_claims(claimed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Claims with ``is_unique``: no other signature claims the text."""
    claimed = checkpointed(claimed)
    alone = claimed.groupBy(key).agg((F.count_distinct("signature") == 1).alias("is_unique"))
    return claimed.join(alone, key)


def signature_problems(proposed: DataFrame, registered: DataFrame, texts: DataFrame) -> DataFrame:
    """``signature, problem, about``: why a proposed signature cannot be registered; none for a sound one.

    ``proposed`` has ``signature, plan, doc, patterns`` (one row each), ``registered`` ``signature, plan, patterns``, ``texts``
    ``doc, plan, text`` with no plan where a document is not filed.  A signature has 1 to 6 patterns
    ("size"); each must occur in its own document ("missing", about the pattern; a document that is not
    there has none); then it must claim no filing of another plan ("claims", about the filing), and no
    registered signature of another plan may claim its document ("claimed", about that signature).
    """
    size = F.coalesce(F.size("patterns"), F.lit(0))
    sized = proposed.withColumn("__fits", (size >= 1) & (size <= SIGNATURE_SIZE))
    told = sized.filter("NOT __fits").select("signature", F.lit("size").alias("problem"), size.cast("string").alias("about"))
    fit = sized.filter("__fits").select("signature", F.col("plan").alias("own"), "doc", "patterns")
    # Its own patterns, each as a signature by itself, over the documents that proposals name.
    each = fit.select("signature", "doc", F.explode("patterns").alias("pattern")).distinct()
    own_texts = texts.select("doc", "text").join(fit.select("doc").distinct(), "doc", "left_semi")
    seen = claims(own_texts, each.select(F.col("pattern").alias("signature"), F.array("pattern").alias("patterns")), "doc").select("doc", F.col("signature").alias("pattern")).distinct()
    missing = checkpointed(each.join(seen, ["doc", "pattern"], "left_anti").select("signature", F.lit("missing").alias("problem"), F.col("pattern").alias("about")))
    sound = checkpointed(fit.join(missing, "signature", "left_anti"))
    other = F.col("own").isNull() | (F.col("own") != F.col("plan"))
    filed = texts.filter("plan IS NOT NULL").select("doc", "plan", "text")
    theirs = claims(filed.select(F.struct("doc", "plan").alias("d"), "text"), sound, "d").select("signature", "d.*")
    over = theirs.join(sound.select("signature", "own"), "signature").filter(other).select("signature", F.lit("claims").alias("problem"), F.col("doc").cast("string").alias("about"))
    mine = claims(own_texts, registered, "doc").join(registered.select("signature", "plan").distinct(), "signature").select("doc", "plan", F.col("signature").alias("by"))
    under = sound.join(mine, "doc").filter(other).select("signature", F.lit("claimed").alias("problem"), F.col("by").alias("about"))
    return told.unionByName(missing).unionByName(over).unionByName(under).distinct()


def _keys(names: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), company_key), lambda k: k != ""))


def plan_of_company(identities: DataFrame, plans: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """``id, plan, status, why``: the registered plan a company's list belongs to, or why none is taken.

    ``identities`` has ``id, company, owner, short_name, aliases, state, existing_plan``, ids unique; ``plans`` ``plan, ord, name,
    owner, aliases, members, state``.  Names meet by their reduced form; of several plans the first by ``ord`` counts.
    A plan of whose own names one is the company's is its plan ("plan"), unless the states differ ("other state")
    or another plan was said ("contradicted").  A member's or parent's own list is not the joint plan's
    ("member"), nor is a list said to be a plan's whose names do not bear it out ("unsupported"); any other company is
    "new".  Only "plan" is accepted.  Nulls are empty names; a null state is no plan's.
    """
    kept = plans.filter(~F.col("plan").isin(*skip)) if skip else plans
    known = plans.select(F.col("plan").alias("existing_plan"), F.lit(True).alias("__known"), F.col("plan").isin(*skip).alias("__skipped") if skip else F.lit(False).alias("__skipped"))
    first = lambda names: kept.select("plan", "ord", F.explode(_keys(names)).alias("key")).groupBy("key").agg(F.min_by("plan", F.struct("ord", "plan")).alias("plan"), F.min("ord").alias("ord"))
    own = first(F.concat(F.array("name", "owner"), F.coalesce("aliases", F.array().cast("array<string>"))))
    joint = first(F.col("members"))
    names = F.concat(F.array("company", "owner", "short_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    asked = identities.select("id", F.explode(_keys(names)).alias("key"))
    found = lambda side, name: asked.join(side, "key").groupBy("id").agg(F.min_by("plan", F.struct("ord", "plan")).alias(name))
    told = identities.select("id", "company", F.upper("state").alias("state"), F.coalesce("existing_plan", F.lit("")).alias("existing_plan"))
    told = told.join(found(own, "own"), "id", "left").join(found(joint, "joint"), "id", "left").join(known, "existing_plan", "left")
    told = told.join(plans.select(F.col("plan").alias("own"), F.col("state").alias("plan_state")), "own", "left")
    said = F.col("existing_plan") != ""
    status = (
        F.when(F.col("own").isNotNull() & ~F.col("state").eqNullSafe(F.col("plan_state")), "other state")
        .when(F.col("own").isNotNull() & said & (F.col("existing_plan") != F.col("own")), "contradicted").when(F.col("own").isNotNull(), "plan")
        .when(F.col("joint").isNotNull(), "member").when(said & F.col("__known") & ~F.col("__skipped"), "unsupported").otherwise("new")
    )
    told = told.withColumn("status", status)
    company, quoted = F.coalesce("company", F.lit("")), lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    why = (
        F.when(F.col("status") == "other state", F.concat(company, F.lit(" is plan "), quoted("own"), F.lit(" of "), F.coalesce("plan_state", F.lit("no state")), F.lit(", but placed in "), F.coalesce("state", F.lit("no state"))))
        .when(F.col("status") == "contradicted", F.concat(company, F.lit(" is plan "), quoted("own"), F.lit(", but said to be "), quoted("existing_plan")))
        .when(F.col("status") == "member", F.concat(company, F.lit(" is a member or parent of plan "), quoted("joint"), F.lit(", whose joint list holds its projects")))
        .when(F.col("status") == "unsupported", F.concat(F.lit("said to be plan "), quoted("existing_plan"), F.lit(", none of whose own names it has")))
    )
    plan = F.coalesce("own", "joint", F.when(F.col("status") == "unsupported", F.col("existing_plan")))
    return told.select("id", plan.alias("plan"), "status", why.alias("why"))
