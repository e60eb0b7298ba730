"""Line dedup by a log-template tree, in DataFrame functions alone.

A line's tokens are its runs without blanks; tokens with a digit are variable and
become ``<*>``.  The tree has a fixed depth: the token count, then the first
``LEADING`` tokens.  The rest of a line is cut into ``SEGMENTS`` runs of tokens, its
places.  A template of a leaf fixes all filled places but a quarter of them, which are
its variable fields; a leaf has as many templates as its lines give, and a line belongs
to all that it fits.  So any two lines that agree in ``AGREE`` of the filled places
share a template, in whatever company.  A template found in ``MIN_DOCS`` documents is
recurring, for lines of more than ``LONG`` tokens in ``MIN_DOCS_LONG``: that two
documents share a whole passage is no chance.  A line stays in the first document of its
recurring templates (smallest id, null first) and is dropped from all others.

Lines of fewer than ``MIN_TOKENS`` tokens, or without two constant tokens, say too
little to be a template; they and blank lines are always kept.

Lines are keyed by their leaf first; only leaves of enough documents are cut into places.
Of these, only lines that share every place of one third with others can share a template
(at most two places vary, so one third is free of them), and only they are given its keys.
Lines are told apart by two 64-bit hashes, of the leaf and of the line.

Defined results: a null text stays null and has no lines; an empty one has one line;
rows of one id are one document, and null ids another; columns other than the two named
ones take no part, whatever they are called.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, without

LEADING, SEGMENTS, AGREE = 3, 8, 0.75
MIN_DOCS, MIN_TOKENS = 3, 4
LONG, MIN_DOCS_LONG = 50, 2
BLANKS = r" \t\r\x0B\f"
VARIABLE = "<*>"
#: Sets of more keys (two numbers each) than this are joined by a shuffle, whose hot keys are split at run time.
BROADCAST_KEYS = 1 << 18
#: Stands for a null id; sorts before every other.
NO_ID = -(1 << 63)


def masked_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of enough tokens, ``id, doc, pos, leaf, line``: single blanks, variable tokens masked.

    Whole texts are rewritten before they are cut, and only those that need it: plain searches,
    far cheaper than patterns, tell which.
    """
    text = F.col(text_col)
    messy = F.lit(False)
    for blank in ("\t", "\r", "\x0b", "\f", "  ", " \n", "\n "):
        messy = messy | text.contains(blank)
    messy = messy | text.startswith(" ") | text.endswith(" ")
    tidy = F.regexp_replace(F.regexp_replace(text, f"[{BLANKS}]+", " "), "(?md)^ | $", "")
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("doc"), F.when(messy, tidy).otherwise(text).alias("text"))
    # A token is matched from its start only, so that long ones take linear time.
    masked = F.when(F.col("text").rlike("[0-9]"), F.regexp_replace("text", "(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", VARIABLE)).otherwise(F.col("text"))
    lines = plain.select("id", "doc", masked.alias("text")).select("id", "doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("n", _tokens()).filter(F.col("n") >= MIN_TOKENS).select(
        "id", "doc", "pos", "n", F.xxhash64("n", F.substring_index("line", " ", LEADING)).alias("leaf"), "line"
    )


def _tokens():
    return F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1


def parse_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int) -> DataFrame:
    """Lines of leaves that enough documents may share: ``id, doc, pos, leaf, line`` (a hash),
    ``need`` (the documents of a recurring template), ``filled, p0, p1, ...``."""
    lines = masked_lines(docs, id_col, text_col)
    need = F.when(F.col("n") > LONG, F.lit(min(MIN_DOCS_LONG, min_docs))).otherwise(F.lit(min_docs))
    shared = lines.groupBy("leaf").agg(F.count("*").alias("many"), F.min("id").alias("low"), F.max("id").alias("high"), F.first(need).alias("need"))
    shared = checkpointed(shared.filter((F.col("many") >= F.col("need")) & (F.col("low") < F.col("high"))).select("leaf"))
    told = _only(lines, shared, ["leaf"]).withColumn("tokens", F.split("line", " "))
    # Two constant tokens at least.
    told = told.filter(F.size(F.array_remove("tokens", VARIABLE)) >= 2)
    rest = F.size("tokens") - LEADING
    cut = lambda j: F.floor(F.lit(j) * rest / SEGMENTS).cast("int")
    places = [F.xxhash64(F.slice("tokens", cut(j) + LEADING + 1, cut(j + 1) - cut(j))).alias(f"p{j}") for j in range(SEGMENTS)]
    return told.select("id", "doc", "pos", "leaf", F.xxhash64("line").alias("line"), need.alias("need"), F.least(rest, F.lit(SEGMENTS)).alias("filled"), *places)


def _only(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose key is among ``keys``: by broadcast if these are few."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)


def _but(places: list[str], vary: tuple[int, ...]):
    """A key of all places but some."""
    return F.xxhash64(F.lit(",".join(map(str, vary))), *[c for j, c in enumerate(places) if j not in vary])


def recurring_lines(parsed: DataFrame) -> DataFrame:
    """Lines of recurring templates: ``leaf, line, keep`` (the document that keeps them)."""
    places = [f"p{j}" for j in range(SEGMENTS)]
    told = ["need", "filled", *places]
    in_docs = parsed.groupBy("leaf", "line", "id").agg(*[F.first(c).alias(c) for c in told])
    variants = checkpointed(in_docs.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min("id").alias("low"), *[F.first(c).alias(c) for c in told]))
    vary = int((1 - AGREE) * SEGMENTS)
    # Lines that agree in all but `vary` places agree in all places of one of `vary + 1` parts.
    parts = F.array(*[F.xxhash64(F.lit(g), *places[g :: vary + 1]) for g in range(vary + 1)])
    coarse = variants.select("leaf", "line", "docs", "need", F.explode(parts).alias("part"))
    enough = coarse.groupBy("leaf", "part").agg(F.sum("docs").alias("all"), F.first("need").alias("need")).filter("all >= need")
    likely = checkpointed(_only(coarse, checkpointed(enough.select("leaf", "part")), ["leaf", "part"]).select("leaf", "line").distinct())
    keys = F.lit(None)
    for k in range(vary, -1, -1):  # k places may vary where so many are filled that the rest is enough
        fits = F.floor((1 - AGREE) * F.col("filled")) == k
        keys = F.when(fits, F.array(*[_but(places, v) for v in itertools.combinations(range(SEGMENTS), k)])).otherwise(keys)
    keyed = checkpointed(_only(variants, likely, ["leaf", "line"]).select("leaf", "line", "docs", "low", "need", F.explode(keys).alias("key")))
    templates = checkpointed(
        keyed.groupBy("leaf", "key").agg(F.sum("docs").alias("all"), F.max("docs").alias("most"), F.min("low").alias("keep"), F.first("need").alias("need"))
        .filter("all >= need")
    )
    # A document may have several lines of one template: where no line alone is enough, they are counted anew.
    unsure = templates.filter("most < need")
    members = keyed.join(unsure.select("leaf", "key"), ["leaf", "key"], "left_semi").select("leaf", "line", "key")
    exact = (
        parsed.select("leaf", "line", "id").join(members, ["leaf", "line"]).groupBy("leaf", "key", "id").agg(F.lit(1).alias("one"))
        .groupBy("leaf", "key").agg(F.count("*").alias("exact"))
    )
    sure = templates.filter("most >= need").select("leaf", "key", "keep").unionByName(
        unsure.join(exact, ["leaf", "key"]).filter("exact >= need").select("leaf", "key", "keep")
    )
    return keyed.join(sure, ["leaf", "key"]).groupBy("leaf", "line").agg(F.min("keep").alias("keep"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The input with its text cleaned, and ``n_lines, n_dropped``."""
    parsed = checkpointed(parse_lines(docs.select(id_col, text_col), id_col, text_col, min_docs))
    # Written first, so that a line of very many documents can be split in the join.
    recurring = checkpointed(recurring_lines(parsed))
    drops = (
        _only(parsed.select("id", "doc", "pos", "leaf", "line"), recurring, ["leaf", "line"], "inner").filter("id <> keep")
        .groupBy("id", "doc").agg(F.collect_set("pos").alias("__dropped"))
        .select(F.col("id").alias("__drop_id"), F.col("doc").alias("__drop_doc"), "__dropped")
    )
    base = without(docs, "n_lines", "n_dropped")
    keyed = base.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__doc": F.xxhash64(text_col)})
    same = (F.col("__id") == F.col("__drop_id")) & (F.col("__doc") == F.col("__drop_doc"))
    joined = keyed.join(drops.hint("shuffle_hash"), same, "left")
    text = F.col(text_col)
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    clean = F.when(F.col("__dropped").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    names = [F.col(f"`{c}`") if c != text_col else clean.alias(text_col) for c in base.columns]
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    n_lines = F.when(text.isNull(), 0).otherwise(breaks + 1)
    return joined.select(*names, n_lines.alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).alias("n_dropped"))
