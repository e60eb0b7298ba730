"""Queries over a registry: documents claimed by signatures, proposed signatures, plans of companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import registry
from ..sources.adapters import build, plain
from .text_queries import sql_chain

#: A layout per item: its first and its last words, as patterns; a plan holds every third.
LAYOUTS = r"""
SELECT 'L' || CAST(item_id AS STRING) AS signature, item_id, CASE item_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS plan,
       regexp_extract(text, '^([A-Za-z]+ [A-Za-z]+ [A-Za-z]+)', 1) AS opening, regexp_extract(text, '([A-Za-z]+ [A-Za-z]+ [A-Za-z]+)[^A-Za-z]*$', 1) AS closing
FROM {benchmark}
"""
PATTERNED = f"SELECT signature, item_id, plan, array(opening || '[ ,.]', '[ ,.]' || closing) AS patterns FROM ({LAYOUTS}) l WHERE opening <> '' AND closing <> ''"


def q_claimed(spark, sf_dir):
    """Layouts all of whose patterns occur in a document, and whether just one claims it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return registry.unique_claims(registry.claims(docs, build(spark, sf_dir, PATTERNED)))


LAYOUTS_CTE = f"""l AS MATERIALIZED (SELECT * FROM ({plain(LAYOUTS)}) WHERE opening <> '' AND closing <> ''),
c AS MATERIALIZED (SELECT d.doc_id, l.signature, l.plan FROM documents d JOIN l ON regexp_matches(d.text, l.opening || '[ ,.]') AND regexp_matches(d.text, '[ ,.]' || l.closing))"""
SQL_CLAIMED = f"WITH {LAYOUTS_CTE} SELECT doc_id, signature, count(*) OVER (PARTITION BY doc_id) = 1 AS is_unique FROM c"

FILED = "SELECT doc_id AS doc, CASE doc_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' END AS plan, text FROM {documents}"


def q_problems(spark, sf_dir):
    """Why a proposed signature cannot be registered.

    Every layout is proposed for the document that first has its opening words, which need not be followed as the pattern asks.
    """
    docs = build(spark, sf_dir, FILED)
    layouts = build(spark, sf_dir, LAYOUTS).filter("opening <> ''")
    openings = layouts.select("signature", F.array("opening").alias("patterns"))
    home = registry.claims(docs, openings, "doc").groupBy("signature").agg(F.min("doc").alias("doc"))
    proposed = layouts.join(home, "signature").select(
        F.concat(F.lit("N"), F.col("item_id").cast("string")).alias("signature"), F.when(F.col("item_id") % 3 == 2, "gamma").otherwise("beta").alias("plan"), "doc",
        F.when(F.col("item_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat("opening", F.lit("[ ,.]")))).alias("patterns"),
    )
    return registry.signature_problems(proposed, build(spark, sf_dir, PATTERNED), docs)


SQL_PROBLEMS = f"""WITH {LAYOUTS_CTE}, f AS ({plain(FILED)}), o AS (SELECT * FROM ({plain(LAYOUTS)}) WHERE opening <> ''),
n AS MATERIALIZED (SELECT 'N' || CAST(item_id AS STRING) AS signature, CASE WHEN item_id % 3 = 2 THEN 'gamma' ELSE 'beta' END AS plan, (SELECT min(doc) FROM f WHERE contains(f.text, o.opening)) AS doc, opening || '[ ,.]' AS pattern, item_id % 7 = 0 AS bare FROM o),
p AS (SELECT * FROM n WHERE doc IS NOT NULL), m AS (SELECT p.* FROM p JOIN f USING (doc) WHERE NOT bare AND NOT regexp_matches(f.text, p.pattern)), s AS (SELECT * FROM p WHERE NOT bare AND signature NOT IN (SELECT signature FROM m))
SELECT signature, 'size' AS problem, '0' AS about FROM p WHERE bare UNION SELECT signature, 'missing', pattern FROM m
UNION SELECT s.signature, 'claims', CAST(f.doc AS VARCHAR) FROM s JOIN f ON f.plan <> s.plan AND regexp_matches(f.text, s.pattern)
UNION SELECT s.signature, 'claimed', c.signature FROM s JOIN c ON c.doc_id = s.doc AND c.plan <> s.plan"""

#: Plans: one per brand, owned by a maker; the brand's types are members of it.
PLANS = """
SELECT p_brand AS plan, min(p_partkey) AS ord, p_brand AS name, 'Owner of ' || p_brand AS owner, array('The ' || p_brand || ' Company') AS aliases,
       array('Union ' || CAST(min(p_size) AS STRING), 'Parent of ' || p_brand || ', LLC') AS members, CASE WHEN min(p_partkey) % 2 = 0 THEN 'SC' ELSE 'GA' END AS state
FROM {part} GROUP BY p_brand
"""
#: Companies as read from documents; some are plans' own, some members, some neither, and what was said of them may be wrong.
COMPANIES = """
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_brand || ', Inc.' WHEN 1 THEN 'Union ' || CAST(p_size AS STRING) || ' Corp' WHEN 2 THEN 'Parent of ' || p_brand WHEN 3 THEN p_name ELSE NULL END AS company,
       CASE WHEN p_partkey % 10 = 4 THEN 'the Owner of ' || p_brand END AS owner, '' AS short_name, array(p_type) AS aliases,
       CASE p_partkey % 3 WHEN 0 THEN 'sc' WHEN 1 THEN 'GA' ELSE 'SC' END AS state, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'Brand#11' WHEN 2 THEN 'none such' END AS existing_plan
FROM {part}
"""


def q_plan_of(spark, sf_dir):
    """The plan of a company's list, or which of four refusals holds."""
    return registry.plan_of_company(build(spark, sf_dir, COMPANIES), build(spark, sf_dir, PLANS))


_KEY = lambda c: f"trim({sql_chain(f'lower(coalesce({c}, {chr(39) * 2}))', text.COMPANY_STEPS)})"
_ARRAYS = lambda sql: plain(sql).replace("array(", "list_value(")
SQL_PLAN_OF = f"""WITH p AS ({_ARRAYS(PLANS)}), i AS ({_ARRAYS(COMPANIES)}),
own AS (SELECT key, arg_min(plan, ord) AS plan, min(ord) AS ord FROM (SELECT plan, ord, {_KEY('n')} AS key FROM (SELECT plan, ord, unnest([name, owner] || aliases) AS n FROM p)) WHERE key <> '' GROUP BY key),
mem AS (SELECT key, arg_min(plan, ord) AS plan, min(ord) AS ord FROM (SELECT plan, ord, {_KEY('n')} AS key FROM (SELECT plan, ord, unnest(members) AS n FROM p)) WHERE key <> '' GROUP BY key),
a AS (SELECT DISTINCT id, {_KEY('n')} AS key FROM (SELECT id, unnest([company, owner, short_name] || aliases) AS n FROM i)),
o AS (SELECT id, arg_min(plan, ord) AS own FROM a JOIN own USING (key) GROUP BY id), m AS (SELECT id, arg_min(plan, ord) AS joint FROM a JOIN mem USING (key) GROUP BY id),
t AS (SELECT i.id, coalesce(i.company, '') AS company, upper(i.state) AS st, coalesce(i.existing_plan, '') AS said, own, joint, q.state AS ps, k.plan IS NOT NULL AS known FROM i LEFT JOIN o USING (id) LEFT JOIN m USING (id) LEFT JOIN p q ON q.plan = own LEFT JOIN p k ON k.plan = i.existing_plan),
s AS (SELECT *, CASE WHEN own IS NOT NULL AND st IS DISTINCT FROM ps THEN 'other state' WHEN own IS NOT NULL AND said <> '' AND said <> own THEN 'contradicted' WHEN own IS NOT NULL THEN 'plan' WHEN joint IS NOT NULL THEN 'member' WHEN said <> '' AND known THEN 'unsupported' ELSE 'new' END AS status FROM t)
SELECT id, coalesce(own, joint, CASE WHEN status = 'unsupported' THEN said END) AS plan, status,
CASE status WHEN 'other state' THEN company || ' is plan ''' || own || ''' of ' || ps || ', but placed in ' || st WHEN 'contradicted' THEN company || ' is plan ''' || own || ''', but said to be ''' || said || ''''
  WHEN 'member' THEN company || ' is a member or parent of plan ''' || joint || ''', whose joint list holds its projects' WHEN 'unsupported' THEN 'said to be plan ''' || said || ''', none of whose own names it has' END AS why FROM s"""

QUERIES = {"claimed_documents": q_claimed, "signature_problems": q_problems, "plan_of_company": q_plan_of}
SQL = {"claimed_documents": SQL_CLAIMED, "signature_problems": SQL_PROBLEMS, "plan_of_company": SQL_PLAN_OF}
