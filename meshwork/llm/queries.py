"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprints, jaccard, licenses, lines, mixing, negatives, quality, ranked, topk, urls, warc
from .common import table

#: Rows whose crc32 of the id, as text, leaves 0 when divided by this are held out.
FOLDS = 5
ACCEPT = 0.3

URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def fold(col: str):
    return F.crc32(F.col(col).cast("string")) % FOLDS


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_documents(docs, labels, learn_from=fold("id") != 0)
    return scored.select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted")
    )


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


SQL_OP3 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0 AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def licence_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: every eighth is a licence file, of an upper or a lower directory."""
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")  # noqa: E731
    upper = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), part(1024), F.lit("/"))
    lower = F.concat(upper, part(128), F.lit("/"))
    name = F.col("doc_id").cast("string")
    path = (
        F.when(F.col("doc_id") % 16 == 0, F.concat(upper, F.lit("LICENSE."), name))
        .when(F.col("doc_id") % 16 == 8, F.concat(lower, F.lit("LICENSE."), name))
        .otherwise(F.concat(lower, F.lit("doc"), name, F.lit(".txt")))
    )
    return docs.select("doc_id", path.alias("path"), "text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(licence_paths(table(spark, sf_dir, "documents")))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_STATEMENTS = ",\n  ".join(
    f"({i}, {_literal(name)}, {_literal(line)})"
    for i, (name, line) in enumerate((name, line) for name, text in licenses.TEMPLATES.items() for line in text.split("\n"))
)

SQL_OP4 = rf"""
WITH files AS (
  SELECT doc_id, text, CASE
    WHEN doc_id % 16 = 0 THEN coalesce(source, 'none') || '/' || (doc_id // 1024) || '/LICENSE.' || doc_id
    WHEN doc_id % 16 = 8 THEN coalesce(source, 'none') || '/' || (doc_id // 1024) || '/' || (doc_id // 128) || '/LICENSE.' || doc_id
    ELSE coalesce(source, 'none') || '/' || (doc_id // 1024) || '/' || (doc_id // 128) || '/doc' || doc_id || '.txt' END AS path
  FROM documents
), templates(template, license, body) AS (VALUES
  {_STATEMENTS}
), tterms AS (
  SELECT template, license, term, count(*) AS n
  FROM (SELECT template, license, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM templates) GROUP BY ALL
), held AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS term FROM files) GROUP BY term
), idf AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM files)) / (1 + coalesce(df, 0))) + 1 AS idf
  FROM held FULL JOIN (SELECT DISTINCT term FROM tterms) USING (term)
), weights AS (
  SELECT template, license, term, n * idf / sqrt(sum((n * idf) * (n * idf)) OVER (PARTITION BY template)) AS weight
  FROM tterms JOIN idf USING (term)
), cut AS (
  SELECT path, string_split(regexp_replace(text, '([.!?])[ \t\r\f]+', '\1' || chr(10), 'g'), chr(10)) AS s,
         string_split_regex(text, '\n[^A-Za-z0-9\n]*\n') AS paragraphs FROM files
), pieces AS (
  SELECT path, s || list_filter(paragraphs, lambda p: NOT list_contains(s, p)) AS s FROM cut
), stated AS (
  SELECT path, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS pos FROM pieces
), counts AS (
  SELECT path, pos, term, count(*) AS n
  FROM (SELECT path, pos, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS term FROM stated) GROUP BY ALL
), norms AS (
  SELECT path, pos, sqrt(sum((n * idf) * (n * idf))) AS norm FROM counts JOIN idf USING (term) GROUP BY ALL
), scored AS (
  SELECT path, pos, template, license, round(sum(n * idf * weight) / max(norm), 6) AS score
  FROM counts JOIN weights USING (term) JOIN idf USING (term) JOIN norms USING (path, pos) GROUP BY ALL
), own AS (
  SELECT path, license, score FROM scored WHERE score >= {licenses.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, template, pos) = 1
), given AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, path AS license_path, license, score FROM own
  WHERE regexp_matches(path, '(^|/)(LICEN[CS]E|COPYING)(\.[a-z0-9]+)?$')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path) = 1
), inherited AS (
  SELECT f.path, g.license, g.score, g.license_path
  FROM (SELECT path FROM files WHERE path NOT IN (SELECT path FROM own)) f JOIN given g ON starts_with(f.path, g.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(g.dir) DESC) = 1
), found AS (
  SELECT path, license, score, path AS license_path,
         CASE WHEN regexp_matches(path, '(^|/)(LICEN[CS]E|COPYING)(\.[a-z0-9]+)?$') THEN 'licence file' ELSE 'header' END AS origin FROM own
  UNION ALL SELECT path, license, score, license_path, 'inherited' FROM inherited
)
SELECT doc_id, path, license, score, origin, license_path FROM files LEFT JOIN found USING (path)
"""


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


SQL_OP5 = r"""
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), ruled AS (
  SELECT page_id, host, path,
         CASE WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '(^|[.-])(adult|ads-track|casino|cheap-pills|free-bets|spam)([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.mix_units(table(spark, sf_dir, "documents"))
    rows = units.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return found.withColumnRenamed("id", "doc_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def preference_sides(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations 2k and 2k + 1 as a pair: the rejected side goes as the chosen one up to
    its last assistant turn, and then as the other conversation from its last assistant turn."""
    last = F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("turn"))), F.min("turn"))
    cuts = turns.groupBy("conv_id").agg(last.alias("last"))
    told = turns.join(cuts, "conv_id").withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("long"))
    even = F.col("conv_id") % 2 == 0
    names = ["pair_id", "turn", "role", "text"]
    chosen = told.filter(even).select(names)
    rejected = told.filter((even & (F.col("turn") < F.col("last"))) | (~even & (F.col("turn") >= F.col("last")))).select(names)
    return chosen, rejected


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(*preference_sides(table(spark, sf_dir, "conversations")))


SQL_OP9 = r"""
WITH cuts AS (
  SELECT conv_id, coalesce(max(CASE WHEN role = 'assistant' THEN turn END), min(turn)) AS last FROM conversations GROUP BY conv_id
), told AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS odd, turn, last, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations JOIN cuts USING (conv_id)
), sides AS (
  SELECT 'c' AS side, pair_id, turn, role, text FROM told WHERE odd = 0
  UNION ALL SELECT 'r', pair_id, turn, role, text FROM told WHERE (odd = 0 AND turn < last) OR (odd = 1 AND turn >= last)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY side, pair_id ORDER BY turn, role, text) - 1 AS place FROM sides
), matched AS (
  SELECT pair_id, place, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text
  FROM (SELECT * FROM placed WHERE side = 'c') c FULL JOIN (SELECT * FROM placed WHERE side = 'r') r USING (pair_id, place)
), cut AS (
  SELECT pair_id, min(CASE WHEN c_role IS NULL OR r_role IS NULL OR c_role <> r_role OR c_text <> r_text THEN place END) AS cut, count(*) AS n
  FROM matched GROUP BY pair_id
), shown AS (
  SELECT side, pair_id, place, role, coalesce(cut, n) AS head, cut IS NOT NULL AS differs,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS body,
         length('<|im_start|>' || role || chr(10)) AS header, length(text) + 10 AS trained
  FROM placed JOIN cut USING (pair_id)
), spans AS (
  SELECT *, sum(CASE WHEN place >= head THEN length(body) ELSE 0 END) OVER (PARTITION BY side, pair_id ORDER BY place) - length(body) AS begins FROM shown
)
SELECT pair_id, CAST(max(head) AS INTEGER) AS n_prompt_turns,
       coalesce(string_agg(body, '' ORDER BY place) FILTER (WHERE side = 'c' AND place < head), '') AS prompt,
       coalesce(string_agg(body, '' ORDER BY place) FILTER (WHERE side = 'c' AND place >= head), '') AS chosen,
       coalesce(string_agg(body, '' ORDER BY place) FILTER (WHERE side = 'r' AND place >= head), '') AS rejected,
       coalesce(string_agg((begins + header) || ':' || trained, ',' ORDER BY place) FILTER (WHERE side = 'c' AND place >= head AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((begins + header) || ':' || trained, ',' ORDER BY place) FILTER (WHERE side = 'r' AND place >= head AND role = 'assistant'), '') AS rejected_mask,
       bool_or(differs) AS differs
FROM spans GROUP BY pair_id
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select(
        "doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )


SQL_OP10 = r"""
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), raw AS (
  SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos FROM cut
), tokens AS (
  SELECT doc_id, pos, list_transform(
    string_split_regex(regexp_replace(raw, '^[ 	
]+|[ 	
]+$', '', 'g'), '[ 	
]+'),
    lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
  FROM raw
), parsed AS (
  SELECT doc_id, pos, t, len(t) AS n, least(len(t) - 3, 8) AS filled, t[1:3] AS lead, CASE WHEN len(t) > 50 THEN 2 ELSE 3 END AS need,
         list_transform(range(8), lambda j: t[CAST(floor(j * (len(t) - 3) / 8) AS BIGINT) + 4 : CAST(floor((j + 1) * (len(t) - 3) / 8) AS BIGINT) + 3]) AS places
  FROM tokens WHERE len(t) >= 4 AND len(list_filter(t, lambda x: x <> '<*>')) >= 2
), variants AS (
  SELECT DISTINCT n, lead, t, places, filled, need FROM parsed
), fields(k, vary) AS (
  SELECT 0, []::BIGINT[] UNION ALL SELECT 1, [i] FROM range(1, 9) r(i)
  UNION ALL SELECT 2, [i, j] FROM range(1, 9) r(i), range(1, 9) s(j) WHERE i < j
), fitting AS (
  SELECT t, n, lead, need, vary, list_transform(range(1, 9), lambda j: CASE WHEN list_contains(vary, j) THEN NULL ELSE places[j] END) AS fixed
  FROM variants JOIN fields ON k = floor(0.25 * filled)
), recurring AS (
  SELECT n, lead, vary, fixed, min(doc_id) AS keep FROM fitting JOIN (SELECT DISTINCT t, doc_id FROM parsed) USING (t)
  GROUP BY n, lead, vary, fixed HAVING count(DISTINCT doc_id) >= max(need)
), grouped AS (
  SELECT t, min(keep) AS keep FROM fitting JOIN recurring USING (n, lead, vary, fixed) GROUP BY t
), dropped AS (
  SELECT doc_id, pos FROM parsed JOIN grouped USING (t) WHERE doc_id <> keep
), counted AS (
  SELECT doc_id, count(*) AS n FROM dropped GROUP BY doc_id
), kept AS (
  SELECT r.doc_id, string_agg(r.raw, chr(10) ORDER BY r.pos) AS text
  FROM raw r ANTI JOIN dropped d ON d.doc_id = r.doc_id AND d.pos = r.pos GROUP BY r.doc_id
)
SELECT c.doc_id, CAST(len(l) AS INTEGER) AS n_lines, CAST(coalesce(n, 0) AS INTEGER) AS n_dropped,
       CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, sha256(coalesce(text, '')) AS text_sha256
FROM cut c LEFT JOIN counted USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


SQL_OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), held AS (
  SELECT doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS big_n, sum(n) AS big_l FROM held
), counted AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM held) GROUP BY ALL
), items AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term) CROSS JOIN total
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // CAST(big_l AS BIGINT)))))) AS BIGINT) AS score
  FROM items JOIN counted USING (term) JOIN weights USING (term) CROSS JOIN total GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine_hard_negatives(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


SQL_OP12 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0 AND len(a.q) = len(b.q)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = warc.read_records(spark, warc.write_pages(pages))
    return warc.pages_of(records)


SQL_OP13 = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), judged AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM judged
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_quality": op2_quality,
        "op3_exact_top_k": op3_exact_top_k,
        "op4_license_scan": op4_license_scan,
        "op5_url_filters": op5_url_filters,
        "op6_mixing": op6_mixing,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_preferences": op9_preferences,
        "op10_line_dedup": op10_line_dedup,
        "op11_ranked_search": op11_ranked_search,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_top_k": SQL_OP3,
        "op4_license_scan": SQL_OP4,
        "op5_url_filters": SQL_OP5,
        "op9_preferences": SQL_OP9,
        "op10_line_dedup": SQL_OP10,
        "op11_ranked_search": SQL_OP11,
        "op12_hard_negatives": SQL_OP12,
        "op13_warc": SQL_OP13,
    }
