"""The corpus pipeline: documents are judged, cleaned, deduplicated, mixed and encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` applies them in order, cutting the
lineage between stages with a checkpoint in the cluster's shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import bpe, jaccard, lines, mixing, quality
from meshwork.llm.common import checkpointed, table
from meshwork.llm.queries import ACCEPT, fold

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"), learn_from=fold("id") != 0, carry=docs.columns)
    return scored.filter(F.col("score") >= ACCEPT).select(*docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; documents of which nothing is left go."""
    clean = lines.dedup_lines(docs)
    gone = (F.col("n_dropped") > 0) & (F.trim("text") == "")
    chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.filter(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", chars).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates.

    A document is an id and a text: rows of one id that hold different texts are compared as
    any others, and of rows that agree in both the one of the smallest other columns stays.
    Rows without an id take no part and stay.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], key.alias("id"))
    found = checkpointed(jaccard.near_duplicates(keyed.filter("id IS NOT NULL"), id_col="id", k=5, num=80, den=100))
    linked = found.filter("component_id <> id").select("id", "component_id")
    heads = linked.select(F.col("component_id").alias("id"), "component_id")
    members = checkpointed(linked.unionByName(heads).distinct())
    told = jaccard.keep_ids(keyed.select("id", "doc_id"), members.select("id"), "left_semi").distinct().join(members, "id")
    first = told.groupBy("component_id").agg(F.min(F.struct("doc_id", "id")).alias("first"))
    others = checkpointed(members.join(first, "component_id").filter("id <> first.id").select("id"))
    kept = jaccard.keep_ids(keyed, others, "left_anti")
    repeated = found.groupBy("id").count().filter("count > 1").select("id").join(others, "id", "left_anti")
    repeated = checkpointed(repeated)
    if repeated.limit(1).count():
        again = jaccard.keep_ids(kept, repeated, "left_semi")
        one = again.groupBy("id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("id", "row.*")
        kept = jaccard.keep_ids(kept, repeated, "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and a digest of what they decode to."""
    encoded = bpe.encode_documents(docs, bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_recurring_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier, the mix's sampling and the encoder have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
