"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms are pairs of neighbouring bytes of the whole text (64 classes a byte) and the
event that a word repeats the word before it: repetition is a usual sign of poor web
text, and no pair of bytes shows it.  Document frequencies are counted over all
documents; a truncated singular value decomposition of the labelled rows' TF-IDF
vectors gives the latent space.  The labelled vectors are broadcast (``SAMPLE``
rows of ``RANK`` numbers at most), every document's cosine with all of them is an
exact blocked matrix product, and the ``NEIGHBOURS`` nearest vote with a weight
that grows with their cosine.

Labels come from a bounded sample: per label the ``SAMPLE / 2`` rows of smallest
hash, each weighted by how many labelled rows it stands for.

Defined results: a null or empty text has no terms and gets the labelled rows'
mean score; without any label every score is 0.5; null labels are left out, a
document with several labels counts with each; of a labelled id's several texts one is
learnt (that of the smallest vector); repeated rows are scored each.  An
input column named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, released, small_batches

#: Bounds of what is collected and broadcast.
SAMPLE, RANK, NEIGHBOURS = 4096, 48, 15
#: Exponent of a neighbour's cosine in its vote.
SHARPNESS = 8.0
KINDS = 64
TERMS = KINDS * KINDS
#: The term of a repeated word takes the place of a pair that no text has.
REPEATED = 0


def _kinds() -> np.ndarray:
    """Class of each byte: letters keep apart by case, other bytes by what they are."""
    kind = np.full(256, 21, np.uint16)  # control bytes count as blanks; no byte has kind 0
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            kind[b] = 1 + (b - ord("a")) // 2  # 13
        elif "A" <= c <= "Z":
            kind[b] = 14 + (b - ord("A")) // 6  # 5
        elif c.isdigit() and b < 128:
            kind[b] = 19
        elif c in "\n\r\x0b\x0c":
            kind[b] = 20
        elif c in " \t":
            kind[b] = 21
        elif 33 <= b < 127:
            kind[b] = 22 + (b - 33) % 32
        elif b >= 128:
            kind[b] = 54 + (b - 128) // 16  # 8
    return kind


_KIND = _kinds()


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the byte pairs of each whole text, one row per text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        if text:
            raw = text.encode()
            k = _KIND[np.frombuffer(raw, np.uint8)]
            if len(k) > 1:
                out[i] = np.bincount(k[:-1] * np.uint16(KINDS) + k[1:], minlength=TERMS)
            words = raw.split()
            out[i, REPEATED] = sum(map(eq, words, words[1:]))
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length (or zero): damped relative term frequency times idf."""
    total = counts.sum(axis=1, keepdims=True)
    tf = np.sqrt(counts / np.maximum(total, 1))
    tf *= idf
    return tf / np.maximum(np.sqrt((tf * tf).sum(axis=1, keepdims=True)), 1e-12)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, over all of them, and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(at, 256).to_pylist()
                total += (term_counts(texts) > 0).sum(axis=0)
                n += len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(TERMS), -1), pa.int32()), pa.array(np.append(total, n), pa.int64())], names=["term", "n"]
        )

    sums = docs.select(text_col).mapInArrow(released(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(TERMS), 0
    for term, many in sums:
        if term < 0:
            n = many
        else:
            df[term] = many
    return df, n


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, keep: Column, sample: int, rank: int) -> dict:
    """What the scorer needs: idf, projection, labelled vectors, labels and weights."""
    df, n = document_frequencies(docs, text_col)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL").filter(keep)
    many = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in sorted(many):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return {}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _weighted(term_counts(batch.column(1).to_pylist()), idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", "y").mapInArrow(released(vectors), "id long, y int, x binary")
    rows = rows.groupBy("id", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    if not rows:
        return {}
    y = np.array([r["y"] for r in rows])
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float16).reshape(len(rows), TERMS).astype(np.float32)
    used = np.flatnonzero(x.any(axis=0))
    projection = np.zeros((TERMS, min(rank, len(rows), max(1, len(used)))), np.float32)
    projection[used] = _right_vectors(x[:, used], projection.shape[1])
    weight = np.array([many[k] / max(1, (y == k).sum()) for k in y], np.float32)
    return {"idf": idf, "projection": projection, "vectors": _unit(x @ projection), "y": y.astype(np.float32), "weight": weight}


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


def _right_vectors(x: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(x.shape[1], rank + 8))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def vote(model: dict, texts: list[str | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of texts: similarity-weighted share of label 1 among the nearest labelled rows."""
    if not model:
        return np.full(len(texts), 0.5)
    y, weight = model["y"], model["weight"]
    mean = float((y * weight).sum() / weight.sum())
    counts = term_counts(texts)
    latent = _unit(_weighted(counts, model["idf"]) @ model["projection"])
    cosine = latent @ model["vectors"].T
    k = min(neighbours, len(y))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    votes = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** SHARPNESS * weight[near]
    total = votes.sum(axis=1)
    score = np.where(total > 1e-12, (votes * y[near]).sum(axis=1) / np.maximum(total, 1e-12), mean)
    return np.where(counts.any(axis=1), np.clip(score, 0, 1), mean)


def score_documents(
    docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", carry: list[str] | None = None, sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """The columns of ``carry`` (the id alone, if None) and ``score``.

    ``learn_from`` is a condition on ``id`` that says which labelled rows may be learnt.
    """
    keep = F.lit(True) if learn_from is None else learn_from
    model = fit(small_batches(docs), labels, id_col, text_col, label_col, keep, sample, rank)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (carry or [id_col]) if c.lower() != "score"]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.where(texts.notna(), None).tolist()
            parts = [vote(sent.value, values[at : at + 256], neighbours) for at in range(0, len(values), 256)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
        release_memory()

    return docs.withColumn("score", score(F.col(text_col))).select(*names, "score")
