"""Ranked search, hard negatives and archives against plain Python, with their edge cases."""

import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm import negatives, ranked, warc

# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked_plainly(docs, items, k):
    parsed = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    parsed = [p for p in parsed if p[2]]
    n, length = len(parsed), sum(p[2] for p in parsed)
    df = Counter(t for _, c, _ in parsed for t in c)
    wanted = defaultdict(Counter)
    for item, text in items:
        wanted[item].update(terms(text))
    out = []
    for item, times in wanted.items():
        scored = []
        for doc, counts, size in parsed:
            m = 75 + (25 * size * n) // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m)) for t, q in times.items() if t in counts)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_items,block_terms,fan_in", [(4096, 1 << 17, 256), (2, 5, 2), (100, 8, 3)])
def test_ranked_search(spark, block_items, block_terms, fan_in):
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "délta", "Ünder", "ß", "x1", "7", "naïve", "zeta", "word"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "_", "\n", ", ", "\x7f"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 30))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "--- !!"), (None, text(9)), (5, docs[5][1]), (63, "beta " * 400_000 + "zeta"), (64, docs[7][1]), (2, docs[7][1])]
    items = [(i, text(rng.randrange(1, 9))) for i in range(9)] + [(3, "beta beta"), (None, "Alpha ünder"), (20, None), (21, ""), (22, "unseen"), (-1, "x1")]
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(5)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = ranked.rank_documents(frame, asked, 7, block_items=block_items, block_terms=block_terms, fan_in=fan_in)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked_plainly(docs, items, 7)


def test_ranked_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ranked.rank_documents(one, items).count() == 0
    assert ranked.rank_documents(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert ranked.rank_documents(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_scores_beyond_floats():
    """Sums that could pass 2**53 are taken in integers."""
    index = ranked._Index([{"item": 1, "term": b"a", "times": 10**8}, {"item": 1, "term": b"b", "times": 1}])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([4], pa.int64()), pa.array([b"a b b"])], names=["doc_id", "text"])
    weights = np.array([20_011, 7], np.int64)
    run = ranked._scorer(index, weights, 3, 9, 2)
    original, ranked.TaskContext = ranked.TaskContext, type("None_", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())})
    try:
        (out,) = run(iter([batch]))
    finally:
        ranked.TaskContext = original
    m = 75 + (25 * 3 * 3) // 9
    assert out.column(3).to_pylist() == [10**8 * 20_011 * (10**9 // (1000 + 12 * m)) + 7 * (2 * 10**9 // (2000 + 12 * m))]


# Hard negatives


def mined_plainly(rows, positives, negs, low, high):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, tuple(math.floor(256 * x) for x in v), label)
        if row not in kept:
            kept.append(row)
    out = []
    for i, v, label in kept:
        if i % 5:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in kept if len(w) == len(v)]
        best = sorted(s for s in scored if s[2] == label and s[1] != i)[:positives]
        for p, j, _ in best:
            hard = sorted(s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)[:negs]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("scale,fewest,block,blocks", [(1.0, 2048, 256, 64), (1.0, 8, 2, 1), (3e4, 16, 3, 2)])
def test_hard_negatives(spark, scale, fewest, block, blocks):
    rng = random.Random(11)
    vector = lambda n: [scale * rng.choice([rng.uniform(-1, 1), 0.5, -0.25, 0.0]) for _ in range(n)]
    rows = [(i, [abs(x) for x in vector(6)] if i % 3 else vector(6), rng.randrange(3)) for i in range(120)]
    rows += [(200 + i, vector(2), i % 2) for i in range(30)] + [(300 + i, [], i % 2) for i in range(11)]
    rows += [(400, [1.0, 2.0], None), (None, vector(6), 1), (405, None, 1), (410, [math.nan] * 6, 1), (415, [None] + vector(5), 1), (420, [math.inf] * 6, 0)]
    rows += [rows[5], rows[5], (5, rows[5][1], 2), (5, vector(6), rows[5][2]), (10, rows[11][1], rows[11][2]), (7, rows[8][1], rows[8][2])]
    rows += [(500 + i, rows[9][1], 1) for i in range(40)]
    frame = spark.createDataFrame([(i, v, x, "r", 1) for i, v, x in rows], "vec_id long, embedding array<double>, label int, row string, place int").repartition(6)
    got = negatives.mine_hard_negatives(frame, F.col("vec_id") % 5 == 0, 4, 3, 50, 95, fewest_rows=fewest, block=block, task_blocks=blocks)
    want = mined_plainly(rows, 4, 3, 50, 95)
    assert len(want) > 50
    assert sorted(tuple(r) for r in got.collect()) == want


def test_hard_negatives_of_empty_tables(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine_hard_negatives(frame, F.col("vec_id") % 5 == 0).count() == 0
    lone = spark.createDataFrame([(5, [1.0], 1), (6, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine_hard_negatives(lone, F.col("vec_id") % 5 == 0).count() == 0


@pytest.mark.parametrize("size,dims", [(1, 3), (255, 64), (10**4, 1500), (10**8, 40), (10**9, 4)])
def test_residue_products_are_exact(size, dims):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-size, size + 1, (n, dims)).astype(float) for n in (9, 14))
    a[0], b[0], b[1] = size, size, -size
    primes = negatives.primes_for(size * size * dims)
    got = negatives.products(negatives.residues(a, primes), negatives.residues(b, primes), primes)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    if max(abs(x) for row in want for x in row) < 2**63:
        assert got.tolist() == want


def test_scores_beyond_64_bits_raise():
    a = np.full((1, 8), 2.0**40)
    primes = negatives.primes_for(8 << 80)
    with pytest.raises(OverflowError):
        negatives.products(negatives.residues(a, primes), negatives.residues(a, primes), primes)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_columns_take_the_first_of_equal_scores(k):
    rng = np.random.default_rng(k)
    scores, allowed = rng.integers(-3, 4, (40, 30)), rng.random((40, 30)) < 0.6
    want = [(i, j) for i in range(40) for j in sorted(sorted(np.flatnonzero(allowed[i]), key=lambda c, i=i: (-scores[i, c], c))[:k])]
    assert list(zip(*(x.tolist() for x in negatives.best_columns(scores, allowed, k)))) == want


# Archives


def archived_plainly(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            key = (i is None, i or 0)
            first[data] = min(first.get(data, key), key)
    out, seen = [], set()
    for i, _, html in rows:
        data = (html or "").encode()
        kind, refers = "response", None
        if len(data) >= 100:
            if first[data] != (i is None, i or 0) or data in seen:
                kind, refers = "revisit", None if first[data][0] else first[data][1]
            else:
                seen.add(data)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), kind, refers))
    return sorted(out, key=repr)


def pages():
    rng = random.Random(5)
    html = lambda n: "".join(rng.choice("abc <p>é\r\n😀") for _ in range(n))
    rows = [(i, f"http://a/{i}", html(rng.randrange(0, 400))) for i in range(80)]
    rows += [(100 + i, "http://b\r\nWARC-Type: x/ü y", rows[3][2] * 3) for i in range(9)] + [(50 + i, None, rows[3][2] * 3) for i in range(3)]
    rows += [(200, None, None), (201, "", ""), (202, "u", "x" * 99), (203, "u", "x" * 99), (204, "u", "x" * 100), (205, "u", "x" * 100)]
    rows += [(None, "n", "y" * 200), (None, "n", "y" * 200), (None, None, "z" * 300), (300, "q", "w" * 3_000_000)]
    return rows + [(7, "again", "t" * 150)] * 5 + [(7, None, "t" * 150), (9, "x", "t" * 150), (8, "short", "s"), (8, "short", "s")]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "p") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(4)


def kinds(records):
    return sorted((tuple(r) for r in warc.pages_of(records).collect()), key=repr)


@pytest.mark.parametrize("split,file_bytes,hot", [(32 << 20, 1 << 30, 100_000), (97, 3000, 1), (1024, 1 << 30, 2)])
def test_archives_hold_what_was_written(spark, tmp_path, monkeypatch, split, file_bytes, hot):
    monkeypatch.setattr(warc, "MOST_HOT", hot)
    monkeypatch.setattr(warc, "RUN", 2)
    files = warc.write_pages(frame_of(spark, pages()), f"file://{tmp_path}", file_bytes=file_bytes)
    assert kinds(warc.read_records(spark, files, split)) == archived_plainly(pages())
    assert kinds(warc.read_records(spark, warc.archives_in(spark, f"file://{tmp_path}"), split)) == archived_plainly(pages())


def test_archives_of_an_empty_table(spark, tmp_path):
    files = warc.write_pages(frame_of(spark, []), f"file://{tmp_path}")
    assert files.count() == 0 and warc.read_records(spark, files).count() == 0


def test_every_record_is_a_member_and_payloads_come_back(spark, tmp_path):
    files = warc.write_pages(frame_of(spark, pages()), f"file://{tmp_path}")
    records = warc.read_records(spark, files, 5000, payload=True).collect()
    told = {(r.path, r.offset): r for r in records}
    assert len(told) == len(records)
    for r in records:
        raw = open(r.path.removeprefix("file://"), "rb").read()[r.offset : r.stop]
        whole = gzip.decompress(raw)
        assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
        if r.record_type == "response":
            assert whole.endswith(r.payload + b"\r\n\r\n") and hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    urls = {r.target_uri for r in records}
    assert "http://b%0D%0AWARC-Type:%20x/ü%20y" in urls


def member(block, kind="resource", level=6):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    return gzip.compress(head + block + b"\r\n\r\n", level)


def archive_of(tmp_path, spark, data):
    (tmp_path / "a.warc.gz").write_bytes(data)
    return warc.archives_in(spark, f"file://{tmp_path}")


@pytest.mark.parametrize("split", [50, 333, 100_000])
def test_archives_within_payloads_and_members_of_several_records(spark, tmp_path, split):
    rng = random.Random(2)
    inner = b"".join(member(rng.randbytes(120), level=0) for _ in range(6))
    blocks = [rng.randbytes(40), inner, inner[:-30], b"", inner + rng.randbytes(500), warc.MAGIC * 50, b"tail"]
    data = b"".join(member(b, level=0 if b else 6) for b in blocks)
    two = gzip.decompress(member(b"one")) + gzip.decompress(member(b"two"))
    data += gzip.compress(two)
    got = warc.read_records(spark, archive_of(tmp_path, spark, data), split, payload=True).orderBy("offset", "payload_bytes", "payload").collect()
    assert [bytes(r.payload) for r in got] == blocks + [b"one", b"two"]


@pytest.mark.parametrize("split", [64, 100_000])
def test_damaged_archives_raise(spark, tmp_path, split):
    whole = [member(random.Random(i).randbytes(200)) for i in range(6)]
    broken = bytearray(b"".join(whole))
    broken[len(whole[0]) + len(whole[1]) + 60] ^= 255
    with pytest.raises(ValueError, match=f"from byte {len(whole[0]) + len(whole[1])} on"):
        warc.read_records(spark, archive_of(tmp_path, spark, bytes(broken)), split)
    with pytest.raises(ValueError, match="no record covers"):
        warc.read_records(spark, archive_of(tmp_path, spark, b"".join(whole)[:-9]), split)


def test_heads_of_other_writers():
    raw = b"WARC/1.0\r\nwarc-type: response\r\nContent-Type: application/http; msgtype=response\r\nX: a\r\n  b\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"
    (record,) = warc.records_in(io.BytesIO(gzip.compress(raw)), 0, 10, True)
    assert (record["record_type"], record["payload"], record["payload_bytes"]) == ("response", b"hello", 5)
