"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshwork.llm import bpe, fingerprints, jaccard, lines, mixing, quality, queries, topk, urls

TABLES = ("documents", "embeddings", "pages", "conversations", "labels", "benchmark")


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = queries.queries()[name](spark, sf_dir)
    want = duck.sql(queries.oracle_sql()[name])
    order = [want.columns.index(c) for c in sorted(got.columns)]
    assert rows_of(got) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


@pytest.fixture(scope="module")
def texts(duck):
    return duck.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def test_op1_against_plain_texts(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for at, (key, text) in enumerate(texts):
        following = texts[(at + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        plain, other = (fingerprints.fingerprint(fingerprints.PrefixHashes(t)) for t in (text, edited))
        row = got[key]
        assert (row.n_chars, row.fingerprint, row.edited_fingerprint) == (len(text), plain, other)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        nexts = fingerprints.fingerprint(fingerprints.PrefixHashes(following))
        assert (row.near_edited, row.near_next) == (fingerprints.likeness(plain, other), fingerprints.likeness(plain, nexts))
        assert (row.near_edited == 1) == (text == edited) and (row.near_next == 1) == (text == following)
        # What is shared at both ends is at least a quarter octave's step of the true share.
        ends = min(len(os.path.commonprefix([text, edited])) + len(os.path.commonprefix([text[::-1], edited[::-1]])), len(text))
        assert row.near_edited >= min(0.8 * ends / max(len(text), 1), 1 - 1 / max(len(text), 2)) - 1e-9
        assert row.common_prefix == len(os.path.commonprefix([text, following]))
        assert row.common_suffix == len(os.path.commonprefix([text[::-1], following[::-1]]))


def windows(text):
    return {text[i : i + fingerprints.WINDOW] for i in range(len(text) - fingerprints.WINDOW + 1)}


def test_likeness_of_texts_changed_in_several_places(texts):
    near = lambda *t: fingerprints.likeness(*(fingerprints.fingerprint(fingerprints.PrefixHashes(x)) for x in t))
    rng, long = random.Random(4), [t for _, t in texts if len(t) > 2000]
    for text, other in zip(long, long[1:]):
        if len(windows(text)) < 1000:
            continue
        places = sorted(rng.sample(range(len(text)), 3))
        edited = "#" + "".join(c if i not in places else "~" for i, c in enumerate(text)) + "#"
        for a, b in ((text, edited), (text, other)):
            x, y = windows(a), windows(b)
            assert near(a, b) == pytest.approx(len(x & y) / len(x | y), abs=0.25)
        assert near(text, edited) > 0.7
    assert near("a" * 5000, "a" * 5001) > 0.9 and near("x" + long[0] + "x", long[0]) > 0.9


@pytest.mark.parametrize("n,shared", [(1000, 870), (2000, 1730), (500, 440), (500, 250), (64, 60), (10_000, 9_900)])
def test_likeness_is_not_overstated(n, shared):
    """Texts of one length that share their beginning or their end alone."""
    rng = random.Random(n)
    text = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    same, a, b = text(shared), text(n - shared - 1), text(n - shared - 1)
    for x, y in ((same + "#" + a, same + "~" + b), (a + "#" + same, b + "~" + same)):
        near = fingerprints.likeness(*(fingerprints.fingerprint(fingerprints.PrefixHashes(t)) for t in (x, y)))
        both, either = len(windows(x) & windows(y)), len(windows(x) | windows(y))
        assert 0.84 * shared / n - 1e-9 <= near <= max(shared / n, both / either + (0.25 if either > fingerprints.KEPT else 0)) + 1e-9
        assert near <= shared / n + 0.1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé𝄞", max_size=40), st.text(alphabet="abé𝄞", max_size=40), st.integers(0, 39), st.integers(0, 39))
def test_prefix_hashes_find_extensions(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    assert fingerprints.PrefixHashes(a).common_extension(i, fingerprints.PrefixHashes(b), j) == want
    near = fingerprints.likeness(*(fingerprints.fingerprint(fingerprints.PrefixHashes(t)) for t in (a, b)))
    assert (near == 1.0) == (a == b)


def test_op2_held_out(spark, sf_dir, duck):
    quality = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    rows = queries.op2_quality(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in quality]
    assert held and np.mean([r.predicted == quality[r.doc_id] for r in held]) >= 0.85


def test_quality_votes_against_brute_force(spark, texts, duck):
    """Every score is the vote of the nearest labelled rows, found one by one."""
    labels = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    told = spark.createDataFrame(sorted(labels.items()), "doc_id long, quality int")
    model = quality.fit(docs, told, "doc_id", "text", "quality", F.lit(True), 40, 12)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, told, sample=40, rank=12, neighbours=5).collect()}
    assert len(model["y"]) <= 40
    for key, text in texts:
        counts = np.zeros(quality.TERMS)
        raw = text.encode()
        for a, b in zip(raw, raw[1:]):
            counts[int(quality._KIND[a]) * quality.KINDS + int(quality._KIND[b])] += 1
        words = raw.split()
        counts[quality.REPEATED] = sum(a == b for a, b in zip(words, words[1:]))
        weighed = np.sqrt(counts / max(counts.sum(), 1)) * model["idf"]
        latent = (weighed / max(np.linalg.norm(weighed), 1e-12)) @ model["projection"]
        latent /= max(np.linalg.norm(latent), 1e-12)
        near = sorted(((float(latent @ v), i) for i, v in enumerate(model["vectors"])), reverse=True)[:5]
        votes = [max(c, 0) ** quality.SHARPNESS * model["weight"][i] for c, i in near]
        mean = (model["y"] * model["weight"]).sum() / model["weight"].sum()
        want = sum(v * model["y"][i] for v, (_, i) in zip(votes, near)) / sum(votes) if raw[1:] and sum(votes) > 1e-12 else mean
        assert got[key] == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("shard,block,blocks", [(4096, 512, 64), (40, 3, 2)])
def test_top_k_in_many_shards(spark, monkeypatch, shard, block, blocks):
    monkeypatch.setattr(topk, "TASK_BLOCKS", blocks)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 6)), np.tile(rng.normal(size=6), (60, 1)), rng.normal(size=(90, 6)) * 0.01])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(x * 256).astype(np.int64)
    want = []
    for i in range(0, len(x), 7):
        s = q @ q[i]
        best = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, r + 1, j, int(s[j])) for r, j in enumerate(best)]
    got = topk.exact_top_k(df, F.col("vec_id") % 7 == 0, 5, shard=shard, query_block=block)
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("shard,block", [(4096, 512), (40, 3)])
@pytest.mark.parametrize("scale", [256.0, 1e8])
def test_top_k_with_repeated_ids(spark, shard, block, scale):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(90, 4)), 1)
    rows = [(i, v) for i, v in enumerate(x)] + [(i, x[i]) for i in range(0, 90, 7)]  # queries twice
    long = sorted(range(90), key=lambda i: -np.abs(x[i]).sum())[:12]
    rows += [(i, x[i]) for i in long for _ in range(6)]  # the best candidates, often
    rows += [(i, x[(i + 1) % 90]) for i in range(0, 90, 14)]  # two vectors of one id
    answers = defaultdict(set)
    q = [(i, [int(np.floor(c * scale)) for c in v]) for i, v in rows]
    for i, a in q:
        if i % 7 == 0:
            answers[i] |= {(-sum(s * t for s, t in zip(a, b)), j) for j, b in q if j != i}
    want = [(i, r + 1, j, -s) for i in sorted(answers) for r, (s, j) in enumerate(sorted(answers[i])[:5])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, F.col("vec_id") % 7 == 0, 5, scale=scale, shard=shard, query_block=block)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_glob_automaton_equals_regex():
    import re

    rng = random.Random(5)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    names = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    patterns = [re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", g)), re.S) for g in globs]
    got = urls.GlobAutomaton(globs).matches(names)
    assert got.tolist() == [[p.fullmatch(n) is not None for p in patterns] for n in names]


def plain_targets(sizes, share, most):
    """Reshare the excess by weight until no target is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_op6_targets_and_totals(spark, sf_dir, texts, duck):
    import re

    source = dict(duck.sql("SELECT doc_id, source FROM documents").fetchall())
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in texts}
    totals = defaultdict(int)
    for k, n in size.items():
        totals[source[k]] += n
    want = plain_targets(totals, 1.5, 2)
    rows = queries.op6_mixing(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted(size.items())
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == totals[source[r.doc_id]]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 20
    assert rows_of(queries.op6_mixing(spark, sf_dir)) == sorted((tuple(r[c] for c in sorted(r.asDict())) for r in rows), key=repr)


def test_mixing_over_many_blocks(spark):
    df = spark.range(900).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 37 % 91).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "b").otherwise(F.when(F.col("id") % 5 == 0, "c").otherwise("a")).alias("source"),
    )
    units = mixing.mix_units(df, block=16, share=1.1).collect()
    assert len(units) == 900
    for s in "abc":
        mine = [u for u in units if u.source == s]
        assert abs(sum(u.size * u.copies for u in mine) - mine[0].target) <= 5
        assert abs(np.mean([u.copies for u in mine]) - mine[0].target / mine[0].source_size) < 0.05


def plain_components(docs, k, num, den):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({b" ".join(w)} if w else set())
    label, links = {i: i for i in sets}, dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                low, high = sorted((label[i], label[j]))
                label = {n: low if v == high else v for n, v in label.items()}
    return sorted((i, len(sets[i]), label[i], links[i]) for i in ids)


def found_components(rows, key):
    return sorted((r[key], r.n_shingles, r.component_id, r.n_links) for r in rows.collect())


def test_op7_against_all_pairs(spark, sf_dir, texts):
    assert found_components(queries.op7_jaccard_join(spark, sf_dir), "doc_id") == plain_components(texts, 4, 85, 100)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_chains_groups_and_hubs(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    docs = []
    vocabulary = [f"w{i}" for i in range(60)]
    for g in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = words  # chains drift away from where they began
            docs.append((len(docs), " ".join(words).upper() if rng.random() < 0.2 else "  ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found_components(jaccard.near_duplicates(df, k=2, num=70, den=100), "id") == plain_components(docs, 2, 70, 100)


@pytest.mark.parametrize("members,num", [(8, 70), (8, 85), (40, 60)])
def test_jaccard_large_clusters_in_blocks(spark, monkeypatch, members, num):
    """Clusters of many blocks: near copies around one text, and others that drift far from it."""
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    rng = random.Random(members)
    base = words = [f"w{i}" for i in range(50)]
    docs = []
    for i in range(260):
        words = list(base) if i % 3 else list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(400)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found_components(jaccard.near_duplicates(df, k=2, num=num, den=100), "id") == plain_components(docs, 2, num, 100)


def test_jaccard_group_of_near_copies_takes_rows_in_proportion(spark):
    """Sets that lie near one text are counted, not compared: rows grow as the group does."""
    docs = spark.range(50000).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", *[F.lit(f"w{i}") for i in range(60)], F.col("id").cast("string"), *[F.lit(f"v{i}") for i in range(60)]).alias("text"),
    )
    rows = jaccard.near_duplicates(docs, k=5, num=80, den=100)
    told = rows.agg(F.count("*"), F.max("component_id"), F.min("n_links"), F.max("n_links")).first()
    assert tuple(told) == (50000, 0, 49999, 49999)


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_shingles_of_repetitive_words_differ(size):
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    other = bits.translate(str.maketrans("ab", "ba"))
    assert not set(jaccard.shingle_set(bits, 5)) & set(jaccard.shingle_set(other, 5))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def tik(vocabulary):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})


def test_op8_against_the_library(spark, sf_dir, texts, tik):
    got = {r.doc_id: r for r in queries.op8_byte_bpe(spark, sf_dir).collect()}
    for key, text in texts:
        ids = np.array(tik.encode_ordinary(text), "<u4")
        assert (got[key].n_tokens, got[key].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[key].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size,more", [(16, 8), (40, 20), (100, 50)])
def test_stitching_equals_whole_text(spark, vocabulary, tik, size, more):
    rng = random.Random(size)
    parts = ["a", "bb", " ", "  ", "\n", "'re", "'", "é", "𝄞", "12", "!!", "<|endoftext|>"]
    texts = []
    for _ in range(120):
        more_parts = [*parts, "word" * rng.randint(1, 30), " " * rng.randint(1, 40), "x" * rng.randint(1, 200)]
        texts.append("".join(rng.choice(more_parts) for _ in range(rng.randint(1, 80))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.encode_documents(df, vocabulary, public_tokenizers.PATTERN, chunk=size, overlap=more).collect()
    want = [(i, np.array(tik.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in enumerate(texts)]
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_a_long_text_takes_many_tasks(spark, vocabulary, tik):
    line = "The engine reads a line; it's number {} of a text that goes on and on.\n"
    text = "".join(line.format(i) for i in range(60000)) + "y" * 100000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    sent = spark.sparkContext.broadcast(("a long text", vocabulary, public_tokenizers.PATTERN))
    runs = bpe._long_texts(df.select(F.col("doc_id").alias("row"), "text"), sent, bpe.CHUNK, bpe.OVERLAP, 4)
    found = runs.select("run", F.spark_partition_id().alias("task")).collect()
    # One run for nearly every chunk; the endless word is one piece, and so one run.
    assert len(found) >= len(text) // bpe.CHUNK - 4 and len({r.task for r in found}) == 4
    (row,) = bpe.encode_documents(df, vocabulary, public_tokenizers.PATTERN).collect()
    assert bytes(row.decoded).decode() == text
    assert bytes(row.ids) == np.array(tik.encode_ordinary(text), "<u4").tobytes()


def test_line_templates_generalise(spark):
    docs = [(i, f"Session of user{i} opened on port {i} by alpha beta gamma delta epsilon zeta eta theta\nOnly {chr(97 + i)} says this line here") for i in range(4)]
    docs += [(10 + i, f"Session of user opened on port by alpha beta gamma delta {w} zeta eta theta iota kappa lambda") for i, w in enumerate(["one", "two", "ten"])]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i].n_dropped for i in range(4)] == [0, 1, 1, 1]
    assert [got[10 + i].n_dropped for i in range(3)] == [0, 1, 1]


def test_several_templates_of_one_leaf(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()

    def line(words, **changed):
        return "Job is done " + " ".join(changed.get(f"p{i}", w) for i, w in enumerate(words))

    upper = [w.upper() for w in words]
    kind_a = [line(words, p1="one"), line(words, p6="two"), line(words, p1="six", p6="ten"), line(words, p1="sun")]
    kind_b = [line(upper, p2="red"), line(upper, p2="sky", p3="sea"), line(upper, p3="oak")]
    drift = [line(words, p0="u", p2="v"), line(words, p3="u", p4="v")]  # no two places that vary fit them all
    passage = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    long = [" ".join(passage), " ".join([*passage[:30], "other", *passage[31:]])]
    texts = [*kind_a, *kind_b, *drift, "own words of nine alone\n" + long[0], "x\n" + long[1], " ".join(passage[:50]), " ".join(passage[:50])]
    got = {r.doc_id: r.n_dropped for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [0, 1, 1, 1] + [0, 1, 1] + [0, 0] + [0, 1] + [0, 0]


def test_pipeline_stages_of_an_empty_table(spark, sf_dir):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, documents.limit(0), sf_dir)
        assert out.collect() == []
        if at + 1 < len(corpus_pipeline.STAGES):
            assert out.dtypes == documents.dtypes


def test_pipeline_against_brute_force(spark, sf_dir, tmp_path, tik):
    """The rows that each stage keeps, from those that the stage before it kept, and the whole run."""
    import corpus_pipeline

    stages = [f for _, f in corpus_pipeline.STAGES]
    con = duckdb.connect()

    def written(at, docs):
        stages[at](spark, docs, sf_dir).write.parquet(f"{tmp_path}/{at}")
        return spark.read.parquet(f"{tmp_path}/{at}")

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = written(0, documents)
    scores = {r.doc_id: r.predicted for r in queries.op2_quality(spark, sf_dir).collect()}
    assert rows_of(good) == rows_of(documents.filter(F.col("doc_id").isin([i for i, p in scores.items() if p])))

    clean = written(1, good)
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/0/*.parquet'")
    told = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_dropped, n_chars, text_sha256 FROM ({queries.SQL_OP10})").fetchall()}
    kept = {r.doc_id: r for r in clean.collect()}
    for key, (dropped, n_chars, sha) in told.items():
        if key in kept:
            assert (hashlib.sha256(kept[key].text.encode()).hexdigest(), len(kept[key].text)) == (sha, n_chars)
        else:
            assert dropped and n_chars < 200  # blanks alone are left
    assert set(kept) <= {r.doc_id for r in good.collect()} and any(r[0] for r in told.values())

    single = written(2, clean)
    want = {c for _, _, c, _ in plain_components([(i, r.text) for i, r in kept.items()], 5, 80, 100)}
    assert rows_of(single) == rows_of(clean.filter(F.col("doc_id").isin(list(want))))

    mixed = written(3, single)
    copies = defaultdict(int)
    for r in mixed.collect():
        copies[tuple(r)] += 1
    assert set(copies) <= {tuple(r) for r in single.collect()} and max(copies.values()) <= 2
    units = mixing.mix_units(single).collect()
    assert sum(copies.values()) == sum(u.n_rows * u.copies for u in units)

    encoded = written(4, mixed)
    ids = sorted((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded_sha256) for r in encoded.collect())
    plain = [(r.doc_id, np.array(tik.encode_ordinary(r.text or ""), "<u4").tobytes(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in mixed.collect()]
    assert ids == sorted((i, b, len(b) // 4, h) for i, b, h in plain)
    assert rows_of(corpus_pipeline.run(spark, sf_dir)) == rows_of(encoded)
