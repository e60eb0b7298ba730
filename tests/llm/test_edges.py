"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from meshwork.llm import bpe, chat, fingerprints, jaccard, licenses, lines, mixing, quality, topk, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = ("word another thing " * 12000) + "x" * 60000
ROWS = [
    (1, None, "en", None, None),
    (2, "", None, "b", 0),
    (3, "The same text of seven words here.", "en", "a", 35),
    (3, "The same text of seven words here.", "en", "a", 35),
    (4, "The same text of seven words here.", "en", "a", 35),
    (None, "A text without an id but words.", "en", "b", 31),
    (5, LONG, "en", "b", len(LONG)),
    (6, "Licensed under the Apache License, Version 2.0.\nOne line\twith tabs. été\n\n", "fr", "c", 70),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("taken"))
    return df


def test_fingerprints(docs, none):
    rows = fingerprints.fingerprint_documents(clashing(docs, "bucket", "guest", "id", "p", "fingerprint")).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_chars == 0 and by_id[1].near_edited == 1.0
    assert by_id[3].fingerprint == by_id[4].fingerprint
    assert sorted(r.near_next for r in rows if r.doc_id == 3) == [1.0, 1.0]
    # Null sorts first, so the last document is followed by the one without an id.
    text, following = ROWS[7][1], ROWS[5][1]
    half = len(text) // 2
    assert by_id[6].edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
    assert fingerprints.fingerprint_documents(none).collect() == []


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, None), (None, 1), (77, 0)], "doc_id long, quality int")
    rows = quality.score_documents(clashing(docs, "score", "y", "x", "id"), labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in rows if r.doc_id in (3, 4)] == pytest.approx([1.0] * 3)
    assert [r.score for r in rows if r.doc_id == 1] == [r.score for r in rows if r.doc_id == 2]
    unlabelled = quality.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    assert quality.score_documents(none, labels).collect() == []


def test_top_k(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, 0.5]), (None, [9.0, 9.0]), (9, []), (10, [3e8, 3e8]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.exact_top_k(clashing(df, "id", "v", "cell", "score"), F.col("vec_id").isin(0, 3, 7, 9), 3).collect()
    answers = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        answers.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert answers == {0: [(10, 256 * 3 * int(256 * 3e8)), (1, 327680), (2, 327680)]}
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") == 0, 3).collect() == []


def test_licenses(docs, none):
    paths = F.when(F.col("doc_id") == 6, "a/LICENSE").when(F.col("doc_id") == 4, "a/b/c.txt").when(F.col("doc_id") == 3, "x/y.txt")
    files = clashing(docs.withColumn("path", paths), "license", "score", "origin", "term", "dir")
    rows = licenses.scan_licenses(files).collect()
    found = {(r.doc_id, r.license, r.origin, r.license_path) for r in rows}
    assert len(rows) == len(ROWS)
    assert (6, "Apache-2.0", "licence file", "a/LICENSE") in found
    assert (4, "Apache-2.0", "inherited", "a/LICENSE") in found
    assert (3, None, None, None) in found and (1, None, None, None) in found
    assert licenses.scan_licenses(none.withColumn("path", F.lit("a"))).collect() == []


def test_licenses_weigh_all_words(spark):
    grant = licenses.TEMPLATES["MIT"].split("\n")[-1].split()
    wrapped = "\n".join(" * " + " ".join(grant[i : i + 9]) for i in range(0, len(grant), 9))
    texts = [
        ("The seats were all reserved.", None), ("Equal rights for all citizens.", None), ("Researchers at MIT released a new model of the brain.", None),
        ("All rights of minorities were reserved by an act of parliament in 1920.", None),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under the Mozilla Public License, v. 2.0.", "MPL-2.0"),
        (f"/*\n * Copyright 2020 someone\n *\n{wrapped}\n *\n */\ncode", "MIT"), ("All rights reserved.", "Proprietary"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ]
    files = spark.createDataFrame([(f"{i}/a.txt", t) for i, (t, _) in enumerate(texts)], "path string, text string")
    got = {r.path: r.license for r in licenses.scan_licenses(files).collect()}
    assert got == {f"{i}/a.txt": want for i, (_, want) in enumerate(texts)}


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/x"), (4, "http://A.Example.ORG"), (5, "http://a.example.org/es/?q"), (6, "x://" + "y" * 5000 + ".org/"),
            (7, "http://casino-win.example.net/a"), (7, "http://casino-win.example.net/a"), (8, "http://x.com/casino-win"), (9, "é://münchen.org/ü#f")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string"), "host", "verdict")
    rules = [("allow", "org/"), ("block", "example.org/es/")]
    got = [(r.page_id, r.host[:20], r.path, r.rule, r.verdict) for r in urls.filter_urls(df, rules).collect()]
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.example.org", "", None, "allow"),
        (5, "a.example.org", "/es/", "example.org/es/", "block"), (6, "y" * 20, "/", "org/", "allow"),
        (7, "casino-win.example.n", "/a", None, "block"), (7, "casino-win.example.n", "/a", None, "block"),
        (8, "x.com", "/casino-win", None, "allow"), (9, "münchen.org", "/ü", "org/", "allow"),
    ]
    assert urls.filter_urls(df.limit(0), rules).collect() == []


def test_rules_from_a_table_and_words_of_hosts(spark):
    rules = spark.createDataFrame([("block", "a.org/"), ("block", "a.org/"), ("allow", "a.org/x"), (None, "b.org/"), ("block", "c.org/"), ("allow", "c.org/")], "verdict string, rule string")
    hosts = {"http://a.org/x/y": "allow", "http://a.org/": "block", "http://b.org/": "allow", "http://c.org/": "allow", "http://spam.net/": "block", "http://my.spam": "block",
             "http://spamhaus.net/": "allow", "http://big-casino-win.net/a": "block", "http://x.net/spam/": "allow", "http://casinos.net": "allow", "http://a.b-spam/": "block"}
    df = spark.createDataFrame(list(enumerate(hosts)), "page_id long, url string")
    assert {r.url: r.verdict for r in urls.filter_urls(df, rules).collect()} == hosts


def test_urls_of_any_length_in_bounded_memory():
    import tracemalloc

    automaton = urls.GlobAutomaton(["*.org/**", "**y"])
    short = [f".a{i}.org/x" for i in range(10000)]
    tracemalloc.start()
    hit = automaton.matches([*short, "." + "x" * 300000 + "y"])
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert hit[:10000].tolist() == [[True, False]] * 10000 and hit[10000].tolist() == [False, True]


def test_mixing(docs, none):
    units = mixing.mix_units(clashing(docs, "size", "target", "p", "h", "block", "turn")).collect()
    assert sum(u.n_rows for u in units) == len(ROWS)
    assert {u.source for u in units} == {None, "a", "b", "c"}
    assert all(0 <= u.copies <= 2 for u in units)
    assert [u.size for u in units if u.doc_id in (1, 2)] == [0, 0]
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(u.n_rows * u.copies for u in units)
    assert mixing.mix_units(none).collect() == [] and mixing.mix_sources(none).collect() == []


def test_jaccard(docs, none):
    rows = jaccard.near_duplicates(clashing(docs, "id", "n", "sig", "h", "label", "node")).collect()
    got = sorted(((r.id, r.component_id, r.n_shingles) for r in rows), key=str)
    assert len(got) == len(ROWS)
    assert [g for g in got if g[0] in (3, 4)] == [(3, 3, 3), (3, 3, 3), (4, 3, 3)]
    assert (1, 1, 0) in got and (2, 2, 0) in got and (None, None, 3) in got
    assert jaccard.near_duplicates(none).collect() == []


def test_jaccard_one_id_of_several_texts(spark):
    a, b = "one two three four five six seven", "eins zwei drei vier fuenf sechs sieben"
    df = spark.createDataFrame([(2, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert {(r.id, r.component_id) for r in jaccard.near_duplicates(df).collect()} == {(2, 2), (5, 2), (9, 2)}


def test_one_of_each_group_with_repeated_and_null_ids(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(40)]
    near, far = " ".join(base[:39] + ["x"]), " ".join(f"v{i}" for i in range(30))
    text = " ".join(base)
    rows = [
        (7, text, "en", "a", 1), (7, text, "en", "b", 1), (7, far, "en", "a", 1), (9, near, "en", "a", 1), (8, "alone in the world of words", "fr", "a", 1),
        (5, near, "en", "c", 1), (11, far, "de", "a", 1), (12, "", "en", "a", 0), (13, "", "en", "a", 0), (14, None, "en", "a", None), (14, None, "en", "a", None),
        (None, text, "en", "a", 1), (None, text, "en", "a", 1), (None, "another text", "en", "a", 1),
    ]
    sets = {t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for t in (text, near, far)}
    label = lambda t: next((n for n in (text, far) if t in sets and sets[t] and len(sets[t] & sets[n]) >= 0.8 * len(sets[t] | sets[n])), None)
    want, seen, done = [r for r in rows if r[0] is None], set(), set()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], str(r[1]), r[3])):
        group = label(r[1])
        if (r[0], r[1]) not in done and (group is None or group not in seen):
            want.append(r)
        done.add((r[0], r[1]))
        seen.add(group)
    df = spark.createDataFrame(rows, DOC)
    for turn in (df, df.orderBy(F.desc("source"), F.desc("doc_id"))):
        got = corpus_pipeline.keep_one_of_each_group(spark, turn, "")
        assert got.dtypes == df.dtypes
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_bpe(docs, none, ranks):
    got = bpe.encode_digests(clashing(docs, "row", "offset", "ids"), ranks, public_tokenizers.PATTERN).collect()
    want = sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ROWS)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == want
    assert [r.n_tokens for r in got if r.doc_id in (1, 2)] == [0, 0]
    twice = bpe.encode_digests(docs.unionAll(docs), ranks, public_tokenizers.PATTERN)
    assert sorted(map(str, twice.collect())) == sorted(2 * list(map(str, got)))
    assert bpe.encode_digests(none, ranks, public_tokenizers.PATTERN).collect() == []


def test_chat(spark):
    turns = "pair_id long, turn long, role string, text string, place long, c string"
    chosen = spark.createDataFrame([(1, 0, "user", "Hi", 1, "x"), (1, 1, "assistant", "Yes", 1, "x"), (2, 0, None, None, 1, "x"), (None, 0, "user", "lost", 0, ""),
                                    (3, 0, "user", "a", 0, ""), (3, 0, "user", "a", 0, "")], turns)
    rejected = spark.createDataFrame([(1, 0, "user", "Hi", 1, "x"), (1, 1, "assistant", "No", 1, "x"), (2, 0, None, None, 1, "x"), (4, 0, "assistant", "é" * 9, 1, "")], turns)
    got = {r.pair_id: r for r in chat.format_preferences(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert (one.n_prompt_turns, one.prompt) == (1, "<|im_start|>user\nHi<|im_end|>\n")
    assert one.chosen == "<|im_start|>assistant\nYes<|im_end|>\n" and one.rejected == "<|im_start|>assistant\nNo<|im_end|>\n"
    start, size = map(int, one.chosen_mask.split(":"))
    assert one.chosen[start : start + size] == "Yes<|im_end|>"
    assert not got[2].differs and got[2].chosen == got[2].rejected == ""
    assert got[3].n_prompt_turns == 0 and got[3].chosen.count("<|im_start|>") == 2 and got[3].rejected == ""
    assert got[4].chosen == "" and got[4].rejected_mask == "22:19"
    assert chat.format_preferences(chosen.limit(0), rejected.limit(0)).collect() == []


def test_lines(spark, docs, none):
    rows = lines.dedup_lines(clashing(docs, "n_lines", "id", "doc", "pos", "raw", "keep", "dropped")).collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id: r.n_dropped for r in rows if r.doc_id in (1, 2, 5, 6)} == {1: 0, 2: 0, 5: 0, 6: 0}
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    shared = [(i, f"Own words of document {i} alone.\nServed by node {i * 7} at 10:0{i} for all\n\nx") for i in range(5)] + [(7, None), (None, "Served by node 3 at 1 for all")]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(shared, "doc_id long, text string")).collect()}
    assert got[None].n_dropped == 0  # null is the first document
    assert got[2].text == "Own words of document 2 alone.\n\nx" or got[2].n_dropped == 2
    assert got[4].n_dropped >= 1 and "Served" not in got[4].text
    assert lines.dedup_lines(none).collect() == []
