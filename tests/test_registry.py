"""Signatures and plans of companies: against every pattern tried on every text, and the refusals case by case."""

import random
import re

import pytest

from meshwork.operators import registry

TEXT = "doc_id long, text string"


def test_required_text():
    cases = {
        r"Planned Projects \$2M and above": "Planned Projects $2M and above", r"Project \d+ of \d+": "Project ", r"Ten[- ]Year Plan": "Year Plan", r"ab|cd": "", r"(?i)abc": "", r"(?:abc)?def": "def",
        r"x(?:abc)+y": "abc", r"a.b*cd": "cd", r"(?=lookahead)xy": "xy", r"(?i:abc)d": "d", r"\bword\b": "word", r"(one|two) three": " three", "": "", r"ab{0}c": "a", r"(Name) list": "Name list",
    }
    assert {p: registry.required_text(p) for p in cases} == cases


def test_every_match_holds_the_required_text():
    rng = random.Random(5)
    pieces = ["a", "b", "ab", "a?", "b*", "(ab)+", "(a|b)", "[ab]", ".", "(?:ba)?", "a{2}", r"\b"]
    for _ in range(3000):
        pattern = "".join(rng.choices(pieces, k=rng.randint(1, 5)))
        text = "".join(rng.choices("ab c", k=rng.randint(0, 12)))
        for m in re.finditer(pattern, text):
            assert registry.required_text(pattern) in m[0]


def test_claims_equal_all_patterns_tried(spark):
    rng = random.Random(6)
    words = ["plan", "Project", "page 12", "$2M", "list", "ABC", "x9", ""]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)] + [(300, None), (301, ""), (7, "plan list"), (302, "list " * 60_000 + "ABC")]
    pool = [r"plan", r"page \d+", r"\$2M", r"(?i)project", r"ABC|x9", r"x\d", r"list\s+plan", r"^plan", r".*", r"Project$"]
    signatures = [(f"s{i}", rng.sample(pool, rng.randint(1, 4))) for i in range(40)] + [("bare", []), (None, ["plan"])]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in texts], f"{TEXT}, signature string").repartition(5)
    got = registry.claims(docs, spark.createDataFrame(signatures, "signature string, patterns array<string>"))
    want = sorted((k, s) for k, t in texts if t is not None for s, ps in signatures if s and ps and all(re.search(p, t) for p in ps))
    assert sorted(map(tuple, got.collect())) == want and got.columns == ["doc_id", "signature"]
    alone = {(r.doc_id, r.signature): r.is_unique for r in registry.unique_claims(got).collect()}
    per = {k: len({s for j, s in want if j == k}) for k, _ in want}
    assert alone == {(k, s): per[k] == 1 for k, s in want}


def test_claims_of_nothing_and_wrong_patterns(spark):
    none = spark.createDataFrame([], "signature string, patterns array<string>")
    docs = spark.createDataFrame([(1, "plan")], TEXT)
    assert registry.claims(docs, none).count() == 0
    assert registry.claims(docs.limit(0), spark.createDataFrame([("a", ["plan"])], none.schema)).count() == 0
    for wrong in ("(", None):
        with pytest.raises(ValueError, match="unusable pattern"):
            registry.claims(docs, spark.createDataFrame([("a", [wrong])], none.schema))


def test_signature_problems(spark):
    texts = spark.createDataFrame(
        [(1, "a", "Alpha list, page 1 of 9"), (2, "b", "Beta list, page 2 of 9"), (3, None, "Beta list draft, page 3 of 9"), (4, "a", None), (5, "c", "Gamma, page 4 of 9")], "doc long, plan string, text string")
    registered = spark.createDataFrame([("ra", "a", ["Alpha list"]), ("rb", "b", ["Beta list", r"of \d"])], "signature string, plan string, patterns array<string>")
    proposed = spark.createDataFrame(
        [("sound", "b", 3, ["Beta list", "draft"]), ("wide", "b", 3, ["page"]), ("absent", "b", 3, ["Beta", "no such"]), ("bare", "b", 3, []), ("long", "b", 3, ["a"] * 7), ("taken", "c", 3, ["draft"]),
         ("lost", "b", 99, ["Beta"]), ("unread", "a", 4, ["Alpha"]), ("new", None, 5, ["Gamma"])], "signature string, plan string, doc long, patterns array<string>")
    got = sorted(map(tuple, registry.signature_problems(proposed, registered, texts).collect()))
    assert got == sorted([
        ("wide", "claims", "1"), ("wide", "claims", "5"), ("absent", "missing", "no such"), ("bare", "size", "0"), ("long", "size", "7"), ("taken", "claimed", "rb"),
        ("lost", "missing", "Beta"), ("unread", "missing", "Alpha"), ("new", "claims", "5"),
    ])


def test_plan_of_company(spark):
    plans = spark.createDataFrame(
        [("desc", 0, "DESC", "Dominion Energy", ["SCE&G"], None, "SC"), ("ga", 1, "Georgia ITS", None, None, ["Georgia Power", "Southern Company"], "GA"), ("two", 2, "desc", None, None, None, "SC")],
        "plan string, ord int, name string, owner string, aliases array<string>, members array<string>, state string")
    cases = {
        ("The DESC Company", "sc", None): ("desc", "plan"), ("S.C.E. & G", "SC", ""): (None, "new"), ("SCE and G, Inc.", "SC", "desc"): ("desc", "plan"), ("dominion energy llc", "GA", None): ("desc", "other state"),
        ("DESC", "SC", "ga"): ("desc", "contradicted"), ("Georgia Power Co", "GA", "ga"): ("ga", "member"), ("Elsewhere", "GA", "ga"): ("ga", "unsupported"), ("Elsewhere", "GA", "no such"): (None, "new"),
        (None, "GA", None): (None, "new"), ("Inc.", None, None): (None, "new"), ("DESC", None, None): ("desc", "other state"),
    }
    rows = [(i, c, None, "", ["", None], s, p) for i, (c, s, p) in enumerate(cases)]
    asked = spark.createDataFrame(rows, "id long, company string, owner string, short_name string, aliases array<string>, state string, existing_plan string")
    got = {r.id: (r.plan, r.status) for r in registry.plan_of_company(asked, plans).collect()}
    assert got == dict(enumerate(cases.values()))
    skipped = {r.id: (r.plan, r.status) for r in registry.plan_of_company(asked, plans, ["desc", "ga"]).collect()}
    assert skipped[0] == ("two", "plan") and skipped[5] == (None, "new") and skipped[6] == (None, "new")
    assert registry.plan_of_company(asked.limit(0), plans).count() == 0 and registry.plan_of_company(asked, plans.limit(0)).filter("status <> 'new'").count() == 0
