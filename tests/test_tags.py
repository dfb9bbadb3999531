import random
import re

from noteloom.operators import tags as K


def test_worked_numbers(spark):
    tags = {1: "a b", 2: "a b", 3: "a c", 4: "b", 5: "b", 6: "c", 7: "d"}
    notes = spark.createDataFrame([(i, t.split()) for i, t in tags.items()], "id long, tags array<string>")
    rows = K.neighbours(K.note_tags(notes), "a").collect()
    assert [(r.tag, r.cooccur, r.lift, r.score) for r in rows] == [("b", 2, 1.17, 1.85)]


def test_alias_candidates_and_variants(spark):
    t = spark.createDataFrame([(i, x) for i, x in enumerate(["note", "notes", "api", "api-v2", "api-v2-beta", "gas", "s", ""])], "id long, tag string")
    got = {(r.shorter, r.longer) for r in K.alias_candidates(t).collect()}
    assert got == {("note", "notes"), ("api", "api-v2"), ("api", "api-v2-beta"), ("api-v2", "api-v2-beta"), ("", "s")}
    raw = spark.createDataFrame([("API",), ("api",), ("x",)], "tag string")
    assert [(r.tag, r.forms) for r in K.case_variants(raw).collect()] == [("api", ["API", "api"])]


def test_mentions_need_boundaries(spark):
    notes = spark.createDataFrame([(1, "The auth-service", "x"), (2, "t", "auth-services"), (3, "t", "pre_auth-service"), (4, "t", "(AUTH-SERVICE)")], "id long, title string, content string")
    e = spark.createDataFrame([("e", "auth-service"), ("n", "12345"), ("s", "ab")], "entity string, name string")
    assert sorted(r.id for r in K.mentions(notes, e).collect()) == [1, 4]


def test_mentions_of_long_names(spark):
    notes = spark.createDataFrame([(1, "The Bank of the United Kingdom", "x"), (2, "t", "the bank of the united nations"), (3, "t", "(the bank of the united kingdom-wide"), (4, "Bank of the", "united kingdom")], "id long, title string, content string")
    e = spark.createDataFrame([("k", "bank of the united kingdom"), ("n", "The bank of the united nations"), ("s", "bank")], "entity string, name string")
    assert sorted((r.id, r.entity) for r in K.mentions(notes, e).collect()) == [(1, "k"), (1, "s"), (2, "n"), (2, "s"), (3, "s"), (4, "s")]


def test_mentions_by_automaton_and_by_joins(spark):
    """Names of any script, many names for one automaton's bound, and overlapping names, against a plain search."""
    rng = random.Random(8)
    names = ["知識庫", "知識", "café", "été noir", "a-b", "x y", "x  y", "c++", "graph", "graph db", "db", "the graph db", "ñandú", "日本語 note", "...", "12345", "ab", "e\u0301t", "graph.db"]
    joints = [" ", "  ", "-", ".", ",", "", "_", "(", "\n", "x"]
    notes = [(i, rng.choice(names), "".join(rng.choice(names) + rng.choice(joints) for _ in range(rng.randrange(0, 8)))) for i in range(200)] + [(200, None, None)]
    n = spark.createDataFrame(notes, "id long, title string, content string").repartition(2)
    e = spark.createDataFrame([(f"e{k}", x) for k, x in enumerate(names)] + [("twin", "Graph DB")], "entity string, name string")
    sought = [(f"e{k}", x.lower()) for k, x in enumerate(names) if len(x) >= 3 and not x.isdigit()] + [("twin", "graph db")]
    inside = "[a-z0-9_-]"
    want = sorted((i, k) for i, t, c in notes for k, x in sought if re.search(f"(?<!{inside}){re.escape(x)}(?!{inside})", "\n".join(y for y in (t, c) if y is not None).lower()))
    for most in (200_000, 3, 1):
        assert sorted(map(tuple, K.mentions(n, e, most=most).collect())) == want
    assert K.mentions(n, e.limit(0)).count() == 0 and K.mentions(n.limit(0), e).count() == 0
