import time

from noteloom.functions import predicates as P
from noteloom.operators import graph as G
from pyspark.sql import functions as F


def test_entity_ids_fold_separators_only(spark):
    names = ["Billing API Gateway", "billing-api-gateway", "billing_api_gateway", "billing.api.gateway", "billing/api/gateway", " billing  api gateway ", "BILLING-API_GATEWAY", "billing's api gateway".replace("'s", ""), "billing - api - gateway"]
    rows = spark.createDataFrame([(n,) for n in [*names, "c", "c#", "..", "..."]], "n string")
    got = {r.n: r.id for r in rows.select("n", G.entity_id(F.col("n")).alias("id")).collect()}
    assert {got[n] for n in names} == {"billing_api_gateway"}
    assert len({got["c"], got["c#"], got[".."], got["..."]}) == 4


def test_predicates_fold(spark):
    cases = {"deploys_to": "deployed_to", "is source of truth for": "source_of_truth_for", "Merged-Into": "merged_to", "kind of": "is", "missed": "missed", "missing": "lacks", "states": "states", "depends on": "depends_on", "Owner’s": "owner"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.c for r in rows.select("p", P.canonical_column(F.col("p")).alias("c")).collect()}
    assert got == cases | {"Owner’s": got["Owner’s"]}
    assert "owned_by" not in P.vocabulary() and "owns" in P.vocabulary() and len(P.vocabulary()) == 58
    assert P.Rules.unchained({"a": "b", "b": "c"}) == {"b": "c"}
    assert {"ship", "ships", "shipped"} <= P.family("shipped") and "fixed" in P.family("fixes") and P.family("status") == {"status"} | (P.family("status") - {"statu"})


def test_rule_table_takes_overrides(spark):
    rules = P.Rules(aliases={"needs": "uses", "wants": "craves", "craves": "uses"}, vocabulary=["mirrors"], inverses={"mirrored_by": "mirrors"})
    f = spark.createDataFrame([(1, "a", "needs", "b"), (2, "a", "wants", "b"), (3, "a", "craves", "b"), (4, "a", "mirrored by", "b"), (5, "a", "mirror", "b")], "id int, subject string, predicate string, object string")
    got = {r.id: (r.subject, r.predicate) for r in G.canonical_triples(f, rules).collect()}
    assert got == {1: ("a", "uses"), 2: ("a", "wants"), 3: ("a", "uses"), 4: ("b", "mirrors"), 5: ("a", "mirrors")}
    assert "mirrors" in rules.vocabulary and "mirrored_by" not in rules.vocabulary


def test_folding_is_idempotent(spark):
    rows = [(i, "tkt-1", p, "svc") for i, p in enumerate([*P.ALIASES, *P.INVERSES, *P.VOCABULARY])]
    once = G.canonical_triples(spark.createDataFrame(rows, "id int, subject string, predicate string, object string"))
    twice = G.canonical_triples(once.select("id", "subject", "predicate", "object"))
    assert sorted(once.collect()) == sorted(twice.select(once.columns).collect())


def facts(spark, rows):
    return spark.createDataFrame(rows, "arrival long, subject string, predicate string, object string, valid_from string")


def run(spark, held, batch):
    h = spark.createDataFrame(held, "subject string, predicate string, object string, valid_from string")
    return sorted((r.arrival, r.status, r.object, r.reason) for r in G.consolidate(h, facts(spark, batch)).collect())


def test_consolidation(spark):
    held = [("tkt_42", "status", "open", "2024-01-01"), ("repo_a", "uses", "spark", "2024-01-01")]
    assert run(spark, held, [(1, "TKT-42", "status", "done", "2024-02-01")]) == [(1, "added", "done", None), (1, "invalidated", "open", "single_valued_predicate_took_new_object")]
    got = run(spark, held, [(1, "tkt_42", "Status", "done", "2024-02-01"), (2, "repo_a", "uses", "duckdb", "2024-02-01"), (3, "repo_a", "uses", "Spark", "2024-02-01"), (4, "x", "zigzags", "y", "2024-02-01"), (5, None, "uses", "y", "2024-02-01")])
    assert got == [(1, "added", "done", None), (1, "invalidated", "open", "single_valued_predicate_took_new_object"), (2, "added", "duckdb", None), (3, "skipped", "Spark", "duplicate"), (4, "skipped", "y", "not_in_vocabulary"), (5, "skipped", "y", "incomplete_triple")]
    assert run(spark, held, [(1, "tkt_42", "status", "done", "2023-02-01")]) == [(1, "skipped", "done", "stale_observation")]
    both = run(spark, held[1:], [(1, "tkt_42", "status", "done", "2024-02-01"), (2, "tkt_42", "status", "open", "2024-02-01")])
    assert [r[1] for r in both] == ["added", "added"]  # one batch cannot order them, so nothing retires


def test_direction_folding_merges_twins(spark):
    rows = [(1, "b", "owns", "a", "2024-03-01", None), (2, "a", "owned_by", "b", "2024-01-01", None), (3, "c", "owned_by", "d", None, None), (4, "c", "owned_by", "e", "2024-01-01", "2024-02-01")]
    got = {r.id: (r.action, r.subject, r.predicate, r.object, r.valid_from) for r in G.fold_directions(spark.createDataFrame(rows, "id long, subject string, predicate string, object string, valid_from string, valid_to string")).collect()}
    assert got == {1: ("keep", "b", "owns", "a", "2024-01-01"), 2: ("merge", "b", "owns", "a", "2024-01-01"), 3: ("fold", "d", "owns", "c", None), 4: ("fold", "e", "owns", "c", "2024-01-01")}


def test_same_reference_and_lists(spark):
    rows = spark.createDataFrame([("web-app PR #3865", "pr #3865", True), ("web-app PR #539", "billing-api PR #539", False), ("A ", "a", True), ("x", "y", False)], "a string, b string, want boolean")
    assert rows.select((G.same_entity(F.col("a"), F.col("b")) == F.col("want")).alias("ok")).filter("NOT ok").count() == 0
    f = spark.createDataFrame([(1, "s", "p", "pr #3835, pr #3849, and pr #3851"), (2, "s", "p", "recharge_to, minus current balance")], "id int, subject string, predicate string, object string")
    assert sorted(r.object for r in G.split_objects(f).collect()) == ["pr #3835", "pr #3849", "pr #3851", "recharge_to, minus current balance"]


def test_nearest_predicates(spark):
    got = G.nearest_predicates(spark.createDataFrame([("deploy_onto",), ("owns",)], "predicate string")).collect()
    best = {r.predicate: r.name for r in got if r.place == 1}
    assert best == {"deploy_onto": "deployed_to", "owns": "owns"} and len(got) == 6


def test_spellings_meet_once_each(spark):
    """Objects of many-valued predicates, in order of arrival, whatever refers to the same thing."""
    held = [("repo_a", "uses", "web-app PR #5", "2024-01-01")]
    got = run(spark, held, [(1, "repo_a", "uses", "pr #5", "2024-02-01"), (2, "repo_a", "uses", "billing PR #6", "2024-02-01"), (3, "repo_a", "uses", "PR #6", "2024-02-01"), (4, "repo_a", "uses", "x", "2024-02-01"), (5, "repo_a", "uses", "X", "2024-02-01"), (6, "repo_a", "uses", "web-app pr #5", "2024-02-01"), (6, "repo_a", "uses", "web-app pr #5", "2024-02-01")])
    assert [r[1:] for r in got] == [("skipped", "pr #5", "equivalent_spelling_of_existing"), ("added", "billing PR #6", None), ("skipped", "PR #6", "equivalent_spelling_of_existing"), ("added", "x", None), ("skipped", "X", "duplicate"), ("skipped", "web-app pr #5", "duplicate"), ("skipped", "web-app pr #5", "duplicate")]


def test_single_inserts_are_whole_or_nothing(spark):
    held = spark.createDataFrame([(1, "tkt_1", "status", "open", "2024-01-01"), (2, "tkt_1", "status", "held", "2024-06-01"), (3, "tkt_2", "status", "open", "2024-01-01"), (4, "repo_a", "uses", "x", "2024-09-01")], "id long, subject string, predicate string, object string, valid_from string")
    asked = spark.createDataFrame([(1, "TKT-1", "status", "done", "2024-03-01"), (2, "tkt-2", "Status", "done", "2024-03-01"), (3, "repo_a", "uses", "y", "2024-01-01"), (4, "tkt-3", "status", "done", "2024-01-01"), (5, "tkt_2", "status", "OPEN", "2024-03-01")], "request long, subject string, predicate string, object string, valid_from string")
    judged, retired = G.single_inserts(held, asked)
    assert {r.request: (r.outcome, r.retires) for r in judged.collect()} == {1: ("refused", 0), 2: ("added", 1), 3: ("added", 0), 4: ("added", 0), 5: ("exists", 0)}
    assert [(r.id, r.request, r.valid_to) for r in retired.collect()] == [(3, 2, "2024-03-01")]


def test_overrides_of_the_rule_table(spark):
    """Names taken off the single-valued ones, mirrored spellings that touch them, and a table of one's own in consolidation."""
    rules = P.Rules(single_valued=["Phase"], many_valued=["version"], inverses={"phase_of": "phase", "assigned": "owns", "status": "supports", "hosted_by": "hosts"}, vocabulary=["hosts"])
    assert "phase" in rules.single_valued and "version" not in rules.single_valued
    assert rules.refused == ["phase_of", "status"] and "hosted_by" in rules.inverses
    assert "phase" in rules.vocabulary and "hosts" in rules.vocabulary and "hosted_by" not in rules.vocabulary
    held = spark.createDataFrame([("tkt_1", "version", "v1", "2024-01-01"), ("tkt_1", "phase", "alpha", "2024-01-01")], "subject string, predicate string, object string, valid_from string")
    batch = [(1, "tkt_1", "version", "v2", "2024-02-01"), (2, "tkt_1", "phase", "beta", "2024-02-01"), (3, "a", "hosted_by", "b", "2024-02-01")]
    own = sorted((r.arrival, r.status, r.subject, r.object) for r in G.consolidate(held, facts(spark, batch), rules).collect())
    assert own == [(1, "added", "tkt_1", "v2"), (2, "added", "tkt_1", "beta"), (2, "invalidated", "tkt_1", "alpha"), (3, "added", "b", "a")]
    built_in = sorted((r.arrival, r.status, r.object) for r in G.consolidate(held, facts(spark, batch)).collect())
    assert built_in == [(1, "added", "v2"), (1, "invalidated", "v1"), (2, "skipped", "beta"), (3, "skipped", "b")]


def test_merges_follow_chains_and_rings(spark):
    m = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(700)] + [("a", "b"), ("b", "c"), ("c", "a"), ("t", "b"), ("x", "y"), ("x", "z"), ("s", "s"), (None, "q")]
    got = {r.source: r.target for r in G.resolved_mapping(spark.createDataFrame(m, "source string, target string")).collect()}
    want = {f"n{i:04d}": "n0700" for i in range(700)} | {"b": "a", "c": "a", "t": "a", "x": "y"}
    assert got == want
    f = spark.createDataFrame([(1, "a1", "uses", "b1", "2024-01-01", None), (2, "a3", "uses", "b1", "2024-02-01", None)], "id long, subject string, predicate string, object string, valid_from string, valid_to string")
    aliases = spark.createDataFrame([("old", "a1")], "alias string, target string")
    mapping = spark.createDataFrame([("a1", "a2"), ("a2", "a3"), ("b1", "b2")], "source string, target string")
    out, names = G.merged(f, aliases, mapping)
    assert [tuple(r)[:4] for r in out.collect()] == [(1, "a3", "uses", "b2")]
    assert sorted(map(tuple, names.collect())) == [("a1", "a3"), ("a2", "a3"), ("b1", "b2"), ("old", "a3")]


def test_many_arrivals_of_one_contested_pair(spark):
    """A contested pair retires nothing and keeps growing; each arrival looks at its kin only."""
    n = 100_000
    rows = [(i, "tkt_1", "status", f"value {i % 60_000}", f"2024-01-{i % 28 + 1:02d}") for i in range(n)]
    began = time.time()
    got = G.consolidate(spark.createDataFrame([], "subject string, predicate string, object string, valid_from string"), facts(spark, rows))
    counts = {(r.status, r.reason): r["count"] for r in got.groupBy("status", "reason").count().collect()}
    assert time.time() - began < 60
    live, want, latest = {}, {}, []
    for i, _, _, o, day in rows:  # the same rule by hand: stale if another value starts later
        later = any(d > day for d, x in latest[-2:] if x != o)
        what = ("skipped", "stale_observation") if later else ("skipped", "duplicate") if o in live else ("added", None)
        want[what] = want.get(what, 0) + 1
        if what == ("added", None):
            live[o] = day
            latest = sorted([*latest, (day, o)])[-2:]
    assert counts == want


def test_references_in_a_single_valued_pair(spark):
    """Spellings of one reference are kin; others are retired, and what is retired comes in the order it was held."""
    held = [("tkt_1", "status", "web-app PR #5", "2024-01-01"), ("tkt_1", "status", "open", "2024-01-02"), ("tkt_1", "status", "api PR #5", None)]
    got = G.consolidate(spark.createDataFrame(held, "subject string, predicate string, object string, valid_from string"), facts(spark, [(1, "tkt_1", "status", "PR #5", "2024-03-01")])).collect()
    assert sorted((r.status, r.object, r.reason) for r in got) == [("invalidated", "open", "single_valued_predicate_took_new_object"), ("skipped", "PR #5", "equivalent_spelling_of_existing")]


def test_folding_joins_the_rule_table(spark):
    """The table that is joined says what the column says, also with overrides and for spellings that it does not list."""
    spelled = ["Status", "deploys-to", "is source_of", "owned by", "requires", "blocks", "it's odd", "", None, "Fixed_in", "written_by"]
    for rules in (None, P.Rules(aliases={"requires": "uses"}, inverses={"status": "supports"})):
        rows = spark.createDataFrame([(p,) for p in spelled], "predicate string")
        got = P.fold(rows, rules=rules).select("predicate", "_folded", "_inverse", P.canonical_column(F.col("predicate"), rules).alias("want")).collect()
        inverses = (rules or P.built_in()).inverses
        assert len(got) == len(spelled) and all(r["_folded"] == r.want and r["_inverse"] == inverses.get(r.want) for r in got)
