import datetime as dt

from noteloom.operators import lifecycle as L
from noteloom.operators import notes as N
from noteloom.operators import reports as R
from pyspark.sql import functions as F

SCHEMA = "id long, doc_id long, surface string, query string, session string, created_at timestamp_ntz, event_id string, is_test boolean"
T0 = dt.datetime(2024, 1, 1, 10)


def rows(spark, *items):
    return spark.createDataFrame([(i, d, s, "q", sess, T0 + dt.timedelta(minutes=m), e, False) for i, (d, s, sess, m, e) in enumerate(items)], SCHEMA)


def test_coverage(spark):
    notes = spark.createDataFrame([(1, None), (2, None), (3, T0)], "id long, superseded_at timestamp_ntz")
    r = R.coverage(notes, rows(spark, (1, "hint", "s", 0, "a"))).first()
    assert (r.total, r.retrieved, r.coverage) == (2, 1, 0.5)


def test_push_then_read_promotes(spark):
    log = rows(spark, (1, "hint", "s", 0, "a"), (2, "hint", None, 0, "b"), (3, "hint", "s", 0, "c"), (1, "kb_read", "s", 5, "d"), (2, "kb_read", None, 5, "e"), (3, "kb_read", "s", 45, "f"))
    marked = R.followed(R.events(log), log)
    by = {r.event: r for r in marked.collect()}
    assert by["a"].in_window and not by["c"].in_window and by["c"].ever and not by["b"].ever
    notes = spark.createDataFrame([(1, "inferred", None), (3, "inferred", None)], "id long, tier string, superseded_at timestamp_ntz")
    none = spark.createDataFrame([], "doc_id long")
    got = L.promotions(marked.filter("surface = 'hint'"), notes, none).collect()
    assert [(r.doc_id, r.event, r.tier) for r in got] == [(1, "a", "observed")]


def test_the_first_read_is_one_read_in_time(spark):
    """The read with the smallest id comes long after; its time and id stay together, and the window holds."""
    log = rows(spark, (1, "kb_read", "s", 300, "x"), (1, "hint", "s", 0, "a"), (1, "kb_read", "s", 5, "y"), (1, "kb_read", "s", 5, "z"), (2, "hint", "s", 0, "late"), (2, "kb_read", "s", 31, "w"), (3, "hint", "s", 7, "same"), (3, "kb_read", "s", 7, "v"), (4, "kb_read", "s", 1, "u"), (4, "hint", "s", 2, "before"))
    by = {r.event: r for r in R.followed(R.events(log), log).collect()}
    assert (by["a"].first_read, by["a"].first_read_at) == (2, T0 + dt.timedelta(minutes=5))
    assert (by["late"].in_window, by["late"].ever, by["late"].first_read) == (False, True, None)
    assert by["same"].first_read == 7 and not by["before"].ever


def test_old_rows_form_events(spark):
    log = rows(spark, (1, "hint", "s", 0, None), (2, "hint", "s", 0, None), (3, "hint", "s", 1, None))
    assert sorted(r.docs for r in R.events(log).collect()) == [[1, 2], [3]]


def test_prune_folds_before_it_deletes(spark):
    calls = spark.createDataFrame([("a", True, 5, 10, T0 - dt.timedelta(days=30)), ("a", False, 7, 100, T0 - dt.timedelta(days=1))], "tool string, ok boolean, duration_ms long, result_chars long, created_at timestamp_ntz")
    cutoff = F.lit((T0 - dt.timedelta(days=10)).isoformat(sep=" ")).cast("timestamp_ntz")
    kept, rolled = R.prune(calls, R.tool_partials(calls.limit(0)), cutoff)
    assert kept.count() == 1 and rolled.count() == 1
    before = R.tool_demand(R.tool_partials(calls)).collect()
    after = R.tool_demand(R.tool_partials(kept).unionByName(rolled)).collect()
    assert before == after


def test_percentiles_by_nearest_rank(spark):
    rows_ = spark.createDataFrame([("x", i) for i in [5, 1, 4, 2, 3]] + [("y", 7)], "k string, v long")
    got = {r.k: (r.n, r.p50, r.p90) for r in R.percentiles(rows_, "k", "v").collect()}
    assert got == {"x": (5, 3, 5), "y": (1, 7, 7)}


def test_bootstrap_holds_the_rate(spark):
    fires = spark.createDataFrame([(f"s{i // 4}", i % 3 == 0) for i in range(1200)], "session string, followed boolean")
    r = R.bootstrap(fires, 400).first()
    assert 0.28 < r.low < 1 / 3 < r.high < 0.39 and r.draws == 400
    assert R.bootstrap(fires.repartition(5), 400).first() == r


def test_front_matter(spark):
    files = spark.createDataFrame([("projects/archive/x.md", "---\ntitle: \"A: b\"\ntags: [x, Y, x]\nstatus: done\n---\n# Head\ntext"), ("decisions/y.md", "# Head two\nbody"), ("Z.MD", "no head")], "path string, content string")
    got = {r.path: (r.title, r.doc_type, r.tags, r.status) for r in N.front_matter(files).collect()}
    assert got == {"projects/archive/x.md": ("A: b", "archive", ["x", "y"], "done"), "decisions/y.md": ("Head two", "decision", [], "active"), "Z.MD": ("Z", "note", [], "active")}


def test_whole_tags(spark):
    notes = spark.createDataFrame([(1, ["oauth"]), (2, ["auth", "x"]), (3, ["authn"])], "id long, tags array<string>")
    aliases = spark.createDataFrame([("authn", "auth")], "alias string, tag string")
    assert sorted(r.id for r in N.with_tags(notes, ["Auth"], aliases).collect()) == [2, 3]


def test_events_count_for_nothing_by_one_reason(spark):
    """No session, then tests, then hints for messages between agents; the same query on another surface counts."""
    message = '<agent-message from="x">hi</agent-message>'
    items = [("e1", "s1", "hint", message, False), ("e2", "s1", "hint", "<task-notification>done</task-notification>", False), ("e3", "s1", "kb_search", message, False), ("e4", None, "hint", message, False), ("e5", "s1", "hint", message, True), ("e6", "s1", "hint", "what is x", False), ("e7", "s1", "hint", " <agent-message>", False), ("e8", "s1", "hint", None, False)]
    log = spark.createDataFrame([(i, 1, surface, q, sess, T0 + dt.timedelta(minutes=i), e, t) for i, (e, sess, surface, q, t) in enumerate(items)] + [(50, 2, "hint", "later words", "s1", T0 + dt.timedelta(minutes=50), "e1", False)], SCHEMA)
    got = {r.event: r["class"] for r in R.events(log).collect()}
    assert got == {"e1": "envelope", "e2": "envelope", "e3": None, "e4": "unattributable", "e5": "test", "e6": None, "e7": None, "e8": None}
    stats = {r.surface: (r.events, r.unattributable, r.test, r.envelope, r.fires) for r in R.surface_stats(R.followed(R.events(log), log)).collect()}
    assert stats == {"hint": (7, 1, 1, 2, 3), "kb_search": (1, 0, 0, 0, 1)}
