import datetime as dt

import pandas as pd
from noteloom.operators import bus as B
from noteloom.operators import reports as R
from noteloom.sources import views as V
from noteloom.streaming import streams as S
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def stream_of(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_tool_days_match_the_batch(spark, tmp_path):
    calls = V.tool_calls(spark, SF)
    got = S.drain(S.tool_days(stream_of(spark, calls, tmp_path / "in")), str(tmp_path / "c"), table="days").collect()
    want = {(r.day, r.tool): (r.calls, r.total_ms) for r in R.tool_partials(calls).collect()}
    last = calls.agg(F.max("created_at")).first()[0].date()
    assert {(r.day, r.tool): (r.calls, r.total_ms) for r in got} == {k: v for k, v in want.items() if k[0] < last}


def test_follow_through_stream(spark, tmp_path):
    rows = V.retrievals(spark, SF)
    pushes, reads = rows.filter("surface = 'hint'"), rows.filter("surface = 'kb_read'")
    out = S.follow_through(stream_of(spark, pushes, tmp_path / "p"), stream_of(spark, reads, tmp_path / "r"), "30 days")
    got = {(r.push_id, r.read_id) for r in S.drain(out, str(tmp_path / "c"), table="follow").collect() if r.read_id is not None}
    r = reads.select(F.col("id").alias("rid"), F.col("session").alias("s"), F.col("doc_id").alias("d"), F.col("created_at").alias("t"))
    want = pushes.join(r, (F.col("session") == F.col("s")) & (F.col("doc_id") == F.col("d")) & (F.col("t") >= F.col("created_at")) & (F.col("t") <= F.col("created_at") + F.expr("INTERVAL 30 DAYS")))
    assert got == {(x.id, x.rid) for x in want.collect()}


def test_deliveries_once(spark, tmp_path):
    m = V.messages(spark, SF).select(F.col("id").alias("message_id"), F.col("channel").alias("session"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"))
    got = S.drain(S.delivered_once(stream_of(spark, m.unionByName(m), tmp_path / "in")), str(tmp_path / "c"), table="once")
    assert got.count() == m.distinct().count()


def cuts(spark, rows, schema, path, parts):
    """Rows as a stream of files, one a batch, and a last one that ends the stream."""
    import os
    import time

    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts > 1 else rows, schema).coalesce(1).write.parquet(f"{path}/{k}")
    end = spark.createDataFrame([tuple(dt.datetime(2100, 1, 1) if f.split()[0] == "at" else None for f in schema.split(", "))], schema)
    end.coalesce(1).write.parquet(f"{path}/{parts}")
    for k in range(parts + 1):
        for name in os.listdir(f"{path}/{k}"):
            os.utime(f"{path}/{k}/{name}", (time.time() - 1000 + k, time.time() - 1000 + k))
    return spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_session_warnings_do_not_depend_on_batches(spark, tmp_path):
    """The first two notes of a session in order of time, however the input is cut; forgotten after seven days."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", 1, at(5)), ("a", 2, at(1)), ("a", 3, at(3)), ("a", 2, at(7)), ("b", 3, at(2)), ("b", 3, at(4)), ("a", 9, at(7 + 60 * 24 * 8)), (None, 4, at(0))]
    want = [("a", 1, False), ("a", 2, False), ("a", 2, True), ("a", 3, True), ("a", 9, True), ("b", 3, False), ("b", 3, True)]
    for parts in (1, 3, 8):
        stream = cuts(spark, rows, "session string, doc_id long, at timestamp", tmp_path / f"in{parts}", parts)
        got = S.drain(S.warnings(stream, late="20 days"), str(tmp_path / f"c{parts}"), table=f"warned{parts}")
        assert sorted(map(tuple, got.collect())) == want


def test_presence_does_not_depend_on_batches(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", at(0)), ("a", at(900)), ("a", at(200)), ("a", at(500)), ("b", at(10)), ("a", at(1200)), ("b", at(311))]
    want = [("a", 0, True), ("a", 800, False), ("a", 900, True), ("a", 1500, False), ("b", 10, True), ("b", 310, False), ("b", 311, True), ("b", 611, False)]
    for parts in (1, 2, 7):
        stream = cuts(spark, rows, "session string, at timestamp", tmp_path / f"in{parts}", parts)
        got = S.drain(S.present(stream, late="1 day"), str(tmp_path / f"c{parts}"), table=f"live{parts}")
        assert sorted((r.session, r.at, r.live) for r in got.select("session", (F.unix_seconds("at") - 1704067200).alias("at"), "live").collect()) == want


def test_logs_stay_bounded_and_replays_see_the_same(spark, tmp_path):
    """Sixty batches leave two snapshots and the batches since; a batch repeated at a snapshot's edge changes nothing."""
    path = str(tmp_path / "cur")
    log = S.cursor_log(path, every=5)
    rows = lambda n: spark.createDataFrame([(f"r{n % 7}", "c", n), ("slow", "c", n // 30)], "reader string, channel string, last_seen long").coalesce(1)
    sink = S.cursor_sink(path, every=5)
    for n in range(60):
        sink(rows(n), n)
        if n % 5 == 4:
            before = sorted(map(tuple, log.rows(spark, n).collect()))
            sink(rows(n), n)
            assert sorted(map(tuple, log.rows(spark, n).collect())) == before
    names = S.listed(spark, path)
    assert sum(x.startswith("snapshot") for x in names) == 2 and len(names) <= 2 + 2 * 5
    want = {f"r{k}": max(n for n in range(60) if n % 7 == k) for k in range(7)} | {"slow": 1}
    assert {r.reader: r.last_seen for r in S.cursors(spark, path).collect()} == want


def test_held_facts_over_snapshots(spark, tmp_path):
    """Facts retired before a snapshot stay retired; the graph equals one that was never compacted."""
    rows = lambda n: spark.createDataFrame([(n, f"tkt_{n % 3}", "status", f"s{n}", f"2024-02-{n + 1:02d}")], "arrival long, subject string, predicate string, object string, valid_from string")
    out = {}
    for every in (2, 1000):
        late = S.late_facts(str(tmp_path / f"held{every}"), str(tmp_path / f"late{every}"), parts=4, every=every)
        for n in [0, 1, 2, 3, 3, 4, 5, 6, 7, 7]:
            late(rows(n), n)
        out[every] = sorted(map(tuple, S.held_facts(spark, str(tmp_path / f"held{every}")).collect()))
    assert out[2] == out[1000] and [x[2] for x in out[2]] == ["s6", "s7", "s5"]


def test_cursors_and_late_facts(spark, tmp_path):
    merge = S.cursor_sink(str(tmp_path / "cur"))
    rows = lambda *x: spark.createDataFrame(list(x), "reader string, channel string, last_seen long")
    merge(rows(("a", "c", 5), ("a", "c", 3)), 0)
    merge(rows(("a", "c", 4), ("a", "c", None), ("b", "c", 1)), 1)
    merge(rows(("a", "c", 4), ("a", "c", None), ("b", "c", 1)), 1)
    assert sorted(tuple(r) for r in S.cursors(spark, str(tmp_path / "cur")).collect()) == [("a", "c", 5), ("b", "c", 1)]
    late = S.late_facts(str(tmp_path / "held"), str(tmp_path / "late"))
    batch = lambda n, o, d: spark.createDataFrame([(n, "tkt_1", "status", o, d)], "arrival long, subject string, predicate string, object string, valid_from string")
    late(batch(1, "open", "2024-02-01"), 0)
    late(batch(2, "done", "2024-01-01"), 1)
    late(batch(3, "closed", "2024-03-01"), 2)
    assert spark.read.parquet(str(tmp_path / "late/1")).count() == 1
    assert [r.object for r in S.held_facts(spark, str(tmp_path / "held")).collect()] == ["closed"]
    late(batch(4, "open", "2024-04-01"), 3)
    late(batch(4, "open", "2024-04-01"), 3)
    assert [(r.object, r.valid_from) for r in S.held_facts(spark, str(tmp_path / "held")).collect()] == [("open", "2024-04-01")]


def test_bus_predicates(spark):
    m = spark.createDataFrame([("a", None, True), ("me", None, False), ("a", "me", True), ("a", "b", False), ("a", "", True)], "sender string, recipient string, want boolean")
    assert m.filter(B.targets(F.col("sender"), F.col("recipient"), F.lit("me")) != F.col("want")).count() == 0
    assert [r.p for r in spark.createDataFrame([(" a\n\tb\u0007 c ",)], "b string").select(B.preview(F.col("b")).alias("p")).collect()] == ["a b c"]


def test_due_messages_meet_by_bucket_and_addressee(spark):
    """Deliveries equal the plain rule, on a busy channel with small buckets, and no join is a product."""
    m = spark.createDataFrame([(i, "hot" if i % 10 else "c", f"u{i % 5}", [None, "", "u1", "u3", "x"][i % 7 % 5], "b") for i in range(2000)], "id long, channel string, sender string, recipient string, body string")
    s = spark.createDataFrame([(f"u{k}", c, None if k == 0 else 300 * k) for k in range(7) for c in ("hot", "c", "empty")], "session string, channel string, last_seen long")
    done = spark.createDataFrame([(11, "u0"), (12, "u2")], "message_id long, session string")
    j = s.join(m, "channel").filter((F.col("id") > F.coalesce("last_seen", F.lit(-1))) & B.targets(F.col("sender"), F.col("recipient"), F.col("session")))
    want = sorted({(r.id, r.session) for r in j.collect()} - {(11, "u0"), (12, "u2")})
    assert sorted(map(tuple, B.deliveries(m, s, done).collect())) == want
    readers = s.select(F.col("session").alias("reader"), "channel", F.col("last_seen").alias("cursor"))
    assert sorted((r.id, r.reader) for r in B.due(m, readers, bucket=16).collect()) == sorted((r.id, r.session) for r in j.collect())
    plan = B.due(m, readers)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


class Handle:
    """Counts the timers that a processor sets."""

    def __init__(self):
        self.timers, self.held = [], []

    def getListState(self, *_):
        return self

    def appendList(self, rows):
        self.held += rows

    def put(self, rows):
        self.held = list(rows)

    def get(self):
        return iter(self.held)

    def clear(self):
        self.held = []

    def registerTimer(self, at):
        self.timers.append(at)


def test_one_timer_stands_for_all_held_rows():
    class Times(S.InOrder):
        def passed(self, key, rows, now):
            yield [at for at, in rows]

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    made, handle = Times(), Handle()
    made.init(handle)
    list(made.handleInputRows(("a",), iter([pd.DataFrame({"at": [50, 20, 90, 70]})]), None))
    assert handle.timers == [20]
    assert list(made.handleExpiredTimer(("a",), Now(60), Now(20))) == [[20, 50]] and handle.timers == [20, 70]
    assert list(made.handleExpiredTimer(("a",), Now(100), Now(70))) == [[70, 90]] and handle.timers == [20, 70] and not handle.held
