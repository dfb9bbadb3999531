"""The message log and the meters as streams. Event times are TIMESTAMP; `ntz` columns are cast before watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from noteloom.functions.tables import delete, discard, exists, listed, materialize, new_path
from noteloom.operators import bus as B


def read(spark: SparkSession, sf_dir: str, name: str, schema=None) -> DataFrame:
    """A table's files as a stream."""
    schema = schema or spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def timed(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def tool_days(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Daily tool sums over a tumbling window."""
    w = timed(calls, "created_at").withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"), "tool")
    return w.agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms")).select(F.to_date("w.start").alias("day"), "tool", "calls", "failed", "total_ms", "max_ms")


def follow_through(pushes: DataFrame, reads: DataFrame, window: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each push with the reads of its note in its session within the window (B10); pushes without one come when the watermark has passed."""
    p = timed(pushes, "created_at").select(F.col("id").alias("push_id"), "session", "doc_id", F.col("created_at").alias("pushed")).withWatermark("pushed", late)
    r = timed(reads, "created_at").select(F.col("id").alias("read_id"), F.col("session").alias("s"), F.col("doc_id").alias("d"), F.col("created_at").alias("read")).withWatermark("read", late)
    return p.join(r, F.expr(f"session = s AND doc_id = d AND read >= pushed AND read <= pushed + INTERVAL {window}"), "left_outer").select("push_id", "read_id")


def delivered_once(due: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (message, session) at most once (B7). Columns: message_id, session, at."""
    return timed(due, "at").withWatermark("at", late).dropDuplicatesWithinWatermark(["message_id", "session"])


class ChangeLog:
    """A state that batches of a stream change: each batch's changes under its number, and a snapshot of all of them every
    `every` batches. What the snapshot before the last one covers is deleted, so files are bounded however many batches come.

    A batch that runs again writes the same files anew. Reading `before` a number uses a snapshot that is older than it, and
    the last but one snapshot stays, so a batch that is repeated across a snapshot sees what it saw at first."""

    def __init__(self, path: str, schema: str, fold: Callable[[DataFrame], DataFrame], every: int = 16, part: str | None = None):
        self.path, self.schema, self.fold, self.every, self.part = path, schema, fold, every, part

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        found = [x for x in listed(spark, self.path) if x.startswith(kind)]
        return sorted(int(x.rpartition("-")[2]) for x in found if exists(spark, f"{self.path}/{x}/_SUCCESS"))

    def _write(self, rows: DataFrame, name: str) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(self.part) if self.part else writer).parquet(f"{self.path}/{name}")

    def rows(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The last snapshot and the changes since it, of batches before a number."""
        early = lambda n: before is None or n < before
        last = max(filter(early, self._numbers(spark, "snapshot")), default=-1)
        at = [f"{self.path}/snapshot-{last}"] * (last >= 0) + [f"{self.path}/batch-{n}" for n in self._numbers(spark, "batch") if n > last and early(n)]
        out = spark.createDataFrame([], self.schema)
        for x in at:  # `every` and one at most; each has its own parts
            out = out.unionByName(spark.read.schema(self.schema).parquet(x))
        return out

    def write(self, changes: DataFrame, number: int) -> None:
        self._write(changes, f"batch-{number}")
        if (number + 1) % self.every == 0:
            self.snapshot(changes.sparkSession, number)

    def snapshot(self, spark: SparkSession, number: int) -> None:
        self._write(self.fold(self.rows(spark, number + 1)), f"snapshot-{number}")
        kept = [n for n in self._numbers(spark, "snapshot") if n <= number][-2:]
        for kind in ("snapshot", "batch"):
            for n in self._numbers(spark, kind):
                if n < kept[0] or kind == "batch" and n == kept[0] and len(kept) > 1:
                    delete(spark, f"{self.path}/{kind}-{n}")


def cursor_log(path: str, every: int = 16) -> ChangeLog:
    fold = lambda rows: B.merged_cursors(rows.limit(0), rows)
    return ChangeLog(path, "reader string, channel string, last_seen long", fold, every)


def cursor_sink(path: str, every: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that keeps cursors as a `ChangeLog` (B4). Cursors only move forward, so the state is the maximum."""
    log = cursor_log(path, every)
    return lambda batch, number: log.write(batch.groupBy("reader", "channel").agg(F.max("last_seen").alias("last_seen")), number)


def cursors(spark: SparkSession, path: str) -> DataFrame:
    """What `cursor_sink` has written, as cursors."""
    log = cursor_log(path)
    return log.fold(log.rows(spark))


#: What keys of rows without a session begin with.
NOBODY = "\x00"


class InOrder(StatefulProcessor):
    """Rows of a key, held until the watermark passes them and then handed on in order of their time: what comes out does not
    depend on how the input is cut into batches. A timer stands at the first held row alone; once it has run out, the next
    one is set at the first row that is still held. Times are milliseconds; `schema` is that of held rows, `at` first."""

    schema = "at long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            if len(f) and not key[0].startswith(NOBODY):
                self.pending.appendList([tuple(int(x) for x in row) for row in f[[c.split()[0] for c in self.schema.split(", ")]].itertuples(index=False)])
                self.handle.registerTimer(int(f["at"].min()))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = sorted(tuple(x) for x in self.pending.get())
        passed, later = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
        if later and passed:
            self.pending.put(later)
            self.handle.registerTimer(later[0][0])
        elif held and not later:
            self.pending.clear()
        yield from self.passed(key, passed, now)

    def passed(self, key: tuple, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        """What comes of rows that the watermark has passed; also called when a timer of one's own runs out."""
        raise NotImplementedError


class Warn(InOrder):
    """The first `most` notes of a session, each once; a session is forgotten `days` after its last fire."""

    schema = "at long, doc_id long"

    def __init__(self, most: int, days: int):
        self.most, self.span = most, days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("shown", "last long, ids array<long>")

    def passed(self, key: tuple, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        last, shown = self.state.get() if self.state.exists() else (None, [])
        shown, out = list(shown or []), []
        for at, doc_id in rows:
            if last is not None and at > last + self.span:
                shown = []
            show = doc_id not in shown and len(shown) < self.most
            shown += [doc_id] * show
            last = at
            out.append((key[0], doc_id, show))
        if rows:
            self.state.update((last, shown))
            self.handle.registerTimer(last + self.span + 1)
            yield pd.DataFrame(out, columns=["session", "doc_id", "shown"])
        elif last is not None and now > last + self.span:
            self.state.clear()


class Watch(InOrder):
    """When a session comes alive, and when it has been silent for `ms`."""

    def __init__(self, ms: int):
        self.ms = ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long")

    def passed(self, key: tuple, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for (at,) in rows:
            if last is not None and at > last + self.ms:
                out.append((last + self.ms, False))
                last = None
            if last is None:
                out.append((at, True))
            last = at
        if last is not None and now > last + self.ms:
            out.append((last + self.ms, False))
            self.last.clear()
        elif last is not None and rows:
            self.last.update((last,))
            self.handle.registerTimer(last + self.ms + 1)
        if out:
            yield pd.DataFrame({"session": [key[0]] * len(out), "at": pd.to_datetime([x[0] for x in out], unit="ms", utc=True), "live": [x[1] for x in out]})


def _by_time(rows: DataFrame, processor: InOrder, out: str, late: str, *values: str) -> DataFrame:
    """`processor` over rows (session, at, values) by session, behind a watermark. Rows without a session move it and go no further:
    a filter on them would be pushed below the watermark, so they get keys that the processor passes over."""
    none = F.concat(F.lit(NOBODY), (F.unix_millis("at") % 64).cast("string"))
    own = timed(rows, "at").withWatermark("at", late).select(F.coalesce("session", none).alias("session"), F.col("at").alias("seen"), F.unix_millis("at").alias("at"), *values)
    return own.groupBy("session").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="eventTime")


def warnings(fires: DataFrame, most: int = 2, late: str = "10 minutes", days: int = 7) -> DataFrame:
    """The first `most` notes that fire in a session, each once, in order of time (B9). Columns: session, doc_id, at."""
    return _by_time(fires, Warn(most, days), "session string, doc_id long, shown boolean", late, "doc_id")


def present(beats: DataFrame, seconds: int = 300, late: str = "1 minute") -> DataFrame:
    """(session, at, live): sessions that came alive, and that had been silent for `seconds` (B6). Columns: session, at."""
    return _by_time(beats, Watch(1000 * seconds), "session string, at timestamp, live boolean", late)


#: Parts of the held facts by hash of their subject, so that a batch reads only the parts that it touches.
PARTS = 64
FACT = ["subject", "predicate", "object"]


HELD = "subject string, predicate string, object string, valid_from string, added boolean, number long, part int"


def fact_log(path: str, every: int = 16) -> ChangeLog:
    """Changes of the held facts; a snapshot has each live fact, or the last change of it."""

    def fold(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*FACT).agg(F.max_by(F.struct("valid_from", "added", "number", "part"), F.struct("number", "added")).alias("r"))
        return last.filter("r.added").select(*FACT, "r.*")

    return ChangeLog(path, HELD, fold, every, "part")


def held_facts(spark: SparkSession, path: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """The live graph from the changes that `late_facts` has written: of each fact the last change decides."""
    log = fact_log(path)
    rows = log.rows(spark, before)
    return log.fold(rows if parts is None else rows.filter(F.col("part").isin(parts))).select(*FACT, "valid_from")


def late_facts(held_path: str, late_path: str, parts: int = PARTS, every: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that consolidates facts into the held graph; stale observations go to a side table.

    A batch writes its own changes to a `ChangeLog`, by hash of the subject, and reads the held facts of those parts only.
    The batch and what comes of it are written once, so both outputs say the same whatever executor is lost."""
    from noteloom.operators.graph import consolidate, entity_id

    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    log = fact_log(held_path, every)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch, "arrived")
        # a folded direction swaps the ends, so either may be the subject
        ends = batch.select(F.explode(F.array("subject", "object")).alias("x")).select(part(entity_id(F.col("x"))).alias("part"))
        touched = [r.part for r in ends.distinct().collect() if r.part is not None]  # at most `parts`
        done = materialize(consolidate(held_facts(spark, held_path, number, touched), batch), "consolidated")
        done.filter("reason = 'stale_observation'").write.mode("overwrite").parquet(f"{late_path}/{number}")
        changes = done.filter("status IN ('added', 'invalidated')").select(*FACT, "valid_from", (F.col("status") == "added").alias("added"), F.lit(number).cast("long").alias("number"), part(F.col("subject")).alias("part"))
        log.write(changes, number)
        for x in (batch, done):
            discard(x)

    return run


def ended(stream: DataFrame, until: str) -> DataFrame:
    """The stream and one row without a session at a later time, which moves the watermark past all that came before. For
    inputs that end, taken in as one batch."""
    spark = stream.sparkSession
    path = new_path(spark, "end")
    row = [F.lit(until).cast(f.dataType).alias(f.name) if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*row).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def drained_table(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now, its output written to files in the shared folder, and read them back."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    out = f"{path}/out"

    def write(batch: DataFrame, number: int) -> None:  # a batch that runs again writes the same files anew
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run(stream.writeStream.foreachBatch(write), f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


def feed(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give what is there and has not been seen to a foreachBatch."""
    _run(stream.writeStream.foreachBatch(sink), checkpoint)


#: State by key and timers need this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _run(writer, checkpoint: str) -> None:
    spark = writer._spark
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, checkpoint: str, mode: str = "append", table: str = "drained") -> DataFrame:
    """Run a stream over what is there now and return what it sent out, from memory (tests of small inputs)."""
    _run(stream.writeStream.outputMode(mode).format("memory").queryName(table), checkpoint)
    return stream.sparkSession.table(table)
