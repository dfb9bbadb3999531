"""Reports over the read, tool and write logs. Sessions that are null never match one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PUSHED = ("hint", "briefing")
READS = ("kb_read",)
WINDOW_S = 30 * 60

# Fixed value: what messages between agents begin with.
ENVELOPE = r"^<(agent-message|task-notification)"


def share(part: Column, whole: Column) -> Column:
    """A rate rounded to 6 places, null where there is nothing to divide by."""
    return F.when(whole > 0, F.round(part / whole, 6))


def coverage(notes: DataFrame, reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Live notes, and how many of them were ever retrieved (R1; with `by`, R2)."""
    seen = reads.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("seen")).distinct()
    live = notes.filter("superseded_at IS NULL").join(seen, F.col("id") == F.col("seen"), "left")
    total, hit = F.count("*"), F.count("seen")
    return live.groupBy(*by).agg(total.alias("total"), hit.alias("retrieved"), share(hit, total).alias("coverage"))


def freshness(notes: DataFrame, reads: DataFrame, now: Column, written_days: int = 90, read_days: int = 30) -> DataFrame:
    """Notes written lately, and those first retrieved within `read_days` of being written."""
    first = reads.groupBy(F.col("doc_id").alias("seen")).agg(F.min("created_at").alias("first_read"))
    recent = notes.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(written_days))).join(first, F.col("id") == F.col("seen"), "left")
    quick = F.count_if(F.col("first_read") <= F.col("created_at") + F.make_dt_interval(F.lit(read_days)))
    return recent.agg(F.count("*").alias("written"), quick.alias("read_in_time"))


def followed_rows(rows: DataFrame) -> DataFrame:
    """Hints whose note the same session reads later, by row."""
    hints = rows.filter("surface = 'hint'")
    reads = rows.filter(F.col("surface").isin(*READS)).select(F.col("session").alias("s"), F.col("doc_id").alias("d"), F.col("created_at").alias("t"))
    last = reads.groupBy("s", "d").agg(F.max("t").alias("t"))  # a later read exists if the last one is later
    joined = hints.join(last, (F.col("session") == F.col("s")) & (F.col("doc_id") == F.col("d")), "left")
    return joined.agg(F.count("*").alias("hints"), F.count_if(F.col("t") > F.col("created_at")).alias("followed"))


def push_pull(rows: DataFrame) -> DataFrame:
    """Rows that were pushed or pulled, and those with a session."""
    pushed = F.col("surface").isin(*PUSHED)
    return rows.agg(F.count_if(pushed).alias("pushed"), F.count_if(~pushed).alias("pulled"), F.count("session").alias("with_session"), F.count("*").alias("total"))


def misses(rows: DataFrame) -> DataFrame:
    """Miss rows of each surface."""
    total, missed = F.count("*"), F.count_if(F.col("doc_id").isNull())
    return rows.groupBy("surface").agg(total.alias("total"), missed.alias("misses"), share(missed, total).alias("miss_rate"))


def asked_to_look(prompts: DataFrame) -> DataFrame:
    """Of prompts that ask to look, whether the prompt before in the session had fired (R7). Columns: session, at, id, fired, nudge."""
    before = F.lag("fired").over(Window.partitionBy("session").orderBy("at", "id"))
    nudges = prompts.filter("session IS NOT NULL").withColumn("before", before).filter("nudge")
    return nudges.agg(F.count("*").alias("nudges"), F.count_if(F.col("before")).alias("after_fire"), F.count_if(~F.col("before")).alias("after_silence"), F.count_if(F.col("before").isNull()).alias("first_prompt"))


def events(rows: DataFrame) -> DataFrame:
    """Rows to decisions (R8): those that share event_id, or session, surface, time and query in older rows."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.coalesce("event_id", F.concat_ws("|", none("session"), "surface", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), none("query")))
    grouped = rows.groupBy("surface", key.alias("event")).agg(F.min("created_at").alias("at"), F.max("session").alias("session"), F.sort_array(F.collect_set("doc_id")).alias("docs"), F.bool_or("is_test").alias("is_test"), F.min_by("query", F.struct("created_at", "id")).alias("asked"))
    return grouped.withColumn("class", event_class()).drop("asked")


def event_class() -> Column:
    """Why an event counts for nothing, the first reason that holds, or null (P8). `asked` is its first query: a hint for a message
    between agents is no prompt of a person's."""
    enveloped = (F.col("surface") == "hint") & F.coalesce(F.col("asked").rlike(ENVELOPE), F.lit(False))
    return F.when(F.col("session").isNull(), "unattributable").when(F.col("is_test"), "test").when(enveloped, "envelope")


def followed(events: DataFrame, reads: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Events with in_window and ever: a read of one of their notes in the same session at or after them (R9), and the first
    such read inside the window (R10).

    Events and reads of a (session, note) stand in one time order, backwards, and the last read seen is the next one after an
    event: a busy session costs a sort, not a product."""
    each = events.select("surface", "event", "session", F.explode("docs").alias("doc_id"), F.col("at").alias("t"), F.lit(None).cast("long").alias("read_id"))
    read = reads.filter(F.col("surface").isin(*READS)).select(F.lit(None).cast("string").alias("surface"), F.lit(None).cast("string").alias("event"), "session", "doc_id", F.col("created_at").alias("t"), F.col("id").alias("read_id"))
    both = each.unionByName(read).filter("session IS NOT NULL AND doc_id IS NOT NULL")
    backwards = Window.partitionBy("session", "doc_id").orderBy(F.desc("t"), F.desc_nulls_last("read_id")).rowsBetween(Window.unboundedPreceding, 0)
    after = F.last(F.when(F.col("read_id").isNotNull(), F.struct("t", "read_id")), ignorenulls=True).over(backwards)
    met = both.withColumn("next", after).filter("event IS NOT NULL AND next IS NOT NULL")
    soon = F.col("next.t") <= F.col("t") + F.make_dt_interval(secs=F.lit(float(window_s)))
    hit = met.groupBy("surface", "event").agg(F.bool_or(soon).alias("in_window"), F.min(F.when(soon, F.col("next"))).alias("first"))
    out = events.join(hit, ["surface", "event"], "left")
    return out.select(*events.columns, F.coalesce("in_window", F.lit(False)).alias("in_window"), F.col("first.t").alias("first_read_at"), F.col("first.read_id").alias("first_read"), F.col("in_window").isNotNull().alias("ever"))


def surface_stats(marked: DataFrame) -> DataFrame:
    """Events, exclusions, fires, declines and follow rates of each surface."""
    fires = F.col("class").isNull() & (F.size("docs") > 0)
    n, soon, ever = F.count_if(fires), F.count_if(fires & F.col("in_window")), F.count_if(fires & F.col("ever"))
    return marked.groupBy("surface").agg(
        F.count("*").alias("events"), F.count_if(F.col("class") == "unattributable").alias("unattributable"), F.count_if(F.col("class") == "test").alias("test"), F.count_if(F.col("class") == "envelope").alias("envelope"), n.alias("fires"),
        F.count_if(F.col("class").isNull() & (F.size("docs") == 0)).alias("declines"), soon.alias("followed"), ever.alias("followed_ever"), share(soon, n).alias("rate"), share(ever, n).alias("rate_ever"),
    )


def bootstrap(fires: DataFrame, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """A cluster bootstrap interval of the follow rate (R13): sessions are drawn with replacement, in a job.

    A session's number of appearances in a draw is Poisson(1) by a hash of (draw, session), so draws need no shuffle of
    sessions: each task sums its own and only (draw, sums) meet."""
    sessions = fires.groupBy("session").agg(F.sum(F.col("followed").cast("long")).alias("hit"), F.count("*").alias("n"))
    each = sessions.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    u = F.pmod(F.xxhash64("session", "draw", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    steps, total, p = [], 0.0, 2.718281828459045**-1
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    times = sum(F.when(u >= s, 1).otherwise(0) for s in steps)
    sums = each.groupBy("draw").agg(F.sum(times * F.col("hit")).alias("hit"), F.sum(times * F.col("n")).alias("n"))
    rates = sums.filter("n > 0").select((F.col("hit") / F.col("n")).alias("rate"))
    return rates.agg(F.percentile("rate", 0.025).alias("low"), F.percentile("rate", 0.975).alias("high"), F.count("*").alias("draws"))


def tool_partials(calls: DataFrame) -> DataFrame:
    """Sums by day and tool that can be added up (half of R15 and R19)."""
    return calls.groupBy(F.to_date("created_at").alias("day"), "tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("result_chars") <= 80).alias("empty"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


def tool_demand(partials: DataFrame) -> DataFrame:
    """Demand of each tool from partial sums, raw and rolled up alike (R15); the mean is truncated."""
    return partials.groupBy("tool").agg(F.sum("calls").alias("calls"), F.sum("failed").alias("failed"), F.sum("empty").alias("empty"), F.floor(F.sum("total_ms") / F.sum("calls")).alias("mean_ms"), F.max("max_ms").alias("max_ms"))


def never_called(known: DataFrame, demand: DataFrame) -> DataFrame:
    return known.join(demand, "tool", "left_anti")


def percentiles(calls: DataFrame, by: str, value: str, exact: bool = True) -> DataFrame:
    """p50 and p90 by nearest rank (R16): the value at floor(p * n), from 0. `exact=False` uses a quantile sketch."""
    if not exact:
        return calls.groupBy(by).agg(F.count("*").alias("n"), F.percentile_approx(value, 0.5, 10_000).alias("p50"), F.percentile_approx(value, 0.9, 10_000).alias("p90"))
    # counts of equal values first: a hot group is as wide as its distinct values, not its rows
    counts = calls.groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    upto = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(by, value, upto.alias("upto"), F.sum("c").over(w).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col(value)))
    return ranked.groupBy(by).agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"))


def decision_bands(decisions: DataFrame, notes: DataFrame) -> DataFrame:
    """Write decisions by 0.1 bands of the nearest score, with written notes that were retired later."""
    band = F.floor(F.col("nearest_score") * 10).cast("double") / 10
    retired = notes.filter("superseded_at IS NOT NULL").select(F.col("id").alias("gone"))
    joined = decisions.join(retired, F.col("doc_id") == F.col("gone"), "left")
    return joined.groupBy(band.alias("band")).agg(F.count("*").alias("decisions"), F.count_if("refused").alias("refused"), F.count("gone").alias("later_retired"))


def growth(tables: dict[str, DataFrame], now: Column, days: int = 7) -> DataFrame:
    """Rows, age and rows a day of each log."""
    out = None
    for name, t in tables.items():
        recent = F.count_if(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))
        one = t.agg(F.lit(name).alias("log"), F.count("*").alias("rows"), F.datediff(now, F.min("created_at")).alias("age_days"), F.round(recent / days, 6).alias("rows_per_day"))
        out = one if out is None else out.unionByName(one)
    return out


def prune(calls: DataFrame, rollups: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and rollups with the rows before the cutoff folded in."""
    old = tool_partials(calls.filter(F.col("created_at") < cutoff))
    merged = rollups.unionByName(old).groupBy("day", "tool").agg(*[F.sum(c).alias(c) for c in ("calls", "failed", "empty", "total_ms")], F.max("max_ms").alias("max_ms"))
    return calls.filter(F.col("created_at") >= cutoff), merged


def verdicts(reviews: DataFrame) -> DataFrame:
    """Any unsafe reviewer blocks an action and the highest risk wins (R29). Columns: action, safe, risk."""
    ranks = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    rank = F.coalesce(F.array_position(ranks, F.col("risk")), F.lit(1)).cast("int")
    return reviews.groupBy("action").agg(F.bool_or(~F.col("safe")).alias("blocked"), F.element_at(ranks, F.max(rank)).alias("risk"), F.count("*").alias("reviewers"))
