"""The temporal fact graph. Open ends of intervals are null and as-of bounds are inclusive."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteloom.functions import predicates as P
from noteloom.functions.tables import materialize
from noteloom.functions.text import let

#: A number is no qualifier of an entity.
NUMBERED = r"^#?\d+(_\d+)*$"
REFERENCE = r"#\s*(\d+)|\b([a-z]{2,6}-\d+)\b|\b(?=[0-9a-f]*\d)([0-9a-f]{7,40})\b"


def entity_id(name: Column) -> Column:
    """One key for all separators; a name of separators only stays whole (G1)."""
    bare = F.regexp_replace(F.lower(name), "'", "")
    folded = F.regexp_replace(F.regexp_replace(bare, r"[\s_./-]+", "_"), "^_+|_+$", "")
    return F.when(folded != "", folded).otherwise(F.trim(bare))


def resolved(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """One hop through the alias table (alias, target), whose targets are folded again."""
    a = aliases.select(F.col("alias").alias("_alias"), entity_id(F.col("target")).alias("_target"))
    return df.withColumn(column, entity_id(F.col(column))).join(a, F.col(column) == F.col("_alias"), "left").withColumn(column, F.coalesce("_target", column)).drop("_alias", "_target")


def canonical_triples(facts: DataFrame, rules: P.Rules | None = None) -> DataFrame:
    """Predicates folded, mirrored ones turned round, and builders put before what they build (G3, G4), by the built-in rules or
    a table with overrides (G26)."""
    f = P.fold(facts, rules=rules).withColumn("predicate", F.col("_folded")).drop("_folded")
    turned = F.col("_inverse").isNotNull()
    s, o = F.when(turned, F.col("object")).otherwise(F.col("subject")), F.when(turned, F.col("subject")).otherwise(F.col("object"))
    f = f.withColumn("_s", s).withColumn("_o", o).withColumn("predicate", F.coalesce("_inverse", "predicate"))
    swap = F.col("predicate").isin(P.WORK_ITEM_OBJECT) & F.trim("_s").rlike(f"(?i)^(?:{P.WORK_ITEM})$") & ~F.trim("_o").rlike(f"(?i)^(?:{P.WORK_ITEM})")
    return f.withColumn("subject", F.when(swap, F.col("_o")).otherwise(F.col("_s"))).withColumn("object", F.when(swap, F.col("_s")).otherwise(F.col("_o"))).drop("_s", "_o", "_inverse")


def in_vocabulary(predicate: Column, rules: P.Rules | None = None) -> Column:
    """G5, for predicates that are folded already."""
    return predicate.isin((rules or P.built_in()).vocabulary)


def nearest_predicates(predicates: DataFrame, limit: int = 3) -> DataFrame:
    """(predicate, place, name): listed names by bigram Dice, plus a half for the same leading stem.

    The vocabulary is a fixed list, so each predicate carries it as an array; nothing is joined."""
    pairs = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substr(x, i, F.lit(2))))
    grams = lambda x: F.filter(pairs(x), lambda g: F.length(g) == 2)
    verb = lambda x: F.regexp_extract(x, "^[^_]*", 0)
    heads = {n: n.partition("_")[0] for n in P.vocabulary()}
    kin = F.create_map(*[x for h in sorted(set(heads.values())) for x in (F.lit(h), F.array(*[F.lit(f) for f in sorted(P.family(h))]))])
    names = F.array(*[F.lit(n) for n in P.vocabulary()])
    each = predicates.select("predicate", P.raw_column(F.col("predicate")).alias("raw")).distinct().select("predicate", "raw", F.explode(names).alias("name"))
    a, b = grams(F.col("raw")), grams(F.col("name"))
    dice = F.when(F.col("raw") == F.col("name"), 1.0).otherwise(F.coalesce(2 * F.size(F.array_intersect(a, b)) / F.nullif(F.size(a) + F.size(b), F.lit(0)), F.lit(0.0)) + F.when(F.array_contains(kin[verb(F.col("name"))], verb(F.col("raw"))), 0.5).otherwise(0.0))
    place = F.row_number().over(Window.partitionBy("predicate").orderBy(F.desc("score"), "name"))
    return each.withColumn("score", dice).withColumn("place", place).filter(F.col("place") <= limit).select("predicate", "place", "name", F.round("score", 6).alias("score"))


def inserted(incoming: DataFrame, facts: DataFrame) -> DataFrame:
    """New triples that no live fact holds, once each (G7). Columns: id, subject, predicate, object, valid_from."""
    folded = canonical_triples(incoming).withColumn("subject", entity_id(F.col("subject"))).withColumn("object", entity_id(F.col("object")))
    live = facts.filter("valid_to IS NULL").select("subject", "predicate", "object")
    first = F.row_number().over(Window.partitionBy("subject", "predicate", "object").orderBy("id"))
    return folded.join(live, ["subject", "predicate", "object"], "left_anti").withColumn("_k", first).filter("_k = 1").drop("_k")


def qualified(ids: Column, eid: Column) -> Column:
    """An entity itself, or it with a qualifier that is no number (P10)."""
    rest = F.substr(ids, F.length(eid) + 2)
    return (ids == eid) | (ids.startswith(F.concat(eid, F.lit("_"))) & ~rest.rlike(NUMBERED))


def prefixes(ids: Column) -> Column:
    """Every id that `ids` may qualify: itself and its parts up to each underscore."""
    parts = F.split(ids, "_")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_")))


def facts_of(entities: DataFrame, facts: DataFrame, as_of: Column | None = None, exact: bool = False) -> DataFrame:
    """Facts with an asked entity, or a qualified form of it, at either end (G8). `entities`: entity.

    Both ends meet the question on their own prefixes, an equi-join instead of LIKE."""
    if as_of is not None:
        facts = facts.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of)))
    asked = entities.select("entity").distinct()
    out = None
    for end, direction in (("subject", "outgoing"), ("object", "incoming")):
        keyed = facts.withColumn("entity", F.col(end) if exact else F.explode(prefixes(F.col(end))))
        hit = keyed.join(asked, "entity").filter(qualified(F.col(end), F.col("entity"))).withColumn("direction", F.lit(direction))
        out = hit if out is None else out.unionByName(hit)
    return out.withColumn("current", F.col("valid_to").isNull())


def page(found: DataFrame, cap: int = 25, chars: int = 500, budget: int = 8000) -> DataFrame:
    """Current facts first, then the newest, within a number of rows and of characters."""
    w = Window.partitionBy("entity").orderBy(F.desc("current"), F.desc_nulls_last("valid_from"), "id")
    cut = found.withColumn("object", F.substring("object", 1, chars)).withColumn("place", F.row_number().over(w))
    used = F.sum(F.length("subject") + F.length("predicate") + F.length("object")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return cut.filter(F.col("place") <= cap).withColumn("used", used).filter(F.col("used") <= budget)


def loose(ids: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(ids), "[^a-z0-9]+", ""), "s$", "")


def ends(facts: DataFrame) -> DataFrame:
    """(entity, id) of both ends; a fact from an entity to itself counts once."""
    return facts.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"), "id")


def nearby(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities that are spelled nearly alike and hold facts."""
    held = ends(facts).groupBy("entity").agg(F.count("*").alias("facts"))
    q = asked.select(F.col("entity").alias("asked"), loose(F.col("entity")).alias("key")).filter("key <> ''")
    return held.withColumn("key", loose(F.col("entity"))).join(q, "key").filter(~qualified(F.col("entity"), F.col("asked"))).select("asked", "entity", "facts")


def invalidated(facts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with ended triples closed, and each request's outcome (G11). `requests`: subject, predicate, object, ended."""
    key = ["subject", "predicate", "object"]
    latest = facts.filter("valid_to IS NULL").groupBy(*key).agg(F.max("valid_from").alias("latest"), F.count("*").alias("n"))
    judged = requests.join(latest, key, "left").withColumn("outcome", F.when(F.col("n").isNull(), "no_current_row").when(F.col("latest") > F.col("ended"), "ended_before_valid_from").otherwise("invalidated"))
    good = judged.filter("outcome = 'invalidated'").groupBy(*key).agg(F.min("ended").alias("ended"))
    closed = facts.join(good, key, "left").withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("ended")).otherwise(F.col("valid_to"))).drop("ended")
    return closed, judged


def timeline(asked: DataFrame, facts: DataFrame, limit: int = 100) -> DataFrame:
    """An entity's facts by start, unknown starts last."""
    own = ends(facts).join(asked, "entity").join(facts, "id")
    w = Window.partitionBy("entity").orderBy(F.asc_nulls_last("valid_from"), "id")
    return own.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def graph_stats(facts: DataFrame) -> DataFrame:
    """G13."""
    n = ends(facts).agg(F.countDistinct("entity").alias("entities"))
    sums = facts.agg(F.count("*").alias("facts"), F.count_if(F.col("valid_to").isNull()).alias("current"), F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"))
    return sums.withColumn("entities", F.lit(n.first()[0]))


def deduped(facts: DataFrame) -> DataFrame:
    """Live facts that name one triple stay once, the earliest."""
    key = Window.partitionBy("subject", "_folded", "object").orderBy(F.asc_nulls_first("valid_from"), "id")
    live = P.fold(facts.filter("valid_to IS NULL")).withColumn("_k", F.row_number().over(key)).filter("_k = 1").drop("_k", "_folded", "_inverse")
    return live.unionByName(facts.filter("valid_to IS NOT NULL"))


def resolved_mapping(mapping: DataFrame) -> DataFrame:
    """(source, target) followed to the ends of chains: a to b and b to c make a to c. A ring of merges ends in its smallest id;
    of several targets of a source the smallest counts.

    Each round follows twice as many steps (pointer jumping), so a chain of n merges takes log2 n rounds; `least` is the
    smallest id on the steps that a row has followed, which on a ring, after enough of them, is the ring's."""
    m = mapping.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target").groupBy("source").agg(F.min("target").alias("target"))
    m = materialize(m.withColumn("least", F.col("target")), "mapping")
    steps, n = 1, m.count()
    while True:
        ahead = m.select(F.col("source").alias("target"), F.col("target").alias("next"), F.col("least").alias("next_least"))
        joined = m.join(ahead, "target", "left")
        if steps > n or not joined.filter("next IS NOT NULL").limit(1).count():
            break
        m = materialize(joined.select("source", F.coalesce("next", "target").alias("target"), F.least("least", "next_least").alias("least")), "mapping")
        steps *= 2
    ends = joined.select("source", F.coalesce("next_least", "target").alias("target"))
    return ends.filter("source <> target")


def merged(facts: DataFrame, aliases: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both ends rewritten by (source, target), aliases recorded and repointed, live twins collapsed (G15). Merges may follow one
    another: facts end at the last target."""
    m = materialize(resolved_mapping(mapping), "mapping").select(F.col("source").alias("_from"), F.col("target").alias("_to"))
    for end in ("subject", "object"):
        facts = facts.join(m, F.col(end) == F.col("_from"), "left").withColumn(end, F.coalesce("_to", end)).drop("_from", "_to")
    repointed = aliases.join(m, F.col("target") == F.col("_from"), "left").select("alias", F.coalesce("_to", "target").alias("target"))
    return deduped(facts), repointed.unionByName(m.select(F.col("_from").alias("alias"), F.col("_to").alias("target"))).filter("alias <> target").distinct()


def merge_plan(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(source, target) for entities whose ids fold together: the one with the most facts stays, then the smallest id."""
    held = ends(facts).groupBy(F.col("entity").alias("e")).agg(F.count("*").alias("n"))
    e = entities.join(held, F.col("entity") == F.col("e"), "left").select("entity", entity_id(F.col("entity")).alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
    best = e.groupBy("key").agg(F.min_by("entity", F.struct(-F.col("n"), "entity")).alias("target"))
    return e.join(best, "key").filter("entity <> target").select(F.col("entity").alias("source"), "target")


def audit(entities: DataFrame, facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Counts of what a sound graph does not have."""
    checks = {
        "not_canonical": entities.filter(F.col("entity") != entity_id(F.col("entity"))),
        "orphan_ends": ends(facts).select("entity").distinct().join(entities, "entity", "left_anti"),
        "duplicate_live": facts.filter("valid_to IS NULL").groupBy("subject", "predicate", "object").count().filter("count > 1"),
        "unresolved_aliases": aliases.join(entities, aliases["target"] == entities["entity"], "left_anti"),
        "aliased_entities": aliases.join(entities, aliases["alias"] == entities["entity"], "left_semi"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def fold_plan(facts: DataFrame) -> DataFrame:
    """Each fact with its folded predicate and what a migration does to it: keep, rewrite, or drop as a twin that folding made."""
    f = P.fold(facts, "folded").drop("_inverse")
    w = Window.partitionBy("subject", "folded", "object")
    changed = F.col("folded") != F.col("predicate")
    live = f.filter("valid_to IS NULL").withColumn("_k", F.row_number().over(w.orderBy(F.asc_nulls_first("valid_from"), "id"))).withColumn("_any", F.bool_or(changed).over(w))
    done = live.withColumn("action", F.when((F.col("_k") > 1) & F.col("_any"), "drop").when(changed, "rewrite").otherwise("keep")).drop("_k", "_any")
    return done.unionByName(f.filter("valid_to IS NOT NULL").withColumn("action", F.when(changed, "rewrite").otherwise("keep")))


def reference(c: Column) -> Column:
    """The reference that a text names, or null."""
    c = F.lower(F.trim(c))
    number = F.nullif(F.regexp_extract(c, REFERENCE, 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("#"), number), F.nullif(F.regexp_extract(c, REFERENCE, 2), F.lit("")), F.nullif(F.regexp_extract(c, REFERENCE, 3), F.lit("")))


def same_entity(a: Column, b: Column) -> Column:
    """Equal, or spellings of one reference of which one ends with the other."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (a == b) | F.coalesce((reference(a) == reference(b)) & (a.endswith(b) | b.endswith(a)), F.lit(False))


def split_objects(facts: DataFrame) -> DataFrame:
    """A listed object becomes a fact each, if every part is a reference."""
    parts = F.filter(F.transform(F.split("object", r"\s*,\s*|\s+and\s+"), lambda x: F.trim(F.regexp_replace(x, r"^and\s+", ""))), lambda x: x != "")
    each = let(parts, lambda p: F.when((F.size(p) > 1) & F.forall(p, lambda x: reference(x).isNotNull()), p).otherwise(F.array("object")))
    return facts.withColumn("object", F.explode(each))


def retires(f: DataFrame, rules: P.Rules | None = None) -> Column:
    """Single-valued predicates of tickets and the like."""
    return f["predicate"].isin((rules or P.built_in()).single_valued) & F.trim(f["subject"]).rlike(P.SINGLE_VALUED_SUBJECT)


def conflicts(batch: DataFrame, rules: P.Rules | None = None) -> DataFrame:
    """Single-valued pairs that a batch itself gives several objects."""
    f = canonical_triples(split_objects(batch), rules).filter("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")
    value = entity_id(F.col("object"))
    return f.filter(retires(f, rules)).groupBy(entity_id(F.col("subject")).alias("subject"), "predicate").agg(F.sort_array(F.collect_set(value)).alias("objects")).filter(F.size("objects") > 1)


CONSOLIDATED = "status string, arrival long, subject string, predicate string, object string, valid_from string, valid_to string, reason string"


def consolidate(held: DataFrame, batch: DataFrame, rules: P.Rules | None = None) -> DataFrame:
    """A batch of facts against the live graph, in arrival order within each (subject, predicate).

    `held`: subject, predicate, object, valid_from (text); `batch`: arrival, subject, predicate, object, valid_from.
    Result rows are added, invalidated or skipped with a reason. An observation older than a held fact that it
    contradicts is stale; a pair that the batch itself contests retires nothing."""
    whole = batch.filter("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")
    broken = batch.join(whole.select("arrival"), "arrival", "left_anti").select(F.lit("skipped").alias("status"), "arrival", "subject", "predicate", "object", "valid_from", F.lit(None).cast("string").alias("valid_to"), F.lit("incomplete_triple").alias("reason"))
    f = canonical_triples(split_objects(whole), rules).withColumn("subject", entity_id(F.col("subject")))
    f = f.withColumn("listed", in_vocabulary(F.col("predicate"), rules)).withColumn("single", retires(f, rules)).withColumn("key", entity_id(F.col("object"))).withColumn("ref", reference(F.col("object")))
    # written once: what follows reads the folded batch and the held facts many times
    f = materialize(f.select("arrival", "subject", "predicate", "object", "valid_from", "listed", "single", "key", "ref"), "batch")
    h = materialize(held.select("subject", "predicate", "object", "valid_from", entity_id(F.col("object")).alias("key"), reference(F.col("object")).alias("ref")), "held")
    unlisted = f.filter("NOT listed").select(F.lit("skipped").alias("status"), "arrival", "subject", "predicate", "object", "valid_from", F.lit(None).cast("string").alias("valid_to"), F.lit("not_in_vocabulary").alias("reason"))
    f = f.filter("listed").drop("listed")
    return _in_order(f.filter("single"), h).unionByName(_gathered(f.filter("NOT single"), h)).unionByName(unlisted).unionByName(broken)


def _in_order(f: DataFrame, held: DataFrame) -> DataFrame:
    """Facts of single-valued predicates: each new one retires those that it contradicts, in order of arrival.

    Held and new facts stand in one order by (subject, predicate), and a task walks through it with the live facts of one
    pair in hand, so no pair has to fit in memory."""
    pair = ["subject", "predicate"]
    first = f.groupBy(*pair).agg(F.min_by(F.struct("key", "ref"), F.struct("arrival", "object")).alias("d"))
    differs = ~((F.col("key") == F.col("d.key")) | F.coalesce((F.col("ref") == F.col("d.ref")) & (F.col("key").endswith(F.col("d.key")) | F.col("d.key").endswith(F.col("key"))), F.lit(False)))
    contested = f.join(first, pair).groupBy(*pair).agg(F.bool_or(differs).alias("contested"))
    cols = ["arrival", *pair, "object", "valid_from", "key", "ref"]
    new = f.select(*cols).withColumn("kind", F.lit(1))
    old = held.join(contested, pair, "left_semi").select(F.lit(None).cast(f.schema["arrival"].dataType).alias("arrival"), *cols[1:]).withColumn("kind", F.lit(0))
    rows = new.unionByName(old).join(contested, pair).repartition(*pair).sortWithinPartitions(*pair, "kind", "arrival", "object")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, live = None, Live()
        for frame in frames:
            out: list[tuple] = []
            for r in frame.itertuples(index=False):
                if (r.subject, r.predicate) != now:
                    now, live = (r.subject, r.predicate), Live()
                if r.kind == 0:
                    live.add((r.object, r.valid_from, r.key, r.ref))
                else:
                    _arrive(live, r, out)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CONSOLIDATED.split(", ")])

    return rows.mapInPandas(walk, CONSOLIDATED)


def _same(a_key: str, a_ref: object, b_key: str, b_ref: object) -> bool:
    return a_key == b_key or (isinstance(a_ref, str) and a_ref == b_ref and (a_key.endswith(b_key) or b_key.endswith(a_key)))


class Live:
    """The live facts (object, valid_from, key, ref) of a pair, by spelling, by reference and by start, so that an arrival looks
    at its own kin only."""

    def __init__(self) -> None:
        self.facts: dict[int, tuple] = {}
        self.by_key: dict[str, list[int]] = {}
        self.by_ref: dict[str, list[int]] = {}
        self.starts: list[tuple[str, int]] = []
        self.made = 0

    def add(self, fact: tuple) -> None:
        n = self.made
        self.made += 1
        self.facts[n] = fact
        self.by_key.setdefault(fact[2], []).append(n)
        if isinstance(fact[3], str):
            self.by_ref.setdefault(fact[3], []).append(n)
        if isinstance(fact[1], str):
            insort(self.starts, (fact[1], n))

    def kin(self, key: str, ref: object) -> list[int]:
        """Numbers of the facts of the same object, in the order they came."""
        found = {*self.by_key.get(key, ())}
        if isinstance(ref, str):
            found.update(n for n in self.by_ref.get(ref, ()) if _same(key, ref, *self.facts[n][2:]))
        return sorted(found)

    def latest_but(self, kin: list[int]) -> str | None:
        """The latest start of a fact that is not among `kin`."""
        own = {*kin}
        return next((start for start, n in reversed(self.starts) if n not in own), None)

    def keep(self, kin: list[int]) -> list[tuple]:
        """Drops all facts but `kin`, and gives the dropped ones in the order they came."""
        own = {*kin}
        gone = [x for n, x in self.facts.items() if n not in own]
        kept = [self.facts[n] for n in kin]
        self.__init__()
        for x in kept:
            self.add(x)
        return gone


def _arrive(live: Live, r: tuple, out: list[tuple]) -> None:
    """A new fact of a pair; what becomes of it, and of those that it retires, goes to `out`."""
    emit = lambda status, o, reason, to=None: out.append((status, r.arrival, r.subject, r.predicate, o, r.valid_from, to, reason))
    kin = live.kin(r.key, r.ref)
    later = live.latest_but(kin)
    if later is not None and isinstance(r.valid_from, str) and later > r.valid_from:
        emit("skipped", r.object, "stale_observation")
        return
    twin = live.facts[kin[0]] if kin else None
    if len(kin) < len(live.facts) and not r.contested:  # one batch cannot order what it contests itself
        for x in live.keep(kin):
            emit("invalidated", x[0], "single_valued_predicate_took_new_object", r.valid_from)
    if twin:
        emit("skipped", r.object, "duplicate" if twin[2] == r.key else "equivalent_spelling_of_existing")
        return
    emit("added", r.object, None)
    live.add((r.object, r.valid_from, r.key, r.ref))


def _gathered(f: DataFrame, held: DataFrame) -> DataFrame:
    """Facts of predicates that hold many objects: the first of each spelling is added unless it, or another spelling of its
    reference, is held or came before. Only spellings meet, however many facts repeat them."""
    pair = ["subject", "predicate"]
    new = f.groupBy(*pair, "key").agg(F.max("ref").alias("ref"), F.min(F.struct("arrival", "object")).alias("first"))
    old = held.join(new.select(*pair).distinct(), pair, "left_semi").groupBy(*pair, "key").agg(F.max("ref").alias("ref")).withColumn("held", F.lit(True))
    none = F.lit(None).cast(new.schema["first"].dataType)
    each = new.withColumn("held", F.lit(False)).unionByName(old.withColumn("first", none))
    each = each.groupBy(*pair, "key").agg(F.max("ref").alias("ref"), F.bool_or("held").alias("held"), F.max("first").alias("first"))
    item = F.struct((~F.col("held")).alias("later"), "first", "key")
    groups = each.groupBy(*pair, F.coalesce("ref", "key").alias("g")).agg(F.array_sort(F.collect_list(item)).alias("items"))  # the spellings of one reference
    alike = lambda a, b: a.endswith(b) | b.endswith(a)
    taken = F.array().cast("array<struct<key:string,why:string>>")
    live = lambda acc, x: F.exists(acc, lambda y: F.isnull(y["why"]) & alike(y["key"], x["key"]))
    why = lambda acc, x: F.when(~x["later"], F.lit(None).cast("string")).when(live(acc, x), F.lit("equivalent_spelling_of_existing"))
    judged = F.aggregate("items", taken, lambda acc, x: F.array_append(acc, F.struct(x["key"].alias("key"), why(acc, x).alias("why"))))
    verdict = groups.select(*pair, F.explode(F.arrays_zip(F.col("items"), judged.alias("judged"))).alias("x")).select(*pair, F.col("x.items.key").alias("key"), F.col("x.items.first").alias("first"), F.col("x.items.later").alias("later"), F.col("x.judged.why").alias("why"))
    j = f.join(verdict.filter("first IS NOT NULL"), [*pair, "key"])
    # rows that repeat a first arrival word for word: one is added
    nth = F.row_number().over(Window.partitionBy(*pair, "key", "arrival", "object").orderBy("valid_from"))
    added = F.col("later") & F.col("why").isNull() & (F.struct("arrival", "object") == F.col("first")) & (F.col("nth") == 1)
    reason = F.when(~F.col("added"), F.coalesce("why", F.lit("duplicate")))
    return j.withColumn("nth", nth).withColumn("added", added).select(F.when(F.col("added"), "added").otherwise("skipped").alias("status"), "arrival", *pair, "object", "valid_from", F.lit(None).cast("string").alias("valid_to"), reason.alias("reason"))


def single_inserts(held: DataFrame, requests: DataFrame, rules: P.Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """One-fact requests, each its own (G24): (judged, retired).

    `held`: id, subject, predicate, object, valid_from (live facts, text dates); `requests`: request, subject, predicate,
    object, valid_from. A request retires all facts that it contradicts or writes nothing: if one of them starts later, or
    ends before it begins, its outcome is refused. `retired` has the facts' ids with the date that ends them."""
    f = canonical_triples(requests, rules).withColumn("subject", entity_id(F.col("subject")))
    f = f.withColumn("single", retires(f, rules)).withColumn("key", entity_id(F.col("object"))).withColumn("ref", reference(F.col("object")))
    h = held.select(F.col("id").alias("fact_id"), "subject", "predicate", F.col("valid_from").alias("since"), entity_id(F.col("object")).alias("h_key"), reference(F.col("object")).alias("h_ref"))
    j = f.join(h, ["subject", "predicate"], "left")
    same = (F.col("key") == F.col("h_key")) | F.coalesce((F.col("ref") == F.col("h_ref")) & (F.col("key").endswith(F.col("h_key")) | F.col("h_key").endswith(F.col("key"))), F.lit(False))
    j = j.withColumn("same", F.col("fact_id").isNotNull() & same).withColumn("against", F.col("single") & F.col("fact_id").isNotNull() & ~same)
    j = j.withColumn("newer", F.col("against") & F.coalesce(F.col("since") > F.col("valid_from"), F.lit(False)))
    sums = j.groupBy("request").agg(F.bool_or("same").alias("there"), F.bool_or("newer").alias("newer"), F.count_if("against").alias("against"))
    outcome = F.when(F.col("newer"), "refused").when(F.col("there"), "exists").otherwise("added")
    judged = sums.select("request", outcome.alias("outcome"), F.when(F.col("newer"), 0).otherwise(F.col("against")).alias("retires"))
    retired = j.filter("against").join(judged.filter("outcome <> 'refused'").select("request"), "request", "left_semi").select(F.col("fact_id").alias("id"), "request", F.col("valid_from").alias("valid_to"))
    return judged, retired


def fold_directions(facts: DataFrame) -> DataFrame:
    """Facts whose direction folds: rewritten, or merged into a live twin, whose date becomes the earlier one.

    Result: id, action (keep, fold, merge), subject, predicate, object, valid_from. Spellings meet, not facts: of each
    (subject, predicate, spelling) the first fact that stays, or else the first that moves, stands for the others."""
    trio = ["subject", "predicate", "key"]
    own = facts.withColumns({"s0": F.col("subject"), "p0": F.col("predicate"), "o0": F.col("object")})
    f = canonical_triples(own).withColumn("moves", (F.col("s0") != F.col("subject")) | (F.col("p0") != F.col("predicate")) | (F.col("o0") != F.col("object")))
    f = f.withColumn("key", F.lower(F.trim("object"))).withColumn("ref", reference(F.col("object")))
    at = F.struct("valid_from", "id")
    live = f.filter("valid_to IS NULL").groupBy(*trio).agg(F.max("ref").alias("ref"), F.min(F.when(~F.col("moves"), at)).alias("stays"), F.min(F.when(F.col("moves"), at)).alias("moved"), F.min(F.when(F.col("moves"), F.col("valid_from"))).alias("earliest"))
    item = F.struct(F.col("stays").isNull().alias("later"), F.coalesce("stays", "moved").alias("at"), "key")
    groups = live.groupBy("subject", "predicate", F.coalesce("ref", "key").alias("g")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    alike = lambda a, b: a.endswith(b) | b.endswith(a)
    taken = lambda acc, x: F.filter(acc, lambda y: (y["owner"] == y["key"]) & alike(y["key"], x["key"]))
    owner = lambda acc, x: F.when(x["later"], F.coalesce(F.get(taken(acc, x), 0)["key"], x["key"])).otherwise(x["key"])
    none = F.array().cast("array<struct<key:string,owner:string>>")
    owners = F.aggregate("items", none, lambda acc, x: F.array_append(acc, F.struct(x["key"].alias("key"), owner(acc, x).alias("owner"))))
    owned = groups.select("subject", "predicate", F.explode(owners).alias("o")).select("subject", "predicate", "o.key", "o.owner")
    j = live.join(owned, trio)
    # the fact that stands for an owner's spellings, and the earliest date of what merges into it
    head = j.filter("key = owner").select("subject", "predicate", "owner", F.coalesce("stays", "moved").alias("head"))
    date = j.groupBy("subject", "predicate", "owner").agg(F.min("earliest").alias("earliest"))
    known = j.select(*trio, "owner").join(head, ["subject", "predicate", "owner"]).join(date, ["subject", "predicate", "owner"])
    out = f.join(known, trio, "left")
    stands = F.col("valid_to").isNull() & (F.col("id") == F.col("head.id"))
    action = F.when(~F.col("moves"), "keep").when(F.col("valid_to").isNull() & ~F.coalesce(stands, F.lit(False)), "merge").otherwise("fold")
    since = F.when(stands & F.col("valid_from").isNotNull(), F.least("valid_from", "earliest")).otherwise(F.col("valid_from"))
    return out.select("id", action.alias("action"), "subject", "predicate", "object", since.alias("valid_from"))
