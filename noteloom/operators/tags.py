"""Tags: canonical forms, counts, co-occurrence and bridges between two tags."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.tables import materialize, spread

#: Names that one automaton holds, and the characters that bar a boundary beside a name.
NAMES = 200_000
INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_-")


def round2(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x * 100 + 0.5) / 100


def canonical(tags: DataFrame, aliases: DataFrame, column: str = "tag") -> DataFrame:
    """Replace aliases by their tag (K2); `aliases` (alias, target) is a dictionary."""
    a = aliases.select(F.col("alias").alias("_a"), F.col("target").alias("_t"))
    return tags.join(a, F.col(column) == F.col("_a"), "left").withColumn(column, F.coalesce("_t", column)).drop("_a", "_t")


def note_tags(notes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Distinct (id, tag)."""
    rows = notes.select("id", F.explode("tags").alias("tag")).filter("tag IS NOT NULL")
    return (canonical(rows, aliases) if aliases is not None else rows).distinct()


def spellings(aliases: DataFrame) -> DataFrame:
    """All spellings of each target, its own first name included (K2)."""
    both = aliases.select("target", F.col("alias").alias("s")).unionByName(aliases.select("target", F.col("target").alias("s")))
    return both.groupBy("target").agg(F.sort_array(F.collect_set("s")).alias("spellings"))


def counts(tags: DataFrame, limit: int) -> DataFrame:
    """Notes of each tag, the most first (K3)."""
    return tags.groupBy("tag").agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def alias_pair(a: Column, b: Column) -> Column:
    """Two tags that may be one: a plural, or one extends the other after a hyphen (K5)."""
    return (F.concat(a, F.lit("s")) == b) | (F.concat(b, F.lit("s")) == a) | a.startswith(F.concat(b, F.lit("-"))) | b.startswith(F.concat(a, F.lit("-")))


def alias_candidates(tags: DataFrame) -> DataFrame:
    """Pairs of existing tags that pass K5 (K4), by a join on the forms a tag can come from, never on all pairs."""
    all_tags = tags.select("tag").distinct()
    cut = F.transform(F.sequence(F.lit(1), F.size(F.split("tag", "-")) - 1), lambda i: F.array_join(F.slice(F.split("tag", "-"), F.lit(1), i), "-"))
    stems = F.concat(F.when(F.col("tag").endswith("s"), F.array(F.expr("substring(tag, 1, length(tag) - 1)"))).otherwise(F.array().cast("array<string>")), F.when(F.col("tag").contains("-"), cut).otherwise(F.array().cast("array<string>")))
    forms = all_tags.select(F.col("tag").alias("longer"), F.explode(F.array_distinct(stems)).alias("shorter"))
    return forms.join(all_tags.select(F.col("tag").alias("shorter")), "shorter").select("shorter", "longer").distinct()


def case_variants(raw: DataFrame) -> DataFrame:
    """Tags written in several cases (K4)."""
    return raw.groupBy(F.lower("tag").alias("tag")).agg(F.sort_array(F.collect_set("tag")).alias("forms")).filter(F.size("forms") > 1)


def scored(pairs: DataFrame, n: int) -> DataFrame:
    """lift and score of co-occurrences (cooccur, n_a, n_b)."""
    lift = round2(F.col("cooccur") * n / (F.col("n_a") * F.col("n_b")))
    return pairs.withColumn("lift", lift).withColumn("score", round2(F.col("lift") * F.log2(1 + F.col("cooccur"))))


def neighbours(tags: DataFrame, target: str, limit: int = 15, least: int = 2) -> DataFrame:
    """Tags that share notes with `target`, by lift (K6)."""
    total = tags.groupBy("tag").agg(F.countDistinct("id").alias("n_b"))
    held = tags.filter(F.col("tag") == target).select("id")
    n, n_a = tags.agg(F.countDistinct("id")).first()[0], held.count()
    co = tags.filter(F.col("tag") != target).join(held, "id", "left_semi").groupBy("tag").agg(F.count("*").alias("cooccur")).filter(F.col("cooccur") >= least)
    out = scored(co.join(total, "tag").withColumn("n_a", F.lit(n_a)), n)
    return out.orderBy(F.desc("score"), F.desc("cooccur"), "tag").limit(limit).select("tag", "cooccur", "lift", "score")


def strongest(tags: DataFrame, limit: int = 10, least: int = 3) -> DataFrame:
    """Pairs of tags with the largest scores, alias candidates left out (K7). Pairs grow with a note's tags, which are few."""
    total = tags.groupBy("tag").agg(F.countDistinct("id").alias("n"))
    n = tags.agg(F.countDistinct("id")).first()[0]
    sets = tags.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("t"))
    pair = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    co = sets.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("cooccur")).filter((F.col("cooccur") >= least) & ~alias_pair(F.col("a"), F.col("b")))
    j = co.join(total.select(F.col("tag").alias("a"), F.col("n").alias("n_a")), "a").join(total.select(F.col("tag").alias("b"), F.col("n").alias("n_b")), "b")
    return scored(j, n).orderBy(F.desc("score"), F.desc("cooccur"), "a", "b").limit(limit).select("a", "b", "cooccur", "lift", "score")


def entity_candidates(entities: DataFrame, facts: DataFrame, excluded: list[str], least: int = 2) -> DataFrame:
    """(entity, name) of entities that stand in `least` facts or more, but for the names of the tags themselves (K8)."""
    both = F.array_distinct(F.array("subject", "object"))
    used = facts.select(F.explode(both).alias("entity")).groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("entity")
    return entities.join(used, "entity", "left_semi").filter(~F.lower(F.trim("name")).isin(excluded)).select("entity", "name")


def tokens(c: Column) -> Column:
    """Runs of the characters that do not bound a name."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9_-]+"), lambda w: w != "")


def grams(words: Column, sizes: list[int]) -> Column:
    """The distinct runs of `sizes` neighbouring words, joined by blanks."""
    out, run = [], words
    for k in range(1, max(sizes) + 1):
        if k > 1:
            run = F.zip_with(run, F.slice(words, F.lit(k), F.greatest(F.size(words) - k + 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        if k in sizes:
            out.append(run)
    return F.filter(F.array_distinct(F.flatten(F.array(*out))), lambda g: g.isNotNull())


def mentions(notes: DataFrame, entities: DataFrame, most: int = NAMES, key_words: int = 4) -> DataFrame:
    """(id, entity): notes whose text names an entity at word boundaries (K8).

    Up to `most` names make one automaton, which every task gets and runs each text through once. Of more names, those with
    ASCII letters or digits are joined by runs of tokens (`joined_mentions`); the others go by automata of `most` names."""
    named = materialize(entities.select("entity", F.lower(F.trim("name")).alias("name")).filter((F.length("name") >= 3) & ~F.col("name").rlike("^[0-9]+$")).distinct(), "names")
    text = notes.select("id", F.lower(F.concat_ws("\n", "title", "content")).alias("text"))
    names = named.select("name").distinct()
    few = names.limit(most + 1).count() <= most
    parts = [] if few else [joined_mentions(text, names.filter(F.size(tokens(F.col("name"))) > 0), key_words)]
    rest = names if few else names.filter(F.size(tokens(F.col("name"))) == 0)
    shards = 1 if few else -(-rest.count() // most)
    for k in range(shards):
        shard = rest if shards == 1 else rest.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == k)
        parts.append(scanned_mentions(text, [r.name for r in shard.collect()]))  # about `most` names
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    return found.join(named, "name").select("id", "entity").distinct()


def scanned_mentions(texts: DataFrame, names: list[str]) -> DataFrame:
    """(id, name) of the names that stand in a text between boundaries, by one automaton."""
    shared = texts.sparkSession.sparkContext.broadcast(sorted(names))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for x in shared.value:
            automaton.add_word(x, x)
        automaton.make_automaton()
        for b in batches:
            rows, hits = [], []
            for i, text in enumerate(b.column(1)):
                text, seen = text.as_py() or "", set()
                for end, x in automaton.iter(text) if shared.value else ():
                    if x not in seen and text[end + 1 : end + 2] not in INSIDE and (end < len(x) or text[end - len(x)] not in INSIDE):
                        seen.add(x)
                rows += [i] * len(seen)
                hits += seen
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], ["id", "name"])

    return spread(texts).mapInArrow(run, f"id {kind}, name string")


def joined_mentions(texts: DataFrame, names: DataFrame, key_words: int) -> DataFrame:
    """(id, name) of names with ASCII tokens, by joins.

    A name of up to `key_words` tokens with single blanks between them is mentioned where the note has just those, so an
    equi-join on runs of tokens decides; other separators bar such runs. Other names are looked for by their first tokens,
    and then each note's text is read once, for all names that may stand in it."""
    first = F.slice(tokens(F.col("name")), 1, key_words)
    named = names.select("name", F.array_join(first, " ").alias("key"), F.size(first).alias("k")).withColumn("whole", F.col("key") == F.col("name"))
    barred = F.regexp_replace("text", "[^a-z0-9_-]*[^a-z0-9_ -][^a-z0-9_-]*| {2,}", " | ")
    sizes = {whole: sorted(r.k for r in named.select("k", "whole").distinct().collect() if r.whole == whole) for whole in (True, False)}  # at most key_words numbers each
    found = texts.select("id", F.lit("").alias("name")).limit(0)
    if sizes[True]:
        words = texts.select("id", F.filter(F.split(barred, " "), lambda w: w != "").alias("w"))
        found = words.select("id", F.explode(grams(F.col("w"), sizes[True])).alias("key")).join(named.filter("whole"), "key").select("id", "name")
    if sizes[False]:
        words = texts.select("id", tokens(F.col("text")).alias("w"))
        maybe = words.select("id", F.explode(grams(F.col("w"), sizes[False])).alias("key")).join(named.filter("NOT whole"), "key").groupBy("id").agg(F.collect_set("name").alias("names"))
        quoted = lambda x: F.concat(F.lit("(^|[^a-z0-9_-])\\Q"), x, F.lit("\\E($|[^a-z0-9_-])"))
        there = F.filter("names", lambda x: F.contains("text", x) & F.regexp_like("text", quoted(x)))
        found = found.unionByName(maybe.join(texts, "id").select("id", F.explode(there).alias("name")))
    return found


def sides(tags: DataFrame, a: str, b: str) -> DataFrame:
    """(id, in_a, in_b) of all tagged notes."""
    return tags.groupBy("id").agg(F.bool_or(F.col("tag") == a).alias("in_a"), F.bool_or(F.col("tag") == b).alias("in_b"))


def tunnel_stats(tags: DataFrame, a: str, b: str) -> DataFrame:
    """Notes on either side and on both (K9)."""
    return sides(tags, a, b).agg(F.count_if("in_a").alias("docs_from"), F.count_if("in_b").alias("docs_to"), F.count_if(F.col("in_a") & F.col("in_b")).alias("overlap"))


def bridge_notes(notes: DataFrame, tags: DataFrame, a: str, b: str, limit: int = 10) -> DataFrame:
    """The newest notes with both tags (K9)."""
    both = sides(tags, a, b).filter("in_a AND in_b").select("id")
    return notes.join(both, "id", "left_semi").orderBy(F.desc_nulls_last("created_at"), "id").limit(limit)


def bridge_entities(mentioned: DataFrame, tags: DataFrame, a: str, b: str, n: int, limit: int = 10) -> DataFrame:
    """Entities named on both sides, by log2(1 + smaller side) * log2(n / df) (K9)."""
    c = mentioned.join(sides(tags, a, b), "id").groupBy("entity").agg(F.count("*").alias("df"), F.count_if("in_a").alias("n_from"), F.count_if("in_b").alias("n_to"))
    strength = round2(F.log2(1 + F.least("n_from", "n_to")) * F.log2(F.lit(float(n)) / F.col("df")))
    return c.filter("n_from > 0 AND n_to > 0").withColumn("strength", strength).filter("strength > 0").orderBy(F.desc("strength"), F.desc(F.least("n_from", "n_to")), "entity").limit(limit)
