"""Operator 11: conversation structure repair by Hirschberg's divide and conquer, over blocks of turns and inside them.

Turns are sorted by range into partitions (conversation, turn, role, text), so a long conversation spreads over several;
blocks of `BLOCK` turns follow from places in them. Each block becomes a string of letters, one a turn, and a `Span`: for
each of four states before it, the cost and the rank of the audit-least edits that reach each state after it (`turn_edits`).
Spans fold to one for each partition of a conversation and then to one for the conversation. Forward and backward vectors
over those choose the states where the least audit crosses from partition to partition, then from block to block, and last,
by halving, from turn to turn. No task holds more than one block's texts, one partition's spans of a conversation, or an
audit; digests run over sorted blocks one after another, as SHA-256 has to.

A turn is a duplicate if its role and text stand earlier in its conversation: the first place of each (conversation, hash)
is a partial minimum, joined back.

Nulls: null roles and texts are one space; a null conv_id is a conversation of its own; null turns come first and are left
out of gaps. Equal turns are ordered by role and text (the first `PREFIX` code points, then a hash), so repeated rows are
duplicates. A role that is empty or begins with another letter than s, u or a can only be rewritten or deleted. Texts of any
length and conversations of any number of turns stay whole. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import turn_edits as T
from .common import materialize

BLOCK_BITS, PREFIX = 8, 64
#: `monotonically_increasing_id` numbers rows inside a partition by its lower 33 bits.
PARTITION_BITS = 33
SHOWN = r"[^\x20\x09-\x0D]"


def filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the contract's damage: by crc32 of `conv_id:turn` a row is dropped, emptied, stripped
    of its stops, repeated or given to the user."""
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(filled("role"))
    rows = turns.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def placed(turns: DataFrame) -> DataFrame:
    """(c, turn, role, text, h1, h2, at): turns with a key of their conversation that is never null, hashes of role and text,
    and a number that orders them."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c")
    rows = turns.select(key, "turn", filled("role").alias("role"), filled("text").alias("text"), F.monotonically_increasing_id().alias("salt"))
    rows = rows.withColumns({f"h{k}": F.xxhash64(F.lit(k), "role", "text") for k in (1, 2)})
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX), F.col("h1"), F.col("h2"), F.col("salt")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return rows.select("c", "turn", "role", "text", "h1", "h2", F.monotonically_increasing_id().alias("at"))


def lettered(rows: DataFrame) -> DataFrame:
    """(c, at, turn, fault, letter) of each turn: its first fault and the letter of its initial and fault."""
    first = rows.groupBy("c", "h1", "h2").agg(F.min("at").alias("first"))
    read = rows.select("c", "at", "turn", "h1", "h2", F.substring("role", 1, 1).alias("initial"), F.col("text").rlike(SHOWN).alias("shown"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ended"))
    fault = F.when(~F.col("shown"), 1).when(F.col("at") > F.col("first"), 2).when(~F.col("ended"), 3).otherwise(0)
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    flat = read.join(first, ["c", "h1", "h2"]).select("c", "at", "turn", fault.alias("fault"), kind.alias("kind"))
    return flat.select("c", "at", "turn", "fault", F.char(65 + 4 * F.col("kind") + F.col("fault")).alias("letter"))


def in_order(rows: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """`keys` with the list `xs` of (order, values) in order; the groups are bounded by what they are grouped from."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("xs"))


def _illegal(kinds: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))


def _initials(letters: str) -> str:
    return "".join("sua?"[(ord(x) - 65) // 4] for x in letters)


SPAN = "span array<int>, head string, tail string, illegal long"


def block_spans(blocks: DataFrame) -> DataFrame:
    """(c, block, letters, span, head, tail, illegal) of each block of letters: its first and last initial and the pairs of
    neighbours that no conversation has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letters = b.column(2).to_pylist()
            kinds = [_initials(x) for x in letters]
            made = [[T.written(T.span(x)) for x in letters], [k[0] for k in kinds], [k[-1] for k in kinds], [_illegal(k) for k in kinds]]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, t) for x, t in zip(made, (pa.list_(pa.int32()), pa.string(), pa.string(), pa.int64())))], ["c", "block", "letters", "span", "head", "tail", "illegal"])

    return blocks.mapInArrow(run, f"c string, block long, letters string, {SPAN}")


def joined_spans(groups: DataFrame, keys: str) -> DataFrame:
    """One span for each list of spans that `in_order` made."""
    names = [x.split()[0] for x in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list = [[], [], [], []]
            for xs in b.column(len(names)).to_pylist():
                spans = [T.read(x["span"]) for x in xs]
                made[0].append(T.written(T.folded(spans) if len(spans) > 1 else spans[0]))
                made[1].append(xs[0]["head"])
                made[2].append(xs[-1]["tail"])
                made[3].append(sum(x["illegal"] for x in xs) + sum(_illegal(x["tail"] + y["head"]) for x, y in zip(xs, xs[1:])))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(x, t) for x, t in zip(made, (pa.list_(pa.int32()), pa.string(), pa.string(), pa.int64())))], [*names, "span", "head", "tail", "illegal"])

    return groups.mapInArrow(run, f"{keys}, {SPAN}")


def crossed(groups: DataFrame, name: str) -> DataFrame:
    """(c, name, p, q) for each span of a list, given columns c, xs, p and q of the list: the states before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, xs, p, q in zip(*(x.to_pylist() for x in b.columns)):
                for x, (before, after) in zip(xs, T.crossings([T.read(x["span"]) for x in xs], p, q)):
                    rows.append((c, x[name], before, after))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32()))], ["c", name, "p", "q"])

    return groups.select("c", "xs", "p", "q").mapInArrow(run, f"c string, {name} long, p int, q int")


def closed(wholes: DataFrame) -> DataFrame:
    """(c, cost, q, closing, illegal) of each conversation: the least cost, the state it ends in and the inserts after that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [T.closing(T.read(x)[T.START]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))), b.column(2)], ["c", "cost", "q", "closing", "illegal"])

    return wholes.select("c", "span", "illegal").mapInArrow(run, "c string, cost long, q int, closing string, illegal long")


def edited(blocks: DataFrame) -> DataFrame:
    """(c, block, audit, made) of blocks with letters, p and q: the edits, and for each turn the roles inserted before it and
    its new role (null if deleted, "" if kept)."""
    made_type = pa.list_(pa.struct([("new", pa.list_(pa.string())), ("role", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            audits, made = [], []
            for letters, p, q in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
                found = T.audit(letters, p, q)
                audits.append("".join(found))
                made.append([{"new": new, "role": role} for new, role in T.lines(letters, found, p)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(audits, pa.string()), pa.array(made, made_type)], ["c", "block", "audit", "made"])

    return blocks.select("c", "block", "letters", "p", "q").mapInArrow(run, "c string, block long, audit string, made array<struct<new:array<string>,role:string>>")


class Repair:
    """The repair of all conversations of `turns` (conv_id, turn, role, text): each step is written once."""

    def __init__(self, turns: DataFrame):
        block, part = F.shiftright("at", BLOCK_BITS).alias("block"), F.shiftright("block", PARTITION_BITS - BLOCK_BITS).alias("part")
        self.rows = materialize(placed(turns), "turns")
        self.letters = materialize(lettered(self.rows), "letters")
        spelled = in_order(self.letters.select("c", "at", "letter", block), ["c", "block"], "at", "letter")
        letters = F.array_join(F.transform("xs", lambda x: x["letter"]), "").alias("letters")
        blocks = materialize(block_spans(spelled.select("c", "block", letters)), "blocks")
        values = ("span", "head", "tail", "illegal")
        by_part = materialize(in_order(blocks.select("*", part), ["c", "part"], "block", *values), "block_lists")
        parts = joined_spans(by_part, "c string, part long")
        by_conversation = materialize(in_order(parts, ["c"], "part", *values), "part_lists")
        self.wholes = materialize(closed(joined_spans(by_conversation, "c string")), "wholes")
        # down again: from conversations to partitions, to blocks, to turns
        above = by_conversation.join(self.wholes.select("c", F.lit(T.START).alias("p"), "q"), "c")
        parts_at = crossed(above, "part")
        blocks_at = crossed(by_part.join(parts_at, ["c", "part"]), "block")
        self.edits = materialize(edited(blocks.join(blocks_at, ["c", "block"])), "edits")

    def lines(self) -> DataFrame:
        """(c, block, lines): the repaired turns of each block, and those inserted at the end under block null."""
        block = F.shiftright("at", BLOCK_BITS).alias("block")
        texts = in_order(self.rows.select("c", "at", "role", "text", block), ["c", "block"], "at", "role", "text")
        line = lambda role, text: F.struct(role.alias("role"), text.alias("text"))

        def of(x: Column, made: Column) -> Column:
            new = F.transform(made["new"], lambda r: line(r, F.lit("")))
            own = F.when(made["role"].isNull(), F.array().cast("array<struct<role:string,text:string>>"))
            return F.concat(new, own.otherwise(F.array(line(F.when(made["role"] == "", x["role"]).otherwise(made["role"]), x["text"]))))

        made = texts.join(self.edits, ["c", "block"]).select("c", "block", F.flatten(F.zip_with("xs", "made", of)).alias("lines"))
        user, assistant = (line(F.lit(r), F.lit("")) for r in ("user", "assistant"))
        end = F.when(F.col("closing") == "I", F.array(assistant)).otherwise(F.array(user, assistant))
        return made.unionByName(self.wholes.filter("closing <> ''").select("c", F.lit(None).cast("long").alias("block"), end.alias("lines")))

    def audits(self) -> DataFrame:
        """(c, audit): the edits of each conversation, in order."""
        pieces = self.edits.select("c", "block", "audit")
        whole = in_order(pieces, ["c"], "block", "audit").select("c", F.array_join(F.transform("xs", lambda x: x["audit"]), "").alias("audit"))
        return whole.join(self.wholes.select("c", "closing"), "c").select("c", F.concat("audit", "closing").alias("audit"))

    def digests(self) -> DataFrame:
        """(c, repaired_sha256) of `role:text` lines, newline-joined. A conversation is hashed in one stream, block by block."""
        text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").alias("text")
        pieces = self.lines().filter(F.size("lines") > 0).select("c", "block", text)
        pieces = pieces.repartition("c").sortWithinPartitions("c", F.col("block").asc_nulls_last())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({"c": ended[0], "repaired_sha256": ended[1]}, pa.schema([("c", pa.string()), ("repaired_sha256", pa.string())]))

            now, digest = None, hashlib.sha256()
            for b in batches:
                ended: tuple[list, list] = ([], [])
                for c, piece in zip(b.column(0).to_pylist(), b.column(2)):
                    if c != now:
                        if now is not None:
                            ended[0].append(now)
                            ended[1].append(digest.hexdigest())
                        now, digest = c, hashlib.sha256()
                    else:
                        digest.update(b"\n")
                    digest.update(piece.as_py().encode())
                yield done()
            if now is not None:
                ended = ([now], [digest.hexdigest()])
                yield done()

        return pieces.mapInArrow(run, "c string, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id (as a string), place (from 0), role and text of the repaired conversations."""
    made = Repair(turns).lines().withColumn("n", F.size("lines"))
    earlier = Window.partitionBy("c").orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = made.select("c", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))  # rows are blocks
    rows = made.join(sizes.withColumnsRenamed({"c": "c_", "block": "block_"}), (F.col("c") == F.col("c_")) & F.col("block").eqNullSafe(F.col("block_")))
    flat = rows.select("c", "start", F.posexplode("lines").alias("k", "x"))
    return flat.select(F.when(F.col("c") != "", F.substring("c", 2, 1 << 30)).alias("conv_id"), (F.col("start") + F.col("k")).alias("place"), "x.role", "x.text")


def reports(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """For each conv_id of `ids`: gaps in the turn numbers, turns by first fault, illegal neighbours, and the cost, audit and
    digest of the repair of its `turns`."""
    made = Repair(turns)
    of = lambda k: F.count(F.when(F.col("fault") == k, 1))
    counts = made.letters.groupBy("c").agg(of(1).alias("blank"), of(2).alias("duplicate"), of(3).alias("truncated"))
    numbers = made.letters.filter(F.col("turn").isNotNull()).groupBy("c", "turn").agg(F.lit(1).alias("one")).groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c")
    out = ids.select("conv_id").distinct().select("conv_id", key)
    for part in (numbers, counts, made.wholes.select("c", "illegal", "cost"), made.audits(), made.digests()):
        out = out.join(part, "c", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged_reports(turns: DataFrame) -> DataFrame:
    """`reports` of the conversations after `damaged`."""
    return reports(damaged(turns), turns)
