"""Operator 12: phrase collocations by stripes.

Each prefix keys a counter of the words that follow it: a stripe. Prefixes have 0 to `LONGEST` - 1 words, and an entry of a stripe
is the count of the phrase one word longer. Merged entry by entry, stripes give all the operator needs:

* entries that reach `LEAST` are the candidates, the total of the root stripe is n,
* a prefix has its own total as an entry one level up: so entries are also the counts l and r of the parts that a candidate
  is cut into,
* a stripe's largest entry says whether some longer phrase to the right is as frequent as the prefix; entries grouped by
  their phrase without its first word say the same for the left. A longer phrase that holds a candidate and is as frequent
  has one word more inside it that is as frequent too, so these two tests find all.

A phrase is frequent only if its parts are. The first scan of the texts makes the root stripe and counts pairs of words by a
hash of `WIDE` bits; the second cuts the texts down to runs of words whose pairs reach `LEAST`, and all that follows reads these
runs, dealt by language so that a task's counters meet. Phrases of three words and more are first counted by their place in an
array of `BITS` places, one length after the other, only where both parts of a phrase may be frequent. Then all stripes are made
at once, of phrases whose place reaches `LEAST`: so a chunk has about as many entries as there are frequent phrases in it, which
their occurrences bound. What may be frequent is looked up in an array of fixed
size that every task gets: a wrong hit makes an entry that turns out rare, never a wrong count.

Tasks count a chunk of text at a time in arrays. Counts by place and entries travel in blocks of places, an even part of all
phrases each, and meet by (lang, block): a frequent prefix is spread over all blocks. Scores are exact decimals. The first `TOP`
of a language are found inside each task first.

Nulls: a null text is empty, a null lang is `und`. Texts are read whole, in chunks; ids are not read. Equal scores fall to
the higher count, then the smaller phrase in byte order; the cut of a phrase with the lowest score counts, then the shortest
first part. Repeated rows count as often as they stand. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize

LEAST, LONGEST, TOP = 100, 5, 2000
#: Exact: a decimal of 38 digits by another, the whole part of the quotient.
SCORE = "(1000BD * a_ * n_) div (l_ * r_)"
#: Bits of the array that says which phrases of a length may be frequent (4 MB), bytes of text that a task counts at once, and rows that
#: it sends at once.
BITS, CHUNK, SENT = 1 << 25, 2 << 20, 100_000
#: Bytes of runs that a task counts at once, and of text whose words it holds at once.
RUNS, SPLIT = 8 << 20, 1 << 20
#: Bits of the hashes that pairs are counted by, and places of the array in a block.
WIDE, BLOCK = 40, 1 << 19
#: The mark between pieces: a separator, so it is never a word.
MARK = b"."
FOLD = bytes.maketrans(b",;:!?\n\x0b\x0c\r", MARK * 9)
STRIPES = "lang string, block int, prefixes array<string>, words array<string>, counts array<long>"
PLACES = "block int, places array<int>, counts array<long>"


class Numbers(dict):
    """Numbers of words in order of appearance, the mark first."""

    def __init__(self) -> None:
        super().__init__({MARK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(texts: list[bytes]) -> list[bytes]:
    """Words in lower case, with a mark for each separator and between texts."""
    return b" . ".join(t.lower().translate(FOLD).replace(MARK, b" . ") for t in texts).split()


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seed = crc32(lang.encode())
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def places_of(hashes: list[np.ndarray]) -> np.ndarray:
    """A hash of `WIDE` bits of each phrase, given the hashes of its first words, second words and so on; its low bits are the
    phrase's place in a bit array."""
    h = np.zeros(len(hashes[0]), np.uint64)
    for x in hashes:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h & np.uint64((1 << WIDE) - 1)).astype(np.int64)


def held(bits: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    places = places_of(hashes) & (32 * len(bits) - 1)
    return (bits[places >> 5] >> (places & 31).astype(np.uint32)) & np.uint32(1) > 0


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) of about `most` bytes; all languages come when they hold four times that together, and at the end."""
    waiting: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = (text.as_py() or "").encode()
            waiting.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 8
            if size[lang] > most:
                yield lang, waiting.pop(lang)
                del size[lang]
            elif sum(size.values()) > 4 * most:
                yield from waiting.items()
                waiting, size = {}, {}
    yield from waiting.items()


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The numbers of all words, and the words by number. Words are held as such for about `SPLIT` bytes of text at a time."""
    numbers, parts, some, size = Numbers(), [], [], 0
    for i, t in enumerate(texts):
        some.append(t)
        size += len(t)
        if size > SPLIT or i == len(texts) - 1:
            words = words_of(some)
            parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
            some, size = [], 0
    return np.concatenate(parts), list(numbers)


def _pairs(ids: np.ndarray) -> np.ndarray:
    """For each place, whether a pair of words begins there."""
    return (ids[:-1] > 0) & (ids[1:] > 0)


def _hashes(ids: np.ndarray, of_word: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Hashes of the first words, second words and so on of phrases of `size` words at `at`."""
    return [of_word[ids[at + j]] for j in range(size)]


def _longer(ok: np.ndarray, ids: np.ndarray, of_word: np.ndarray, size: int, bits: np.ndarray) -> np.ndarray:
    """For each place, whether a phrase of `size` words that may be frequent begins there; `ok` tells that of its parts."""
    out = ok[:-1] & ok[1:]
    at = np.flatnonzero(out)
    out[at] = held(bits, _hashes(ids, of_word, at, size))
    return out


def counted(texts: list[bytes], lang: str) -> Iterator[pa.RecordBatch]:
    """The root stripe of some texts, and the counts of their pairs by hash."""
    ids, words = _numbered(texts)
    n_words = np.bincount(ids, minlength=len(words))[1:]
    of_word = word_hashes(words, lang)
    pairs, n_pairs = np.unique(places_of(_hashes(ids, of_word, np.flatnonzero(_pairs(ids)), 2)), return_counts=True)
    columns = [[pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n_words), np.int64))), pa.nulls(len(pairs), pa.string())], [pa.array(words[1:], pa.binary()).cast(pa.string()), pa.nulls(len(pairs), pa.string())]]
    columns += [[pa.nulls(len(n_words), pa.int64()), pa.array(pairs, pa.int64())], [pa.array(n_words, pa.int64()), pa.array(n_pairs, pa.int64())]]
    yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], ["lang", "word", "pair", "n"])


def placed(texts: list[bytes], lang: str, size: int, bits: list[np.ndarray], n_bits: int, least: int) -> Iterator[pa.RecordBatch]:
    """Counts, up to `least`, of phrases of `size` words, three or more, in runs by place, a row for each block of places. `bits`: for
    three words and each length up to `size` - 1, which may be frequent."""
    ids, words = _numbered(texts)
    of_word, ok = word_hashes(words, lang), _pairs(ids)
    for m, some in enumerate(bits, 3):
        ok = _longer(ok, ids, of_word, m, some)
    at = np.flatnonzero(ok[:-1] & ok[1:])  # both parts of the phrase
    places, counts = np.unique(places_of(_hashes(ids, of_word, at, size)) & (n_bits - 1), return_counts=True)
    blocks, first = np.unique(places // BLOCK, return_index=True)
    ends = pa.array(np.append(first, len(places)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array((places % BLOCK).astype(np.int32)), pa.array(np.minimum(counts, least).astype(np.int64)))]
    yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), *lists], ["block", "places", "counts"])


def stripes_of(texts: list[bytes], lang: str, longest: int, bits: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The entries of stripes of prefixes of 1 to `longest` - 1 words in runs, a row for each length and block of places. `bits`: for
    three words and each length up to `longest`, which may be frequent."""
    ids, words = _numbered(texts)
    names = pa.array(words, pa.binary()).cast(pa.string())
    of_word, ok = word_hashes(words, lang), _pairs(ids)
    for size in range(1, longest):
        if size > 1:
            ok = _longer(ok, ids, of_word, size + 1, bits[size - 2])
        at = np.flatnonzero(ok)
        # numbers of prefixes, made word by word, then of (prefix, next word)
        code = ids[at]
        for j in range(1, size):
            code = np.unique(code * len(words) + ids[at + j], return_inverse=True)[1]
        first, code = np.unique(code, return_index=True, return_inverse=True)[1:]
        pairs, some, counts = np.unique(code * len(words) + ids[at + size], return_index=True, return_counts=True)
        blocks = (places_of(_hashes(ids, of_word, at[some], size + 1)) & (BITS - 1)) // BLOCK
        order = np.argsort(blocks, kind="stable")
        heads, nexts = np.divmod(pairs[order], len(words))
        parts = [names.take(pa.array(ids[at[first] + j])) for j in range(size)]
        prefix = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
        blocks, starts = np.unique(blocks[order], return_index=True)
        ends = pa.array(np.append(starts, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (prefix.take(pa.array(heads)), names.take(pa.array(nexts)), pa.array(counts[order], pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(blocks), pa.string()), pa.array(blocks.astype(np.int32)), *lists], ["lang", "block", "prefixes", "words", "counts"])


def runs_of(texts: list[bytes], lang: str, bits: np.ndarray) -> bytes:
    """Texts cut to the words of pairs that may be frequent, with a mark between runs."""
    ids, words = _numbered(texts)
    ok = _pairs(ids)
    at = np.flatnonzero(ok)
    ok[at] = held(bits, _hashes(ids, word_hashes(words, lang), at, 2))
    joined = np.append(False, ok)  # this word and the one before it are in one pair
    at = np.flatnonzero(joined | np.append(ok, False))
    out = []
    for i, new in zip(ids[at].tolist(), (~joined[at]).tolist()):
        if new:
            out.append(MARK)
        out.append(words[i])
    return b" ".join(out)


def _mapped(texts: DataFrame, make: Callable[[str, list[bytes]], Iterator[pa.RecordBatch]], schema: str, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, some in chunks(batches, chunk):
            for made in make(lang, some):
                for at in range(0, made.num_rows, SENT):
                    yield made.slice(at, SENT)
                del made
            pa.default_memory_pool().release_unused()  # workers stay for later tasks

    return texts.mapInArrow(run, schema)


def entries(runs: DataFrame, longest: int, bits, least: int, chunk: int = RUNS) -> DataFrame:
    """(lang, prefix, word, n): the merged stripes of phrases of 2 to `longest` words that reach `least`; `bits` is a broadcast of
    `stripes_of`'s. A block of the phrases of a language is a group."""

    def merged(rows: pa.Table) -> pa.Table:
        each = pa.table({k: rows.column(c).combine_chunks().flatten() for k, c in (("prefix", "prefixes"), ("word", "words"), ("n", "counts"))})
        sums = each.group_by(["prefix", "word"]).aggregate([("n", "sum")]).rename_columns(["prefix", "word", "n"])
        sums = sums.filter(pc.field("n") >= least)
        return sums.add_column(0, "lang", pa.array([rows.column("lang")[0].as_py()] * len(sums), pa.string()))

    rows = _mapped(runs, lambda lang, some: stripes_of(some, lang, longest, bits.value), STRIPES, chunk)
    return rows.groupBy("lang", "block").applyInArrow(merged, "lang string, prefix string, word string, n long")


def frequent_places(runs: DataFrame, size: int, bits, n_bits: int, least: int, chunk: int = RUNS) -> np.ndarray:
    """The bit array of phrases of `size` words, three or more, whose place reaches `least`; `bits` is a broadcast of those of shorter
    phrases. A block of the array is a group; its bits come to the driver."""
    span = min(BLOCK, n_bits)

    def merged(rows: pa.Table) -> pa.Table:
        places, counts = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("places", "counts"))
        hit = np.bincount(places, counts, span) >= least
        return pa.table({"block": rows.column("block")[:1], "bits": pa.array([np.packbits(hit, bitorder="little").tobytes()], pa.binary())})

    rows = _mapped(runs, lambda lang, some: placed(some, lang, size, bits.value, n_bits, least), PLACES, chunk)
    out = np.zeros(n_bits // 8, np.uint8)
    for row in rows.groupBy("block").applyInArrow(merged, "block int, bits binary").toArrow().to_pylist():
        out[row["block"] * span // 8 :][: span // 8] = np.frombuffer(row["bits"], np.uint8)
    return out.view("<u4")


def phrase() -> Column:
    return F.concat("prefix", F.lit(" "), "word")


def _broadcast_bits(places: DataFrame, n_bits: int):
    """The bit array of hashes in the column `place`; at most `n_bits` / 32 rows come to the driver."""
    place = F.col("place").bitwiseAND(n_bits - 1)
    rows = places.select(F.shiftright(place, 5).alias("at"), F.expr("shiftleft(1L, cast(place & 31 as int))").alias("bit"))
    merged = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(n_bits // 32, np.uint32)
    bits[merged["at"].to_numpy(np.int64)] = merged["bits"].to_numpy(np.int64).astype(np.uint32)
    return places.sparkSession.sparkContext.broadcast(bits)


def stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, n_bits: int = BITS, chunk: int = CHUNK, runs_chunk: int = RUNS) -> tuple[DataFrame, DataFrame]:
    """The root stripe (lang, word, n) and the entries (lang, prefix, word, n) of phrases of 2 to `longest` words that reach `least`,
    written once."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    scan = _mapped(texts, lambda lang, some: counted(some, lang), "lang string, word string, pair long, n long", chunk)
    scan = scan.groupBy("lang", "word", "pair").agg(F.sum("n").alias("n")).filter(F.col("word").isNotNull() | (F.col("n") >= least))
    scan = materialize(scan, "words")
    bits = _broadcast_bits(scan.filter("pair is not null").select(F.col("pair").alias("place")), n_bits)

    def cut(lang: str, some: list[bytes], bits=bits) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"lang": [lang], "text": [runs_of(some, lang, bits.value).decode()]})

    dealt = materialize(_mapped(texts, cut, "lang string, text string", chunk), "runs")  # once: a deal by range reads twice
    runs = materialize(dealt.repartitionByRange("lang", F.xxhash64("text")), "runs")
    discard(dealt)
    bits.destroy()
    longer: list[np.ndarray] = []
    for size in range(3, longest + 1):
        bits = docs.sparkSession.sparkContext.broadcast(longer)
        longer = [*longer, frequent_places(runs, size, bits, n_bits, least, runs_chunk)]
        bits.destroy()
    bits = docs.sparkSession.sparkContext.broadcast(longer)
    below = materialize(entries(runs, longest, bits, least, runs_chunk), "stripes")
    bits.destroy()
    return scan.filter("word is not null").select("lang", "word", "n"), below


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, n_bits: int = BITS, chunk: int = CHUNK, runs_chunk: int = RUNS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of 2 to `longest` words."""
    root, below = stripes(docs, text_col, lang_col, least, longest, n_bits, chunk, runs_chunk)
    whole = root.groupBy("lang").agg(F.sum("n").alias("n"))
    listed = materialize(below.select("lang", phrase().alias("phrase"), F.col("n").alias("a")), "phrases")
    right = below.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("n").alias("right"))
    left = listed.groupBy("lang", F.regexp_replace("phrase", "^[^ ]+ ", "").alias("phrase")).agg(F.max("a").alias("left"))
    kept = listed.join(left, ["lang", "phrase"], "left").join(right, ["lang", "phrase"], "left")
    kept = kept.filter(F.greatest(F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0))) < F.col("a")).select("lang", "phrase", "a")

    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = kept.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    counts = materialize(root.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")).unionByName(listed), "counts")
    sums = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    cuts = cuts.join(sums("first", "l"), ["lang", "first"]).join(sums("rest", "r"), ["lang", "rest"]).join(whole, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in "alrn"}
    scored = cuts.withColumns({f"{c}_": x for c, x in wide.items()}).withColumn("score", F.expr(SCORE))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
