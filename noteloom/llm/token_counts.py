"""Operator 10: token counts by counting each distinct pre-token once.

1. One scan counts pre-tokens (counters of bounded size in each task, then a sum by pre-token). They are the words between
   white space without the signs at their ends, those signs, and, of what is longer than `LONGEST` characters (a page of
   Chinese without a space), the pieces that the library's own pre-tokeniser cuts. A single piece that is longer still is
   counted where it stands, so that keys and counters are bounded in bytes.
2. The library sees each distinct pre-token once; the result is a table (pretoken, n_tokens).
3. A second scan makes each document's pre-token frequencies. The `frequent` most frequent pre-tokens (a fixed number, so
   a table of bounded size in memory) are summed at once; frequencies of the others join the table on the pre-token, and
   no such key is frequent enough to be hot. Ids are never made.

Nulls: a null text counts as empty (0 bytes, 0 tokens); null ids are kept. Repeated rows stay rows. A very long text is
read whole and counted in memory in proportion to its distinct words. An empty table gives an empty table. Extra columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import LONGEST, default_path, stem, vocabulary, words_of

#: Entries that a counter holds before a task sends it on; a pre-token has `LONGEST` characters at most.
COUNTER = 400_000
FREQUENT = 100_000


def pretokens(words: Counter, pieces: Callable[[str], list[str]]) -> tuple[Counter, list[tuple[str, int]]]:
    """Frequencies of the pre-tokens of counted words, and those that are too long to be keys, each with its frequency."""
    out: Counter = Counter()
    long = []
    for w, n in words.items():
        if len(w) > LONGEST:
            for p in pieces(w):
                if len(p) > LONGEST:
                    long.append((p, n))
                else:
                    out[p] += n
            continue
        core = stem(w)
        out[core] += n
        if core is not w:
            out[w[len(core) :]] += n
    return out, long


def _count_all(path: str) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "freq"])

        pieces = vocabulary(path).pieces
        seen: Counter = Counter()
        for b in batches:
            words: Counter = Counter()
            for t in b.column(0):
                words.update(words_of(t.as_py() or ""))
                if len(words) > COUNTER:
                    seen.update(pretokens(words, pieces)[0])
                    words = Counter()
                    yield send()
                    seen = Counter()
            seen.update(pretokens(words, pieces)[0])
            if len(seen) > COUNTER:
                yield send()
                seen = Counter()
        yield send()

    return count


def pretoken_table(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(pretoken, freq, n_tokens) for all distinct pre-tokens of all texts."""
    path = tokenizer or default_path()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vocab.count_words(b.column(0).to_pylist()), pa.int64())], ["pretoken", "freq", "n_tokens"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_all(path), "pretoken string, freq long")
    distinct = counted.groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return distinct.mapInArrow(sizes, "pretoken string, freq long, n_tokens long")


def frequent_from(table: DataFrame, most: int) -> float:
    """A frequency that at most `most` pre-tokens reach, from counts per step of 1/8 of a doubling (some hundred rows)."""
    step = F.ceil(F.log2("freq") * 8)
    rows = table.groupBy(step.alias("step")).agg(F.min("freq").alias("least"), F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    cut, total = float("inf"), 0
    for r in rows:
        total += r.n
        if total > most:
            break
        cut = r.least
    return cut


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    spark = docs.sparkSession
    path = tokenizer or default_path()
    table = materialize(pretoken_table(docs, text_col, path), "pretokens")
    top = table.filter(F.col("freq") >= frequent_from(table, frequent)).select("pretoken", "n_tokens").toPandas()
    hot = spark.sparkContext.broadcast(dict(zip(top.pretoken, map(int, top.n_tokens))))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, get = vocabulary(path), hot.value.get
        for b in batches:
            known, words, counts, ends = [], [], [], [0]
            for t in b.column(3):
                found = Counter(words_of(t.as_py() or ""))
                n_known, left = 0, Counter()
                for w, n in found.items():
                    k = get(w)
                    if k is None:
                        left[w] = n
                    else:
                        n_known += n * k
                left, long = pretokens(left, vocab.pieces)
                n_known += sum(n * k for (_, n), k in zip(long, vocab.count_words([p for p, _ in long])))
                for w, n in left.items():
                    k = get(w)
                    if k is None:
                        words.append(w)
                        counts.append(n)
                    else:
                        n_known += n * k
                known.append(n_known)
                ends.append(len(words))
            rest = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["pretoken", "n"])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(known, pa.int64()), rest], ["rid", "doc_id", "n_bytes", "known", "rest"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(split, f"rid long, doc_id {kind}, n_bytes long, known long, rest array<struct<pretoken:string,n:long>>")
    each = rows.select("rid", "doc_id", "n_bytes", "known", F.explode_outer("rest").alias("r")).select("rid", "doc_id", "n_bytes", "known", "r.n", F.coalesce("r.pretoken", F.concat(F.lit("\n"), "rid")).alias("pretoken"))  # documents without rare words spread by number; no pre-token begins with \n
    joined = each.join(table.select("pretoken", "n_tokens"), "pretoken", "left")
    total = joined.groupBy("rid", "doc_id", "n_bytes", "known").agg(F.sum(F.coalesce(F.col("n") * F.col("n_tokens"), F.lit(0))).alias("rare"))
    n = (F.col("known") + F.col("rare")).alias("n_tokens")
    return total.select(F.col("doc_id"), "n_bytes", n).withColumn("over_limit", F.col("n_tokens") > limit)
