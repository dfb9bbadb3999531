"""Operator 13: lines that many documents share are dropped, in DataFrame functions only.

A line's key is the line without blanks at its ends and with A-Z in lower case. Each document's distinct keys are exploded
and hashed (two 64-bit hashes, so that keys of unlike lines do not meet), and documents are counted per hash, first inside
each task. Places of lines whose hash reaches the threshold are joined back by that hash, gathered per document, and the
document is put together again by position from the stretches between them.

Only hashes and places are shuffled by line; a text is shuffled once, to its places. The counts are partial sums, and the
join by hash is a plain one, which Spark splits where one line stands in a large share of all documents. What one task
holds is one document.

Nulls: a null text is one empty line and stays null in `deduplicated`; null ids are kept. Empty keys (blank lines) are never
dropped. A document is a row: repeated rows count as often as they stand. Lines of equal keys fall together, so there are
no ties. A document that loses all its lines becomes empty. An empty table gives an empty table. Extra columns are kept by
`deduplicated`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import let, materialize

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents that a line has to stand in, and code points that its key has at least.
LEAST, SHORTEST = 10, 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case; `lower` would change other letters too."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def hashes(*xs: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), *xs) for k in (1, 2)]


def shared_lines(docs: DataFrame, text_col: str, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """(h1, h2, n_docs) of the keys that stand in `least` documents or more."""
    keys = F.array_distinct(F.transform(lines_of(F.col(text_col)), line_key))
    each = docs.select(F.explode(keys).alias("key")).filter(F.length("key") >= shortest)
    h1, h2 = hashes(F.col("key"))
    return each.select(h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least)


def dropped_places(docs: DataFrame, keys: list[str], text_col: str, shared: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """`keys` of each document that loses lines, with the ascending places (from 0) of those lines."""
    each = docs.select(*keys, F.posexplode(F.transform(lines_of(F.col(text_col)), line_key)).alias("place", "key")).filter(F.length("key") >= shortest)
    h1, h2 = hashes(F.col("key"))
    each = each.select(*keys, "place", h1.alias("h1"), h2.alias("h2"))
    found = each.join(shared.select("h1", "h2"), ["h1", "h2"])
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set("place")).alias("places"))  # equal rows share their places


def remaining(lines: Column, places: Column) -> Column:
    """Lines that stand at none of the ascending places: the stretches between them, in time linear in the lines."""
    after = F.concat(F.array(F.lit(-1)), places)
    before = F.concat(places, F.array(F.size(lines)))
    return F.flatten(F.zip_with(after, before, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def planned(docs: DataFrame, text_col: str = "text", least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """(row, n_lines, n_dropped, kept): each row of `docs` as a struct, with its number of lines, how many go, and the text
    that is left ("" where none or null)."""
    names = ["line_doc1", "line_doc2"]
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("line_text"))
    # the same row always gets the same key, whichever task reads it; rows that share one have equal texts
    own = [F.col("row")[f.name] for f in docs.schema if isinstance(f.dataType, AtomicType) and f.name != text_col]
    rows = rows.select(*[h.alias(n) for h, n in zip(hashes(F.col("line_text"), *own), names)], "row", "line_text")
    shared = materialize(shared_lines(docs.select(text.alias("t")), "t", least, shortest), "shared_lines")
    drops = dropped_places(rows, names, "line_text", shared, shortest)
    joined = rows.drop("line_text").join(drops, names, "left")
    none = F.array().cast("array<int>")

    def cut(x: Column) -> Column:
        kept = F.when(F.size(x["places"]) > 0, F.array_join(remaining(x["lines"], x["places"]), "\n")).otherwise(x["text"])
        return F.struct(F.size(x["lines"]).cast("long").alias("n_lines"), F.size(x["places"]).cast("long").alias("n_dropped"), kept.alias("kept"))

    own_text = F.coalesce(F.col("row")[text_col], F.lit(""))
    made = let(F.struct(lines_of(own_text).alias("lines"), own_text.alias("text"), F.coalesce("places", none).alias("places")), cut)
    return joined.select("row", made.alias("made")).select("row", "made.n_lines", "made.n_dropped", "made.kept")


def deduplicated(docs: DataFrame, text_col: str = "text", least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """`docs` without the lines that `least` documents or more share."""
    plan = planned(docs, text_col, least, shortest)
    new = F.when(F.col("row")[text_col].isNotNull(), F.col("kept"))
    return plan.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped and kept_sha256 of the text that is left."""
    plan = planned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", least, shortest)
    return plan.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
