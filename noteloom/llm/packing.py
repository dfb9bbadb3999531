"""Operator 8: best-fit packing with certified bin counts.

1. Documents become token pieces (ids and a closing 0), cut only where they are longer than the capacity.
2. Pieces are dealt by number to parts of bounded size; each part is packed by best-fit decreasing.
3. Dual feasible functions over a part's lengths bound its bin count from below. A part that meets the bound is certified.
   Parts with a gap release all bins that are not full, and every part releases its bins that are a quarter empty;
   released pieces are dealt anew, across parts, and packed again, until a round saves no bin.

Nulls: a null text is empty (one piece: the closing 0); null ids are kept. Repeated rows are packed each by itself. A very
long text is cut into whole sequences and one shorter piece. Pieces of equal length go by row number, bins of equal room
by the latest, so a rerun packs alike. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .tokens import default_path, vocabulary

CAPACITY = 2048
#: Pieces in a part: what one task holds at once.
PART = 100_000
SCHEMA = "rid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"
PACKED = SCHEMA + ", sequence_id long, offset long, fill long, certified boolean"


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(rid, doc_id, piece, start, length, ids_crc32[, ids binary]): each document's pieces of at most `capacity` tokens."""
    path = tokenizer or default_path()
    names = ["rid", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(vocab.ids([t or "" for t in part.column(2).to_pylist()])):
                    ids += b"\0\0\0\0"
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        x = ids[a : a + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                        if with_ids:
                            kept.append(x)
                index = pa.array(row, pa.int64())
                own = [part.column(0).take(index), part.column(1).take(index), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(kept, pa.binary())] * with_ids], names)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, SCHEMA.format(kind=kind) + ", ids binary" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound of two families of dual feasible functions on the bins that these lengths need."""
    count = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    items, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * x)])
    for k in range(1, capacity // 2 + 1):  # lengths over capacity - k count whole, those under k not at all
        large = items[capacity + 1] - items[capacity - k + 1]
        middle = mass[capacity - k + 1] - mass[k]
        best = max(best, int(large) - (-int(middle) // capacity))
    for k in range(1, 101):  # (k + 1) x rounded down to whole shares of k; whole shares of k + 1 stay as they are
        y = (k + 1) * x
        scaled = np.where(y % capacity == 0, x * k, y // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's fill. Longest first, each into the fullest bin that takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted, those with a bin
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            free = rooms[at]
            own = room[free]
            b = own.pop()
            if not own:
                rooms.pop(at)
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        free -= n
        if free:
            if not room.get(free):
                room[free] = []
                bisect.insort(rooms, free)
            room[free].append(b)
    return bins, offsets, np.array(fill, np.int64)


def _packed(pieces: DataFrame, parts: int, number: int, capacity: int, kind: str) -> DataFrame:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf.part.iloc[0])
        pdf = pdf.sort_values(["rid", "piece"], kind="stable").reset_index(drop=True)  # the same whatever order rows came in
        lengths = pdf.length.to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        return pdf.assign(sequence_id=((number << 24) + part << 32) + bins, offset=offsets, fill=fill[bins], certified=len(fill) == lower_bound(lengths, capacity)).drop(columns="part")

    own = ["rid", "doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = pieces.select(*own, F.pmod(F.xxhash64("rid", "piece", F.lit(number)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, PACKED.format(kind=kind))


def _bins(packed: DataFrame) -> int:
    return packed.filter("offset = 0").count()


def pack(pieces: DataFrame, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """Pieces (as from `token_pieces`, written already) with sequence_id, offset, fill and certified."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    whole = pieces.filter(F.col("length") == capacity).select(*SCHEMA_NAMES, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(capacity).cast("long").alias("fill"), F.lit(True).alias("certified"))
    rest = pieces.filter(F.col("length") < capacity)
    out = materialize(_packed(rest, max(1, -(-rest.count() // part)), 0, capacity, kind), "packed")
    for number in range(1, 60):  # until a round saves nothing; sequence ids have six bits for its number
        loose = (F.col("fill") < capacity) & (~F.col("certified") | (F.col("fill") <= capacity * 3 // 4))
        released, kept = out.filter(loose), out.filter(~loose)
        n = released.count()
        before = _bins(released) if n else 0
        if before < 2:
            break
        again = materialize(_packed(released, -(-n // part), number, capacity, kind), "packed")
        if _bins(again) >= before:
            discard(again)
            break
        out = kept.unionByName(again)
    return out.unionByName(whole)


SCHEMA_NAMES = ["rid", "doc_id", "piece", "start", "length", "ids_crc32"]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokens of all documents in sequences of at most `capacity`: one row per piece with its place."""
    pieces = materialize(token_pieces(docs, id_col, text_col, tokenizer, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
