"""Operator 4: SimHash near-duplicates with a Gray-order hierarchical index.

Equal fingerprints are one entry. The index's upper nodes are masked bit patterns: fingerprints within two bits agree on
at least one of three blocks, so the root's three children fix a block each, and entries that share a node's pattern lie
below it. A node with more than `LEAF` entries splits again, its free bits into three blocks, until it fits (free bits
shrink by a third each time, so it must), which spreads a hot pattern over many nodes without losing a link. Inside a leaf
entries stand in Gray order, where neighbours share most bits; runs of them form groups with the bits all members share,
and a search adds up the differences from group to group and drops a whole group when they pass the limit.

A leaf sends out only the edges of a spanning forest of the links that it found; components follow from rounds of large
and small stars over edges.

The corpus stage `without_near_copies` starts from the same fingerprints and index. Two texts are near copies where the sets
of their five-word shingles have a Jaccard similarity of 0.8 or more: the pairs that the index finds are confirmed by that, and
their components are where the rest begins. At 0.8 fingerprints differ in ten bits of 64 on average and often in 15, for which
the index would need blocks of four bits, so MinHash bands propose what lies beyond two bits, and only in bands whose members
the index has not joined already. The member of such a band that shares most bands with others is compared with all its members
of other components first, so that most members of a large group are one component already. Then all pairs of a band whose ends are still in different
components: in small bands as rows; of large bands, the members outside the largest component meet each other and that
component in blocks, where a product of matrices gives all intersections of shingle sets at once and only the edges of a
spanning forest leave the task.

Nulls: a null text is empty, and all empty texts share fingerprint zero; null ids are never a component's id unless all
its ids are null. Repeated rows stay rows. A very long text is read whole, its shingles in blocks of bounded size. Of rows
that tie in the smallest id, the first as stored stays. An empty table gives an empty table. Extra columns are kept by
`without_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, materialize

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Entries that a leaf holds at most, of which one task compares a leaf at a time.
LEAF = 1024
#: Neighbours in Gray order that form a group.
GROUP = 16
#: Near copies of the corpus stage: words of a shingle, least Jaccard similarity, bands of MinHash values and values of a
#: band. A pair at 0.8 shares a band with probability 1 - (1 - 0.8 ** 5) ** 24 = 0.9999.
COPY_SHINGLE, COPY, BANDS, VALUES = 5, 0.8, 24, 5
#: Members of a band whose pairs are rows; in larger bands, members of a block, shingles of a block, and shared shingles that
#: are multiplied at once.
SMALL, BLOCK, SHINGLES, COLUMNS = 32, 512, 1 << 20, 4096
#: Partners that a text meets in one group, at most on average.
PARTNERS = 512


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hashed word shingles of a text in order; a text of fewer words is one shingle, an empty one has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= size:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())), np.uint64, n - size + 1)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit majority of the hashed word shingles of a text, as an unsigned number."""
    hashes = shingle_hashes(text, size, seed)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column) -> Column:
    """Signed 64-bit fingerprints of a text column."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return simhash(text)


def gray_rank(x: Column) -> Column:
    """The place of a bit pattern in Gray order, as a signed number that sorts alike."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def split_mask(mask: int) -> list[int]:
    """The masks of a node's children: its own bits and a third of the free ones each."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [round(len(free) * k / (DISTANCE + 1)) for k in range(DISTANCE + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(x: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within `distance` bits among distinct patterns in Gray order."""
    n = len(x)
    if n <= 4 * GROUP:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(x[i] ^ x[j]) <= distance
        return i[near], j[near]
    levels = []  # from the bottom: each group's shared bits and their values
    shared, value = np.full(n, ~np.uint64(0)), x
    while len(shared) > GROUP:
        at = np.arange(0, len(shared), GROUP)
        differ = np.bitwise_or.reduceat(value ^ np.repeat(value[at], np.diff(np.append(at, len(value)))), at)
        shared = np.bitwise_and.reduceat(shared, at) & ~differ
        value = value[at]
        levels.append((shared, value))
    q, node = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(len(shared)), indexing="ij"))
    seen, apart = np.zeros(len(q), np.uint64), np.zeros(len(q), np.int64)
    for k in range(len(levels) - 1, -2, -1):
        shared, value = levels[k] if k >= 0 else (np.full(n, ~np.uint64(0)), x)
        if k < len(levels) - 1:  # to the children of the groups that are left
            node = (node[:, None] * GROUP + np.arange(GROUP)).ravel()
            q, seen, apart = (np.repeat(a, GROUP) for a in (q, seen, apart))
            there = node < len(shared)
            q, node, seen, apart = q[there], node[there], seen[there], apart[there]
        apart = apart + np.bitwise_count((x[q] ^ value[node]) & shared[node] & ~seen)
        left = apart <= distance
        q, node, apart = q[left], node[left], apart[left]
        seen = shared[node]
    once = q < node
    return q[once], node[once]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indices reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _leaf_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, fp) sorted by node and Gray rank to spanning edges (u, v) within nodes."""
    held: list[np.ndarray] = []

    def edges(mask: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))) if len(mask) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(mask)))
        x = fp.view(np.uint64)
        two = cut[size == 2]
        two = two[np.bitwise_count(x[two] ^ x[two + 1]) <= DISTANCE]
        u, v = [fp[two]], [fp[two + 1]]
        for a, n in zip(cut[size > 2].tolist(), size[size > 2].tolist()):
            i, j = near_pairs(x[a : a + n])
            if len(i):
                root = spanning(n, i, j)
                own = np.flatnonzero(root != np.arange(n))
                u.append(fp[a + root[own]])
                v.append(fp[a + own])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    for b in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        mask, value, _ = columns
        if not len(mask):
            continue
        last = int(np.flatnonzero((mask != mask[-1]) | (value != value[-1]))[-1] + 1) if (mask != mask[-1]).any() or (value != value[-1]).any() else 0
        if last:
            yield edges(*[c[:last].copy() for c in columns])
        held = [c[last:].copy() for c in columns]  # a node whose rows may go on in the next batch
    if held:
        yield edges(*held)


def links(distinct: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of `fp` within the distance."""
    masks, at, out = [0], distinct.select("fp", F.lit(0).cast("long").alias("mask")), None
    while True:
        children = {m: split_mask(m) for m in masks}
        masks = sorted({c for x in children.values() for c in x})
        lookup = F.create_map(*[y for m, x in children.items() for y in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in x]))])
        at = at.select("fp", F.explode(lookup[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = at.groupBy("mask", "value").count()
        hot = materialize(sizes.filter(F.col("count") > leaf).select("mask", "value"), "hot")
        n_hot = hot.count()
        small = at.join(hot, ["mask", "value"], "left_anti") if n_hot else at
        ordered = small.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", gray_rank(F.col("fp")))
        found = ordered.mapInArrow(_leaf_edges, "u long, v long")
        out = found if out is None else out.unionByName(found)
        if not n_hot:
            return out
        at = materialize(at.join(hot, ["mask", "value"], "left_semi").select("fp", "mask"), "hot")
        masks = [m % (1 << 64) for (m,) in hot.select("mask").distinct().collect()]  # at most 3 ** depth masks


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the edges (u, v), by rounds of large and small stars."""

    def stars(both: DataFrame, up: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        far = (both.filter("v > u") if up else both).join(least, F.col("u") == F.col("k"))
        out = far.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return (out if up else out.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))).filter("u <> v").distinct()

    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        large = stars(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        small = stars(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False)
        then, now = now, materialize(small, "edges")
        discard(then)
        new = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("u"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def with_components(rows: DataFrame, leaf: int = LEAF, edges: DataFrame | None = None) -> DataFrame:
    """(…, doc_id, fp), written already, with component (a fingerprint of it) and component_id (the smallest doc_id that a row
    reaches); over the given edges (u, v) between values of fp, or else over fingerprints within the distance."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    groups = components(links(distinct, leaf) if edges is None else edges)
    joined = distinct.join(groups.withColumnRenamed("u", "fp"), "fp")
    lowest = joined.groupBy("root").agg(F.min("low").alias("lowest"))
    moved = materialize(joined.join(lowest, "root").select("fp", "root", "lowest"), "components")
    named = distinct.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"), F.coalesce("lowest", "low").alias("component_id"))
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")), "simhash")
    return with_components(rows, leaf).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def signatures(text: Column) -> Column:
    """struct<a, b, n, bands, print> of a text: 128 bits that tell its shingle set, the set's size, its MinHash bands, and its
    fingerprint."""

    @F.pandas_udf("a long, b long, n long, bands array<long>, print long")
    def sign(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        odd = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * VALUES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        rows = []
        for t in texts:
            found = np.unique(shingle_hashes(t, COPY_SHINGLE))
            a, b = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist()
            least = np.full(BANDS * VALUES, ~np.uint64(0))
            for at in range(0, len(found), 1 << 12):
                least = np.minimum(least, (found[at : at + (1 << 12)] * odd).min(1))
            bands = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, VALUES))] if len(found) else []
            rows.append((a, b, len(found), np.array(bands, np.uint64).view(np.int64), _signed(fingerprint(t))))
        return pd.DataFrame(rows, columns=["a", "b", "n", "bands", "print"])

    return sign(text)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (hub, fp) of near copies among (hub, fp, slots), from (fp, text). A hub's partners are dealt over `slots` groups,
    each of which gets the hub's text once, so that a text with many partners is many small groups."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        sets: dict[str, np.ndarray] = {}
        out = []
        for pair in zip(a, b):
            for t in pair:
                if t not in sets:
                    sets[t] = np.unique(shingle_hashes(t, COPY_SHINGLE))
            x, y = sets[pair[0]], sets[pair[1]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= COPY * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    hubs = pairs.groupBy("hub").agg(F.max("slots").alias("slots"))
    dealt = texts.select(F.col("fp").alias("hub"), F.col("text").alias("hub_text")).join(hubs, "hub")
    dealt = dealt.select("hub", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "hub_text")
    asked = pairs.select("hub", "fp", F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int").alias("slot"))
    return asked.join(texts.select("fp", "text"), "fp").join(dealt, ["hub", "slot"]).filter(alike("hub_text", "text")).select("hub", "fp")


def shingle_set(text: Column) -> Column:
    """A text's sorted distinct shingle hashes as bytes."""

    @F.pandas_udf("binary")
    def distinct(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.unique(shingle_hashes(t, COPY_SHINGLE)).tobytes())

    return distinct(text)


def alike_in_block(sets: list[np.ndarray], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near copies with different roots, from all intersections of the sets."""
    n = np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), n), times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part @ part.T
    i, j = np.nonzero(np.triu(both >= COPY * (n[:, None] + n[None, :] - both), 1))
    apart = root[i] != root[j]
    return i[apart], j[apart]


def _block_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, kind, i, j, fp, root, shingles) sorted by block pair to spanning edges (u, v) between their members."""
    now, held = None, []

    def edges() -> pa.RecordBatch:
        fp, root = (np.array(x, np.int64) for x in zip(*[h[:2] for h in held]))
        i, j = alike_in_block([np.frombuffer(h[2], np.uint64) for h in held], root)
        label = spanning(len(held), i, j)
        own = np.flatnonzero(label != np.arange(len(held)))
        return pa.RecordBatch.from_arrays([pa.array(fp[label[own]]), pa.array(fp[own])], ["u", "v"])

    for b in batches:
        for *key, fp, root, shingles in zip(*[c.to_pylist() for c in b.columns]):
            if key != now:
                if held:
                    yield edges()
                now, held = key, []
            held.append((fp, root, shingles))
    if held:
        yield edges()


def block_links(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (u, v) whose components, with those of the roots, are those of all near copies of a band; from (band, fp, n, root)."""
    by_root = left.groupBy("band", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    largest = F.max_by(F.struct("root", "c", "s"), F.struct("c", "root"))
    bands = by_root.groupBy("band").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), largest.alias("m"))
    blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / SHINGLES)).cast("int")
    bands = bands.select("band", F.col("m.root").alias("main"), blocks(F.col("m.c"), F.col("m.s")).alias("nm"), blocks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("nr"))
    j = left.join(bands, "band").withColumn("rest", F.col("root") != F.col("main"))
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("rest"), F.col("nr")).otherwise(F.col("nm"))).cast("int")
    meet = lambda kind, i, k: F.struct(F.lit(kind).alias("kind"), i.alias("i"), k.alias("j"))
    to = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    outside = F.concat(to(F.col("nr"), lambda x: meet(0, F.least("own", x), F.greatest("own", x))), to(F.col("nm"), lambda x: meet(1, F.col("own"), x)))
    inside = to(F.col("nr"), lambda x: meet(1, x, F.col("own")))
    dealt = j.withColumn("own", own).select("band", F.explode(F.when(F.col("rest"), outside).otherwise(inside)).alias("m"), "fp", "root").select("band", "m.*", "fp", "root")
    sets = materialize(texts.join(left.select("fp").distinct(), "fp", "left_semi").select("fp", shingle_set(F.col("text")).alias("shingles")), "shingles")
    rows = dealt.join(sets, "fp").select("band", "kind", "i", "j", "fp", "root", "shingles")
    pair = ["band", "kind", "i", "j"]
    return rows.repartition(*pair).sortWithinPartitions(*pair, "fp").mapInArrow(_block_edges, "u long, v long")


def index_links(sets: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Edges (u, v) of near copies among the pairs that the fingerprints' index finds; from (fp, print, text). Texts of one
    fingerprint meet the first of them, which stands for it in the index."""
    prints = materialize(sets.groupBy("print").agg(F.min("fp").alias("hub"), F.count("*").alias("size")), "prints")
    same = sets.select("print", "fp").join(prints.filter("size > 1"), "print").filter("fp <> hub").select("hub", "fp")
    named = lambda end, name: prints.select(F.col("print").alias(end), F.col("hub").alias(name))
    near = links(prints.select(F.col("print").alias("fp")), leaf).distinct().join(named("u", "hub"), "u").join(named("v", "fp"), "v").select("hub", "fp")
    pairs = materialize(same.unionByName(near), "pairs")
    slots = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("slots"))
    ends = pairs.select("fp").union(pairs.select("hub")).distinct()
    texts = materialize(sets.select("fp", "text").join(ends, "fp", "left_semi"), "texts")
    found = materialize(confirmed(pairs.join(slots, "hub"), texts).select(F.least("hub", "fp").alias("u"), F.greatest("hub", "fp").alias("v")), "links")
    for x in (pairs, texts):
        discard(x)
    return found


def copy_links(sets: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (u, v) whose components, with those of the `known` edges, are those of all near copies that share a band; from
    (fp, n, bands, text)."""
    banded = materialize(sets.select("fp", "n", F.explode("bands").alias("band")), "bands")
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    begins = components(known).select(F.col("u").alias("fp"), F.col("root").alias("begin"))
    joined = materialize(banded.join(sizes, "band").join(begins, "fp", "left").withColumn("begin", F.coalesce("begin", "fp")), "bands")
    discard(banded)
    apart = joined.groupBy("band").agg(F.min("begin").alias("low"), F.max("begin").alias("high")).filter("low < high").select("band")
    shared = materialize(joined.join(apart, "band", "left_semi"), "bands")
    discard(joined)
    weight = materialize(shared.groupBy("fp").agg(F.sum("size").alias("weight")), "weights")
    texts = materialize(sets.select("fp", "text").join(weight, "fp", "left_semi"), "texts")
    # lengths alone rule out pairs that cannot reach the similarity
    close = F.least("n", "m") >= COPY * F.greatest("n", "m")
    ends = lambda x, y: (F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))

    # of a pair, the hub is the end with the greater (weight, fp) in every band; its weight is at least its number of partners
    first = shared.join(weight, "fp").groupBy("band").agg(F.max(F.struct("weight", "fp", "n", "begin")).alias("x"))
    first = first.select("band", F.col("x.fp").alias("hub"), F.col("x.n").alias("m"), F.col("x.begin").alias("hub_begin"), F.ceil(F.col("x.weight") / PARTNERS).cast("int").alias("slots"))
    begun = materialize(shared.join(first, "band").filter((F.col("begin") != F.col("hub_begin")) & close).select("hub", "fp", "slots").distinct(), "pairs")
    found = known.unionByName(materialize(confirmed(begun, texts).select(*ends("hub", "fp")), "links"))
    root = components(found).select(F.col("u").alias("fp"), "root")
    rooted = materialize(shared.join(root, "fp", "left").select("band", "fp", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
    left = materialize(rooted.join(mixed, "band", "left_semi"), "rooted")
    large = materialize(left.groupBy("band").count().filter(F.col("count") > SMALL).select("band"), "large")
    blocks = materialize(block_links(left.join(large, "band", "left_semi"), texts), "links")
    left = left.join(large, "band", "left_anti")
    other = left.select("band", F.col("fp").alias("gp"), F.col("n").alias("m"), F.col("root").alias("other"))
    more = left.join(other, "band").filter((F.col("root") < F.col("other")) & close).select(*ends("fp", "gp")).distinct().join(begun.select(*ends("hub", "fp")), ["u", "v"], "left_anti")
    # a text has at most `SMALL` partners in each of its bands here
    more = more.select(F.col("u").alias("hub"), F.col("v").alias("fp"), F.lit(1).alias("slots"))
    return found.unionByName(blocks).unionByName(materialize(confirmed(more, texts).select(*ends("hub", "fp")), "links"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, with its columns: that of the smallest id (of repeated rows, the first as stored)."""
    rid, sign = free_name(docs, "near_row"), free_name(docs, "near_sign")
    tagged = materialize(docs.withColumn(rid, F.monotonically_increasing_id()).withColumn(sign, signatures(F.col(text_col))), "tagged")
    each = tagged.select(F.col(rid).alias("rid"), F.col(id_col).alias("doc_id"), F.col(f"{sign}.a").alias("a"), F.col(f"{sign}.b").alias("b"))
    # texts of equal shingle sets are one entry, named by its first row
    entries = materialize(each.groupBy("a", "b").agg(F.min("rid").alias("fp")), "entries")
    rows = materialize(each.join(entries, ["a", "b"]).select("rid", "doc_id", "fp"), "rows")
    sets = tagged.select(F.col(rid).alias("fp"), F.col(f"{sign}.n").alias("n"), F.col(f"{sign}.bands").alias("bands"), F.col(f"{sign}.print").alias("print"), F.col(text_col).alias("text")).join(entries, "fp", "left_semi")
    grouped = materialize(with_components(rows, edges=copy_links(sets, index_links(sets))).select("rid", "doc_id", "component", "component_id"), "grouped")
    # a component's smallest id is that of the row to keep; among rows with that id (repeats, or all null) the first one stays
    first = grouped.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("rid").alias("first"))
    keep = first.select(F.col("first").alias(rid))
    return tagged.join(keep, rid, "left_semi").select(*docs.columns)
