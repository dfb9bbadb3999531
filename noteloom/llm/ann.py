"""Operator 5: nearest neighbours by additive quantisation.

Codebooks are full-dimensional: the first is fitted to a bounded sample of vectors (the `SAMPLE` with the smallest hashed
ids), each further one to what the ones before leave over, and then all are refitted together by least squares. A vector
is encoded by beam search over the codebooks and stored as one code for each, with the norm of what its code rebuilds.
Queries go to the stored codes in rounds of at most `QUERIES`, a bounded table that every task holds; neither codes nor
vectors are shuffled. A lookup table of products of the queries and the codewords scores every code of a batch, and the
best `DEPTH` of the batch (ties to the smaller id) are scored again by the vectors beside them, in double precision. Only
each query's `k` best of a batch are shuffled.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, nor do
rows without an id. Rows that repeat an id stay candidates of others but not of that id's query. An empty table gives an
empty table. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SAMPLE = 16_384
BOOKS, WORDS, BEAM = 16, 256, 4
NEAREST, EVERY = 20, 20
#: Best codes of a batch of candidates (Spark's Arrow batch, 10,000 rows by default) that are scored exactly.
DEPTH = 128
#: Queries of a round, 32 MB at 64 dimensions, and how many of them meet a batch's codes at once.
QUERIES, AT_ONCE = 65_536, 64
SEED = 5
SCHEMA = "query_id long, vec_id long, score double"


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def encode(x: np.ndarray, books: list[np.ndarray], beam: int = BEAM) -> np.ndarray:
    """Codes by beam search: after each codebook the `beam` partial codes with the least error stay."""
    n = len(x)
    codes = np.zeros((n, 1, 0), np.uint8)
    left = x[:, None, :].astype(np.float32)
    for book in books:
        book = book.astype(np.float32)
        error = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
        width = error.shape[1] * error.shape[2]
        flat = error.reshape(n, width)
        keep = min(beam, width)
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        path, word = best // len(book), best % len(book)
        codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        left = np.take_along_axis(left, path[:, :, None], 1) - book[word]
    return codes[:, 0, :]


def rebuilt(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = SEED) -> list[np.ndarray]:
    """Residual codebooks, then one joint least-squares refit of all codewords to the beam-search codes."""
    rng = np.random.default_rng(seed)
    out, left = [], x.astype(np.float64)
    for _ in range(books):
        book = k_means(left, words, rng)
        out.append(book)
        left = left - book[np.argmax(left @ book.T - 0.5 * (book**2).sum(1), axis=1)]
    codes = encode(x, out)
    at = np.cumsum([0] + [len(b) for b in out[:-1]])
    used = codes.astype(np.int64) + at
    size = sum(len(b) for b in out)
    gram, right = np.eye(size) * 1e-1, 1e-1 * np.concatenate(out)
    for i in range(used.shape[1]):
        np.add.at(right, used[:, i], x)
        for j in range(used.shape[1]):
            np.add.at(gram, (used[:, i], used[:, j]), 1.0)
    return np.split(np.linalg.solve(gram, right), at[1:])


def sound(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole.isNotNull() & whole & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0].d if sizes else 0))


def best_of(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, books: list[np.ndarray], k: int, depth: int) -> pd.DataFrame:
    """Each query's `k` best of a batch: candidates by lookup tables over their codes, ranks by the vectors."""
    order = np.argsort(ids, kind="stable")
    ids, x, codes, norm = ids[order], x[order], codes[order], norm[order]
    exact_norm = np.linalg.norm(x, axis=1)
    stretch = np.where(norm > 0, exact_norm / np.where(norm > 0, norm, 1), 1.0).astype(np.float32)  # what coding has shortened
    out = []
    for at in range(0, len(queries), AT_ONCE):
        q = queries[at : at + AT_ONCE]
        score = np.zeros((len(x), len(q)), np.float32)
        for m, book in enumerate(books):
            score += (book @ q.T).astype(np.float32)[codes[:, m]]  # the lookup tables of this codebook
        score = np.ascontiguousarray((score * stretch[:, None]).T)
        take = min(depth, len(x))
        for i, own in enumerate(score):
            own[ids == query_ids[at + i]] = -np.inf
            cut = -np.partition(-own, take - 1)[take - 1]
            best = np.flatnonzero(own > cut)
            best = np.concatenate([best, np.flatnonzero(own == cut)[: take - len(best)]])
            best = best[ids[best] != query_ids[at + i]]
            exact = (x[best] * q[i]).sum(1)
            top = np.lexsort((ids[best], -exact))[:k]
            out.append((np.full(len(top), query_ids[at + i]), ids[best][top], exact[top]))
    query_id, vec_id, score = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, every: int = EVERY, sample: int = SAMPLE, depth: int = DEPTH, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the `k` largest inner products found for each id divisible by `every`."""
    spark = df.sparkSession
    rows = sound(df, id_col, vector_col)
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(sample).toPandas()
    if some.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = spark.sparkContext.broadcast(train(np.array(some.v.tolist()), seed=SEED))

    def coded(frames):
        for f in frames:
            if len(f):
                codes = encode(np.array(f.v.tolist()), books.value)
                yield f.assign(codes=[c.tobytes() for c in codes], norm=np.linalg.norm(rebuilt(codes, books.value), axis=1))

    stored = materialize(rows.mapInPandas(coded, "vec_id long, v array<double>, codes binary, norm double"), "codes")
    asked = materialize(stored.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("q")), "queries")
    rounds = max(1, -(-asked.count() * 5 // (4 * queries)))  # a fifth of room, as hashes fill rounds unevenly
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for number in range(rounds):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == number).toPandas()
        table = spark.sparkContext.broadcast((own.vec_id.to_numpy(), np.array(own.q.tolist())))

        def search(frames, table=table):
            for f in frames:
                if len(f) and len(table.value[0]):
                    codes = np.frombuffer(b"".join(f.codes), np.uint8).reshape(len(f), -1)
                    yield best_of(f.vec_id.to_numpy(), np.array(f.v.tolist()), codes, f.norm.to_numpy(), *table.value, books.value, k, depth)

        found = materialize(stored.mapInPandas(search, SCHEMA).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "nearest")
        table.unpersist()
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", "rank", "vec_id", "score")
