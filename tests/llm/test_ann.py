import numpy as np
from noteloom.llm import ann as A


def exact(ids, x, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(1)
        keep = np.flatnonzero(ids != ids[q])
        order = keep[np.lexsort((ids[keep], -s[keep]))][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_recall_and_scores(spark):
    """Recall over rows that the codebooks were not fitted to (half of them), a fiftieth of each batch reranked."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 64)).astype("f4").astype("f8")
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score int")
    want = exact(np.arange(6000), x, 20)
    got = A.nearest(df.repartition(2), depth=60, queries=200, sample=3000).collect()
    assert len(got) == 300 * 20
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(abs(s - float((x[q] * x[v]).sum())) < 1e-12 for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 6000


def test_edge_rows(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(0, v), (1, v), (2, v), (2, v), (3, None), (4, [0.0] * 3), (5, [1.0, None, 2.0]), (6, [float("nan")] * 3), (7, [1.0]), (None, v), (20, [3.0, 1.0, 0.0]), (21, [float("inf")] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in A.nearest(df).collect())
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 2, 5.0), (0, 4, 20, 3.0), (20, 1, 0, 3.0), (20, 2, 1, 3.0), (20, 3, 2, 3.0), (20, 4, 2, 3.0)]
    assert A.nearest(df.limit(0)).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    books = A.train(x, 3, 16)
    error = lambda beam: ((x - A.rebuilt(A.encode(x, books, beam), books)) ** 2).sum()
    assert error(8) <= error(1)
