import numpy as np
import pytest
import xxhash
from noteloom.llm import simhash as S
from pyspark.sql import functions as F


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprint():
    for t in (None, "", " \t", "One", "a b", "A b C", "the cat sat on the mat the cat sat", "É b c d É b c d", "x " * 5000):
        assert S.fingerprint(t) == brute_fingerprint(t), t


def test_spark_hashes_alike(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b cde fgh ijk lmn opq")).alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("a b cde fgh ijk lmn opq", 42)


@pytest.mark.parametrize("n", [3, 70, 1000])
def test_index_finds_all_pairs(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    x = base[rng.integers(0, 5, n)]
    for _ in range(3):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    x = np.unique(x)
    rank = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    x = x[np.argsort(rank)]
    i, j = S.near_pairs(x)
    a, b = np.triu_indices(len(x), 1)
    near = np.bitwise_count(x[a] ^ x[b]) <= 2
    assert set(zip(i.tolist(), j.tolist())) == set(zip(a[near].tolist(), b[near].tolist()))


@pytest.mark.parametrize("leaf", [48, 1024])
def test_components_match_brute_force(spark, leaf):
    rng = np.random.default_rng(leaf)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2)
    x = base[rng.integers(0, 4, 300)]
    for _ in range(3):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    rows = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x.view(np.int64).tolist())], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in S.with_components(rows, leaf).collect()}
    want = brute_components(x.tolist())
    assert [got[i] for i in range(300)] == want


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "alpha beta gamma delta"), (3, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, "other words here now"), (4, "long " * 30000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in S.near_duplicates(docs).collect()}
    assert got[(1, "0" * 16)] == got[(2, "0" * 16)] == 1
    assert {v for (d, _), v in got.items() if d is None} == {3, None}
    kept = S.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(0, "other"), (1, ""), (3, "alpha"), (4, "long ")]
    assert S.near_duplicates(docs.limit(0)).count() == 0


def brute_copies(texts):
    """Components over five-word Jaccard similarities of 0.8 or more."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_corpus_loses_all_near_copies(spark):
    rng = np.random.default_rng(8)
    word = lambda: "w" + str(rng.integers(0, 5000))
    texts = []
    for n in (20, 60, 120, 240, 400):
        base = [word() for _ in range(n)]
        for k in (0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 12, 20):  # words replaced: similarities from 1 to under 0.8
            w = list(base)
            for at in rng.choice(n, k, replace=False):
                w[at] = word()
            texts.append(" ".join(w))
        texts += [" ".join(base[: n * 9 // 10]), " ".join(base[n // 3 :]), " ".join(base).upper() + "\n"]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(brute_copies(texts))
    assert 20 < len(want) < len(texts) - 20
    assert {r.doc_id for r in S.without_near_copies(docs).collect()} == want


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    """A chain of near copies whose ends are far apart, and look-alikes under the threshold, in bands of hundreds."""
    rng = np.random.default_rng(5)
    word = lambda: "w" + str(rng.integers(0, 50_000))
    base = [word() for _ in range(120)]
    texts = []
    for k in range(60):  # each step replaces a word of the one before
        texts.append(" ".join(base))
        base[k * 2] = word()
    base = [word() for _ in range(120)]
    for _ in range(150):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            w[at] = word()
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(int(i), texts[i]) for i in rng.permutation(len(texts))], "doc_id long, text string")
    want = set(brute_copies(texts))
    assert 5 < len(want) < 150
    for small, block in ((4, 16), (1, 512)):
        monkeypatch.setattr(S, "SMALL", small)
        monkeypatch.setattr(S, "BLOCK", block)
        assert {r.doc_id for r in S.without_near_copies(docs).collect()} == want


def test_intersections_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(S, "COLUMNS", 7)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)] + [np.arange(50, dtype=np.uint64)] * 2
    root = np.arange(len(sets)) // 2
    got = set(zip(*(x.tolist() for x in S.alike_in_block(sets, root))))
    assert got == {(i, j) for j in range(len(sets)) for i in range(j) if root[i] != root[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}


def test_corpus_pairs_come_from_the_index(spark, monkeypatch):
    """Without any band: texts of one fingerprint, or within two bits, meet through the index; the exact similarity confirms."""
    rng = np.random.default_rng(4)
    word = lambda: "w" + str(rng.integers(0, 50_000))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(900)]
        texts += [" ".join(base), " ".join(base[:-1] + [word()]), " ".join(base[:-2] + [word(), word()])]
    texts += ["one two three", "one two three four five", "", " "]
    prints = [brute_fingerprint(t) for t in texts]
    alike = brute_copies(texts)
    near = {(i, j) for j in range(len(texts)) for i in range(j) if bin(prints[i] ^ prints[j]).count("1") <= 2 and alike[i] == alike[j]}
    assert len(near) > 40
    sets = spark.createDataFrame([(i, S._signed(p), t) for i, (p, t) in enumerate(zip(prints, texts))], "fp long, print long, text string")
    got = {tuple(r) for r in S.index_links(sets, leaf=8).collect()}
    # the index sends on a spanning forest of its links: ends of an edge may be joined by a chain
    assert all(alike[i] == alike[j] for i, j in got) and 30 < len(got) <= len(texts)
    label = list(range(len(texts)))
    for i, j in got:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    assert all(label[i] == label[j] for i, j in near)
    monkeypatch.setattr(S, "copy_links", lambda sets, known: known)
    kept = {r.doc_id for r in S.without_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept >= set(alike) and len(kept) < len(texts) - 30
