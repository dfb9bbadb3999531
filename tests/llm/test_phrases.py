import random
import re
from collections import Counter

import pytest
from noteloom.llm import phrases as P

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + m])) for m in range(1, 6) for i in range(len(ws) - m + 1))
    out = []
    for lang in n:
        found = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            cut = lambda k: (1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k)
            score, k = min(cut(k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(rng, n):
    words = ["New", "york", "city", "the", "of", "and", "é", "É", "straße", "A", "b\x1c", "\x85", "x" * 300, "日本"]
    fixed = ["New York City", "the end of the world", "a a a a a a", "State of the Union address today"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", "! ", " .. ", "?;:"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words if rng.random() < 0.6 else fixed) + rng.choice(ends) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return rows + [("en", None), ("fr", ""), ("fr", "..."), (None, None)]


@pytest.mark.parametrize("least, top", [(100, 2000), (5, 40), (1, 300)])
def test_against_brute_force(spark, least, top):
    rows = made(random.Random(least), 150)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n long").repartition(3)
    got = P.collocations(docs, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


def test_small_chunks_and_full_bits_change_nothing(spark):
    """Chunks of one text, and bits that are all set, so that nothing is pruned."""
    rows = made(random.Random(2), 60)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, P.collocations(docs, least=4, n_bits=32, chunk=100, runs_chunk=500).collect())) == brute(rows, 4)


def test_rare_phrases_of_frequent_pairs_make_no_entries(spark, monkeypatch):
    """30 words in random order: all 900 pairs are frequent, hardly any of 27,000 triples; entries are those of frequent phrases,
    and stripes come in blocks, not a row for each prefix."""
    rng = random.Random(3)
    rows = [("en", " ".join(f"w{rng.randrange(30)}" for _ in range(500)) + " x y z" * 3) for _ in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    made, inner = [], P._mapped

    def counted(texts, make, schema, chunk):
        out = inner(texts, make, schema, chunk)
        if "words array" in schema:
            made.extend(out.collect())
        return out

    monkeypatch.setattr(P, "_mapped", counted)
    assert sorted(map(tuple, P.collocations(docs, least=20).collect())) == brute(rows, 20)
    assert sum(len(r.words) for r in made) < 4000 and len(made) <= 2 * 4 * (P.BITS // P.BLOCK)


def test_scores_beyond_64_bits(spark):
    """(1000 a n) div (l r) is exact where the products pass 64 bits."""
    rng = random.Random(5)
    rows = [tuple(rng.randrange(10**11, 10**13) for _ in range(4)) for _ in range(50)]
    docs = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = docs.withColumns({f"{c}_": docs[c].cast("decimal(18,0)") for c in "alrn"}).selectExpr("a", "n", "l", "r", P.SCORE + " AS score").collect()
    assert len(got) == 50 and all(x.score == 1000 * x.a * x.n // (x.l * x.r) for x in got)


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([("en", "one two")] * 100, "lang string, text string")
    assert [tuple(r) for r in P.collocations(docs).collect()] == [("en", 1, "one two", 100, 100, 100, 200, 2000)]
    assert P.collocations(docs.limit(0)).count() == 0
