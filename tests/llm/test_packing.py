import random
import zlib

import numpy as np
from noteloom.llm import packing as P
from noteloom.llm.tokens import Vocabulary, default_path, words_of
from pyspark.sql import functions as F


def fuzz(n, seed):
    """Texts of signs from all planes, with many stops, cases, combining marks and special strings."""
    rng = random.Random(seed)
    signs = [chr(i) for i in range(0x250)] + list("'s't're  \n\t abcABC.,") * 8 + list("—‘…İΣſ中é́ 　\x1c\x1f😀̧͔ß") + ["<|endoftext|>", "<|ENDOFTEXT|>", "word, ", "end. ", "İ.", "İ,", "EVİ. ", "É! ", "1977, "] * 3
    anywhere = lambda: chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)]))
    return ["".join(anywhere() if k % 2 and rng.random() < 0.4 else rng.choice(signs) for _ in range(rng.randint(0, 30))) for k in range(n)]


def test_ids_are_the_librarys():
    v = Vocabulary(default_path(), cache=40_000)
    texts = ["İ.", "İ,", "GİBİ, EVİ. OLDUĞU", "<|ENDOFTEXT|>.", "word<|endoftext|>,", "word," * 300] + fuzz(20_000, 4)
    got = [y for i in range(0, len(texts), 50) for y in v.ids(texts[i : i + 50])]
    want = v.library.encode_batch_fast(texts, add_special_tokens=False)
    for t, x, w in zip(texts, got, want):
        assert np.frombuffer(x, "<u4").tolist() == w.ids, t
        cut = [p for y in words_of(t) for p in v.pieces(y)]
        assert sum(v.count_words(cut)) == len(w.ids), t
    assert v.size <= 40_000 + 30_000  # what one call added, at most


def test_bounds_and_best_fit():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 200):
        x = rng.integers(1, 100, n)
        bins, offsets, fill = P.best_fit_decreasing(x, 100)
        assert len(fill) >= P.lower_bound(x, 100)
        for b in range(len(fill)):
            own = sorted((int(o), int(k)) for o, k, c in zip(offsets, x, bins) if c == b)
            at = 0
            for o, k in own:
                assert o == at
                at += k
            assert at == fill[b] <= 100
    assert P.lower_bound(np.array([51] * 7), 100) == 7
    assert P.lower_bound(np.array([34] * 6), 100) == 3


def check(rows, documents, capacity):
    v = Vocabulary(default_path())
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in documents:
        ids = np.array(v.library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), capacity))
        for r in own:
            part = ids[r.start : r.start + capacity]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes())
    for own in by_bin.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by_bin)


def test_packing(spark):
    rng = random.Random(1)
    documents = [(i, " ".join(rng.choices(["the", "of", "naïve", "Antidisestablish", "x,", "end."], k=rng.choice([0, 3, 9, 20, 33, 150])))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "word " * 30_000)]
    docs = spark.createDataFrame([(*d, "x") for d in documents], "doc_id long, text string, piece string")
    pieces = P.materialize(P.token_pieces(docs, capacity=64))
    one = P.pack(pieces, 64).collect()
    bins = check(one, documents, 64)
    total = pieces.agg(F.sum("length")).first()[0]
    assert bins <= -(-total // 64) + 1
    many = P.pack(pieces, 64, part=40).collect()  # parts exchange what is loose
    assert check(many, documents, 64) <= bins + 3
    assert P.pack_documents(docs.limit(0)).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "d")] * 2, "doc_id long, text string")
    rows = P.pack_documents(docs).collect()
    assert len(rows) == 5 and len({(r.sequence_id, r.offset) for r in rows}) == 5
