from noteloom.llm import token_counts as T
from noteloom.llm.tokens import Vocabulary, default_path

from test_packing import fuzz


def test_counts_are_the_librarys(spark):
    texts = [None, "", "The cat, the CAT. the cat!", "naïve café — 中文 😀 Σσς İ", "<|endoftext|> a<|startoftext|>b", "a\x1cb \x1f c", "word " * 60_000, "İ. İ, EVİ. OLDUĞU", "<|ENDOFTEXT|>", "中文字，" * 3000, "字" * 5000 + ". a", "a\x1cb, " * 900, "x" * 5000 + "," * 400, "12345 x=1; don't they'll", ",,, ... a,b.c,", "  \n "] + [f"rare{i} common, words{i % 7}." for i in range(300)] + fuzz(2000, 5)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", ""), (2, texts[2], "")], "doc_id long, text string, known string")
    library = Vocabulary(default_path()).library
    for frequent in (100_000, 5, 0):
        got = T.count_tokens(docs, frequent=frequent).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            t = "a b" if r.doc_id is None else texts[r.doc_id] or ""
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048), t[:50]
    assert T.count_tokens(docs.limit(0)).count() == 0
