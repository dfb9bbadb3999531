import hashlib
import random
import re
from collections import Counter

from noteloom.llm.line_dedup import deduplicated, line_counts

ENDS = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return ENDS.sub("", line).translate(FOLD)


def brute(texts, least=10):
    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for lines in split for k in {key(x) for x in lines})
    out = []
    for lines in split:
        kept = [x for x in lines if not key(x) or n[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", {"a": i}) for i, t in enumerate(texts)], "doc_id long, text string, places string, row map<string,int>")
    want = brute(texts)
    got = {r.doc_id: r for r in line_counts(docs).collect()}
    assert len(got) == len(texts)
    for i, (n, k, kept) in enumerate(want):
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (n, k, hashlib.sha256(kept.encode()).hexdigest()), texts[i]
    out = deduplicated(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {i: None if t is None else want[i][2] for i, t in enumerate(texts)}


def test_against_brute_force(spark):
    rng = random.Random(13)
    lines = ["", " ", "Accept cookies", " accept COOKIES\t", "ACCEPT cookies\x0b", "Ärger", "ärger", "ÄRGER", " home", "home", "HOME\r", "one of a kind", "İstanbul", "a\x85b", "\x1cx"] + [f"line {i}" for i in range(40)]
    texts = [None, "", "\n", "\n\n", "only one"] + ["\n".join(rng.choices(lines, k=rng.randrange(0, 12))) for _ in range(150)]
    check(spark, texts)


def test_nine_and_ten_documents(spark):
    """A line that one document repeats counts once; ten documents are enough, nine are not."""
    check(spark, [f"nine\nown {i}\nnine\nnine" for i in range(9)] + [f"Ten \nown {i + 9}\nten" for i in range(10)])


def test_long_text_loses_lines_in_linear_time(spark):
    long = "\n".join(f"shared {i % 1000}" if i % 2 else f"own {i}" for i in range(100_000))
    check(spark, [long] + ["\n".join(f"shared {i}" for i in range(1000))] * 10)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "same\nline"), (1, "same\nline"), (None, "same\nother"), (None, None)] + [(i, "same") for i in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped) for r in line_counts(docs).collect())
    assert got == sorted([(1, 2, 1), (1, 2, 1), (0, 2, 1), (0, 1, 0)] + [(i, 1, 1) for i in range(2, 9)])
    assert line_counts(docs.limit(0)).count() == 0
