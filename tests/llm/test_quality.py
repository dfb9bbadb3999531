import random
import re
from collections import Counter

import numpy as np
from noteloom.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_match_brute_force():
    rng = random.Random(0)
    texts = [None, "", " \n\t", "a", "a b a b a b", "é b\x1cc é b\x1cc #$", "x y z\nx y z\n x y z\n\n\n"] + ["".join(rng.choices(["a", "b", "c ", " ", "\n", "#", "é", "\x0b", "\x85"], k=rng.randint(0, 60))) for _ in range(500)]
    for t in texts:
        assert Q.statistics(t)[0] == brute(t), repr(t)


def test_verdicts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(1500):
        words = [word() for _ in range(rng.randint(60, 200))]
        bad = i % 10 == 0
        if bad:
            words = [w + "***" for w in words] if i % 20 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "clash"))
        if i % 3:
            labels.append((i, int(not bad), 0))
    rows += [(9000, None, ""), (9001, "few words", ""), (9002, "same old words " * 5000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, verdict string")
    tags = spark.createDataFrame([*labels, (None, 1, 0), (77777, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.judged(docs, tags).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        n, *rest = brute(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (n, *rest)
        assert got[i].base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
    held = [i for i in range(1500) if i % 3 == 0]  # not among the labels
    good, bad = [i for i in held if i % 10], [i for i in held if i % 10 == 0]
    assert np.mean([got[i].kept for i in good]) > 0.97
    assert np.mean([not got[i].kept for i in bad]) > 0.8
    kept = Q.kept_documents(docs, tags)
    forest, threshold, least = Q.fit(docs, tags)
    assert 50 == least  # no good document is short
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())
    # the verdict by brute force: paths through each tree, one document at a time
    for i, t, _ in rows[::50]:
        x, paths = Q.statistics(t)[1], []
        for feature, value, left, length in forest.trees:
            node = 0
            while feature[node] >= 0:
                node = left[node] + (x[feature[node]] >= value[node])
            paths.append(length[node])
        score = 2.0 ** (-np.mean(paths) / Q.Forest.mean_path(forest.size))
        assert abs(score - got[i].score) < 1e-9
        assert got[i].kept == (not got[i].base_failed and got[i].score <= threshold)
    assert Q.judged(docs.limit(0), tags).count() == 0
    assert all(r.kept != r.base_failed for r in Q.judged(docs, tags.limit(0)).collect())


def test_short_documents_that_labels_call_good_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows = [(i, " ".join(word() + "##" * (i % 10 == 0) for _ in range(rng.randint(8, 120)))) for i in range(900)]
    docs = spark.createDataFrame(rows + [(5, "another text of the id")], "doc_id long, text string")
    tags = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(900)] + [(1, 0), (1, 1)], "doc_id long, quality int")
    assert Q.fit(docs, tags)[2] <= 10
    kept = {r.doc_id for r in Q.kept_documents(docs, tags).collect()}
    good = [i for i in range(900) if i % 10 and i not in (1, 5)]
    assert len(kept & set(good)) > 0.97 * len(good)
    assert {r.doc_id: r.base_failed for r in Q.judged(docs, tags).collect()}[good[0]] == (len(rows[good[0]][1].split()) < 50)
