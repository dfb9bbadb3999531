import random
import zlib
from collections import Counter

import __spark_entry__ as E
import corpus_pipeline as C
import numpy as np
from noteloom.llm import mixing, quality
from noteloom.llm.tokens import Vocabulary, default_path
from test_mixing import targets
from test_secrets import brute as brute_secrets
from test_simhash import brute_copies

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, near_row string"


def corpus():
    """Documents with copies, near copies, secrets, junk, and odd rows: nulls, empty and long texts, repeats, shared ids."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    rows = []
    for i in range(220):
        words = [word() for _ in range(rng.randint(60, 140))]
        if i % 9 == 0:
            words = [w + "***" for w in words]
        if i % 7 == 0:
            words.insert(30, "token=" + "".join(rng.choices("abcdef0123456789", k=20)))
        text = " ".join(words)
        rows.append((i, text, f"s{i % 4}"))
        if i % 10 == 1:
            rows.append((1000 + i, text, "s1"))
        if i % 10 == 2:
            rows.append((2000 + i, text.replace(words[3], "other", 1), "s2"))
    rows += [(3000, None, None), (3001, "", "s0"), (3002, " ".join(word() for _ in range(9000)), "s3"), (3003, "few words", "s0"), (5, rows[5][1], "s1"), (None, " ".join(word() for _ in range(80)), None)]
    return [(i, t, "en", s, None if t is None else len(t), "clash") for i, t, s in rows]


def fill(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    good = {i: int(i % 9 > 0) for i in range(0, 220, 2)}
    spark.createDataFrame([(i, q, 0) for i, q in good.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    by, sf = dict(C.STAGES), str(tmp_path)

    kept = C.materialize(by["quality_rules"](spark, docs, sf))
    assert kept.columns == docs.columns
    forest, threshold, least = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = Counter()
    for i, t, *_ in corpus():
        (n, _, _, _, repeated), x = quality.statistics(t)
        if n >= least and 100 * repeated <= 50 * n and forest.score(np.array([x]))[0] <= threshold:
            want[(i, t)] += 1
    assert fill(kept.collect()) == want and 100 < sum(want.values()) < 260

    left = C.materialize(by["near_duplicates"](spark, kept, sf))
    assert left.columns == docs.columns
    rows, groups = kept.collect(), {}
    for r, g in zip(rows, brute_copies([r.text or "" for r in rows])):
        groups.setdefault(g, []).append(r)
    some = fill(left.collect())
    assert sum(some.values()) == len(groups) < len(rows)
    for own in groups.values():
        ids = [r.doc_id for r in own if r.doc_id is not None]
        texts = {(r.doc_id, r.text) for r in own}
        assert [k[0] for k in some if k in texts] == [min(ids) if ids else None]

    masked = C.materialize(by["secret_scans"](spark, left, sf))
    assert masked.columns == docs.columns
    before, n = {r.doc_id: r.text for r in left.collect()}, 0
    for r in masked.collect():
        text = before[r.doc_id]
        spans, at, out = brute_secrets(text), 0, ""
        for a, _, b in spans:
            if a >= at:
                out += text[at:a] + "[masked]"
            at = max(at, b)
        n += bool(spans)
        assert r.text == (out + text[at:] if spans else text) and r.n_chars == (None if r.text is None else len(r.text))
    assert n > 10

    mixed = C.materialize(by["mixing"](spark, masked, sf))
    assert mixed.columns == docs.columns
    sizes, rows = Counter(), masked.collect()
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
    want, copies = targets(dict(sizes)), fill(mixed.collect())
    plan = {(r.doc_id, r.size): r.copies for r in mixing.planned(masked).collect()}
    for r in rows:
        size = len((r.text or "").split())
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert copies[(r.doc_id, r.text)] == plan[(r.doc_id, size)] and abs(copies[(r.doc_id, r.text)] - rate) < 1 + 1e-9

    packed = by["packing"](spark, mixed, sf).collect()
    library, pieces = Vocabulary(default_path()).library, Counter()
    for (i, t), c in copies.items():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            pieces[(i, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += c
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in map(sorted, bins.values()):
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(bins) <= -(-sum(r.length for r in packed) // 2048) + 2


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = C.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert out.filter("offset + length > 2048").count() == 0 < out.count()


def test_all_are_registered():
    names = set(E.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
