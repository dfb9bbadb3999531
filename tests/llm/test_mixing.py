import math
import re

from noteloom.llm import mixing as M


def targets(sizes):
    """Water filling, by hand: sources that are over their cap are fixed, the others share what is left."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), ["b", "a", "ä", "Z", None, "tiny"][i % 5 if i % 50 else 5]) for i in range(2000)] + [(-1, None, "a"), (-2, " \t", "zero"), (None, "x y", "a")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, mix_size string")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    got = M.planned(docs).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert math.floor(rate + 1e-9) - 1 <= r.copies <= 3 and abs(r.copies - rate) < 1 + 1e-9
        taken[s] = taken.get(s, 0) + r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 0.15 * want[s] + 60 for s in sizes)
    again = {(r.doc_id, r.size): r.copies for r in M.planned(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size): r.copies for r in got}
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert M.planned(docs.limit(0)).count() == 0


def test_many_sources_keep_their_order(spark):
    names = [f"s{i:04d}" for i in range(500)] + [None]
    sizes = spark.createDataFrame([(n, 10) for n in names], "source string, source_size long").repartition(3)
    got = {r.source: r.target for r in M.source_targets(sizes).collect()}
    want = targets({n: 10 for n in names})
    assert len(got) == 501 and all(math.isclose(got[n], want[n], rel_tol=1e-9) for n in names)
