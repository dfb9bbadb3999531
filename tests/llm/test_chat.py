import random

from noteloom.llm import chat as C


def brute(turns):
    by = {}
    for c, t, r, x, *_ in turns:
        by.setdefault(c, []).append((t if t is not None else -1e9, r or "", x or ""))
    by = {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}
    kept = [c for c, v in by.items() if not any(len(w) > len(v) and w[: len(v)] == v for w in by.values())]
    first = {}
    for c in sorted(kept, key=lambda c: (c is None, c)):
        first.setdefault(tuple(by[c]), c)
    return {c: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v) for v, c in first.items()}


def test_snapshots_collapse(spark):
    rng = random.Random(0)
    rows = []
    for c in range(300):
        base, n = rng.randrange(40), rng.randint(1, 6)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{base} says {t}") for t in range(n)]
    rows += [(900, t, "user", f"long {t}") for t in range(1000)] + [(901, t, "user", f"long {t}") for t in range(300)]
    rows += [(None, 0, "user", "lost"), (None, None, None, None), (902, 5, "user", "x"), (902, 5, "user", "x"), (902, None, "system", ""), (903, 0, "user", "y" * 100_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = C.formatted(df).collect()
    whole = {r.conv_id: r.text for r in got}
    assert len(whole) == len(got) and all(r.n_turns == r.text.count("<|im_end|>") for r in got)
    assert whole == brute(rows)
    assert C.formatted(df.limit(0)).count() == 0
