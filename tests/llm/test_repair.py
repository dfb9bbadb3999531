import hashlib
import random
import re
from zlib import crc32

import pytest
from noteloom.llm import repair, turn_edits

INITIALS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def cheapest(rows):
    """(cost, audit, repaired lines) by keeping whole strings for each state; rows are (role, text, fault)."""

    def with_inserts(best):
        best = dict(best)
        for _ in range(3):
            for p, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    q = INITIALS[role[0]].get(p)
                    new = (cost + 3, audit + "I", [*out, f"{role}:"])
                    if q is not None and (q not in best or new[:2] < best[q][:2]):
                        best[q] = new
        return best

    best = {0: (0, "", [])}
    for role, text, fault in rows:
        after = {}

        def offer(q, cost, audit, out):
            if q is not None and (q not in after or (cost, audit) < after[q][:2]):
                after[q] = (cost, audit, out)

        for p, (cost, audit, out) in with_inserts(best).items():
            offer(p, cost + 4, audit + "D", out)
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                offer(INITIALS.get(role[:1], {}).get(p), cost + more, audit + "K", [*out, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    offer(INITIALS[new[0]].get(p), cost + 3 + more, audit + "R", [*out, f"{new}:{text}"])
        best = after
    return min((x for q, x in with_inserts(best).items() if q in (0, 3)), key=lambda x: x[:2])


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def report(rows):
    """Of one conversation's rows after damage, in order: gaps to digest."""
    seen, faulty = set(), []
    for _, _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role, text, fault))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = [sum(f == k for *_, f in faulty) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
    cost, audit, out = cheapest(faulty)
    return (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def by_conversation(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {c: sorted(rs, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])) for c, rs in groups.items()}


def made(rng, n, turns):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Saint", "sys", "unit", "a"]
    texts = ["Yes.", "No!", "ok", "", " \t", None, "Why?\n ", "no stop", "é。", "…", "\x1c", "\x85"]
    rows = []
    for c in [*range(n), None]:
        for t in range(rng.randrange(0, turns)):
            rows.append((c, rng.choice([t, t, t, t + 2, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Say {t}."))
    return rows


def check(spark, rows, parts=3):
    data = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string").repartition(parts)
    got = {r[0]: tuple(r[1:]) for r in repair.damaged_reports(data).collect()}
    after = by_conversation(damage(rows))
    want = {c: report(after.get(c, []))[0] for c in {r[0] for r in rows}}
    assert got == want
    return data


def test_against_brute_force(spark):
    rows = made(random.Random(11), 120, 14)
    check(spark, rows + rows[:40])  # repeated rows are turns


def test_long_conversation_in_many_blocks_and_partitions(spark):
    """A third of all rows in one conversation, turns that share numbers, and a conversation without any."""
    rng = random.Random(4)
    rows = made(rng, 60, 20)
    rows += [(1000, t // 3, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "no", "", f"Say {t}."])) for t in range(3000)]
    rows += [(1001, None, rng.choice(["user", "assistant"]), f"Null {t}.") for t in range(700)] + [(1002, 7, "user", "Same.")] * 600
    check(spark, rows)


def test_damage_by_kind(spark):
    """Kinds 0 to 4, found by their crc32; a conversation that loses all turns has zeros and the empty digest."""
    kinds = {k: next(c for c in range(10_000) if crc32(f"{c}:1".encode()) % 20 == k) for k in range(5)}
    rows = [(c, 1, "assistant", "Fine! Really.") for c in kinds.values()]
    check(spark, rows)
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    after = sorted(map(tuple, repair.damaged(data).collect()))
    text = {1: "", 2: "Fine Really", 3: "Fine! Really.", 4: "Fine! Really."}
    assert after == sorted((kinds[k], 1, "user" if k == 4 else "assistant", text[k]) for k in (1, 2, 3, 3, 4))
    lost = repair.damaged_reports(data).filter(f"conv_id = {kinds[0]}").collect()
    assert [tuple(r[1:]) for r in lost] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows(spark):
    rows = [r for r in made(random.Random(8), 30, 12) if r[0] is not None] + [(99, t, "user", f"Q{t}.") for t in range(600)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in sorted(repair.repaired(data).collect(), key=lambda r: (int(r.conv_id), r.place)):
        got.setdefault(int(r.conv_id), []).append(f"{r.role}:{r.text}")
        assert r.place == len(got[int(r.conv_id)]) - 1
    plain = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    want = {c: report(rs)[1] for c, rs in by_conversation(plain).items()}
    assert got == {c: out for c, out in want.items() if out}


@pytest.mark.parametrize("n", [1, 2, 7, 40, 400])
def test_halving_equals_whole_strings(n):
    rng = random.Random(n)
    for _ in range(max(3, 600 // n)):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), "", rng.choice(["", "", "", "blank", "truncated"])) for _ in range(n)]
        letters = "".join(turn_edits.letter(r, turn_edits.FAULTS.index(f)) for r, _, f in rows)
        cost, q, closing = turn_edits.closing(turn_edits.forward(turn_edits.begin(turn_edits.START), letters))
        assert (cost, "".join(turn_edits.audit(letters, turn_edits.START, q)) + closing) == cheapest(rows)[:2]


def test_empty_table(spark):
    data = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.damaged_reports(data).count() == 0 and repair.repaired(data).count() == 0
