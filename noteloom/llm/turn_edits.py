"""Cheapest edits of a run of turns: the Spark-free helper of `repair`.

A repaired conversation reads `(s?(ua)+)?` in initials of its roles. Four states follow it: nothing yet, after a system
turn, after a user turn, after an assistant turn. A turn is a letter, `letter(initial, fault)`. Between states p and q a
turn has one cheapest edit, the ASCII-least of equals: inserts before it, then Delete, Keep or Rerole.

A vector holds, for each state, the cost of reaching it and the rank of its least edits among those of the other states.
Edits that reach different states after the same turns are never prefixes of each other, so ranks decide between whole
strings, and two numbers a state are all that is kept: `Span`s of turns compose like turns do. Hirschberg's scheme gives the
edits back: forward and backward vectors meet in the middle, the crossing of least cost and then of least rank is taken,
and both halves are solved in turn. Memory is the edits themselves and one vector for each level of halving.
"""

from __future__ import annotations

from functools import lru_cache

INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Where an initial leads from each state; None where the pattern does not allow it.
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
ROLES = {"u": "user", "a": "assistant"}
#: Cost and inserts that end a conversation in each state.
ENDS = ((0, ""), (6, "II"), (3, "I"), (0, ""))

#: Cost and rank for each state, or None where it can't be reached.
Vector = tuple
#: A vector for each state that a run of turns may begin in.
Span = tuple


def letter(initial: str, fault: int) -> str:
    return chr(65 + 4 * (INITIALS.find(initial) if initial else -1) % 16 + fault)


def inserted(state: int) -> tuple[str, int]:
    """The one role whose turn can be inserted in a state, and the state after it."""
    return ("a", ASSISTANT) if state == USER else ("u", USER)


@lru_cache(maxsize=None)
def edits(turn: str) -> tuple:
    """For each pair of states, (cost, edit) of a turn, or None; 16 turns there are."""
    kind, fault = divmod(ord(turn) - 65, 4)
    initial, more = (INITIALS[kind] if kind < 3 else ""), TRUNCATED * (fault == 3)
    table = []
    for p in STATES:
        found: dict[int, tuple[int, str]] = {}

        def offer(q: int | None, cost: int, edit: str, found=found) -> None:
            if q is not None:
                found[q] = min(found.get(q, (cost, edit)), (cost, edit))

        state = p
        for n in range(3):  # more inserts would come back to the same states
            offer(state, INSERT * n + DELETE, "I" * n + "D")
            if fault in (0, 3):
                if initial:
                    offer(NEXT[initial][state], INSERT * n + more, "I" * n + "K")
                for role in "ua":
                    offer(NEXT[role][state], INSERT * n + REROLE + more, "I" * n + "R")
            state = inserted(state)[1]
        table.append(tuple(found.get(q) for q in STATES))
    return tuple(table)


def _ranked(found: list) -> Vector:
    """A vector of (cost, what its edits are ordered by) for each state. States that no cheapest edits pass are left out: from
    an assistant turn all goes on at 4 more at most, and a user turn is 3 from there."""
    most = min([x[0] + more for x, more in ((found[ASSISTANT], 4), (found[USER], 7)) if x], default=None)
    kept = [x if x and (most is None or q > SYSTEM or x[0] <= most) else None for q, x in enumerate(found)]
    order = sorted(x[1] for x in kept if x)
    return tuple(x and (x[0], order.index(x[1])) for x in kept)


@lru_cache(maxsize=None)
def span_of(turn: str) -> Span:
    return tuple(_ranked(list(row)) for row in edits(turn))


def begin(state: int) -> Vector:
    return tuple((0, 0) if q == state else None for q in STATES)


def extended(vector: Vector, span: Span) -> Vector:
    """The vector after one more span."""
    found: list = [None] * 4
    for p in STATES:
        if vector[p]:
            cost, rank = vector[p]
            for q in STATES:
                if span[p][q]:
                    x = (cost + span[p][q][0], (rank, span[p][q][1]))
                    found[q] = min(found[q] or x, x)
    return _ranked(found)


def before(span: Span, rest: tuple) -> tuple:
    """Costs from each state on, given those after one span."""
    return tuple(min((span[p][q][0] + rest[q] for q in STATES if span[p][q] and rest[q] is not None), default=None) for p in STATES)


@lru_cache(maxsize=1 << 16)
def _step(vector: Vector, turn: str) -> tuple[int, Vector]:
    v = extended(vector, span_of(turn))
    least = min(x[0] for x in v if x)
    return least, tuple(x and (x[0] - least, x[1]) for x in v)


def forward(vector: Vector, turns: str) -> Vector:
    total = 0
    for t in turns:
        cost, vector = _step(vector, t)
        total += cost
    return tuple(x and (x[0] + total, x[1]) for x in vector)


@lru_cache(maxsize=1 << 16)
def _back(turn: str, rest: tuple) -> tuple:
    w = before(span_of(turn), rest)
    least = min(x for x in w if x is not None)
    return tuple(None if x is None else x - least for x in w)


def backward(turns: str, rest: tuple) -> tuple:
    """Costs to go from before the turns, up to a constant."""
    for t in reversed(turns):
        rest = _back(t, rest)
    return rest


def only(state: int) -> tuple:
    return tuple(0 if q == state else None for q in STATES)


def crossing(vector: Vector, rest: tuple) -> int:
    """The state of the audit-least among the cheapest ways through."""
    return min((vector[q][0] + rest[q], vector[q][1], q) for q in STATES if vector[q] and rest[q] is not None)[2]


def crossings(spans: list[Span], p: int, q: int) -> list[tuple[int, int]]:
    """The states before and after each of some spans, on the least way from p to q."""
    rest = [only(q)]
    for s in reversed(spans[1:]):
        rest.append(before(s, rest[-1]))
    out, vector, at = [], begin(p), p
    for s, w in zip(spans, reversed(rest)):
        vector = extended(vector, s)
        out.append((at, at := crossing(vector, w)))
    return out


def folded(spans: list[Span]) -> Span:
    out = []
    for p in STATES:
        vector = begin(p)
        for s in spans:
            vector = extended(vector, s)
        out.append(vector)
    return tuple(out)


def span(turns: str) -> Span:
    return tuple(forward(begin(p), turns) for p in STATES)


def audit(turns: str, p: int, q: int) -> list[str]:
    """The edit of each turn on the least way from p to q, by halving."""
    if len(turns) == 1:
        return [edits(turns)[p][q][1]]
    half = len(turns) // 2
    c = crossing(forward(begin(p), turns[:half]), backward(turns[half:], only(q)))
    return audit(turns[:half], p, c) + audit(turns[half:], c, q)


def lines(turns: str, edited: list[str], p: int) -> list[tuple[list[str], str | None]]:
    """For each turn the roles inserted before it and its new role: None if deleted, "" if kept."""
    out = []
    for t, edit in zip(turns, edited):
        new = []
        for _ in edit[:-1]:
            role, p = inserted(p)
            new.append(ROLES[role])
        if edit[-1] == "K":
            p = NEXT[INITIALS[(ord(t) - 65) // 4]][p]
        elif edit[-1] == "R":
            role, p = inserted(p)
        out.append((new, {"K": "", "D": None}.get(edit[-1], ROLES.get(role) if edit[-1] == "R" else None)))
    return out


def closing(vector: Vector) -> tuple[int, int, str]:
    """(cost, last state, inserts after the last turn) of the least way to the end."""
    cost, _, q = min((vector[q][0] + ENDS[q][0], vector[q][1], q) for q in STATES if vector[q])
    return cost, q, ENDS[q][1]


def written(s: Span) -> list[int]:
    """A span as 32 numbers, -1 for None."""
    return [x for row in s for cell in row for x in (cell or (-1, -1))]


def read(xs: list[int]) -> Span:
    cells = [None if xs[i] < 0 else (xs[i], xs[i + 1]) for i in range(0, 32, 2)]
    return tuple(tuple(cells[i : i + 4]) for i in range(0, 16, 4))
