"""Text folding as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought to of in for on with at by from as "
    "into through during before after above below between out off over under again further then and but or nor not so yet both either neither each every all any few more most "
    "other some such no only own same than too very just because if when where how what which who whom this that these those i me my we our you your he him his she her "
    "it its they them their about up"
).split()


def let(x: Column, make: Callable[[Column], Column]) -> Column:
    """`make` of a value that is computed once, however often `make` names it."""
    return F.element_at(F.transform(F.array(x), make), 1)


@cache
def _folding() -> tuple[str, str]:
    """Characters that decompose to one base letter and marks, with the letter; marks themselves come last and go."""
    pairs, marks = [], []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(c for c, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


def folded(c: Column) -> Column:
    """Lower case without diacritics; ASCII texts have none."""
    old, new = _folding()
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.lower(F.translate(c, old, new)))


def words(c: Column) -> Column:
    """Runs of letters and digits, folded (what the index holds)."""
    return F.filter(F.split(folded(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def topic_words(c: Column) -> Column:
    """Words of three or more characters that are no stop words."""
    return F.filter(words(c), lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))


def covered(term: Column, other: Column) -> Column:
    """Equal, or one begins the other, has at least 4 characters and lacks at most 2."""
    short = F.when(F.length(term) <= F.length(other), term).otherwise(other)
    long = F.when(F.length(term) <= F.length(other), other).otherwise(term)
    return (term == other) | ((F.length(short) >= 4) & long.startswith(short) & (F.length(long) - F.length(short) <= 2))
