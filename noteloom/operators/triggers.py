"""Command triggers: shell commands cut into segments, matched with patterns of notes, and vetted against a corpus."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
WRAPPERS = ("sudo", "nohup", "time", "env", "command")
MAX_PARTS, MIN_PART, MIN_HITS, MAX_SHARE, KEPT = 4, 3, 1, 0.05, 3
MIN_LINES, MIN_SESSIONS = 500, 20
OPENER = re.compile(r"(?<!<)<<(?!<)-?\s*(['\"]?)([A-Za-z_]\w*)\1", re.ASCII)
#: A quoted run, an escaped character, an operator that ends a segment, or any other character.
SHELL = re.compile(r"""'[^']*'?|"(?:\\.|[^"\\])*"?|\\.|\|\||&&|\$\(|[;|`&]|.""", re.S)


def drop_heredocs(command: str) -> str:
    """A command without the bodies of its here-documents; as it is if one is not closed."""
    waiting: list[str] = []
    kept = []
    for line in command.split("\n"):
        if waiting:
            if line.strip() == waiting[0]:
                waiting.pop(0)
        else:
            kept.append(line)
            waiting.extend(m[2] for m in OPENER.finditer(line))
    return command if waiting else "\n".join(kept)


def segments(command: str) -> list[str]:
    """The simple commands of a shell line, in lower case, without wrappers and assignments before them."""
    flat = re.sub(r"\s+", " ", drop_heredocs(command).lower().replace("\n", " ; ")).strip()
    parts, now = [], []
    for m in SHELL.finditer(flat):
        t = m[0]
        ends = t in ("||", "&&", "$(", ";", "|", "`")
        if t == "&":  # part of a redirection next to '>', else it ends a segment too
            ends = not ("".join(now).rstrip().endswith(">") or flat[m.end() : m.end() + 1] == ">")
        if ends:
            parts.append("".join(now))
            now = []
        else:
            now.append(t)
    parts.append("".join(now))
    out = []
    for p in parts:
        words = [w for w in re.findall(r"""(?:'[^']*'?|"(?:\\.|[^"\\])*"?|\\.|[^\s'"\\]|\\)+""", p.strip(), re.S)]
        while words and (words[0] in WRAPPERS or re.match(r"[a-z_][a-z0-9_]*=", words[0])):
            words.pop(0)
        if words:
            out.append(" ".join(words))
    return out


def segments_of(c: Column | str) -> Column:
    @F.pandas_udf("array<string>")
    def cut(commands: pd.Series) -> pd.Series:
        return commands.map(lambda x: segments(x) if x else [])

    return cut(c)


def without_heredocs(c: Column) -> Column:
    @F.pandas_udf("string")
    def dropped(commands: pd.Series) -> pd.Series:
        return commands.map(lambda x: drop_heredocs(x) if x and "<<" in x else x)

    return dropped(c)


def corpus_segments(commands: DataFrame) -> DataFrame:
    """(command, segment): cut once for each distinct command."""
    return commands.select("command").distinct().select("command", F.explode(segments_of("command")).alias("segment"))


def proposals(rows: DataFrame) -> DataFrame:
    """(id, parts) from proposed patterns, one a row, whose parts are joined by &&."""
    parts = F.filter(F.transform(F.split("proposal", "&&"), lambda p: F.trim(F.regexp_replace(F.lower(p), r"\s+", " "))), lambda p: p != "")
    return rows.select("id", parts.alias("parts")).filter(F.size("parts") > 0).distinct()


def code_text(c: Column) -> Column:
    """What a note says in code: fenced blocks, then inline spans (C4)."""
    fence = r"(?s)```[^\n]*\n?(.*?)```"
    rest = F.regexp_replace(c, r"(?s)```[^\n]*\n?.*?```", " ")
    return F.array_join(F.concat(F.regexp_extract_all(c, F.lit(fence), F.lit(1)), F.regexp_extract_all(rest, F.lit(r"`([^`\n]+)`"), F.lit(1))), "\n")


def matched(segs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(command, id, parts): patterns whose first part begins a segment and whose others appear in it.

    Both sides meet on the first word, an equi-join."""
    first_word = lambda c: F.regexp_extract(c, r"^[a-z0-9]+|^.", 0)
    p = patterns.withColumn("first", F.col("parts")[0]).withColumn("key", first_word(F.col("first")))
    s = segs.withColumn("key", first_word(F.col("segment")))
    after = F.substr("segment", F.length("first") + 1, F.lit(1))
    anchored = F.startswith("segment", "first") & ~after.rlike("[a-z0-9_-]")
    quoted = lambda x: F.concat(F.lit(r"(?<![a-z0-9_-])\Q"), x, F.lit(r"\E(?![a-z0-9_-])"))
    shown = lambda x: F.when(x.rlike("^[a-z0-9 ]+$"), F.regexp_like("segment", quoted(x))).otherwise(F.contains("segment", x))
    return s.join(p, "key").filter(anchored & F.forall(F.slice("parts", F.lit(2), F.size("parts")), shown)).select("command", "id", "parts").distinct()


def is_command(part: Column) -> Column:
    """Looks like a command: has a separator, a flag or a path."""
    return part.rlike(r"[ ./_=-]")


def vetted(proposed: DataFrame, notes: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, parts, hits, sessions, place): patterns that the note shows as code and that are rare in the corpus (C5). `proposed`: id, parts, pinned."""
    code = notes.select(F.col("id").alias("nid"), F.trim(F.regexp_replace(F.lower(code_text(F.concat_ws("\n", "title", "content"))), r"\s+", " ")).alias("code"))
    shape = (F.size("parts") <= MAX_PARTS) & F.forall("parts", lambda p: F.length(p) >= MIN_PART) & F.exists("parts", is_command)
    able = proposed.filter(shape).join(code, F.col("id") == F.col("nid")).filter(F.forall("parts", lambda p: F.contains("code", p))).select("id", "parts", "pinned")
    size = corpus.agg(F.count("*").alias("n"), F.countDistinct("session").alias("s")).first()
    asked = able.select("parts").distinct().select(F.xxhash64("parts").alias("id"), "parts")  # a pattern is counted once, however many notes propose it
    hit = matched(corpus_segments(corpus), asked).join(corpus, "command").groupBy("parts").agg(F.count("*").alias("hits"), F.countDistinct("session").alias("sessions"))
    j = able.join(hit, "parts", "left").fillna(0, ["hits", "sessions"])
    fits = (F.lit(size.n) >= MIN_LINES) & (F.lit(size.s) >= MIN_SESSIONS) & (F.col("hits") >= MIN_HITS) & (F.col("sessions") <= F.lit(MAX_SHARE) * size.s)
    place = F.row_number().over(Window.partitionBy("id").orderBy("sessions", "hits", "parts"))
    return j.filter(F.col("pinned") | fits).withColumn("place", place).filter(F.col("place") <= KEPT)


def built_index(notes: DataFrame) -> DataFrame:
    """(id, title, tier, parts, hits): the patterns of live notes outside the archive; what is no JSON list is left out.

    Columns: id, title, tier, doc_type, superseded_at, triggers (JSON: a list of {parts, hits})."""
    live = notes.filter("triggers IS NOT NULL AND superseded_at IS NULL AND doc_type <> 'archive'")
    parsed = live.select("id", "title", "tier", F.explode(F.from_json("triggers", "array<struct<parts:array<string>,hits:long>>")).alias("p"))
    return parsed.select("id", "title", "tier", "p.parts", "p.hits").filter(F.size("parts") > 0)


def notes_for(commands: DataFrame, index: DataFrame, fired: DataFrame | None = None) -> DataFrame:
    """(command, id, hits): notes that a command calls for, by their rarest pattern; fired (command, id) are left out."""
    hit = matched(corpus_segments(commands), index.select("id", "parts")).join(index, ["id", "parts"]).groupBy("command", "id").agg(F.min("hits").alias("hits"))
    return hit if fired is None else hit.join(fired, ["command", "id"], "left_anti")


def decisions(calls: DataFrame, found: DataFrame, most: int = 2) -> DataFrame:
    """(session, pos, id, shown): in each session a note warns once, at most `most` notes a session; all are logged.

    A note's first call in a session decides; the first `most` such notes are shown, so windows are enough."""
    j = calls.join(found, "command").select("session", "pos", "id", "hits")
    first = F.row_number().over(Window.partitionBy("session", "id").orderBy("pos", "hits"))
    turn = F.sum((F.col("nth") == 1).cast("int")).over(Window.partitionBy("session").orderBy("pos", "hits", "id").rowsBetween(Window.unboundedPreceding, 0))
    return j.withColumn("nth", first).withColumn("turn", turn).select("session", "pos", "id", ((F.col("nth") == 1) & (F.col("turn") <= most)).alias("shown"))
