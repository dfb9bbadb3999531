import datetime as dt

from noteloom.operators import bus as B
from noteloom.operators import notes as N
from noteloom.operators import triggers as C
from pyspark.sql import functions as F


def test_built_notes(spark):
    w = spark.createDataFrame([(1, 'A "quoted"\ntitle', "fix", "body", "B, a,b", " Proj ", "http://x", "observed", None, "2024-05-01"), (2, "Plain", "odd", "body", None, None, None, "inferred", "abc", "2024-05-01")], "id long, title string, doc_type string, content string, tags string, project string, source string, tier string, ref string, day string")
    r = spark.createDataFrame([(1, 2, "Second", "x/two.md", 0.6), (1, 1, "First", "y/one.md", 0.71)], "id long, place int, title string, path string, score double")
    got = {x.id: x for x in N.built(w, r).collect()}
    assert got[1].path == "builds/fixes/2024-05-01-a-quoted-title.md" and got[2].path == "inbox/2024-05-01-plain.md"
    assert got[1].note == '---\ntitle: "A \\"quoted\\"\\ntitle"\ntype: fix\ncreated: "2024-05-01"\nupdated: "2024-05-01"\ntags: [b, a]\nproject: proj\nsource: "http://x"\ntier: observed\nstatus: active\n---\n\nbody\n\n## Related\n- [[one]] — First (0.71)\n- [[two]] — Second (0.6)'
    assert 'tier_ref: "abc"' in got[2].note and "Related" not in got[2].note and "project" not in got[2].note


def test_captures_keep_the_first_or_the_last(spark):
    rows = spark.createDataFrame([(1, "A talk", "2024-05-01", "0930", None, "p", ["t"], [("S", "one")]), (2, "A talk", "2024-05-01", "0930", None, None, None, [("S", "two"), ("T", "")])], "id long, title string, day string, clock string, url string, project string, tags array<string>, sections array<struct<head:string,text:string>>")
    first, last = N.captured(rows, "video").collect(), N.captured(rows, "session").collect()
    assert [(r.id, r.path) for r in first] == [(1, "sources/youtube/2024-05-01-a-talk.md")]
    assert [(r.id, r.path) for r in last] == [(2, "builds/sessions/2024-05-01-0930-a-talk.md")]
    assert "## S\ntwo" in last[0].note and "## T" not in last[0].note and "tags: [t, youtube]" in first[0].note
    assert N.captured(rows, "video", N.captured(rows, "video")).count() == 0


def test_trigger_index_skips_what_is_no_json(spark):
    rows = [(1, "t", "x", "note", None, '[{"parts": ["git push"], "hits": 3}]'), (2, "t", "x", "note", None, "[{"), (3, "t", "x", "archive", None, '[{"parts": ["a b"], "hits": 1}]'), (4, "t", "x", "note", dt.datetime(2024, 1, 1), '[{"parts": ["a b"], "hits": 1}]'), (5, "t", "x", "note", None, None)]
    n = spark.createDataFrame(rows, "id long, title string, tier string, doc_type string, superseded_at timestamp_ntz, triggers string")
    assert [(r.id, r.parts, r.hits) for r in C.built_index(n).collect()] == [(1, ["git push"], 3)]


def test_unread_counts_in_buckets(spark):
    import random

    rng = random.Random(1)
    m = [(i, f"c{rng.randrange(2)}", rng.choice("abk"), rng.choice(["a", "b", "k", "", None])) for i in range(400)]
    readers = [(r, c, s) for r in "abz" for c in ("c0", "c1", "none") for s in (None,)] + [("k", "c0", 123), ("k", "c1", 399), ("k", "none", 5)]
    messages = spark.createDataFrame([(*x, "body") for x in m], "id long, channel string, sender string, recipient string, body string")
    r = spark.createDataFrame(readers, "reader string, channel string, last_seen long")
    want = {(who, c): sum(ch == c and i > (s if s is not None else -1) and who != se and (to in (None, "", who)) for i, ch, se, to in m) for who, c, s in readers}
    for bucket in (16, 4096):
        assert {(x.reader, x.channel): x.unread for x in B.unread(messages, r, bucket=bucket).collect()} == want
    top = {}
    for x in B.newest(messages, r, ["reader"], 5).collect():
        top.setdefault(x.reader, []).append(x.id)
    brute = {who: sorted((i for i, ch, se, to in m for w, c, s in readers if w == who and c == ch and i > (s if s is not None else -1) and se != who and to in (None, "", who)), reverse=True)[:5] for who in "abzk"}
    assert {k: sorted(v, reverse=True) for k, v in top.items()} == {k: v for k, v in brute.items() if v}


def test_text_records_have_defaults(spark):
    rows = spark.createDataFrame([(1, " ", None, None, None), (2, " T ", "memo", "B,a", "x")], "id long, title string, doc_type string, tags string, text string")
    got = {r.id: (r.title, r.doc_type, r.tags, r.content) for r in N.text_records(rows).collect()}
    assert got == {1: ("untitled", "text", [], ""), 2: ("T", "memo", ["b", "a"], "x")}
    assert rows.select(F.lit(1)).count() == 2
