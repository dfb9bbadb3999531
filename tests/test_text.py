import math
import random
import tracemalloc

import numpy as np
from noteloom.functions import text as X
from noteloom.operators import index as I
from noteloom.operators import search as S
from noteloom.operators import transcripts as R
from noteloom.operators import triggers as C
from noteloom.operators import vectors as V
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOTES = "id long, title string, content string, tags array<string>, tier string, doc_type string, superseded_at timestamp_ntz"


def notes(spark, *rows):
    return spark.createDataFrame([(i, t, c, g, "inferred", "note", None) for i, (t, c, g) in enumerate(rows)], NOTES)


def test_topic_words(spark):
    r = spark.range(1).select(X.topic_words(F.lit("The Café's bot-triage, naïve É and ß of 42x")).alias("w")).first()
    assert r.w == ["cafe", "bot", "triage", "naive", "42x"]


def test_search_prefers_title_and_needs_all_terms(spark):
    n = notes(spark, ("Vault indexer", "how notes are indexed", ["kb"]), ("Other", "the vault has an indexer", []), ("Third", "only a vault", []), ("Fourth", "nothing", []))
    q = spark.createDataFrame([(1, "the vault index"), (2, "vault zebra"), (3, "the of"), (4, "")], "query_id long, query string")
    got = {}
    for r in S.search(q, n).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got[1] == [0, 1] and set(got[2]) == {0, 1, 2} and got[3] == [1] and 4 not in got


def test_bm25_by_hand(spark):
    n = notes(spark, ("a", "cat cat dog", []), ("b", "dog", []), ("c", "bird", []))
    index = I.indexed(n)
    q = spark.createDataFrame([(1, "cat")], "query_id long, query string")
    r = S.bm25(S.matches(S.query_terms(q), index), index).collect()
    idf, mean = math.log((3 - 1 + 0.5) / 1.5), 8 / 3
    assert len(r) == 1 and abs(r[0].score + idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / mean))) < 1e-9


def test_families_testify_once(spark):
    cases = [
        ([("index", 1.0), ("indexer", 2.0), ("vault", 3.0)], (2, 5.0)),
        ([("backfill", 4.0), ("backfills", 3.0)], (1, 4.0)),
        ([("log", 1.0), ("logic", 1.5)], (2, 2.5)),  # three letters relate to nothing
        ([("works", 1.0), ("worker", 1.0), ("work", 5.0), ("workflow", 2.0)], (3, 8.0)),  # "work" joins the first family it is kin of
        ([], (0, 0.0)),
    ]
    rows = spark.createDataFrame([(i, [(p, w, x) for p, (w, x) in enumerate(ws)]) for i, (ws, _) in enumerate(cases)], "i int, found array<struct<pos:int,word:string,idf:double>>")
    got = {r.i: (r.x.families, r.x.mass) for r in rows.select("i", S.family_mass(F.col("found")).alias("x")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_aliases_are_part_of_a_notes_identity(spark):
    n = notes(spark, ("How the vault is kept", "an indexer walks files", ["kb"]), *[(f"filler {i}", "nothing of that", []) for i in range(300)], ("vault", "vault", []), ("x", "indexer", []))
    p = spark.createDataFrame([(1, "does the indexer see the vault")], "prompt_id long, prompt string")
    aliases = spark.createDataFrame([(0, "indexer")], "id long, aliases string")
    assert S.relevant(p, n).count() == 0
    assert [r.id for r in S.relevant(p, n, aliases=aliases).collect()] == [0]


def made_notes(spark, rng, ids):
    vocabulary = [a + b for a in ("vault", "index", "note", "graph", "tag", "cache") for b in ("", "s", "er", "ing", "ed")]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    return spark.createDataFrame([(i, text(2), text(rng.randrange(0, 25)), [rng.choice(vocabulary)], "inferred", "note", None) for i in ids], NOTES)


def test_blocks_are_skipped_and_results_stay(spark):
    """Top notes by bounds equal those by scoring all; notes that stand out leave most buckets unread."""
    rng = random.Random(6)
    n = made_notes(spark, rng, range(3000)).withColumn("content", F.when(F.col("id") < 5, F.repeat(F.lit("lynx "), 200)).when(F.col("id") % 10 == 0, F.concat("content", F.lit(" lynx"))).otherwise(F.col("content")))
    index = I.indexed(n, buckets=60)
    q = spark.createDataFrame([(1, "lynx"), (2, "index cache"), (3, "notes graph tagging"), (4, "zebra vault"), (5, "the of"), (6, "lynx vault")], "query_id long, query string")
    terms = S.query_terms(q)
    everything = S.all_or_any(S.bm25(S.matches(terms, index), index)).withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).filter("k <= 5")
    want = sorted((r.query_id, r.id, round(r.score, 9)) for r in everything.collect())
    for first in (1, 4, 100):
        got = S.best(terms, index, n, 5, first=first)
        assert sorted((r.query_id, r.id, round(r.score, 9)) for r in got.collect()) == want
    _, bounds = S.bounded(S.expansions(terms, index), index)
    fifth = max(x[2] for x in want if x[0] == 1)
    buckets = [r.bound for r in bounds.filter("query_id = 1").collect()]
    assert sum(-b <= fifth for b in buckets) <= len(buckets) // 2


def test_queries_share_the_postings_of_their_terms(spark, monkeypatch):
    """What a search writes does not grow with the queries that ask the same words, and its notes are those of the plain form."""
    rng = random.Random(8)
    n = made_notes(spark, rng, range(2000)).withColumn("superseded_at", F.when(F.col("id") % 3 == 0, F.to_timestamp_ntz(F.lit("2024-01-01"))).cast("timestamp_ntz"))
    n = n.withColumn("content", F.when(F.col("id") == 3, "lynx puma").when(F.col("id") % 50 == 1, "lynx").otherwise(F.col("content")))
    index, own, rows, inner = I.indexed(n, buckets=24), n.filter("superseded_at IS NULL"), {}, S.materialize

    def counted(df, what):
        out = inner(df, what)
        rows[what] = rows.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(S, "materialize", counted)
    written = {}
    for k in (1, 40):
        rows.clear()
        q = spark.createDataFrame([(i, "vault cach") for i in range(k)], "query_id long, query string")
        assert S.search(q, n, limit=5, index=index).count() == 5 * k
        written[k] = sum(x for what, x in rows.items() if what not in ("asked", "scored"))
    assert written[40] == written[1]
    monkeypatch.undo()
    # the only note with both words is superseded, so none is left; other queries: ties, unknown words, words of two parts
    q = spark.createDataFrame([(1, "lynx puma"), (2, "index cache"), (3, "notes-graph tagging"), (4, "zebra vault"), (5, "the of"), (6, "lynx")], "query_id long, query string")
    terms = S.query_terms(q)
    plain = S.all_or_any(S.bm25(S.matches(terms, index), index))
    shape = lambda df: sorted((r.query_id, r.id, r.n_terms, r.exact, r.matched, round(r.score, 9)) for r in df.collect())
    for rounds in (1, 1 << 20):
        assert shape(S.scored(terms, index, round_terms=rounds)) == shape(plain)
        top = plain.join(own.select("id"), "id", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9), "id"))).filter("k <= 5")
        assert shape(S.scored(terms, index, own, 5, round_terms=rounds)) == shape(top)


def test_search_without_an_index_scans_for_the_words_asked(spark, monkeypatch):
    """No index is built for a few queries; notes and scores are those that an index gives, also in small groups of notes."""
    n = made_notes(spark, random.Random(9), range(700)).withColumn("content", F.when(F.col("id") % 50 == 1, "Straße łódź Éclair lynx-puma").when(F.col("id") % 50 == 2, "").when(F.col("id") % 50 == 3, F.lit(None)).otherwise(F.col("content")))
    asked = ["vault cach", "cache caches", "notes-graph tagging", "a-a zebra", "the of", "eclair straß", "lynx-puma vault", "\" '", "?!", "łó", "c v"]
    terms = S.query_terms(spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"))
    index, shape = I.indexed(n, buckets=3), lambda df: sorted((r.query_id, r.id, r.n_terms, r.exact, r.matched, round(r.score, 9)) for r in df.collect())
    want, empty = shape(S.scored(terms, index)), n.limit(0)
    assert {0, 1, 2, 5, 6, 9} <= {x[0] for x in want}
    with monkeypatch.context() as m:
        m.setattr(S, "indexed", None)
        assert shape(S.scored(terms, n)) == want
        m.setattr(S, "CELLS", 50)
        assert shape(S.scored(terms, n)) == want
        assert S.scored(terms, empty).count() == S.scored(terms.limit(0), n).count() == 0
    names = terms.select("term", "exact").distinct().withColumn("tno", F.xxhash64("term", "exact"))
    lists = lambda most: sorted((r.tno, i, w) for r in S.gathered(names, n, most).found.collect() for i, w in zip(r.ids, r.weights))
    assert lists(3) == lists(1000)


def test_blocks_of_vectors_meet_a_few_rows_at_a_time(spark):
    """Two blocks of vectors take memory for a part of their products; the pairs are those of the whole product."""
    rng = np.random.default_rng(5)
    a, b = (V.unit(rng.normal(size=(2000, 8))) for _ in range(2))
    a_ids, b_ids = np.arange(0, 4000, 2), np.arange(1, 4000, 2)
    tracemalloc.start()
    got = [np.concatenate(x) for x in zip(*V.upwards(a_ids, a, b_ids, b, 0.93, 0.97, 3, cells=200_000))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2000 * 2000 * 8 // 2
    score = a @ b.T
    have = {(x, y) for x, y in zip(*(g.tolist() for g in got[:2]))}
    want = set()
    for i, x in enumerate(a_ids.tolist()):
        j = [k for k in range(2000) if b_ids[k] > x and score[i, k] >= 0.93]
        want |= {(x, int(b_ids[k])) for k in j if score[i, k] >= 0.97} | {(x, int(b_ids[k])) for k in sorted((k for k in j if score[i, k] < 0.969), key=lambda k: -score[i, k])[:3]}
    assert want <= have and all(y > x for x, y in have)
    assert all(score[x // 2, y // 2] >= 0.93 - 1e-9 for x, y in have)


def test_index_follows_the_store(spark):
    """After batches of new, changed and deleted notes the index equals a rebuild, as segments and merged; so do searches."""
    rng = random.Random(7)
    store = made_notes(spark, rng, range(300)).cache()
    index = I.indexed(store, buckets=7)
    for batch in range(3):
        changed = made_notes(spark, rng, [*range(batch * 40, batch * 40 + 60), *range(300 + 10 * batch, 310 + 10 * batch)]).cache()
        deleted = spark.createDataFrame([(i,) for i in range(200 + batch, 300, 9)], "id long")
        index = I.followed(index, changed, deleted)
        store = store.join(changed, "id", "left_anti").join(deleted, "id", "left_anti").unionByName(changed).cache()
    assert index.segments == 4
    fresh = I.indexed(store, buckets=7)
    merged = I.compacted(index)
    q = spark.createDataFrame([(1, "vault"), (2, "index cache"), (3, "notes graph tagging")], "query_id long, query string")
    want = sorted(map(tuple, S.search(q, store, index=fresh).collect()))
    for x in (index, merged):
        assert (x.n, round(x.mean, 9)) == (fresh.n, round(fresh.mean, 9))
        assert sorted(map(tuple, x.vocabulary.collect())) == sorted(map(tuple, fresh.vocabulary.collect()))
        assert sorted(map(tuple, S.search(q, store, index=x).collect())) == want


def test_aliases_keep_what_the_note_says(spark):
    rows = [("Note", "the vault keeps an indexer busy", [])] + [(f"t{i}", "filler words here", []) for i in range(100)]
    p = spark.createDataFrame([(0, "vault indexer"), (0, "missing filler")], "id long, proposal string")
    assert S.vetted_aliases(p, notes(spark, *rows)).first().aliases == "indexer vault"


def test_planted_cosines(spark):
    q, r = [1.0, 0.0], [0.0, 1.0]
    at = lambda s: [s * a + math.sqrt(1 - s * s) * b for a, b in zip(q, r)]
    corpus = spark.createDataFrame([(1, at(0.85)), (2, at(0.8494)), (3, at(0.6)), (4, at(0.59)), (5, [0.0, 0.0])], "id long, v array<double>")
    ask = spark.createDataFrame([(0, q)], "id long, v array<double>")
    got = V.verdicts(V.similar(ask, corpus, least=0.5)).collect()
    assert [(x.kind, x.id) for x in got] == [("duplicate", 1)]
    got = V.verdicts(V.similar(ask, corpus.filter("id > 1"), least=0.5)).orderBy("place").collect()
    assert [(x.kind, x.id, x.score) for x in got] == [("near", 2, 0.849), ("near", 3, 0.6)]
    few = V.similar(ask, corpus, k=2, round_bytes=8).orderBy("place").collect()
    assert [x.id for x in few] == [1, 2]


def cosines(rows):
    m = np.array([v for _, v in rows], float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    return m @ m.T


def test_searches_in_rounds_and_pairs_by_pivots(spark):
    """Both equal brute force, with ties, zero vectors and repeated rows, however small rounds and blocks are."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(120)] + [(i, [0.0] * 4) for i in range(120, 124)] + [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(124, 130)]
    s = cosines(rows)
    d = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    for n, q in ((1, 10), (200, 1)):  # the queries are the smaller side, and the larger
        asked = d.filter(f"id % {q} = 0")
        few = d if n > 1 else d
        few = few.filter("id < 40") if q == 1 else few
        ids = [i for i, _ in rows if q != 1 or i < 40]
        want = {i: sorted((-round(s[i, j], 12), j) for j in ids if j != i)[:3] for i, _ in rows if i % q == 0}
        for size in (64, 1 << 20):
            got = {}
            for r in V.similar(asked, few, 3, apart=True, round_bytes=size).collect():
                got.setdefault(r.query_id, []).append((r.place, r.id))
            assert {i: [j for _, j in sorted(x)] for i, x in got.items()} == {i: [j for _, j in x] for i, x in want.items()}
    pairs = {(i, j) for i in range(130) for j in range(i + 1, 130) if s[i, j] >= 0.9}
    for pivots, block in ((1, 4096), (8, 10), (32, 4096)):
        got = [(r.query_id, r.id) for r in V.paired(d, 0.9, pivots=pivots, block=block).collect()]
        assert sorted(got) == sorted(pairs)
    assert V.paired(d.limit(0), 0.5).count() == 0 and V.similar(d.limit(0), d, 3).count() == 0 and V.similar(d, d.limit(0), 3).count() == 0


def test_blocks_that_cannot_reach_each_other_do_not_meet(spark):
    """Groups far apart: pairs of blocks grow with the rows, not with their square."""
    rng = np.random.default_rng(9)
    counts = []
    for n in (400, 1600):
        centres = np.eye(16)
        rows = [(i, (centres[i % 16] + rng.normal(scale=0.02, size=16)).tolist()) for i in range(n)]
        d = spark.createDataFrame(rows, "id long, v array<double>")
        blocks, pivots = V.clustered(d, 64, n)
        counts.append(V.block_pairs(blocks, pivots, 0.9).count())
        assert counts[-1] <= 64 * 64 // 8 + 64
    assert counts[1] <= 2 * counts[0]


def test_admission_in_arrival_order(spark):
    a = math.radians
    c = spark.createDataFrame([(i, [math.cos(a(d)), math.sin(a(d))]) for i, d in enumerate([0, 20, 40, 60, 200])], "id long, v array<double>")
    store = spark.createDataFrame([(9, [math.cos(a(200)), math.sin(a(200))])], "id long, v array<double>")
    got = {r.id: r.refused for r in V.admissions(c, store, 0.9).collect()}  # 0.9: within 25 degrees
    assert got == {0: False, 1: True, 2: False, 3: True, 4: True}


def test_relevance_sends_on_what_can_stay(spark, monkeypatch):
    """A prompt's best notes are those of a full scoring, in stages too, and no step writes more than its candidates for each prompt."""
    monkeypatch.setattr(I, "BUCKET", 8)
    rng = random.Random(4)
    n = made_notes(spark, rng, range(1500)).union(made_notes(spark, random.Random(4), range(1500, 1600)))
    index = I.indexed(n)
    asked = [(i, w, False, 0) for i in range(12) for w in rng.sample(["vault", "ind", "note", "graphs", "tag", "cacheed", "tager", "zebra", "noteing"], 5)]
    terms = spark.createDataFrame(asked, "query_id long, term string, exact boolean, n_terms int")
    live = n.filter("id % 17 <> 0").select("id")
    want = sorted((r.query_id, r.id, round(r.score, 9)) for r in S.scored(terms, index, live, 40).collect())
    for first in (1, 100):
        assert sorted((r.query_id, r.id, round(r.score, 9)) for r in S.best_of_any(terms, index, live, 40, first_groups=first).collect()) == want
    written, before = {}, S.materialize

    def counted(df, what="step"):
        out = before(df, what)
        written[what] = max(written.get(what, 0), out.count())
        return out

    monkeypatch.setattr(S, "materialize", counted)
    prompts = spark.createDataFrame([(i, " ".join(t for q, t, _, _ in asked if q == i)) for i in range(12)], "prompt_id long, prompt string")
    S.relevant(prompts, n, max_df=1.0, mass=0.1).count()
    assert max(written.get(w, 0) for w in ("scored", "best", "hit")) <= 12 * S.CANDIDATES


def test_admission_writes_no_pairs(spark, monkeypatch):
    """One large group of copies, and groups that chain: the same as one by one, and no table has more rows than there are candidates."""
    rng = np.random.default_rng(3)
    rows = np.vstack([np.tile(rng.normal(size=4), (150, 1)), rng.normal(size=(150, 4)), np.zeros((2, 4))])
    rows = rows[rng.permutation(len(rows))]
    u = V.unit(rows)
    written, before = [], V.materialize

    def counted(df, what="step"):
        out = before(df, what)
        written.append(out.count())
        return out

    monkeypatch.setattr(V, "materialize", counted)
    for held, piece in (([], {}), (range(5), {"piece_bytes": 8 * 4 * 90})):
        own = [i for i in range(len(rows)) if i not in held]
        d = [spark.createDataFrame([(i, rows[i].tolist()) for i in some], "id long, v array<double>") for some in (own, held)]
        taken: list[int] = []
        for i in own:
            if all(u[i] @ u[j] < 0.8 for j in [*held, *taken]):
                taken.append(i)
        written.clear()
        got = {r.id for r in V.admissions(*d, 0.8, **piece).collect() if not r.refused}
        assert got == set(taken)
        assert max(written) <= len(own)


def test_best_of_a_row_with_ties():
    score = np.array([[0.1, 0.30049999, 0.3005, 0.3001, 0.3], [0.2, 0.2, 0.2, -np.inf, 0.2]])
    top, ids = V.first(score, np.array([9, 8, 7, 6, 5]), 2, 3)
    whole = np.lexsort((np.broadcast_to([9, 8, 7, 6, 5], score.shape), -np.round(score, 3)), axis=1)[:, :2]
    assert ids.tolist() == np.array([9, 8, 7, 6, 5])[whole].tolist() and top.tolist() == np.take_along_axis(score, whole, 1).tolist()


def test_shell_segments():
    assert C.segments("sudo FOO=1 git push && echo 'a && b' | wc -l") == ["git push", "echo 'a && b'", "wc -l"]
    assert C.segments("make 2>&1 & tail -f x") == ["make 2>&1", "tail -f x"]
    assert C.segments("cat <<'EOF'\nrm -rf /\nEOF\nls") == ["cat <<'eof'", "ls"]
    assert C.drop_heredocs("cat <<A\nx") == "cat <<A\nx"
    assert C.segments('echo "a;b\\"c" $(date)') == ['echo "a;b\\"c"', "date)"]


def test_triggers_have_to_be_rare(spark):
    note = spark.createDataFrame([(1, "N", "use `git push --force` and `rare cmd` not drop table")], "id long, title string, content string")
    corpus = spark.createDataFrame([(f"s{i % 40}", "git push --force" if i % 40 < 3 else "rare cmd x" if i == 39 else "ls -la") for i in range(520)], "session string, command string")
    p = C.proposals(spark.createDataFrame([(1, "git push"), (1, "rare cmd"), (1, "drop table")], "id long, proposal string")).withColumn("pinned", F.lit(False))
    assert [(r.parts, r.hits, r.sessions) for r in C.vetted(p, note, corpus).collect()] == [(["rare cmd"], 1, 1)]


def test_chunks_and_transcripts(spark):
    d = spark.createDataFrame([(1, "".join(chr(97 + i % 26) for i in range(250)))], "id long, text string")
    assert [r.pos for r in R.chunks(d, 10).orderBy("pos").collect()] == [0, 1, 2, 3, *range(9, 25)]
    raw = '{"type":"user","message":{"content":"hi"}}\n{bad\n{"type":"assistant","isSidechain":true,"message":{"content":"no"}}\n{"type":"assistant","message":{"content":[{"type":"text","text":"yes"},{"type":"tool_use"}]}}\n{"type":"user","message":{"content":"<system-reminder>x"}}\n{"payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"more"}]}}'
    f = spark.createDataFrame([("a", raw), ("b", "{bad\nworse")], "path string, text string")
    got = {r.path: r.text for r in R.transcript_text(f).collect()}
    assert got == {"a": "USER: hi\n\nASSISTANT: yes\n\nUSER: more"}


def test_dates_are_stated(spark):
    cases = [("on 2026/7/28", True), ("July 28th", True), ("28th of July", True), ("7/28", True), ("Jul. 28", True), ("July 2", False), ("17/28 x", False), ("", False)]
    rows = spark.createDataFrame(cases, "t string, want boolean")
    assert rows.filter(R.date_stated(F.col("t"), F.lit("2026-07-28")) != F.col("want")).count() == 0


FILLER = "The release notes were reviewed by the on-call engineer during the handover. A dashboard panel was added for queue depth in the same afternoon. The runbook now links to the escalation policy for paging. Someone renamed the staging bucket without telling anyone. The weekly report was posted late again. "
LIMIT = "The write cache is safe only when writes are single-threaded."


def packed(spark, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.c for r in d.select("id", R.packed(F.col("text")).alias("c")).orderBy("id").collect()]


def test_sentences_are_packed(spark):
    fused = "The team spent the morning triaging billing alerts after a spike in webhook retries. Most of the retries turned out to be a benign side effect of a provider maintenance window. Production Metronome configuration points at sandbox Metronome. This is temporary and tracked by TICKET-42 for revert."
    wide = f"The {'very ' * 30}long claim sentence points at the sandbox. This is temporary and tracked by TICKET-42 for revert."
    many = " ".join(f"The write cache is safe only when partition {i} is quiescent." for i in range(12))
    out = packed(spark, "", "a. b.", "x" * 4000, fused, wide, f"The write cache is safe. {FILLER}{FILLER}{LIMIT}", f"The deployment cache was cleared on Tuesday. {FILLER}{FILLER}{LIMIT}", f"The write cache is safe. {FILLER}{many}", "A b c. " * 300)
    assert out[0] == [""] and out[1] == ["a. b."]
    assert len(out[2]) == 8 and "".join(out[2]) == "x" * 4000
    home = [i for i, c in enumerate(out[3]) if "Production Metronome" in c]
    assert len(out[3]) == 2 and home == [i for i, c in enumerate(out[3]) if "This is temporary" in c]
    assert all("very long" not in c or "This is temporary" not in c for c in out[4])
    claim = [i for i, c in enumerate(out[5]) if LIMIT in c]
    assert claim == [0, len(out[5]) - 1] and len(out[5]) > 2
    assert [i for i, c in enumerate(out[6]) if LIMIT in c] == [len(out[6]) - 1]
    assert len(out[7]) <= 8 and max(map(len, out[7])) <= 2 * 250 + 120
    assert len(out[8]) <= 8


def test_chunks_know_their_neighbours(spark):
    d = spark.createDataFrame([(1, FILLER * 2), (2, None), (3, "short.")], "id long, text string")
    rows = sorted(map(tuple, R.sentence_chunks(d).collect()))
    first = [r for r in rows if r[0] == 1]
    assert [r[1] for r in first] == list(range(len(first))) and len(first) > 1
    assert all(a[4] == b[2] and b[3] == a[2] for a, b in zip(first, first[1:]))
    assert first[0][3] is None and first[-1][4] is None and [r[2] for r in rows if r[0] == 3] == ["short."]


def test_tokens_that_begin_like_asked_words(spark):
    """Stems of words and joined neighbours that begin with a head are those of all words, no others, and facts are judged alike."""
    text = "The gateways were deployed. Deploy gate way; es deployment ab abc #12 runs: Abcdef ghi"
    heads = ["gat", "dep", "ab"]
    row = spark.createDataFrame([(text, heads)], "t string, h array<string>").select(R.text_tokens(F.col("t")).alias("all"), R.text_tokens(F.col("t"), F.col("h")).alias("some")).first()
    assert sorted(row.some) == sorted(x for x in row["all"] if x[:3] in heads) and 3 < len(row.some) < len(row["all"])
    facts = spark.createDataFrame([(1, "gateway", "is", "deployed", None), (1, "gateway", "is", "gone", None), (1, "gateways", "is", None, None)], "doc_id long, subject string, predicate string, object string, valid_from string")
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    assert sorted((r.object or "", r.status) for r in R.grounded(facts, texts, F.lit("2024-01-01")).collect()) == [("", "skipped"), ("deployed", "kept"), ("gone", "skipped")]
