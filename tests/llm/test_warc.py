import gzip
import hashlib
import os

from noteloom.llm import warc as W

PAGES = [
    (1, "http://a/x", "é" * 600, "clash"), (2, "http://a/y", "é" * 600, ""), (3, None, "small", ""), (4, "http://b/ z\r\nX: y", "small", ""),
    (5, "u", None, ""), (6, "u", "", ""), (7, "u", "line\nends\r\n\r\nWARC/1.1\r\nx\r\n" * 90, ""), (None, "u", "é" * 600, ""), (8, "u", "\n", ""), (9, "u", "z" * 3_000_000, ""), (9, "u", "z" * 3_000_000, ""),
]
SCHEMA = "page_id long, url string, html string, digest string"


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, SCHEMA)
    got = W.archived(df, str(tmp_path / "w")).collect()
    assert len(got) == len(PAGES) and all(r.intact for r in got)
    want = {}
    for i, _, html, _ in PAGES:
        raw = (html or "").encode()
        same = [j for j, _, h, _ in PAGES if (h or "").encode() == raw and j is not None]
        response = len(raw) < 1000 or i == max(same)
        want[i] = (len(raw), hashlib.sha1(raw).hexdigest(), "response" if response else "revisit", None if response else max(same))
    for r in got:
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want[r.page_id]


def test_segments(spark, tmp_path):
    """Payloads with and without line feeds, cut at odd places, come back whole; the reader holds one segment at a time."""
    pages = [(1, "u", "é" * 5000), (2, "u", "x" * 5000), (3, "u", "ab\n" * 1500), (4, "u", "x" * 5000), (5, "u", "\r\n\r\nWARC/1.1\r\n" * 300), (6, "u", None), (None, "u", "y" * 1500), (7, "u", "z" * 1400)]
    df = spark.createDataFrame(pages, SCHEMA.rpartition(",")[0])
    for segment in (700, 100):
        path = str(tmp_path / f"w{segment}")
        got = W.archived(df, path, segment=segment).collect()
        assert len(got) == len(pages) and all(r.intact for r in got)
        want = {i: (h or "").encode() for i, _, h in pages}
        assert all((r.payload_bytes, r.payload_digest) == (len(want[r.page_id]), hashlib.sha1(want[r.page_id]).hexdigest()) for r in got)
        rows = W.read_chunks(spark, path, chunk=700).filter("record_type = 'response'").collect()
        by = {}
        for r in sorted(rows, key=lambda r: (r.page_id or 0, r.chunk_no)):
            by[r.page_id] = by.get(r.page_id, b"") + bytes(r.chunk)
            assert r.digest_so_far == hashlib.sha1(by[r.page_id]).hexdigest() and r.n_bytes <= 700
        assert by == {i: x for i, x in want.items() if i != 2}
    lines = spark.read.option("lineSep", "\n").text(path)
    assert lines.selectExpr("max(length(value))").first()[0] <= 700


def test_a_revisit_of_nothing_is_not_intact(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:2], SCHEMA)
    W.write_archives(df, str(tmp_path / "w"))
    rows = W.read_chunks(spark, str(tmp_path / "w"), payload=False)
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows.collect()} == {(2, "response", None), (1, "revisit", 2)}
    raw = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:3>\r\nWARC-Segment-Number: 1\r\nContent-Length: 24\r\n\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.gz").write_bytes(raw)
    r = W.read_chunks(spark, str(tmp_path / "cut")).collect()  # its second segment is missing
    assert [(x.page_id, x.n_bytes, x.declared_bytes, x.last) for x in r] == [(3, 3, 9, True)]


def test_files_are_warc(spark, tmp_path):
    W.write_archives(spark.createDataFrame(PAGES[:2], SCHEMA).coalesce(1), str(tmp_path / "w"))
    raw = b"".join(gzip.open(tmp_path / "w" / f).read() for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    records = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        assert rest[n : n + 4] == b"\r\n\r\n"
        raw = rest[n + 4 :]
        records += 1
    assert records == 2


def test_chunks_join_to_payloads(spark, tmp_path):
    df = spark.createDataFrame(PAGES[6:7], SCHEMA)
    W.write_archives(df, str(tmp_path / "w"))
    rows = sorted(W.read_chunks(spark, str(tmp_path / "w"), chunk=100).collect(), key=lambda r: r.chunk_no)
    payload = PAGES[6][2].encode()
    assert b"".join(bytes(r.chunk) for r in rows) == payload and all(r.n_bytes <= 100 for r in rows)
    for r in rows:
        assert r.digest_so_far == hashlib.sha1(payload[: r.bytes_so_far]).hexdigest()
    assert [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
    assert W.archived(df.limit(0), str(tmp_path / "none")).count() == 0
