"""Operator 3: WARC archives and their chunked record table.

`write_archives` turns pages into WARC/1.1 records (gzip files, one per task, written by Spark's text writer, whose line
end closes each record). A payload of more than `SEGMENT` characters is written in segments, as the format has it: the
record and, right behind it, `continuation` records that name it as their origin. `read_chunks` streams archives line by
line and follows segments: a payload leaves as rows (record, chunk number) of at most `chunk` bytes, each with the SHA-1 of
the payload so far. A line ends with its segment at the latest, so neither side holds more than a segment of a record,
whether the payload has line feeds or none.

Of records with equal payloads of at least 1000 bytes, those with the largest page_id are responses and others revisit
them; a revisit record has HTTP headers only and its payload's length and digest stand in its header fields, which
`archived` holds against the response that it read.

Nulls: a null html is an empty payload, a null url becomes `about:blank`; rows with null page_id come back with null and
are never preferred as response. Repeated rows stay rows (equal page_ids are all responses, or all revisits). An empty
table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

LEAST = 1000
CHUNK = 1 << 20
#: Characters of a payload that one record holds.
SEGMENT = 4 << 20
CRLF = "\r\n"
CHUNKS = "page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string, chunk_no long, n_bytes long, bytes_so_far long, digest_so_far string, last boolean"


def _record(page_id: Column, url: Column, piece: Column, size: Column, digest: Column, refers: Column, part: Column, parts: Column) -> Column:
    """A record, or a segment of one, without the line feed that the writer adds. `piece` is its share of a payload of `size` bytes."""
    none = F.lit("")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(CRLF * 2))
    revisit, later = refers.isNotNull(), part > 0
    block = F.when(later, 0).otherwise(F.octet_length(http)) + F.when(revisit, 0).otherwise(F.octet_length(piece))
    own = F.coalesce(page_id.cast("string"), F.lit("none"))
    line = lambda name, *x: F.concat(F.lit(f"{name}: "), *x, F.lit(CRLF))
    segment = F.concat(
        line("WARC-Segment-Number", (part + 1).cast("string")),
        F.when(later, line("WARC-Segment-Origin-ID", F.lit("<urn:x-page:"), own, F.lit(">"))).otherwise(none),
        F.when(part == parts - 1, line("WARC-Segment-Total-Length", (F.octet_length(http) + size).cast("string"))).otherwise(none),
    )
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(later, "continuation").when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.lit("<urn:x-page:"), F.when(later, F.concat(F.lit("segment-"), (part + 1).cast("string"), F.lit(":"))).otherwise(none), own, F.lit(">")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace(url, r"[\x00-\x20\x7f]", ""), F.lit("about:blank"))),
        F.when(later, none).otherwise(line("WARC-Payload-Digest", F.lit("sha1:"), digest)),
        F.when(parts > 1, segment).otherwise(none),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.lit("<urn:x-page:"), refers.cast("string"), F.lit(">")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(none),
        F.when(later, none).otherwise(line("Content-Type", F.lit("application/http; msgtype=response"))),
        line("Content-Length", block.cast("string")),
        F.lit(CRLF), F.when(later, none).otherwise(http), F.when(revisit, none).otherwise(piece), F.lit("\r\n\r"),
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Write one record for each page under `path`, in segments of `segment` characters."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha1("html"))
    large = rows.filter(F.octet_length("html") >= least)
    shared = large.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).filter("n > 1").select("digest", "latest")
    joined = rows.join(materialize(shared, "digests"), "digest", "left")
    refers = F.when((F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest"))
    parts = F.when(F.col("refers").isNotNull() | (F.octet_length("html") <= segment), 1).otherwise(F.ceil(F.length("html") / segment)).cast("int")
    cut = joined.withColumn("refers", refers).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    piece = F.when(F.col("parts") == 1, F.col("html")).otherwise(F.substring("html", F.col("part") * segment + 1, F.lit(segment)))
    value = _record(F.col("page_id"), F.col("url"), piece, F.octet_length("html"), F.col("digest"), F.col("refers"), F.col("part"), F.col("parts"))
    cut.select(value.alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


class _Reader:
    """Follows records and their segments through lines; `rows` gathers the chunks that are done."""

    def __init__(self, chunk: int, payload: bool):
        self.chunk, self.payload, self.rows = chunk, payload, []
        self.state, self.open = "end", False

    def line(self, line: bytes) -> None:
        if self.state == "block":
            self.block(line + b"\n")
        elif self.state == "fields":
            if line == b"\r":
                self.left = int(self.head.get(b"content-length", b"0"))
                if self.open and self.head.get(b"warc-segment-origin-id") == self.fields.get(b"warc-record-id"):
                    self.state = "block"
                    if not self.left:
                        self.finish()
                else:
                    self.close()
                    self.fields, self.http, self.state = self.head, {}, "http"
            else:
                k, _, v = line.partition(b":")
                self.head[k.strip().lower()] = v.strip()
        elif self.state == "http":
            self.left -= len(line) + 1
            if line == b"\r":
                self.sha, self.got, self.done, self.number, self.held = hashlib.sha1(), 0, 0, 0, []
                self.state, self.open = "block", True
                if not self.left:
                    self.finish()
            else:
                k, _, v = line.partition(b":")
                self.http[k.strip().lower()] = v.strip()
        elif line.startswith(b"WARC/"):
            self.state, self.head = "fields", {}

    def block(self, data: bytes) -> None:
        view = memoryview(data)[: self.left]
        self.left -= len(view)
        while len(view):
            if self.got == self.chunk:
                self.emit(False)
            part = view[: self.chunk - self.got]
            self.sha.update(part)
            if self.payload:
                self.held.append(bytes(part))
            self.got += len(part)
            view = view[len(part) :]
        if not self.left:
            self.finish()

    def finish(self) -> None:
        """At the end of a block: the record is whole, or its next segment follows."""
        self.state = "end"
        if b"warc-segment-number" not in self.fields or self.done + self.got >= int(self.http.get(b"content-length", b"0")):
            self.close()

    def close(self) -> None:
        if self.open:
            self.emit(True)
            self.open = False

    def emit(self, last: bool) -> None:
        f = self.fields
        urn = lambda x: int(x.rpartition(b":")[2].rstrip(b">")) if x and not x.endswith(b":none>") else None
        self.done += self.got
        row = (urn(f.get(b"warc-record-id")), f.get(b"warc-target-uri", b"").decode(), f.get(b"warc-type", b"").decode(), urn(f.get(b"warc-refers-to")), int(self.http.get(b"content-length", b"0")), f.get(b"warc-payload-digest", b"").decode().rpartition(":")[2], self.number, self.got, self.done, self.sha.copy().hexdigest(), last)
        self.rows.append((*row, b"".join(self.held)) if self.payload else row)
        self.number, self.got, self.held = self.number + 1, 0, []


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """Chunk rows of all records under `path`; without `payload`, all but the bytes."""
    schema = CHUNKS + ", chunk binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(chunk, payload)

        def out() -> pa.RecordBatch:
            columns = zip(*reader.rows) if reader.rows else [[]] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)
            reader.rows = []
            return batch

        for b in batches:
            for line in b.column(0):
                reader.line(line.as_py())
                if len(reader.rows) * (chunk if payload else 1000) > 64 << 20:
                    yield out()
            yield out()
        reader.close()
        yield out()

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(parse, schema)


def archived(pages: DataFrame, path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Write `pages` as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, and intact
    (the payload has the length and digest that its record declares; a revisit's response was read with the same ones)."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, segment=segment)
    done = materialize(read_chunks(spark, path, payload=False).filter("last").drop("url", "chunk_no", "n_bytes", "last"), "records")
    revisit = F.col("record_type") == "revisit"
    own = done.filter(~revisit).withColumn("intact", (F.col("bytes_so_far") == F.col("declared_bytes")) & (F.col("digest_so_far") == F.col("declared_digest")))
    own = own.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to", "intact")
    # only responses that are referred to meet the revisits, each once
    claims = done.filter(revisit).select("page_id", F.col("declared_bytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type", "refers_to")
    named = claims.select(F.col("refers_to").alias("page_id")).distinct()
    read = own.filter("page_id IS NOT NULL").join(named, "page_id", "left_semi").groupBy(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").agg(F.lit(True).alias("there"))
    checked = claims.join(materialize(read, "responses"), ["refers_to", "payload_bytes", "payload_digest"], "left")
    return own.unionByName(checked.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.coalesce("there", F.lit(False)).alias("intact")))
