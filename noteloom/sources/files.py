"""Readers of markdown notes, mixed files, transcripts, command corpora and fire logs; every schema is stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders and files of an editor's vault that hold no notes (fixed values).
IGNORED = r"(^|/)(\.obsidian|\.trash|\.git|node_modules|_templates)(/|$)"
#: Kinds of mixed files by extension; what is not text becomes a placeholder line.
KINDS = {"md": "markdown", "txt": "text", "json": "json", "csv": "csv", "log": "log", "html": "html", "yml": "config", "yaml": "config", "py": "code", "js": "code", "ts": "code", "sh": "code", "sql": "code", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image"}
BINARY = ("pdf", "image")

FIRE = T.StructType([T.StructField("ts", T.StringType()), T.StructField("session", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("command", T.StringType()), T.StructField("shown", T.BooleanType()), T.StructField("_corrupt_record", T.StringType())])


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every .md file below `root` that is not an editor's own.

    Spark's listing leaves out names that begin with _ or a dot; such notes have to be renamed on landing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(root)
    return files.filter(~F.col("path").rlike(IGNORED)).select("path", F.decode("content", "UTF-8").alias("content"), "modificationTime")


def mixed(files: DataFrame) -> DataFrame:
    """(path, name, kind, text) of files given as (path, content binary, length)."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    pairs = [x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))]
    kind = F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit("unknown"))
    placeholder = F.format_string("[%s file: %s, %d bytes]", kind, name, F.col("length").cast("long"))
    return files.select("path", name.alias("name"), kind.alias("kind"), F.when(kind.isin(*BINARY), placeholder).otherwise(F.decode("content", "UTF-8")).alias("text"))


def read_mixed(spark: SparkSession, root: str) -> DataFrame:
    return mixed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))


def transcripts(spark: SparkSession, root: str, since: str | None = None, until: str | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """(path, modified, text) of transcript files changed after `since` (S10) and, to leave those in use alone, before `until`."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    for key, at in (("modifiedAfter", since), ("modifiedBefore", until)):
        if at:
            reader = reader.option(key, at)
    return reader.load(root).select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def in_flight(modified: Column, now: Column, minutes: int = 30) -> Column:
    """Files that were touched so lately that their session may go on."""
    return modified > now - F.make_dt_interval(mins=F.lit(minutes))


def is_print_mode(text: Column) -> Column:
    """Transcripts of non-interactive runs, told by a key near their start."""
    return F.substring(text, 1, 65_536).rlike(r'"(entrypoint|promptSource)"\s*:\s*"(sdk-cli|sdk)"')


def command_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(session, command) of a TSV corpus, in lower case with single spaces."""
    parts = F.split("value", "\t", 2)
    command = F.trim(F.regexp_replace(F.lower(F.try_element_at(parts, F.lit(2))), r"\s+", " "))
    return spark.read.text(path).select(parts[0].alias("session"), command.alias("command")).filter("command <> ''")


def fire_log(spark: SparkSession, glob: str) -> DataFrame:
    """Logged fires; lines that are no JSON objects are left out."""
    rows = spark.read.schema(FIRE).json(glob)
    return rows.filter("session IS NOT NULL AND doc_id IS NOT NULL").drop("_corrupt_record")
