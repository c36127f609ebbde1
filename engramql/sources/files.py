"""File sources: transcripts, Markdown vaults, memory folders and project documents.

Files are read with the binary source (whole files in parallel, recursive,
newer than a cursor) and parsed with built-in expressions.  A cursor is the
largest modification time of what was read; it is committed by the caller after
the append, so a failed run is repeated and the idempotent append drops what
came through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramql.config import DEFAULT
from engramql.functions import scalars as S
from engramql.functions.parsing import heading_sections
from engramql.functions.text import stripped

# Line forms of transcripts.
SPEAKER_LINE = r"(?d)^([A-Z][\w .'-]{0,40}):\s*(.*)$"
VTT_TIMING = r"^\d{2}:\d{2}"
VTT_VOICE = r"^<v\s+([^>]+)>(.*?)(?:</v>)?$"


def read_files(spark: SparkSession, folder: str, patterns: str = "*.{md,txt,vtt}", after_ms: int | None = None, skip: str | None = None) -> DataFrame:
    """(path, name, modified_ms, content) of files below ``folder`` newer than the cursor."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", patterns).load(folder)
    files = raw.where(F.unix_millis("modificationTime") > after_ms) if after_ms is not None else raw
    if skip:
        files = files.where(~F.col("path").rlike(skip))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.unix_millis("modificationTime").alias("modified_ms"), F.decode("content", "UTF-8").alias("content"))


def cursor(files: DataFrame) -> int | None:
    return files.agg(F.max("modified_ms")).first()[0]


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "raw")).withColumn("line", F.trim("raw"))


def speaker_turns(files: DataFrame) -> DataFrame:
    """(path, turn, speaker, text) of .txt and .md transcripts.

    A line 'Name: text' opens a turn, other lines continue it, text before the
    first one is Unknown's; blank lines and empty turns are dropped.
    """
    lines = _lines(files).withColumn("speaker", F.regexp_extract("raw", SPEAKER_LINE, 1)).withColumn("opens", F.col("speaker") != "")
    w = Window.partitionBy("path").orderBy("line_no")
    body = F.when(F.col("opens"), F.trim(F.regexp_extract("raw", SPEAKER_LINE, 2))).otherwise(F.col("line"))
    turned = lines.withColumn("turn", F.sum(F.col("opens").cast("int")).over(w)).withColumn("body", body)
    grouped = turned.groupBy("path", "turn").agg(
        F.max("speaker").alias("speaker"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("line_no", "body")))), lambda x: x["body"]), "\n").alias("text"),
    )
    return grouped.where("text <> ''").select("path", "turn", F.when(F.col("speaker") == "", "Unknown").otherwise(F.col("speaker")).alias("speaker"), "text")


def caption_turns(files: DataFrame) -> DataFrame:
    """(path, turn, speaker, text) of WebVTT captions; lines without a speaker are dropped."""
    lines = _lines(files).where((F.col("line") != "") & (F.col("line") != "WEBVTT") & ~F.col("line").rlike(VTT_TIMING) & ~F.col("line").rlike(r"^\d+$"))
    voice = F.trim(F.regexp_extract("line", VTT_VOICE, 1))
    plain = F.regexp_extract("line", SPEAKER_LINE, 1)
    spoken = lines.select(
        "path", F.col("line_no").alias("turn"), F.when(voice != "", voice).otherwise(plain).alias("speaker"),
        F.trim(F.when(voice != "", F.regexp_extract("line", VTT_VOICE, 2)).otherwise(F.regexp_extract("line", SPEAKER_LINE, 2))).alias("text"),
    )
    return spoken.where("speaker <> ''")


def note_chunks(files: DataFrame, most: int = DEFAULT.max_content_bytes) -> DataFrame:
    """(path, chunk, text): a note whole if it fits, else one part per level-one or level-two heading."""
    sections = F.when(F.octet_length("content") <= most, F.array("content")).otherwise(heading_sections(F.col("content")))
    return files.select("path", F.posexplode(sections).alias("chunk", "text")).where(F.trim("text") != "")


def external_ids(parts: DataFrame, folder: str) -> DataFrame:
    """Parts with (external_id): path below the folder and a digest of the text."""
    rel = F.regexp_replace("path", r"^(?:file:)?/*" + folder.strip("/").replace(".", r"\."), "")
    return parts.withColumn("external_id", S.content_external_id(F.regexp_replace(rel, "^/", ""), F.col("text")))


def memory_files(files: DataFrame, skip_stems: tuple[str, ...] = (), tracker_stems: tuple[str, ...] = ()) -> DataFrame:
    """Memory files of project folders named '-Users-<user>-<project>': cwd, project, external id and what is left out."""
    folder = F.regexp_extract("path", r"/(-(?:Users|home)-[^/]+)/memory/[^/]+$", 1)
    parts = [F.regexp_extract(folder, r"^-(Users|home)-([^-]+)-(.+)$", i) for i in (1, 2, 3)]
    stem = F.lower(F.regexp_replace("name", r"(?i)\.md$", ""))
    reason: Column = F.when(F.lower("name") == "memory.md", "memory-index")
    if skip_stems:
        reason = reason.when(stem.isin(*skip_stems), "policy-bundle")
    if tracker_stems:
        reason = reason.when(stem.isin(*tracker_stems), "tracker")
    found = files.withColumn("project", parts[2]).where("project <> ''")
    return found.select(
        "path", "name", "project", F.concat(F.lit("/"), parts[0], F.lit("/"), parts[1], F.lit("/"), parts[2]).alias("cwd"),
        F.concat_ws(":", F.lit("memory-import"), "project", "name").alias("external_id"), reason.alias("skip_reason"), "content",
    ).withColumn("scope", S.cwd_scope(F.col("cwd")))


def survey_lines(answers: DataFrame, most: int = 25) -> DataFrame:
    """(area, pos, text): at most ``most`` bullet lines of each area's answer; refusals give none."""
    lines = answers.select("area", F.posexplode(F.split("answer", r"\r?\n")).alias("line_no", "raw"))
    clean = lines.withColumn("text", F.trim(F.regexp_replace("raw", r"^\s*(?:[-*•]|\d+[.)])\s*", ""))).where("text <> ''")
    kept = clean.where(~F.lower("text").rlike("^(?:i'm sorry|i cannot|i can't|as an ai)"))
    w = Window.partitionBy("area").orderBy("line_no")
    return kept.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("area", "pos", "text")


def fingerprint(files: DataFrame) -> str:
    """State of a folder for a gate: the largest modification time and the number of files."""
    row = files.agg(F.max("modified_ms").alias("m"), F.count(F.lit(1)).alias("n")).first()
    return f"mtime:{row.m}:{row.n}"


def seed_nodes(files: DataFrame, salience: float = 0.1, confidence: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Nodes and 'links_to' edges of a first start from Markdown notes.

    A note's paragraphs are claims; of equal claims the last by path wins, and
    [[links]] point to the claim of exactly that text.
    """
    kind = F.regexp_extract("content", r"(?s)^---.*?^type:\s*(\S+)", 1)
    paragraphs = files.select("path", kind.alias("note_type"), F.posexplode(F.split("content", r"\n\s*\n")).alias("pos", "raw"))
    claims = paragraphs.select("path", "pos", "note_type", stripped(F.col("raw")).alias("value")).where("value <> '' AND NOT startswith(value, '---')")
    claims = claims.withColumn("id", F.sha2(F.concat_ws("|", "path", "pos"), 256))
    by_value = claims.groupBy("value").agg(F.max_by("id", F.struct("path", "pos")).alias("id"))
    nodes = by_value.select("id", F.lit("fact").alias("type"), "value", F.sha2("value", 256).alias("value_hash"), F.lit(salience).alias("s"), F.lit(confidence).alias("c"))
    links = claims.select("value", F.explode(F.regexp_extract_all("value", F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1))).alias("target"))
    edges = links.join(by_value.select("value", F.col("id").alias("src")), "value").join(by_value.select(F.col("value").alias("target"), F.col("id").alias("dst")), "target")
    return nodes, edges.where("src <> dst").select("src", "dst", F.lit("links_to").alias("rel"), F.lit("relation").alias("kind")).distinct()
