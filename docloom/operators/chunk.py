"""Units to storable chunks, and checks on chunks and cleaned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

# Fields that every chunk has, and what cleaned text must not hold.
REQUIRED = ["chunk_id", "document_id", "document_type", "title", "jurisdiction", "language", "version", "effective_from", "effective_to", "in_force", "as_at", "source_name", "unit_type", "path", "content"]
FORBIDDEN = {
    "page markers": r"--- PAGE [0-9]+ ---",
    "heading of the contents": r"(?dm)^Contents$",
    "imprint of the publisher": r"Legislation as at",
    "dots before page numbers": r"(?dm)\.{5,}\s+[0-9]+\s*$",
    "fi ligature": "ﬁ",
    "fl ligature": "ﬂ",
    "ff ligature": "ﬀ",
    "ffi ligature": "ﬃ",
    "ffl ligature": "ﬄ",
}


def build_chunks(units: DataFrame, limit: int = T.MAX_CHUNK) -> DataFrame:
    """A row a part of each unit: chunk_id, point_id, citation, part, part_count, content.

    ``units`` has document_id, version, path and text; its other columns stay
    with each chunk. Units without text give no chunk.
    """
    parts = units.withColumn("parts_", T.split_text(F.coalesce("text", F.lit("")), limit)).withColumn("part_count", F.size("parts_"))
    each = parts.select(*[c for c in units.columns if c != "text"], "part_count", F.posexplode("parts_").alias("part", "content")).where(T.strip(F.col("content")) != "")
    each = each.withColumn("part", F.col("part") + 1)
    made = each.withColumn("chunk_id", T.chunk_id(F.col("document_id"), F.col("version"), F.col("path"), F.col("part"), F.col("part_count")))
    return made.withColumns({"point_id": T.point_id(F.col("chunk_id")), "citation": T.citation(F.col("path"))})


# The columns of a stored chunk, in order, and those that come from its document.
FIELDS = [
    "chunk_id", "document_id", "document_type", "title", "jurisdiction", "language", "version", "effective_from", "effective_to", "in_force", "as_at",
    "source_name", "source_url", "unit_type", "unit_number", "unit_title", "path", "citation", "part", "part_count", "content",
]
HEADER = ["document_type", "title", "jurisdiction", "language", "effective_from", "effective_to", "in_force", "source_name", "source_url"]


def chunk_rows(units: DataFrame, registry: DataFrame, as_at: Column, limit: int = T.MAX_CHUNK) -> DataFrame:
    """The stored row of each chunk: all of ``FIELDS``.

    ``units`` has document_id, version, unit_type, unit_number, unit_title, path
    and text; ``registry`` a row of ``HEADER`` for each document_id and version.
    ``as_at`` is the day of ingestion. Units of a document that the registry
    lacks keep null fields, which the checks of chunks tell.
    """
    chunks = build_chunks(units.select("document_id", "version", "unit_type", "unit_number", "unit_title", "path", "text"), limit)
    header = registry.select("document_id", "version", *HEADER)
    return chunks.join(header, ["document_id", "version"], "left").withColumn("as_at", as_at).select(*FIELDS)


def chunk_stats(chunks: DataFrame, by: str = "document_id") -> DataFrame:
    """Chunks, split chunks and the longest content of each group."""
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.count_if(F.col("part_count") > 1).alias("split_chunks"), F.max(F.length("content")).alias("longest"))


def chunk_errors(chunks: DataFrame, limit: int = T.MAX_CHUNK, required: list[str] = REQUIRED) -> DataFrame:
    """(check, bad): how many rows break each rule; a table without rows breaks ``rows``."""
    have = [c for c in required if c in chunks.columns]
    lacking = [c for c in required if c not in chunks.columns]
    missing = F.count_if(F.array_contains(F.array(*[F.col(c).isNull() for c in have if c not in ("effective_from", "effective_to")]), True)) if have else F.lit(0)
    row = chunks.agg(
        (F.count("*") == 0).cast("long").alias("rows"), (F.count("*") - F.countDistinct("chunk_id")).alias("duplicate_ids"),
        (F.countDistinct("chunk_id") - F.countDistinct("point_id")).alias("colliding_points"), (missing + F.lit(len(lacking)) * F.count("*")).alias("missing_fields"),
        F.count_if(T.strip(F.coalesce("content", F.lit(""))) == "").alias("empty_content"), F.count_if(F.length("content") > limit).alias("over_limit"), F.count_if(F.coalesce(F.size("path"), F.lit(0)) <= 0).alias("no_path"),
    )
    return row.unpivot([], row.columns, "check", "bad")


def text_errors(c: Column) -> Column:
    """What is wrong with a cleaned text, as a list of names."""
    found = [F.when(c.rlike(p), n) for n, p in FORBIDDEN.items()]
    found += [F.when(c.rlike(r"[\x00-\x08\x0B-\x1F]"), "control characters"), F.when(c.rlike(r"\n\s*\n\s*\n"), "blank lines")]
    return F.when(T.strip(c) == "", F.array(F.lit("empty"))).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))


def duplicates(df: DataFrame, *by: str) -> DataFrame:
    """Values that occur more than once, with their count."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def missing_markers(c: Column, markers: dict[str, str]) -> Column:
    """Names of the markers that a text lacks."""
    return F.filter(F.array(*[F.when(F.instr(c, m) == 0, n) for n, m in markers.items()]), lambda x: x.isNotNull())
