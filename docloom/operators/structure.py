"""Statute structure: lines to units, as running positions of markers.

A heading of one level ends everything below it, so the state at a line is the
last position of each kind of marker: running maxima over the document's lines
replace a state machine. Documents are dealt to tasks by their key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import strip

# The shapes of headings and markers in statutes and in constitutions.
PART = r"^Part\s+([0-9]+|[IVXLCDM]+[A-Z]?)\s*[–—-]\s*(.*)$"
CHAPTER = r"^Chapter\s+([IVXLCDM]+[A-Z]?)$"
SECTION = r"^([0-9]{1,3}[A-Z]{0,2})\.\s*$"
SUBSECTION = r"^\(([0-9]+)\)$"
PARAGRAPH = r"^\(([a-z]{1,4})\)$"
SCHEDULE = r"^(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH)\s+SCHEDULE\b\s*(?:\[[^\]]*\])?\s*$"
HEADING_END, HEADING_LENGTH = r"[.;,:\-–—]$", 90
C_CHAPTER = r"(?i)^Chapter\s+(ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN|ELEVEN|TWELVE|THIRTEEN|FOURTEEN|FIFTEEN|SIXTEEN|SEVENTEEN|EIGHTEEN)$"
C_ARTICLE = r"^([0-9]{1,3})\.\s*$"
C_PARAGRAPH = r"^\(([a-z])\)$"
C_SCHEDULE = r"(?i)^(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH) SCHEDULE$"
REPEALED = r"^(repealed|deleted|spent)"
#: The line that ends a constitution's preamble, unless said.
PREAMBLE_END = "HERE"


def lines(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(key, pos, l, nx): non-blank stripped lines with the line that follows."""
    each = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\R")).alias("pos", "raw")).select(key, "pos", strip(F.col("raw")).alias("l")).where("l <> ''")
    return each.withColumn("nx", F.coalesce(F.lead("l").over(Window.partitionBy(key).orderBy("pos")), F.lit("")))


def _running(df: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """Last position (m_) and line (v_) of each kind, up to each line."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    made = {}
    for k in kinds:
        made[f"m_{k}"] = F.coalesce(F.max(F.when(F.col("kd") == k, F.col("pos"))).over(w), F.lit(-1))
        made[f"v_{k}"] = F.last(F.when(F.col("kd") == k, F.col("l")), ignorenulls=True).over(w)
        made[f"n_{k}"] = F.last(F.when(F.col("kd") == k, F.col("nx")), ignorenulls=True).over(w)
    return df.withColumns(made)


def _texts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Pieces of a unit in order; a marker is followed by its own lines."""
    piece = rows.groupBy(*by, "k1", "k2", "k3").agg(
        F.max(F.when(F.col("marker"), F.col("l"))).alias("mark"), F.array_sort(F.collect_list(F.when(~F.col("marker"), F.struct("pos", "l")))).alias("own"))
    line = F.concat_ws(" ", "mark", F.array_join(F.transform("own", lambda x: x["l"]), " "))
    return piece.withColumn("line", line).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k1", "k2", "k3", "line"))).alias("p")).withColumn("body", strip(F.array_join(F.transform("p", lambda x: x["line"]), "\n"))).drop("p")


def parse_acts(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(key, ordinal, unit_type, number, title, path, body): the sections of statutes.

    Parsing stops at the first schedule. Text before a subsection follows the
    subsections; a loose line that equals the title is dropped, and so are empty
    and repealed sections. An empty document has no units.
    """
    n = lines(docs, key, text).withColumn("cut", F.min(F.when(F.col("l").rlike(SCHEDULE), F.col("pos"))).over(Window.partitionBy(key)))
    n = n.where(F.col("cut").isNull() | (F.col("pos") < F.col("cut")))
    cross = F.col("nx").rlike(SECTION) & (F.length("l") < HEADING_LENGTH) & ~F.col("l").startswith("[") & ~F.col("l").rlike(HEADING_END) & ~F.col("l").rlike("^[0-9]+$")
    kd = F.when(F.col("l").rlike(PART), "part").when(F.col("l").rlike(CHAPTER), "chap").when(cross, "cross").when(F.col("l").rlike(SECTION), "sec").when(F.col("l").rlike(SUBSECTION), "sub").when(F.col("l").rlike(PARAGRAPH), "par").otherwise("txt")
    m = _running(n.withColumn("kd", kd), key, ["part", "chap", "sec", "sub", "par"])
    sa = (F.col("m_sec") > F.col("m_part")) & (F.col("m_sec") > F.col("m_chap"))
    ss = F.col("m_sub") > F.col("m_sec")
    sp = (F.col("m_par") > F.col("m_sub")) & ss
    marker = ((F.col("kd") == "sub") & ss) | ((F.col("kd") == "par") & ss)
    part = F.when(F.col("m_part") >= 0, F.concat(F.lit("Part "), F.regexp_extract("v_part", PART, 1)))
    chap = F.when((F.col("m_chap") > F.col("m_part")), F.concat(F.lit("Chapter "), F.regexp_extract("v_chap", CHAPTER, 1)))
    rows = m.where(sa & ~F.col("kd").isin("part", "chap", "cross", "sec")).withColumns({
        "number": F.regexp_extract("v_sec", SECTION, 1), "title": F.col("n_sec"), "part": part, "chapter": chap, "marker": marker,
        "k1": F.when(ss, 0).otherwise(1), "k2": F.when(ss, F.col("m_sub")).otherwise(F.col("pos")), "k3": F.when(sp, F.col("m_par")).otherwise(-1),
    }).where(F.col("marker") | (F.col("k1") == 0) | (F.col("l") != F.col("title")))
    units = _texts(rows, [key, "m_sec", "number", "title", "part", "chapter"])
    live = ~F.regexp_replace(F.lower(strip(F.col("title"))), r"^\[+", "").rlike(REPEALED)
    path = F.filter(F.array("part", "chapter", F.concat(F.lit("Section "), F.col("number"))), lambda x: x.isNotNull())
    return units.where(live & (F.col("body") != "")).select(
        key, F.row_number().over(Window.partitionBy(key).orderBy("m_sec")).alias("ordinal"), F.lit("section").alias("unit_type"), "number", "title", path.alias("path"), "body")


def parse_constitutions(docs: DataFrame, preamble_end: str = PREAMBLE_END, key: str = "doc", text: str = "text") -> DataFrame:
    """As :func:`parse_acts` for constitutions: chapters and articles after the line ``preamble_end``, then schedules, numbered as they stand, as units."""
    n = lines(docs, key, text).withColumn("from_", F.min(F.when(F.col("l") == preamble_end, F.col("pos"))).over(Window.partitionBy(key)))
    n = n.where(F.col("pos") > F.col("from_"))
    before = F.coalesce(F.lag("l").over(Window.partitionBy(key).orderBy("pos")), F.lit(""))
    n = n.withColumn("named", before.rlike(C_CHAPTER))  # a chapter's next line is its title, whatever it looks like
    kd = F.when(F.col("l").rlike(C_CHAPTER), "chap").when(F.col("named"), "name").when(F.col("l").rlike(C_SCHEDULE), "sched").when(F.col("l").rlike(C_ARTICLE), "sec").when(F.col("l").rlike(SUBSECTION), "sub").when(F.col("l").rlike(C_PARAGRAPH), "par").otherwise("txt")
    m = _running(n.withColumn("kd", kd), key, ["sched", "chap", "sec", "sub", "par"])
    m = m.withColumn("schedules", F.count_if(F.col("kd") == "sched").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    in_schedule = (F.col("m_sched") >= 0) & (F.col("m_sched") > F.col("m_chap"))
    sched = m.where(in_schedule & (F.col("kd") != "sched")).groupBy(key, "m_sched", "v_sched", "schedules").agg(F.array_sort(F.collect_list(F.struct("pos", "l"))).alias("p"))
    sched = sched.withColumn("body", strip(F.array_join(F.transform("p", lambda x: x["l"]), "\n"))).where("body <> ''")
    schedules = sched.select(key, F.col("m_sched").alias("at"), F.lit("schedule").alias("unit_type"), F.col("schedules").cast("string").alias("number"), F.col("v_sched").alias("title"), F.array("v_sched").alias("path"), "body")
    sa = (F.col("m_sec") > F.col("m_chap")) & (F.col("m_chap") >= 0) & ~in_schedule
    ss = F.col("m_sub") > F.col("m_sec")
    sp = (F.col("m_par") > F.col("m_sub")) & ss
    rows = m.where(sa & ~F.col("kd").isin("chap", "name", "sec", "sched")).withColumns({
        "number": F.regexp_extract("v_sec", C_ARTICLE, 1).cast("int").cast("string"), "title": F.col("n_sec"), "chapter": F.concat(F.lit("Chapter "), F.regexp_extract("v_chap", C_CHAPTER, 1)),
        "marker": F.col("kd").isin("sub", "par") & ss, "k1": F.when(ss, 0).otherwise(1), "k2": F.when(ss, F.col("m_sub")).otherwise(F.col("pos")), "k3": F.when(sp, F.col("m_par")).otherwise(-1),
    }).where(F.col("marker") | (F.col("k1") == 0) | (F.col("l") != F.col("title")))
    articles = _texts(rows, [key, "m_sec", "number", "title", "chapter"]).where("body <> ''")
    articles = articles.select(key, F.col("m_sec").alias("at"), F.lit("article").alias("unit_type"), "number", "title", F.array("chapter", F.concat(F.lit("Article "), F.col("number"))).alias("path"), "body")
    both = articles.unionByName(schedules)
    return both.select(key, F.row_number().over(Window.partitionBy(key).orderBy(F.col("unit_type") == "schedule", "at")).alias("ordinal"), "unit_type", "number", "title", "path", "body")


def sequence_gaps(found: DataFrame, key: str, number: str, upto: str) -> DataFrame:
    """(key, missing, repeated): numbers of 1 to the largest ``upto`` that lack, and those that occur more than once."""
    each = found.groupBy(key, F.col(number).alias("number_")).agg(F.count("*").alias("n_"), F.max(upto).alias("top_"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list("number_")).alias("have"), F.array_sort(F.collect_list(F.when(F.col("n_") > 1, F.col("number_")))).alias("repeated"), F.max("top_").alias("top")).select(
        key, F.array_except(F.sequence(F.lit(1), F.col("top").cast("int")), F.transform("have", lambda x: x.cast("int"))).alias("missing"), "repeated")


def count_errors(units: DataFrame, expected: DataFrame, key: str = "doc") -> DataFrame:
    """(key, unit_type, expected, found) of the counts that differ; ``expected`` has a row for each count to check."""
    found = units.groupBy(key, "unit_type").agg(F.count("*").alias("n_"))
    both = expected.join(found, [key, "unit_type"], "left").select(key, "unit_type", "expected", F.coalesce("n_", F.lit(0)).alias("found"))
    return both.where("expected <> found")
