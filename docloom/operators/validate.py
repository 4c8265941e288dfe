"""Expectations of documents as tables: what a text and its parsed units must hold.

A rule table has one row a document, so rules meet their document in one join and
are checked there on arrays; nothing is repeated for each rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources.stored import written

# Headings on lines of their own.
SECTION_LINE = r"(?dm)^([0-9]{1,3})\.[ \t]*$"
LETTERED_LINE = r"(?dm)^([0-9]{1,3}[A-Z]{1,2})\.[ \t]*$"
PART_LINE = r"(?dm)^(Part[ \t]+(?:[0-9]+|[IVXLCDM]+[A-Z]?)[ \t]*[–—-].*)$"
CHAPTER_LINE = r"(?dm)^(Chapter[ \t]+[IVXLCDM]+[A-Z]?)$"


def _listed(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def headings(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with what its lines number: sections (with repeats), lettered, parts and chapters (how many)."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    return docs.withColumns({
        "sections": F.array_sort(F.transform(found(SECTION_LINE), lambda x: x.cast("int"))), "lettered": found(LETTERED_LINE),
        "parts": F.size(found(PART_LINE)), "chapters": F.size(found(CHAPTER_LINE)),
    })


def text_problems(docs: DataFrame, rules: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(key, problem, detail) of the texts that break their document's rules.

    ``rules`` has (key, markers array<struct<name, marker>>, n_sections, want_lettered
    array<string>, n_parts, n_chapters, exempt array<int>): names of markers that
    the text holds, the highest section number, sections with letters, counts of
    divisions, and sections that are known to occur twice. An exempt section that
    does not is a problem of its own: its exemption excuses nothing. A null rule
    is not checked; a text without sections has that one problem about them.
    """
    h = headings(docs.select(key, text), text).join(rules, key)
    # Neighbours of a sorted array are compared in a step of their own, so that repeats cost one pass.
    h = h.withColumn("repeated", F.array_distinct(F.filter("sections", lambda x, i: F.when(i > 0, x == F.try_element_at("sections", i)).otherwise(False))))
    exempt = F.coalesce("exempt", F.array().cast("array<int>"))
    none, numbered = F.col("n_sections").isNotNull() & (F.size("sections") == 0), (F.col("n_sections") > 0) & (F.size("sections") > 0)
    missing = F.array_except(F.sequence(F.lit(1), F.greatest("n_sections", F.lit(1))), "sections")
    twice, stale = F.array_except("repeated", exempt), F.array_except(exempt, "repeated")
    letters = F.array_except("want_lettered", "lettered")
    absent = F.transform(F.filter("markers", lambda m: F.instr(F.coalesce(F.col(text), F.lit("")), m["marker"]) == 0), lambda m: m["name"])
    told = lambda name, when, detail: F.when(when, F.struct(F.lit(name).alias("problem"), detail.alias("detail")))
    counted = lambda want, have: F.concat(F.col(want).cast("string"), F.lit(" expected, "), F.col(have).cast("string"), F.lit(" found"))
    found = F.array(
        told("missing marker", F.size(absent) > 0, _listed(absent)), told("no sections", none, F.lit("")), told("missing section", numbered & (F.size(missing) > 0), _listed(missing)),
        told("repeated section", numbered & (F.size(twice) > 0), _listed(F.array_sort(twice))), told("stale exemption", numbered & (F.size(stale) > 0), _listed(F.array_sort(stale))),
        told("missing lettered section", F.size(letters) > 0, _listed(letters)), told("parts", F.col("n_parts") != F.col("parts"), counted("n_parts", "parts")),
        told("chapters", F.col("n_chapters") != F.col("chapters"), counted("n_chapters", "chapters")),
    )
    return h.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select(key, "p.problem", "p.detail")


def unit_problems(units: DataFrame, rules: DataFrame, key: str = "doc") -> DataFrame:
    """(key, problem, detail) of parsed documents that break their rules.

    ``units`` has (key, ordinal, unit_type, number, path); ``rules`` has (key,
    counts map<string,int> by unit type, want_numbers array<string>, depths
    array<int> of paths, part_order array<string>: the first steps of the paths in
    the order in which they first occur). A null rule is not checked. A document
    without units breaks each count and number that is asked for.
    """
    # Parsing comes before; written once, it isn't repeated for each of the three tables below.
    units = written(units.select(key, "ordinal", "unit_type", "number", "path"), "units")
    first = units.groupBy(key, F.try_element_at("path", F.lit(1)).alias("part")).agg(F.min("ordinal").alias("at"))
    order = first.where("part is not null").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]).alias("parts"))
    kinds = units.groupBy(key, "unit_type").agg(F.count("*").cast("int").alias("n"))
    counts = kinds.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("unit_type", "n"))).alias("have"))
    plain = units.groupBy(key).agg(F.collect_set("number").alias("numbers"), F.collect_list(F.size("path")).alias("sizes"))
    h = rules.join(counts, key, "left").join(plain, key, "left").join(order, key, "left")
    nothing = F.array().cast("array<string>")
    wanted = F.transform(F.array_sort(F.map_entries("counts")), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("want"), F.coalesce(F.try_element_at("have", x["key"]), F.lit(0)).alias("got")))
    off = F.transform(F.filter(wanted, lambda x: x["want"] != x["got"]), lambda x: F.concat(x["k"], F.lit(" "), x["got"].cast("string"), F.lit(" of "), x["want"].cast("string")))
    lacking = F.array_except("want_numbers", F.coalesce("numbers", nothing))
    deep = F.size(F.filter("sizes", lambda x: ~F.array_contains("depths", x)))
    told = lambda name, when, detail: F.when(when, F.struct(F.lit(name).alias("problem"), detail.alias("detail")))
    found = F.array(
        told("counts", F.size(off) > 0, F.array_join(off, ",")), told("missing number", F.size(lacking) > 0, F.array_join(lacking, ",")),
        told("path depth", F.col("depths").isNotNull() & (deep > 0), deep.cast("string")), told("part order", F.col("part_order").isNotNull() & (F.coalesce("parts", nothing) != F.col("part_order")), F.array_join(F.coalesce("parts", nothing), ",")),
    )
    return h.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select(key, "p.problem", "p.detail")


def parsed_answers(rows: DataFrame, raw: str, required: list[str]) -> DataFrame:
    """``rows`` with ``error``: why a model's JSON can't be used, or null: no object, or the required keys that it lacks."""
    keys = F.json_object_keys(F.col(raw))
    lacking = F.array_except(F.array(*[F.lit(k) for k in required]), keys)
    return rows.withColumn("error", F.when(keys.isNull(), "no JSON object").when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ","))))


# The keys of a model's answer, and those of its claims.
ANSWER_KEYS = ["sufficient", "question_type", "verdict", "statements", "qualifications", "missing"]
CLAIM_KEYS = ["text", "chunk_id", "quote"]


def _told(value: Column, as_string: Column) -> Column:
    """A JSON value as text without white space at its ends: strings as they are, others as they are written (True, False and None for their names)."""
    written = F.to_json(value)
    plain = F.when(written.startswith('"'), as_string).when(written == "true", "True").when(written == "false", "False").when(F.is_variant_null(value), "None").otherwise(written)
    return F.when(value.isNull(), "").otherwise(T.strip(plain))


def _truth(value: Column) -> Column:
    """Whether a JSON value counts as true: not false, null, zero or empty."""
    written = F.to_json(value)
    return ~(F.is_variant_null(value) | written.isin("false", '""', "[]", "{}") | written.rlike(r"^-?0(\.0+)?([eE][+-]?[0-9]+)?$"))


def answers_from_json(rows: DataFrame, raw: str) -> DataFrame:
    """``rows`` with the fields of a model's answer in column ``raw`` and ``error``.

    statements and qualifications are arrays of (text, chunk_id, quote), each
    coerced to text, absent ones empty; ``sufficient`` is what the value counts
    as. An answer that is no JSON object, lacks keys, or has claims that are no
    array of objects has an error and null fields.
    """
    rows = rows.withColumn("v_", F.try_parse_json(F.col(raw)))
    part = lambda name, kind="variant": F.try_variant_get("v_", f"$.{name}", kind)
    keys = F.json_object_keys(F.col(raw))
    lacking = F.array_except(F.array(*[F.lit(k) for k in ANSWER_KEYS]), keys)
    claim = lambda x: F.struct(*[_told(F.try_variant_get(x, f"$.{k}", "variant"), F.try_variant_get(x, f"$.{k}", "string")).alias(k) for k in CLAIM_KEYS])
    error = F.when(F.col("v_").isNull() | keys.isNull(), "no JSON object").when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ",")))
    for name in ("statements", "qualifications"):
        items = part(name, "array<variant>")
        error = error.when(items.isNull(), f"{name} is no array").when(F.exists(items, lambda x: ~F.coalesce(F.to_json(x), F.lit("null")).startswith("{")), f"a claim of {name} is no object")
    rows = rows.withColumn("error", error)
    sound = lambda c: F.when(F.col("error").isNull(), c)
    made = {
        "sufficient": sound(_truth(part("sufficient"))), "question_type": sound(_told(part("question_type"), part("question_type", "string"))), "verdict": sound(_told(part("verdict"), part("verdict", "string"))),
        "statements": sound(F.transform(part("statements", "array<variant>"), claim)), "qualifications": sound(F.transform(part("qualifications", "array<variant>"), claim)),
        "missing": sound(_told(part("missing"), part("missing", "string"))),
    }
    return rows.withColumns(made).drop("v_")


def known_only(rows: DataFrame, known: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with an id that ``known`` has, ids of ``rows`` that it lacks)."""
    ids = known.select(F.col(id_col).alias("known_")).distinct()
    same = F.col(id_col) == F.col("known_")
    return rows.join(ids, same, "left_semi"), rows.select(id_col).distinct().join(ids, same, "left_anti")


def first_k(rows: DataFrame, by: str, order: str, k: int = 5) -> DataFrame:
    """The first ``k`` of each group as they stand, without reranking."""
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("rank_") <= k).drop("rank_")
