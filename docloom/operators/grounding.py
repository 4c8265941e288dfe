"""Whether quotes support claims: normalisation, ordered search, and the refusal rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import BLANK, strip

# Limits of a quote, in characters and fragments.
MIN_QUOTE, MIN_FRAGMENT, MAX_FRAGMENTS = 40, 10, 3
# Characters that are compared as one.
DASHES = "‐‑‒–—―−"
SINGLE_QUOTES = "‘’‚‛"
DOUBLE_QUOTES = "“”„‟"
ENUMERATOR = r"\((?:[a-z]{1,3}|[ivxl]{1,6}|[0-9]{1,2})\)"
ELLIPSIS = r"\s*(?:\.\.\.+|…)\s*"


def nfkc(c: Column) -> Column:
    """Compatibility composition (NFKC) by the Unicode library that Spark carries; null stays null."""
    return F.when(c.isNotNull(), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)))


def casefold(c: Column) -> Column:
    """Full case folding by the Unicode library that Spark carries; null stays null."""
    return F.when(c.isNotNull(), F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True)))


def normalise_for_match(c: Column) -> Column:
    """What a comparison of quotes looks at: compatibility forms, dashes, quotes, enumerators, spacing and case set aside; all of it in the JVM."""
    return casefold(_plain(nfkc(c)))


def _plain(c: Column) -> Column:
    """Dashes, quotes, enumerators and spacing set aside."""
    c = F.translate(c, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + " ", "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + " ")
    c = F.replace(F.regexp_replace(c, ENUMERATOR, " "), F.lit("-"), F.lit(" - "))
    return F.btrim(F.regexp_replace(c, BLANK, " "))


def fragments(quote: Column) -> Column:
    """The stretches between ellipses, without the stops at their ends."""
    return F.filter(F.transform(F.split(quote, ELLIPSIS), lambda x: strip(F.regexp_replace(strip(x), r"[.;,:]+$", ""))), lambda x: x != "")


def needles(quote: Column) -> Column:
    """The fragments of a quote as they are searched for; null where their number or lengths rule the quote out."""
    parts = fragments(quote)
    sizes = F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x))
    fit = (F.size(parts) > 0) & (F.size(parts) <= MAX_FRAGMENTS) & (sizes >= MIN_QUOTE) & F.forall(parts, lambda x: F.length(x) >= MIN_FRAGMENT)
    return F.when(fit, F.transform(parts, normalise_for_match))


def in_order(found: Column, hay: Column) -> Column:
    """Whether all ``found`` fragments occur in ``hay``, each behind the one before; false for null."""
    rest = F.aggregate(
        found, hay.cast("string"),
        lambda s, x: F.when((x != "") & (F.instr(s, x) > 0), F.substr(s, F.instr(s, x) + F.length(x))),
    )
    return rest.isNotNull()


def supports(quote: Column, content: Column) -> Column:
    """Whether every fragment occurs in the content, in order, as :func:`normalise_for_match` sees them."""
    return in_order(needles(quote), normalise_for_match(content))


def verify(claims: DataFrame, sources: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """``claims(answer, pos, kind, text, chunk_id, quote)`` with ``failure``: null, unknown_source or unsupported_quote.

    ``sources(answer, chunk_id, content)`` are the passages that the answer was
    given; with ``passages(chunk_id, content)`` sources need only (answer,
    chunk_id). A passage is normalised once, before any claim meets it.
    """
    if passages is None:
        known = sources.select("answer", "chunk_id", normalise_for_match(F.col("content")).alias("hay_"), F.lit(True).alias("known_"))
    else:
        hay = passages.select("chunk_id", normalise_for_match(F.col("content")).alias("hay_"))
        known = sources.select("answer", "chunk_id").distinct().join(hay, "chunk_id").select("answer", "chunk_id", "hay_", F.lit(True).alias("known_"))
    joined = claims.withColumn("needles_", needles(F.col("quote"))).join(known, ["answer", "chunk_id"], "left")
    failure = F.when(F.col("known_").isNull(), "unknown_source").when(~F.coalesce(in_order(F.col("needles_"), F.col("hay_")), F.lit(False)), "unsupported_quote")
    return joined.withColumn("failure", failure).drop("hay_", "known_", "needles_")


def downgrade(verified: DataFrame, answers: DataFrame) -> DataFrame:
    """``answers(answer, sufficient)`` with kept, lost and refused: an answer with no more kept than lost statements is refused."""
    counts = verified.where("kind = 'statement'").groupBy("answer").agg(F.count_if(F.col("failure").isNull()).alias("kept"), F.count_if(F.col("failure").isNotNull()).alias("lost"))
    out = answers.join(counts, "answer", "left").withColumns({"kept": F.coalesce("kept", F.lit(0)), "lost": F.coalesce("lost", F.lit(0))})
    return out.withColumn("refused", F.col("sufficient") & (F.col("kept") <= F.col("lost"))).withColumn("sufficient", F.col("sufficient") & ~F.col("refused"))


def cited_order(verified: DataFrame) -> DataFrame:
    """(answer, chunk_id, rk): sources in the order of their first citation, statements before qualifications."""
    order = F.struct(F.when(F.col("kind") == "statement", 0).otherwise(1), "pos")
    first = verified.where(F.col("failure").isNull() & (F.col("chunk_id") != "")).groupBy("answer", "chunk_id").agg(F.min(order).alias("o"))
    return first.withColumn("rk", F.row_number().over(Window.partitionBy("answer").orderBy("o"))).drop("o")


#: Fields of a source as readers see it, each with the chunk's column it comes from.
SOURCE_FIELDS = {"chunk_id": "chunk_id", "document": "title"} | {c: c for c in ("document_type", "citation", "unit_title", "content", "version", "in_force", "as_at", "source_name", "source_url", "rerank_score")}


def source_of(columns: list[str]) -> Column:
    """A chunk's row as a source: ``title`` becomes ``document``; fields that the row lacks are null."""
    kinds = {"in_force": "boolean", "rerank_score": "double"}
    return F.struct(*[(F.col(c) if c in columns else F.lit(None).cast(kinds.get(name, "string"))).alias(name) for name, c in SOURCE_FIELDS.items()])


def cited_ids(statements: Column, qualifications: Column) -> Column:
    """Ids of the cited chunks in the order of their first citation, statements before qualifications."""
    return F.array_distinct(F.filter(F.transform(F.concat(statements, qualifications), lambda x: x["chunk_id"]), lambda x: F.coalesce(x, F.lit("")) != ""))


def response(intent: Column, answer: Column, sufficient: Column, statements: Column, qualifications: Column, ungrounded: Column, considered: Column) -> Column:
    """An answer as a reader gets it: texts of its qualifications, the sources it cites among those considered, and how many claims were dropped."""
    cited = cited_ids(statements, qualifications)
    return F.struct(
        intent.alias("intent"), answer.alias("answer"), sufficient.alias("sufficient"), statements.alias("statements"), F.transform(qualifications, lambda x: x["text"]).alias("qualifications"),
        F.filter(considered, lambda x: F.array_contains(cited, x["chunk_id"])).alias("sources"), considered.alias("considered"), F.size(ungrounded).alias("ungrounded_claims"))
