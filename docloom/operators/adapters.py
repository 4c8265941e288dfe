"""What differs between documents as data: cleaning patterns by document, parsers by type, encoders and caches by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import structure
from docloom.sources.stored import written

#: Parsers by document type: functions of (docs, key, text) that give units. More are added by assignment.
PARSERS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {
    "act": lambda docs, key, text: structure.parse_acts(docs, key, text),
    "constitution": lambda docs, key, text: structure.parse_constitutions(docs, structure.PREAMBLE_END, key, text),
}


def clean_by_document(docs: DataFrame, specs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """``docs`` with ``clean``: every step of :func:`docloom.functions.text.clean` by the document's own patterns.

    ``specs`` has (key, start, end, header), patterns or null for none; a
    document without a row is cleaned without patterns. A pattern that its text
    lacks gives a null ``clean`` and names itself in ``error``.
    """
    both = docs.join(specs.select(key, F.col("start").alias("start_"), F.col("end").alias("end_"), F.col("header").alias("header_")), key, "left")
    t = F.coalesce(F.col(text), F.lit(""))
    at = F.when(F.col("start_").isNull(), 1).otherwise(F.regexp_instr(t, F.col("start_")))
    both = both.withColumn("t_", F.when(at > 0, F.substr(t, at)))
    stop = F.when(F.col("end_").isNull(), F.length("t_") + 1).otherwise(F.regexp_instr(F.col("t_"), F.col("end_")))
    error = F.when(F.col("t_").isNull(), "no start marker").when(stop == 0, "no end marker")
    both = both.withColumn("error", error).withColumn("t_", F.when(stop > 0, F.substr(F.col("t_"), F.lit(1), stop - 1)))
    bare = T.remove_page_markers(T.remove_footer_numbers(F.col("t_")))
    bare = F.when(F.col("header_").isNull(), bare).otherwise(F.regexp_replace(bare, F.col("header_"), F.lit("")))
    both = both.withColumn("t_", bare)
    done = F.concat(T.strip(T.normalise_lines(T.join_hyphenated(T.normalise_unicode(F.col("t_"))))), F.lit("\n"))
    return both.withColumn("clean", F.when(F.col("error").isNull(), done)).drop("start_", "end_", "header_", "t_")


def parse_by_type(docs: DataFrame, kind: str = "document_type", key: str = "doc", text: str = "text", parsers: dict | None = None) -> DataFrame:
    """Units of all documents, each by the parser of its type; a type without one is an error that names those there are."""
    parsers = PARSERS if parsers is None else parsers
    names = sorted(parsers)
    known = F.when(F.col(kind).isin(names), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("no parser for "), F.coalesce(F.col(kind).cast("string"), F.lit("null")), F.lit(f"; there are {', '.join(names)}"))))
    sure = docs.select(F.col(key), F.col(text), known.alias("kind_"))
    out = None
    for name in names:
        own = parsers[name](sure.where(F.col("kind_") == name).select(key, text), key, text)
        out = own if out is None else out.unionByName(own)
    return out


def encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """A column function that gives the vectors of texts.

    ``load`` runs once in each task and gives the model, a function of a list of
    texts; it gets whole Arrow batches. Null is the empty text.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(texts.fillna("").tolist()), float)), index=texts.index)

    return encode


def index_chunks(chunks: DataFrame, encode: Callable[[Column], Column], document: Column, title: Column, cited: Column) -> DataFrame:
    """``chunks`` with the vector of each content under its document's title and heading, ready to be stored."""
    return chunks.withColumn("vector", encode(T.contextual_text(document, T.heading(title, cited), F.coalesce("content", F.lit("")))))


def through_cache(wanted: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], read: bool = True, write: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results, new entries) of ``wanted(key, ...)``: values of the cache, and computed ones for the keys it lacks.

    ``compute`` gets one row of each missing key (of several, that of the smallest
    other columns), runs once, and gives (key, value). Of several entries of a
    key in the cache, or made, the one of the largest value counts. A null key is
    a key like others. ``read`` off computes all; ``write`` off gives no entries.
    Results have (key, value, hit), a row a wanted row.
    """
    others = [c for c in wanted.columns if c != "key"]
    keys = wanted.groupBy("key").agg(F.min(F.struct(F.lit(0).alias("none_"), *others)).alias("r_")).select("key", *[F.col(f"r_.{c}").alias(c) for c in others])
    single = lambda df: df.groupBy("key").agg(F.max("value").alias("value"))
    have = single(cache) if read else single(cache).limit(0)
    missing = keys.join(have.select(F.col("key").alias("k_")), F.col("key").eqNullSafe(F.col("k_")), "left_anti")
    made = written(single(compute(missing)), "made")
    every = have.withColumn("hit", F.lit(True)).unionByName(made.withColumn("hit", F.lit(False))).withColumnRenamed("key", "k_")
    found = wanted.select("key").join(every, F.col("key").eqNullSafe(F.col("k_")), "left")
    return found.select("key", "value", F.coalesce("hit", F.lit(False)).alias("hit")), made if write else made.limit(0)


def cache_counts(results: DataFrame) -> DataFrame:
    """(hits, misses) of :func:`through_cache`."""
    return results.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
