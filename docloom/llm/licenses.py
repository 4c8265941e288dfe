"""License scans by diagonal voting, in DataFrame functions only.

Every run of k consecutive words of a text (two, unless said) is hashed and
joined with the hashed runs of a fixed set of templates, from phrases to whole
licence texts. A hit votes for the diagonal ``place in the text - place in the
template``; a diagonal with all votes is a verbatim occurrence. Neighbouring
diagonals, which a missing or added word separates, are merged, and a span counts
when the merged diagonals cover enough of the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words once A-Z is in lower case.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases with their labels, as the scan's contract names them.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Opening words of common license notices and whole short licenses, with labels of their own.
NOTICES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("licensed under the apache license version 2 0", "apache-notice"),
    ("you may not use this file except in compliance with the license", "apache-notice"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-notice"),
    ("licensed under cc by", "cc-notice"),
    ("this work is licensed under a creative commons attribution", "cc-notice"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "mit-text",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd-text",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc-text",
    ),
]
#: Words that may be missing or added between merged diagonals, and the share of a template a span must cover.
GAP, COVER, GRAM = 2, 0.75, 2


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = GRAM) -> DataFrame:
    """(tid, label, exact, pairs, j, gram, gh): a row for each run of ``k`` words of each template."""
    rows = []
    for tid, (text, label) in enumerate([*phrases, *notices]):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template has {k} words or more")
        n = len(words) - k + 1
        rows += [(tid, label, tid < len(phrases), n, j, " ".join(words[j : j + k])) for j in range(n)]
    schema = "tid int, label string, exact boolean, pairs int, j int, t_gram string"
    return spark.createDataFrame(rows, schema).withColumn("gh", F.xxhash64("t_gram"))


def _runs(k: int) -> Column:
    """All runs of ``k`` words of the array ``w``, each joined by a space."""
    last = lambda n: F.slice("w", n, F.greatest(F.col("n_words") - n + 1, F.lit(0)).cast("int"))
    out = F.col("w")
    for n in range(2, k + 1):
        out = F.zip_with(F.slice(out, 1, F.greatest(F.col("n_words") - n + 1, F.lit(0)).cast("int")), last(n), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", phrases=PHRASES, notices=NOTICES, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(spans, rows): found spans, and the row table they refer to by ``rid``.

    ``spans`` has (rid, doc_id, n_words, tid, label, exact, place, last, verbatim,
    cover): one row for each group of merged diagonals, and one with a null
    ``tid`` for each text, so that texts without hits stay. ``verbatim`` lists
    the starts of whole occurrences. Templates may have any number of words, ``k``
    at least; their table has a row a word, is the same whatever the documents,
    and is broadcast.
    """
    t = F.broadcast(templates(docs.sparkSession, phrases, notices, k))
    words = F.array_remove(F.split(F.translate(text_of(text), UPPER, LOWER), APART, -1), "")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words.alias("w")).withColumn("n_words", F.size("w").cast("long"))
    pairs = rows.select("rid", "doc_id", "n_words", F.posexplode_outer(_runs(k)).alias("pos", "gram")).withColumn("h", F.xxhash64("gram"))
    # A diagonal has each place of a template once at most, so its votes are counted without a set.
    votes = (
        pairs.join(t, (F.col("h") == F.col("gh")) & (F.col("gram") == F.col("t_gram")), "left")
        .groupBy("rid", "doc_id", "n_words", "tid", "label", "exact", "pairs", (F.col("pos") - F.col("j")).alias("diagonal"))
        .agg(F.collect_list("j").alias("places"))
    )
    order = Window.partitionBy("rid", "tid").orderBy("diagonal")
    near = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) <= GAP, F.lit(False))
    merged = votes.withColumn("new", (~near).cast("int")).withColumn("span", F.sum("new").over(order))
    whole = F.when(F.size("places") == F.col("pairs"), F.col("diagonal"))
    spans = (
        merged.groupBy("rid", "doc_id", "n_words", "tid", "label", "exact", "pairs", "span")
        .agg(F.min("diagonal").cast("long").alias("place"), F.max("diagonal").cast("long").alias("last"), F.sort_array(F.collect_list(whole.cast("long"))).alias("verbatim"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"))
        .withColumn("cover", F.coalesce(F.col("covered") / F.col("pairs"), F.lit(0.0)))
        .drop("covered", "span", "pairs")
    )
    return spans, rows


def label(docs: DataFrame, text: str = "text", id_col: str = "doc_id", phrases=PHRASES, notices=NOTICES, cover: float = COVER, k: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row a text.

    Base results are the verbatim occurrences of ``phrases``; ``labels`` adds
    those of notices of which a span covers ``cover``. Score is the largest
    share of a template that a span covers. Null and empty texts have no words,
    empty labels, null first and last word and score 0. Repeated rows each get
    their row; an empty table gives an empty result; other columns are not read.
    """
    spans, _ = scan(docs, text, id_col, phrases, notices, k)
    base = F.col("exact") & (F.size("verbatim") > 0)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans.groupBy("rid", "doc_id", "n_words")
        .agg(
            F.coalesce(F.sum(F.when(F.col("exact"), F.size("verbatim"))), F.lit(0)).cast("long").alias("n_base"),
            F.min(F.when(base, F.element_at("verbatim", 1))).alias("first_word"),
            F.max(F.when(base, F.element_at("verbatim", -1))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(F.when(base | (~F.col("exact") & (F.col("cover") >= cover)), F.col("label"))).alias("labels"),
            F.max("cover").alias("score"),
        )
        .drop("rid")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return label(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _values() -> str:
    out = []
    for tid, (text, name) in enumerate([*PHRASES, *NOTICES]):
        w = text.split()
        out += [f"({tid}, '{name}', {str(tid < len(PHRASES)).lower()}, {len(w) - 1}, {j}, '{w[j]} {w[j + 1]}')" for j in range(len(w) - 1)]
    return ", ".join(out)


ORACLE = rf"""
WITH t(tid, label, exact, pairs, j, gram) AS (VALUES {_values()}),
r AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, p - 1 AS pos, w[p] || ' ' || w[p + 1] AS gram FROM (SELECT rid, w, unnest(range(1, len(w))) AS p FROM r)),
v AS (SELECT rid, tid, label, exact, pairs, pos - j AS diagonal, list(j) AS places FROM p JOIN t USING (gram) GROUP BY ALL),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, tid ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS new FROM v),
s AS (SELECT *, sum(new) OVER (PARTITION BY rid, tid ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM m),
g AS (
  SELECT rid, tid, label, exact, span, len(list_distinct(flatten(list(places)))) / max(pairs) AS cover,
         count(*) FILTER (len(places) = pairs) AS n,
         min(diagonal) FILTER (len(places) = pairs) AS a, max(diagonal) FILTER (len(places) = pairs) AS b
  FROM s GROUP BY rid, tid, label, exact, span),
o AS (
  SELECT rid, sum(n) FILTER (exact) AS n_base, min(a) FILTER (exact) AS first_word, max(b) FILTER (exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND n > 0) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER ((exact AND n > 0) OR (NOT exact AND cover >= {COVER})) AS labels,
         max(cover) AS score
  FROM g GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM r LEFT JOIN o USING (rid)
"""
