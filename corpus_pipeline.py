"""A corpus pipeline of five stages, each written as Parquet and read by the next.

Good documents stay, one of each group of near-duplicates stays, secrets are
masked, sources are mixed to their target weights, and the mix is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import jaccard, mixing, pieces, quality, secrets
from docloom.llm.common import drop_table, materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    model = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by similarity of word 5-grams."""
    return jaccard.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked and its length counted anew, where there is a column for it."""
    clean = secrets.redact(docs, net=secrets.fitted(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two times."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256, exact) of every row; lang and source where there are such columns.

    ``exact`` tells whether decoding gives the text back (it does unless the text
    holds U+2581, which stands for a space).
    """
    held = ["doc_id", *[c for c in ("lang", "source") if c in docs.columns]]
    back = pieces.round_trip(docs.select(*held, F.sha2(F.coalesce("text", F.lit("")), 256).alias("was"), "text"), keep=[*held, "was"])
    return back.select(*held, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("was")).alias("exact"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: Learned models decide in two stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: a row for each time the mix takes a document.

    Null and empty texts pass all stages; repeated rows are near-duplicates of
    each other but for empty ones, which all stay; an empty table gives an empty
    result; other columns of documents, whatever their names, reach the last
    stage, which leaves them. doc_id, text and source are needed. A stage's table goes once the next one is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        done = materialize(stage(spark, docs, sf_dir), name.split()[0])
        if k:
            drop_table(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
