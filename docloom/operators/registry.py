"""Document versions: checks, resolution of references, fingerprints and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import version_slug


def registry_errors(registry: DataFrame) -> DataFrame:
    """(document_id, problem): missing fields, repeated versions, more than one version in force."""
    missing = registry.where("document_id is null or version is null or title is null or trim(title) = ''").select("document_id", F.lit("missing field").alias("problem"))
    repeated = registry.groupBy("document_id", "version").agg(F.count("*").alias("n")).where("n > 1").select("document_id", F.lit("repeated version").alias("problem"))
    forced = registry.groupBy("document_id").agg(F.count_if("in_force").alias("n")).where("n > 1").select("document_id", F.lit("several in force").alias("problem"))
    return missing.unionByName(repeated).unionByName(forced)


def resolve(references: DataFrame, registry: DataFrame) -> DataFrame:
    """(ref, slug, status): an exact slug, else the only version, else the only one in force, else ambiguous or unknown."""
    r = registry.select("document_id", "version", "in_force", version_slug(F.col("document_id"), F.col("version")).alias("slug"))
    exact = references.join(r, F.col("ref") == F.col("slug")).select("ref", "slug", F.lit(1).alias("p"))
    stats = r.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if("in_force").alias("f"), F.min("slug").alias("only"), F.min(F.when(F.col("in_force"), F.col("slug"))).alias("forced"))
    by_id = references.join(stats, F.col("ref") == F.col("document_id")).select("ref", F.when(F.col("n") == 1, F.col("only")).when(F.col("f") == 1, F.col("forced")).alias("slug"), F.when(F.col("n") == 1, 2).when(F.col("f") == 1, 3).otherwise(4).alias("p"))
    best = exact.unionByName(by_id).withColumn("k", F.row_number().over(Window.partitionBy("ref").orderBy("p"))).where("k = 1").select(F.col("ref").alias("r_"), "slug", "p")
    status = F.when(F.col("p").isNull(), "unknown").when(F.col("p") == 4, "ambiguous").otherwise("resolved")
    return references.join(best, F.col("ref") == F.col("r_"), "left").select("ref", "slug", status.alias("status"))


def as_of(registry: DataFrame, day: str) -> DataFrame:
    """Versions whose validity holds a day: effective_from <= day < effective_to (null: open)."""
    d = F.lit(day).cast("date")
    return registry.where((F.coalesce("effective_from", d) <= d) & F.coalesce(F.col("effective_to") > d, F.lit(True)))


def fingerprint(rows: DataFrame, group: str, key: str, checksum: str, count: str | None = None) -> DataFrame:
    """(group, fingerprint, n): the same for the same set of (key, checksum, count), whatever the order.

    ``count`` is a document's number of chunks; a null checksum (a document that
    could not be read) counts as ``unreadable``.
    The digests of pairs are first combined by a bucket of the key, then over
    the sorted bucket digests, so no group's pairs meet in one row.
    """
    parts = [F.col(key).cast("string"), F.coalesce(checksum, F.lit("unreadable")), *([F.coalesce(F.col(count).cast("string"), F.lit(""))] if count else [])]
    pair = F.sha2(F.concat_ws("|", *parts), 256)
    bucket = F.substring(pair, 1, 2)
    first = rows.select(group, bucket.alias("b"), pair.alias("d")).groupBy(group, "b", F.substring("d", 3, 2).alias("b2")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("d"), F.count("*").alias("n"))
    return first.groupBy(group).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "b2", "d"))), lambda x: x["d"]), ","), 256).alias("fingerprint"), F.sum("n").alias("n"))


def probe(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted(key, ...)`` with value and hit; misses are to be computed."""
    return wanted.join(cache.select("key", "value", F.lit(True).alias("hit")), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
