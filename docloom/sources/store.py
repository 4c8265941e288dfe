"""A keyed store of results: a table bucketed by key, in which the last write of a key counts."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.stored import new_path, written

SCHEMA = "key STRING, value STRING, at BIGINT, proof STRING"


@dataclass(frozen=True)
class Store:
    """A store as this session's catalog knows it."""

    spark: SparkSession
    table: str
    path: str
    buckets: int


def _proof():
    """A digest of key, value and time: an entry whose proof differs is damaged."""
    return F.sha2(F.concat_ws("\x1f", "key", "value", F.col("at").cast("string")), 256)


def open_store(spark: SparkSession, path: str | None = None, buckets: int = 64) -> Store:
    """The store at ``path`` (a new one in the shared folder without it), made if there is none; ``buckets`` as it was made with."""
    path = path or new_path(spark, "store")
    name = f"store_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'")
    return Store(spark, name, path, buckets)


def append(store: Store, entries: DataFrame, at: int | None = None) -> None:
    """Add ``entries(key, value)`` to the buckets they belong to, by one write; older entries stay until :func:`compact`.

    ``at`` orders writes (nanoseconds now). Of one write's entries of a key the
    largest value counts. Null keys and values are not stored.
    """
    single = entries.where("key IS NOT NULL AND value IS NOT NULL").groupBy("key").agg(F.max("value").alias("value"))
    stamped = single.withColumn("at", F.lit(time.time_ns() if at is None else at))
    rows = stamped.withColumn("proof", _proof()).repartition(store.buckets, "key")
    rows.write.mode("append").format("parquet").bucketBy(store.buckets, "key").sortBy("key").option("path", store.path).saveAsTable(store.table)
    store.spark.catalog.refreshTable(store.table)


def current(store: Store) -> DataFrame:
    """(key, value): the last sound entry of each key. The table is read by bucket, so its rows are not shuffled."""
    sound = store.spark.table(store.table).where(F.col("proof") == _proof())
    return sound.groupBy("key").agg(F.max(F.struct("at", "value")).alias("last")).select("key", F.col("last.value").alias("value"))


def compact(store: Store, path: str | None = None) -> Store:
    """A new store that holds the current entries alone."""
    made = open_store(store.spark, path, store.buckets)
    append(made, current(store))
    return made


def through_store(wanted: DataFrame, store: Store, compute: Callable[[DataFrame], DataFrame], read: bool = True, write: bool = True) -> DataFrame:
    """``wanted(key, ...)`` with value and hit: what the store has, and what ``compute`` gives for the keys that it lacks.

    ``compute`` gets one row of each missing key (of several, that of the
    smallest other columns) and gives (key, value); it runs once, its results
    are stored, and it may leave keys out, whose value is then null. Damaged
    entries are misses, to be replaced. A null key is never stored: it is
    computed, once for all its rows. A failed write loses the entries, not the
    results. ``read`` off computes all, ``write`` off stores nothing.
    """
    others = [c for c in wanted.columns if c != "key"]
    one = wanted.groupBy("key").agg(F.min(F.struct(F.lit(0).alias("none_"), *others)).alias("r_")).select("key", *[F.col(f"r_.{c}").alias(c) for c in others])
    # Joined by bucket: only the wanted keys are shuffled.
    have = current(store) if read else current(store).limit(0)
    asked = written(one.join(have.withColumn("hit", F.lit(True)), "key", "left"), "asked")
    made = written(compute(asked.where("hit IS NULL").select(*wanted.columns)).select("key", F.col("value").cast("string").alias("value")).groupBy("key").agg(F.max("value").alias("value")), "made")
    if write:
        try:
            append(store, made)
        except Exception as failed:  # noqa: BLE001  results do not depend on the cache
            logging.getLogger(__name__).warning("the store at %s was not written: %s", store.path, failed)
    known = asked.where("hit").select("key", "value", "hit").unionByName(made.withColumn("hit", F.lit(False)))
    known = known.withColumnRenamed("key", "k_")
    return wanted.join(known, F.col("key").eqNullSafe(F.col("k_")), "left").select(*wanted.columns, "value", F.coalesce("hit", F.lit(False)).alias("hit"))
